"""Sorted pages, cursors and prefix searches."""

import base64
import json
from itertools import accumulate, pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import new_path


def ordering(key: str, descending: bool, ties: list[str]) -> list[Column]:
    """Empties last in both directions; ties by the other columns, ascending (SRT-02)."""
    return [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def page(rows: DataFrame, order: list[Column], offset: int, size: int, most: int = 200) -> DataFrame:
    """A page by offset, its rows numbered in ``rn`` from 1 over the whole order (SRT-03).

    A limit with a sort takes the best rows of every partition and merges them, so nothing is sorted whole.
    """
    size = max(1, min(size, most))
    first = rows.orderBy(*order).limit(offset + size)
    # At most offset + size rows are left to number.
    numbered = first.withColumn("rn", F.row_number().over(W.orderBy(*order)).cast("long"))
    return numbered.where(F.col("rn") > offset)


class Pages(NamedTuple):
    """A table in order, in ranges: the rows of each in a folder of its own, and how many rows stand before it."""

    rows: DataFrame
    before: list[int]

    @property
    def total(self) -> int:
        return self.before[-1]

    def page(self, offset: int, size: int, most: int = 200) -> DataFrame:
        """A page by offset, as ``page`` gives it; only the ranges that hold it are read."""
        size = max(1, min(size, most))
        held = [i for i, (a, b) in enumerate(pairwise(self.before)) if a < offset + size and b > offset]
        return self.rows.where(F.col("__range").isin(held) & F.col("rn").between(offset + 1, offset + size)).drop("__range")

    def ranked(self) -> DataFrame:
        """All rows with their rank."""
        return self.rows.drop("__range")


def pages(rows: DataFrame, order: list[Column], rows_a_range: int = 1 << 20) -> Pages:
    """``rows`` numbered in ``rn`` from 1 over the whole order, for pages at any depth (SRT-02, SRT-03, WIN-01).

    Rows are dealt out by ranges of the order, sorted within each and written, a folder a range; a rank is the place in
    the range and the number of rows in the ranges before. No task sees more than a range, and the driver only counts.
    The order has to tell rows apart, or ranks of equal rows are arbitrary. The table is written once, pages are read.
    """
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // rows_a_range))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The lower 33 bits of this id count the rows of a partition.
    placed = dealt.withColumn("__range", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)
    path = new_path(spark)
    placed.write.partitionBy("__range").parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    counts = {r["__range"]: r["n"] for r in written.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(counts.get(i, 0) for i in range(n))]
    first = spark.createDataFrame(list(enumerate(before[:-1])), "__range int, __first long")
    ranked = written.join(F.broadcast(first), "__range").withColumn("rn", F.col("__first") + F.col("__place"))
    return Pages(ranked.select(*rows.columns, "rn", "__range"), before)


def with_total(paged: DataFrame, rows: DataFrame) -> DataFrame:
    """The number of all rows beside each row of a page."""
    return paged.withColumn("total", rows.agg(F.count("*")).scalar())


def after(keys: list[tuple[str, object]], descending: bool = False) -> Column:
    """Rows after a cursor: the tuple comparison spelled out, nulls last (SRT-04, SRT-05)."""
    out, equal = F.lit(False), F.lit(True)
    for name, value in keys:
        c = F.col(name)
        if value is None:
            beyond = F.lit(False)
        else:
            beyond = c.isNull() | (c < F.lit(value) if descending else c > F.lit(value))
        out = out | equal & beyond
        equal = equal & c.eqNullSafe(F.lit(value))
    return out


def keyset_page(rows: DataFrame, keys: list[str], cursor: list | None, size: int, descending: bool = False) -> DataFrame:
    """The page after a cursor, and in ``has_next`` whether another row follows it."""
    order = [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_last() for k in keys]
    rest = rows if cursor is None else rows.where(after(list(zip(keys, cursor)), descending))
    more = rest.orderBy(*order).limit(size + 1)
    numbered = more.withColumn("rn", F.row_number().over(W.orderBy(*order)).cast("long"))
    return numbered.withColumn("has_next", F.max("rn").over(W.partitionBy()) > size).where(F.col("rn") <= size)


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":"), default=str).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str) -> list | None:
    """The values of a cursor; none for what isn't one."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        return None
    return found if isinstance(found, list) else None


def prefix_search(rows: DataFrame, folded: str, query: str, ties: list[str], size: int = 10) -> DataFrame:
    """Names that start with the query, then names one of whose words does (SRT-07)."""
    starts = F.col(folded).startswith(query)
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in query)
    word = F.col(folded).rlike(rf"(^|[^a-z0-9]){quoted}")
    hits = rows.where(starts | word).withColumn("is_prefix", starts)
    return hits.orderBy(F.desc("is_prefix"), folded, *ties).limit(size)
