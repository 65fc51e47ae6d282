"""Rows in order within a key: the latest, the first, transitions, runs, first sights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_n(rows: DataFrame, keys: list[str], order: list[Column], n: int, number: str = "rn") -> DataFrame:
    """The first n rows of each key (WIN-02); Spark drops the rest before the shuffle."""
    return rows.withColumn(number, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(number) <= n)


def preferred(rows: DataFrame, keys: list[str], preference: Column, ties: list[str]) -> DataFrame:
    """One row a key: the smallest preference, then ties (AGG-20)."""
    return latest_n(rows, keys, [preference.asc(), *[F.col(t).asc() for t in ties]], 1, "__n").drop("__n")


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """The state before each row, where it differs (WIN-07)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("state_from", F.lag(state).over(w)).withColumn("state_to", F.col(state)).where(~F.col("state_from").eqNullSafe(F.col("state_to")))


def runs(rows: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Runs of rows between breaking rows, numbered: ``run``, and in it ``streak`` (WIN-04)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("run", F.sum(breaks.cast("long")).over(w))
    inside = W.partitionBy(*keys, "run").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return numbered.withColumn("streak", F.sum((~breaks).cast("long")).over(inside))


def first_sights(rows: DataFrame, batch: str, key: str) -> DataFrame:
    """By batch, in order: distinct keys, and those that no earlier batch had (AGG-14, WIN-03)."""
    each = rows.groupBy(key, batch).agg(F.count("*").alias("__n"))
    first = each.withColumn("__first", F.min(batch).over(W.partitionBy(key)))
    return first.groupBy(batch).agg(F.count("*").alias("n_keys"), F.count_if(F.col("__first") == F.col(batch)).alias("n_new"))


def numbered_groups(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Groups of a fixed size in order (WIN-09), within keys that bound them."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("packet", F.floor(n / size).cast("long"))


def round_robin(rows: DataFrame, keys: list[str], order: list[str], groups: int) -> DataFrame:
    """WIN-08."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("group", (n % groups).cast("long"))
