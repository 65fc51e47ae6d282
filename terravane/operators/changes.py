"""Differences between versions, merges, overlays and retirement."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as text; nulls and empty strings differ (HSH-01)."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """insert, delete, update or unchanged for each key of either version (SNK-04)."""
    a = old.select(*keys, row_hash(columns).alias("__old"))
    b = new.select(*keys, row_hash(columns).alias("__new"))
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__old") != F.col("__new"), "update").otherwise("unchanged")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def apply_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The next version: rows of ``new``, and no row of ``old`` that it doesn't have."""
    return new.dropDuplicates(keys).select(*old.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first: list[str], last: list[str], values: list[str]) -> DataFrame:
    """Merge by key: earliest of ``first``, latest of ``last``, new values unless empty (EVD-01)."""
    a = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in [*first, *last, *values]])
    b = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in [*first, *last, *values]])
    merged = a.join(b, keys, "full_outer")
    return merged.select(
        *keys,
        *[F.least(f"__o_{c}", f"__n_{c}").alias(c) for c in first],
        *[F.greatest(f"__o_{c}", f"__n_{c}").alias(c) for c in last],
        *[F.coalesce(F.nullif(F.col(f"__n_{c}").cast("string"), F.lit("")).cast(new.schema[c].dataType), F.col(f"__o_{c}")).alias(c) for c in values],
    )


def overlay(base: DataFrame, over: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The base with the overlay's values where it has any."""
    o = over.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(o, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def retire_others(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One active fact a key, the first in order; the others retired (EVD-05)."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return facts.withColumn("lifecycle", F.when(n == 1, "active").otherwise("retired"))


def keep_newest(versions: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The newest versions of a small table of versions (SNK-03, SNK-05)."""
    return versions.orderBy(*order).limit(n)


def missing_from(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner, safe for nulls (JN-06, JN-20)."""
    on = None
    for k in keys:
        c = rows[k].eqNullSafe(others[k])
        on = c if on is None else on & c
    return rows.join(others, on, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks; none if equal as bags (SET-03)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
