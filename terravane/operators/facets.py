"""Counts by facet, each ignoring its own filter, in one pass over the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def self_excluding_facets(rows: DataFrame, filters: dict[str, Column], domain: DataFrame | None = None, view: Column | None = None) -> DataFrame:
    """``facet, code, total, in_view`` for each facet column of ``filters``, rows that pass all other filters (AGG-01).

    One scan: each row becomes one row a facet, which counts if the row passes the other facets' filters, and is
    counted map-side; so codes of which no row counts are there with zero. With ``domain(facet, code)`` the codes
    are those of it, whether any row has them or not. ``view`` restricts ``in_view``.
    """
    view = F.lit(True) if view is None else view
    entries = []
    for facet in filters:
        others = [c for name, c in filters.items() if name != facet]
        passes = reduce(lambda a, b: a & b, others, F.lit(True))
        entries.append(F.struct(F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("code"), passes.alias("passes")))
    exploded = rows.select(view.alias("seen"), F.explode(F.array(*entries)).alias("e")).select("e.*", "seen")
    counted = exploded.groupBy("facet", "code").agg(F.count_if("passes").alias("total"), F.count_if(F.col("passes") & F.col("seen")).alias("in_view"))
    if domain is None:
        return counted
    return domain.join(counted, ["facet", "code"], "left").fillna(0, ["total", "in_view"])


def counts_by_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``dimension, value, n`` for each column, in one scan (AGG-02, AGG-15)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def bounds(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Count and bounding box by key (AGG-03)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north")
    )


def zero_filled(counts: DataFrame, domain: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """AGG-06."""
    return domain.join(counts, keys, "left").fillna(0, [count])


def histogram_map(rows: DataFrame, key: list[str], outcome: str) -> DataFrame:
    """Counts of outcomes as a map for each key (AGG-13)."""
    counts = rows.groupBy(*key, outcome).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(outcome, "n")))).alias("outcomes"))


def inventory(records: DataFrame, venues: DataFrame, regions: DataFrame, keys: list[str], has_site: Column) -> DataFrame:
    """Records, venues, duplicates and coverage by region, from the regions, so that empty ones count (AGG-04)."""
    r = records.groupBy(*keys).agg(F.count("*").alias("records"))
    v = venues.groupBy(*keys).agg(F.count("*").alias("venues"), F.count_if(has_site).alias("with_site"))
    out = regions.select(*keys).distinct().join(r, keys, "left").join(v, keys, "left").fillna(0, ["records", "venues", "with_site"])
    return out.withColumn("duplicates", F.col("records") - F.col("venues")).withColumn("coverage", F.round(F.try_divide("with_site", "venues"), 4))
