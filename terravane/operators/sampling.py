"""Reproducible samples: by hash, by quota, and greedy ones over strata."""

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def order_hash(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\n"), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of sha256(seed, key) (SMP-01)."""
    return rows.withColumn("order_hash", order_hash(seed, F.col(key))).orderBy("order_hash", key).limit(n)


def next_batch(rows: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """n rows that aren't done, in the order of sha256(key) (SMP-02)."""
    rest = rows.join(done.select(key).distinct(), key, "left_anti")
    return rest.withColumn("order_hash", F.sha2(F.col(key).cast("string"), 256)).orderBy("order_hash", key).limit(n)


def largest_remainder(counts: DataFrame, stratum: str, count: str, total: int) -> DataFrame:
    """Quotas in proportion that sum to ``total``: whole parts, then one each by the largest remainder, ties by name (SMP-03).

    ``counts`` has one row a stratum; remainders are compared as whole numbers.
    """
    everything = F.sum(count).over(W.partitionBy())
    shared = counts.select(stratum, count, F.floor(F.col(count) * total / everything).cast("long").alias("whole"), ((F.col(count) * total) % everything).alias("rest"))
    left = F.lit(total) - F.sum("whole").over(W.partitionBy())
    place = F.row_number().over(W.partitionBy().orderBy(F.desc("rest"), stratum))
    return shared.select(stratum, count, "whole", "rest", (F.col("whole") + (place <= left).cast("long")).alias("quota"))


def by_quota(rows: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """Each stratum's quota of rows by seeded hash order."""
    w = W.partitionBy(stratum).orderBy("order_hash", key)
    numbered = rows.withColumn("order_hash", order_hash(seed, F.col(key))).withColumn("rn", F.row_number().over(w))
    return numbered.join(quotas.select(stratum, "quota"), stratum).where("rn <= quota").drop("quota")


def shortlist(rows: DataFrame, cell: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows a cell by hash (SMP-07)."""
    w = W.partitionBy(*cell).orderBy("order_hash", key)
    return rows.withColumn("order_hash", order_hash(seed, F.col(key))).withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= n)


def audit_sample(rows: DataFrame, key: str, seed: str, least: int = 15, share: float = 0.2) -> DataFrame:
    """max(least, share of the rows) by hash order (SMP-08)."""
    n = max(least, -int(-rows.count() * share // 1))
    return hash_sample(rows, key, n, seed)


# The penalties of the slots' strata, and the slots' cycle.
PENALTY = {"size": 100, "tourism": 70, "chain": 20, "language": 10}
TYPE_PENALTY, TOWN_PENALTY = 8, 5


def slot_target(slot: int) -> dict[str, str]:
    return {
        "website": "missing" if slot % 2 else "known",
        "size": ("small", "medium", "large")[slot % 3],
        "tourism": "general_market" if slot % 5 else "tourism_focus",
        "chain": "known_chain" if slot in (1, 11) else "independent_or_unknown",
        "language": "included" if slot in (2, 12) else "standard",
    }


def diverse_slots(rows: DataFrame, slots: int = 15, holdout: int = 5, per_cell: int = 64) -> DataFrame:
    """Slots filled in turn for each region by the least penalty: strata missed, types and towns repeated (SMP-05, SMP-06).

    Rows: region, venue_id, order_hash, type, town, website, size, tourism, chain, language. Choices in one region
    depend on each other, regions don't. Before a region is gathered, each cell of its strata, type and town is cut
    to its first rows by hash: a slot takes the first of some cell, so ``per_cell`` of at least ``slots`` loses nothing.
    """
    if per_cell < slots:
        raise ValueError("per_cell must be at least the number of slots")
    strata = ["website", "size", "tourism", "chain", "language", "type", "town"]
    w = W.partitionBy("region", *strata).orderBy("order_hash", "venue_id")
    cut = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_cell).drop("__n")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["order_hash", "venue_id"]).to_dict("records")
        types, towns, out = Counter(), Counter(), []
        for slot in range(slots):
            target = slot_target(slot)
            fit = [r for r in left if r["website"] == target["website"]]
            if not fit:
                continue
            best = min(fit, key=lambda r: sum(p for k, p in PENALTY.items() if r[k] != target[k]) + TYPE_PENALTY * types[r["type"]] + TOWN_PENALTY * towns[r["town"]])
            left.remove(best)
            types[best["type"]] += 1
            towns[best["town"]] += 1
            out.append((best["region"], best["venue_id"], slot, "locked_holdout" if slot >= slots - holdout else "development"))
        return pd.DataFrame(out, columns=["region", "venue_id", "slot", "part"])

    kinds = dict(rows.dtypes)
    return cut.groupBy("region").applyInPandas(fill, f"region {kinds['region']}, venue_id {kinds['venue_id']}, slot long, part string")


def powered_target(slot: int) -> dict[str, str]:
    """As ``slot_target``, with chains and languages in every ten slots."""
    return slot_target(slot) | {"chain": "known_chain" if slot % 10 == 1 else "independent_or_unknown", "language": "included" if slot % 10 == 2 else "standard"}


def powered_holdout(rows: DataFrame, seed: str, slots: int = 25) -> DataFrame:
    """``region, venue_id, slot, part``: 25 venues a region, all locked, by the least penalty in turn (SMP-06).

    Ties of a slot go by sha256(seed, region, slot, venue), which differs from slot to slot. A region that has no venue
    left with the website a slot asks for fails. Rows are those of ``diverse_slots`` without the hash. Each slot takes the
    first of some cell of strata, type and town, and at most ``slots`` are taken, so the first ``slots`` of a cell by a
    slot's hash are all that is gathered for it.
    """
    strata = ["website", "size", "tourism", "chain", "language", "type", "town"]
    asked = F.explode(F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: (s % 2 == 0) == (F.col("website") == "known"))).alias("slot")
    each = rows.where(F.col("website").isin("known", "missing")).select("region", "venue_id", *strata, asked)
    each = each.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(seed), F.col("region").cast("string"), F.col("slot").cast("string"), F.col("venue_id").cast("string")), 256))
    w = W.partitionBy("region", "slot", *strata).orderBy("hash", "venue_id")
    first = each.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= slots).drop("__n")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        types, towns, taken, out = Counter(), Counter(), set(), []
        by_slot = {slot: part.to_dict("records") for slot, part in pdf.groupby("slot")}
        for slot in range(slots):
            target = powered_target(slot)
            fit = [r for r in by_slot.get(slot, ()) if r["venue_id"] not in taken]
            if not fit:
                raise ValueError(f"region {pdf['region'].iloc[0]} lacks venues whose website is {target['website']}")
            penalty = lambda r, target=target: sum(p for k, p in PENALTY.items() if r[k] != target[k]) + TYPE_PENALTY * types[r["type"]] + TOWN_PENALTY * towns[r["town"]]
            best = min(fit, key=lambda r, penalty=penalty: (penalty(r), r["hash"], r["venue_id"]))
            taken.add(best["venue_id"])
            types[best["type"]] += 1
            towns[best["town"]] += 1
            out.append((best["region"], best["venue_id"], slot, "locked_holdout"))
        return pd.DataFrame(out, columns=["region", "venue_id", "slot", "part"])

    kinds = dict(rows.dtypes)
    return first.groupBy("region").applyInPandas(fill, f"region {kinds['region']}, venue_id {kinds['venue_id']}, slot long, part string")


def balanced_types(rows: DataFrame, catalog: list[str]) -> DataFrame:
    """For each town of a short catalog, in order, one known and one missing website, types chosen least so far, ties by hash (SMP-04).

    Rows: town, venue_id, order_hash, type, website. The first row by hash of each town, website and type decides,
    so one small group, bounded by towns and types, holds all that the sequence of choices needs.
    """
    first = rows.where(F.col("town").isin(catalog)).groupBy("town", "website", "type").agg(F.min(F.struct("order_hash", "venue_id")).alias("r")).select("town", "website", "type", "r.*")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, out = Counter(), []
        for town in catalog:
            for website in ("known", "missing"):
                fit = pdf[(pdf.town == town) & (pdf.website == website)].to_dict("records")
                if fit:
                    best = min(fit, key=lambda r: (counts[r["type"]], r["order_hash"], r["venue_id"]))
                    counts[best["type"]] += 1
                    out.append((len(out) + 1, town, website, best["type"], best["venue_id"]))
        return pd.DataFrame(out, columns=["n", "town", "website", "type", "venue_id"])

    kinds = dict(rows.dtypes)
    return first.groupBy().applyInPandas(choose, f"n long, town {kinds['town']}, website string, type string, venue_id {kinds['venue_id']}")


def selection_faults(selected: DataFrame, key: str, region: str, per_region: int, excluded: DataFrame) -> DataFrame:
    """What is wrong with a selection; no rows if nothing (SMP-09)."""
    twice = selected.groupBy(key).count().where("count > 1").select(F.lit("duplicate").alias("fault"), F.col(key).cast("string").alias("of"))
    barred = selected.join(excluded.select(key).distinct(), key, "left_semi").select(F.lit("excluded").alias("fault"), F.col(key).cast("string").alias("of"))
    uneven = selected.groupBy(region).count().where(F.col("count") != per_region).select(F.lit("count").alias("fault"), F.col(region).cast("string").alias("of"))
    return twice.unionByName(barred).unionByName(uneven)
