"""Joins with a rule beside equality: one to one, nearest in time, first wins, by suffix."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other (JN-17)."""
    a = left.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*left_order)).cast("long"))
    b = right.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*right_order)).cast("long"))
    return a.join(b, [*keys, "rn"])


def with_first(rows: DataFrame, others: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first partner's columns and the number of partners (JN-14)."""
    first = others.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__f"), F.count("*").alias("n_partners"))
    return rows.join(first, keys, "left").select(*rows.columns, *[F.col(f"__f.{c}").alias(c) for c in columns], F.coalesce("n_partners", F.lit(0)).alias("n_partners"))


def last_before(events: DataFrame, keys: list[str], at: str, order: str, where: Column | None = None) -> DataFrame:
    """The latest event of a key, ties by order (JN-10)."""
    rows = events if where is None else events.where(where)
    return rows.groupBy(*keys).agg(F.max_by(at, F.struct(at, order)).alias(f"last_{at}"), F.max_by(order, F.struct(at, order)).alias(f"last_{order}"))


def by_any_name(records: DataFrame, cases: DataFrame, names: str, name: str) -> DataFrame:
    """Cases with the records one of whose names is theirs; ``n_matches`` over one is an error of the data (JN-16)."""
    exploded = records.withColumn("__name", F.explode(F.array_distinct(names)))
    joined = cases.join(exploded, cases[name] == exploded["__name"], "left").drop("__name")
    return joined.withColumn("n_matches", F.count(names).over(W.partitionBy(*[cases[c] for c in cases.columns])))


def collapsed_origins(rows: DataFrame, keys: list[str], origin: str, position: str, value: str) -> DataFrame:
    """One row a key: its first value, and the distinct origins in order (SET-01, AGG-21)."""
    each = rows.groupBy(*keys, origin).agg(F.min(position).alias("__p"), F.min_by(value, position).alias("__v"))
    return each.groupBy(*keys).agg(
        F.min_by("__v", F.struct("__p", origin)).alias(value),
        F.transform(F.array_sort(F.collect_list(F.struct("__p", origin))), lambda s: s[origin]).alias("origins"),
    )


def strict_lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """An inner join that fails on a row without a partner (JN-19)."""
    joined = rows.join(dimension.withColumn("__known", F.lit(True)), key, "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("__known")


def candidate_sites(venues: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Websites of venues from source records and from active website facts, with where each is from (JN-05, SET-01)."""
    a = sources.where("url IS NOT NULL").select("venue_id", "url", F.lit("source").alias("origin"))
    b = facts.where("kind = 'website' AND lifecycle = 'active'").select("venue_id", "url", F.lit("fact").alias("origin"))
    return venues.select("venue_id").join(a.unionByName(b), "venue_id")


def attestation_history(events: DataFrame, attestations: DataFrame, domain: str | None = None) -> DataFrame:
    """A venue's attestation events in order, of one domain if given (JN-07)."""
    chosen = attestations if domain is None else attestations.where(F.col("publisher_domain") == domain)
    return events.join(chosen.select("attestation_id", "venue_id", "publisher_domain"), "attestation_id").orderBy("venue_id", "event_id")


def joined_entries(fixtures: DataFrame, reviews: DataFrame, predictions: DataFrame) -> DataFrame:
    """Entries of fixtures that are reviewed, with their prediction or ``no_prediction`` (JN-15)."""
    j = fixtures.join(reviews, "venue_id").join(predictions, "venue_id", "left")
    return j.withColumn("outcome", F.coalesce("outcome", F.lit("no_prediction")))


def attempts_with_decisions(attempts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Crawl attempts with the decision on the address that was asked for; those without stay (JN-18)."""
    return attempts.join(decisions, ["venue_id", "requested_url"], "left")


def queued_candidates(jobs: DataFrame, venues: DataFrame, places: list[str] | None = None) -> DataFrame:
    """Venues with a queued job, of some places if given (JN-13, JN-21)."""
    chosen = venues if places is None else venues.where(F.col("place").isin(places))
    return chosen.join(jobs.where("status = 'queued'").select("venue_id", "job_id", "priority"), "venue_id")


def concatenated(*sources: DataFrame) -> DataFrame:
    """Sources one after the other; columns that one lacks are null (SET-02)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two cohorts share; none if they are disjoint (SET-04)."""
    return a.select(key).intersect(b.select(key))
