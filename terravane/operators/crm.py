"""Contacts, activities and stages of leads: lists, pages, due rows, and new versions of the tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .paging import keyset_page


def contacts_page(contacts: DataFrame, due: DataFrame, search: str, columns: list[str], sort: str, cursor: list | None, size: int, only_due: bool = False) -> DataFrame:
    """Contacts that hold the text in any of the columns, with the reason they are due, after a cursor (FLT-18, JN-08, SRT-04)."""
    q = F.lower(F.lit(search))
    hit = F.lit(search == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
    joined = contacts.where(hit).join(due.select("id", "reason"), "id", "left")
    rows = joined.where("reason IS NOT NULL") if only_due else joined
    return keyset_page(rows, [sort, "id"], cursor, size)


def activities_page(events: DataFrame, pipeline: DataFrame, contacts: DataFrame, kinds: list[str], stages: list[str], since: str | None, until: str | None, cursor: list | None, size: int) -> DataFrame:
    """Activities of venues in the pipeline, newest first, with their contacts' names (JN-11, JN-21, SRT-05)."""
    rows = events.where(F.col("kind").isin(kinds)) if kinds else events
    rows = rows.where(F.col("happened_on") >= F.lit(since).cast("date")) if since else rows
    rows = rows.where(F.col("happened_on") <= F.lit(until).cast("date")) if until else rows
    staged = pipeline.where(F.col("stage").isin(stages)) if stages else pipeline
    joined = rows.join(staged.select("venue_id", "stage"), "venue_id").join(contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("contact")), "contact_id", "left")
    return keyset_page(joined, ["happened_on", "id"], cursor, size, descending=True)


def worklist(pipeline: DataFrame, counts: DataFrame, stages: list[str], most: int = 500) -> DataFrame:
    """Rows of some stages by next action, those without last (SRT-06)."""
    rows = pipeline.where(F.col("stage").isin(stages)).join(counts, "venue_id", "left")
    return rows.orderBy(F.col("next_action_on").asc_nulls_last(), "venue_id").limit(most)


def retention_due(contacts: DataFrame, pipeline: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """Contacts to be dropped, with the reason: lost for a year, or quiet for two (JN-09, JN-10)."""
    last = events.groupBy("venue_id").agg(F.max("happened_on").alias("last_on"))
    staged = events.where("kind = 'stage'").join(pipeline.select("venue_id", "stage"), "venue_id").where("stage_to = stage").groupBy("venue_id").agg(F.max_by("happened_on", "id").alias("stage_on"))
    j = contacts.join(pipeline.select("venue_id", "stage"), "venue_id", "left").join(last, "venue_id", "left").join(staged, "venue_id", "left")
    lost = F.col("stage").isin("lost", "do_not_contact") & (F.col("stage_on") < F.add_months(today, -12))
    quiet = (F.coalesce("stage", F.lit("")) != "won") & (F.greatest("last_on", "updated_on") < F.add_months(today, -24))
    reason = F.when(lost, F.concat_ws(" ", "stage", F.lit("since"), F.col("stage_on").cast("string"))).when(quiet, F.concat_ws(" ", F.lit("quiet since"), F.greatest("last_on", "updated_on").cast("string")))
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "venue_id", "reason")


def without_contact(contacts: DataFrame, events: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next versions of contacts and events: contacts gone, an event only for those that were there (JN-23)."""
    there = gone.join(contacts.select("id", "venue_id"), "id")
    notes = there.select(F.col("venue_id"), F.lit("contact_deleted").alias("kind"), F.col("reason").alias("note"), F.col("happened_on"))
    return contacts.join(gone.select("id"), "id", "left_anti"), events.unionByName(notes, allowMissingColumns=True)


def stage_history(events: DataFrame) -> DataFrame:
    """Each stage event with the stage before it (WIN-07)."""
    w = W.partitionBy("venue_id").orderBy("id")
    return events.where("kind = 'stage'").withColumn("stage_from", F.lag("stage_to").over(w))


def snapshot(venues: DataFrame, sources: DataFrame, attestations: DataFrame, sites: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row a venue with its first source record, its owned website and its last assessment (JN-03)."""
    first = sources.groupBy("venue_id").agg(F.min_by(F.struct("source_record_id", "url"), "source_record_id").alias("s"), F.count("*").alias("n_sources"))
    owned = sites.join(attestations.select("venue_id", "domain").distinct(), ["venue_id", "domain"]).groupBy("venue_id").agg(F.min("url").alias("website"))
    last = assessments.groupBy("venue_id").agg(F.max_by("state", F.struct("checked_at", "assessment_id")).alias("state"))
    j = venues.join(first, "venue_id", "left").join(owned, "venue_id", "left").join(last, "venue_id", "left")
    return j.select(*venues.columns, F.col("s.source_record_id").alias("source_record_id"), F.col("s.url").alias("source_url"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "website", "state")
