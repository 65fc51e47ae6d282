"""Queries whose results depend on an order that SQL does not fold: checked by their invariants."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import harvest, queue, sampling
from ..streaming import jobs
from .common import leads, table


def reserved_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as requests of one to four units against two scopes."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("budget"), F.col("event_id").alias("request_id"), (F.col("event_id") % 4 + 1).alias("n"))
    requests = e.withColumn("scope", F.lit("all")).unionByName(e.where("request_id % 2 = 0").withColumn("scope", F.lit("even")))
    limits = e.select("budget").distinct().select("budget", F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.lit(300).cast("long").alias("most")), F.struct(F.lit("even").alias("scope"), F.lit(100).cast("long").alias("most")))).alias("l")).select("budget", "l.*")
    return queue.reserve(requests, limits)


def stages_after_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's stage after steps by hand and automatic ones."""
    k = F.col("o_orderkey")
    stages = F.array(*[F.lit(s) for s in queue.STAGES])
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("venue_id"), k.alias("id"), F.element_at(stages, (k % 7 + 1).cast("int")).alias("stage"), (k % 3 != 0).alias("automatic"))
    return queue.stage_after(steps, "venue_id", ["id"], "stage", "automatic")


_STAGES, _FINAL = str(queue.STAGES), str(queue.FINAL)
STAGES_SQL = f"""
WITH RECURSIVE s AS (SELECT o_custkey AS venue_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 7 + 1 AS stage, o_orderkey % 3 <> 0 AS automatic FROM orders),
f AS (SELECT DISTINCT venue_id, 0::BIGINT AS i, 1::BIGINT AS stage FROM s
  UNION ALL
  SELECT f.venue_id, s.i, CASE WHEN NOT s.automatic OR (NOT list_contains({_FINAL}, {_STAGES}[f.stage]) AND s.stage > f.stage) THEN s.stage ELSE f.stage END FROM f JOIN s ON s.venue_id = f.venue_id AND s.i = f.i + 1)
SELECT venue_id, {_STAGES}[arg_max(stage, i)] AS stage FROM f GROUP BY venue_id"""


def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = leads(spark, sf_dir).select(F.col("nation").alias("town"), k.alias("venue_id"), sampling.order_hash("b", k).alias("order_hash"), F.col("segment").alias("type"), F.when(k % 2 == 0, "known").otherwise("missing").alias("website"))
    return sampling.balanced_types(rows, ["FRANCE", "GERMANY", "ITALY", "NATION_1", "NATION_2", "BRAZIL", "CHINA"])


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say of themselves in JSON-LD; the given pages say nothing, so a part of them is made to."""
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Restaurant","name":"Ristoro '), F.col("page_id").cast("string"), F.lit('","telephone":"1","address":{"@type":"PostalAddress","streetAddress":"Via Roma 1"}}]}</script>'))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", block)).otherwise(F.col("html")))
    return harvest.json_ld(pages).select("page_id", "json_ld.name", "json_ld.telephone", "json_ld.address")


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the windowed stream (an extension)."""
    return jobs.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "6 hours", ["event_type"])


WINDOWED_SQL = """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3"""

# The given tables have pages without JSON-LD, so this one has SQL too: the made ones, and nulls.
STRUCTURED_SQL = """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Ristoro ' || page_id END AS name, CASE WHEN page_id % 2 = 0 THEN '1' END AS telephone, CASE WHEN page_id % 2 = 0 THEN 'Via Roma 1' END AS address FROM pages"""

QUERIES = {
    "reserved_budgets": (reserved_budgets, None),
    "stages_after_steps": (stages_after_steps, STAGES_SQL),
    "balanced_selection": (balanced_selection, None),
    "structured_pages": (structured_pages, STRUCTURED_SQL),
    "windowed_events": (windowed_events, WINDOWED_SQL),
}
