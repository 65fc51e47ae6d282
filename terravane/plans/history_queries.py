"""Joins, histories, versions, samples."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, history, matching, sampling
from .common import LEADS_SQL, leads, table


def overlay_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    events = table(spark, sf_dir, "events")
    contacts = events.where("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_clicks"))
    last = events.where("event_type <> 'view'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_touch"))
    both = spent.join(contacts, "id", "full_outer")
    return both.join(last, "id", "left").select("id", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_clicks", F.lit(0)).alias("n_clicks"), "last_touch")


OVERLAY_SQL = """
WITH p AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
c AS (SELECT user_id AS id, count(*) AS n_clicks FROM events WHERE event_type = 'click' GROUP BY 1),
l AS (SELECT user_id AS id, max(ts) AS last_touch FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT coalesce(p.id, c.id) AS id, coalesce(n_orders, 0) AS n_orders, coalesce(n_clicks, 0) AS n_clicks, last_touch
FROM p FULL JOIN c ON p.id = c.id LEFT JOIN l ON l.id = coalesce(p.id, c.id)"""


def not_exists_unattested(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    live = table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= at) & (at < F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(live, "c_custkey", "left_anti").select("c_custkey", "c_name", "c_mktsegment")


UNATTESTED_SQL = """
SELECT c_custkey, c_name, c_mktsegment FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' < o_orderdate + INTERVAL 90 DAY)"""


def lateral_last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = matching.last_before(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    urgent = matching.last_before(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", F.col("o_orderpriority") == "1-URGENT").select("o_custkey", F.col("last_o_orderkey").alias("last_urgent"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(last, c.c_custkey == last.o_custkey, "left").drop("o_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("last_o_orderdate").alias("last_date"), F.col("last_o_orderkey").alias("last_order"), "last_urgent")


LATERAL_SQL = """
SELECT c_custkey, a.o_orderdate AS last_date, a.o_orderkey AS last_order, u.o_orderkey AS last_urgent FROM customer
LEFT JOIN LATERAL (SELECT o_orderdate, o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) a ON true
LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) u ON true"""


def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("1998-08-01").cast("date")
    o = table(spark, sf_dir, "orders").withColumn("happened_on", F.to_date("o_orderdate"))
    stage = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("happened_on", "o_orderkey")).alias("stage"))
    last_any = o.groupBy("o_custkey").agg(F.max("happened_on").alias("last_on"))
    set_on = o.join(stage, "o_custkey").where((F.col("o_orderstatus") == F.col("stage"))).groupBy("o_custkey").agg(F.max_by("happened_on", "o_orderkey").alias("stage_on"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("1995-03-01").cast("date")).alias("updated_on"))
    j = c
    for side in (stage, last_any, set_on):
        j = j.join(side, F.col("c_custkey") == side.o_custkey, "left").drop("o_custkey")
    lost = (F.col("stage") == "O") & (F.col("stage_on") < F.add_months(today, -12))
    quiet = (F.coalesce("stage", F.lit("")) != "F") & (F.greatest("last_on", "updated_on") < F.add_months(today, -24))
    reason = F.when(lost, F.concat(F.lit("lost since "), F.col("stage_on").cast("string"))).when(quiet, F.concat(F.lit("no activity since "), F.greatest("last_on", "updated_on").cast("string")))
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("c_custkey", "stage", "reason")


RETENTION_SQL = """
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS happened_on FROM orders),
s AS (SELECT o_custkey, arg_max(o_orderstatus, ROW(happened_on, o_orderkey)) AS stage, max(happened_on) AS last_on FROM o GROUP BY 1),
t AS (SELECT o.o_custkey, arg_max(happened_on, o_orderkey) AS stage_on FROM o JOIN s ON s.o_custkey = o.o_custkey AND o_orderstatus = stage GROUP BY 1),
j AS (SELECT c_custkey, stage, last_on, stage_on, CASE WHEN c_custkey % 5 = 0 THEN DATE '1995-03-01' END AS updated_on FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey),
r AS (SELECT c_custkey, stage, CASE WHEN stage = 'O' AND stage_on < DATE '1997-08-01' THEN 'lost since ' || stage_on
  WHEN coalesce(stage, '') <> 'F' AND greatest(last_on, updated_on) < DATE '1996-08-01' THEN 'no activity since ' || greatest(last_on, updated_on) END AS reason FROM j)
SELECT * FROM r WHERE reason IS NOT NULL"""


def latest_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_n(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).withColumn("rn", F.col("rn").cast("long"))


LATEST_SQL = "SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 3"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.transitions(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")
    return rows.groupBy("state_from", "state_to").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


TRANSITIONS_SQL = """
WITH e AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS state_from, event_type AS state_to FROM events)
SELECT state_from, state_to, count(*) AS n, min(event_id) AS first_event FROM e WHERE state_from IS DISTINCT FROM state_to GROUP BY 1, 2"""


def circuit_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") != "error")
    found = rows.groupBy("user_id", "run").agg(F.max("streak").alias("failures")).where("failures > 0")
    return found.select("user_id", "run", "failures", (F.col("failures") >= 3).alias("is_open"))


ISLANDS_SQL = """
WITH e AS (SELECT user_id, event_id, event_type, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events)
SELECT user_id, run, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 3 AS is_open FROM e GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'error') > 0"""


def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 11 <> 0")
    new = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changes.diff(old, new, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


DIFF_SQL = """
WITH a AS (SELECT o_orderkey, sha256('=' || o_custkey || '|=' || o_orderstatus || '|=' || o_orderpriority) AS h FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey, sha256('=' || o_custkey || '|=' || CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|=' || o_orderpriority) AS h FROM orders WHERE o_orderkey % 13 <> 0)
SELECT o_orderkey, CASE WHEN a.h IS NULL THEN 'insert' WHEN b.h IS NULL THEN 'delete' WHEN a.h <> b.h THEN 'update' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (o_orderkey)"""


def first_with_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return history.preferred(o, ["o_custkey"], F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), ["o_orderkey"])


PREFERENCE_SQL = "SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) = 1"


def union_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.concat(F.lit("doc-"), "lang").alias("origin"), F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("value"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("key"), F.lit("page").alias("origin"), (F.col("page_id") + 100000).alias("position"), F.col("url").alias("value"))
    found = matching.collapsed_origins(docs.unionByName(pages), ["key"], "origin", "position", "value")
    return found.select("key", "value", F.array_join("origins", ",").alias("origins"))


ORIGINS_SQL = """
WITH u AS (SELECT source AS key, 'doc-' || lang AS origin, doc_id AS position, CAST(doc_id AS VARCHAR) AS value FROM documents
  UNION ALL SELECT 'src' || page_id % 20, 'page', page_id + 100000, url FROM pages),
e AS (SELECT key, origin, min(position) AS p FROM u GROUP BY 1, 2)
SELECT key, (SELECT arg_min(value, position) FROM u WHERE u.key = e.key) AS value, string_agg(origin, ',' ORDER BY p, origin) AS origins FROM e GROUP BY key"""


def marginal_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("batch"), "user_id")
    return history.first_sights(rows, "batch", "user_id")


YIELD_SQL = """
WITH e AS (SELECT DISTINCT event_id // 500 AS batch, user_id FROM events), f AS (SELECT *, min(batch) OVER (PARTITION BY user_id) AS first FROM e)
SELECT batch, count(*) AS n_keys, count(*) FILTER (first = batch) AS n_new FROM f GROUP BY 1"""


def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"), "event_id")
    return matching.one_to_one(o, e, ["id"], ["o_orderkey"], ["event_id"])


ONE_SQL = """
WITH o AS (SELECT o_custkey AS id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
e AS (SELECT user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'purchase')
SELECT id, rn, o_orderkey, event_id FROM o JOIN e USING (id, rn)"""


def seeded_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sampling.hash_sample(changes.missing_from(c, done, ["c_custkey"]), "c_custkey", 100, "terravane")


SAMPLE_SQL = """
SELECT c_custkey, c_name, sha256('terravane' || chr(10) || c_custkey) AS order_hash FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
ORDER BY order_hash, c_custkey LIMIT 100"""


def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return sampling.largest_remainder(counts, "c_mktsegment", "n", 101)


QUOTA_SQL = """
WITH c AS (SELECT c_mktsegment, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS everything FROM customer GROUP BY 1),
s AS (SELECT c_mktsegment, n, n * 101 // everything AS whole, n * 101 % everything AS rest FROM c)
SELECT c_mktsegment, n, whole, rest, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, c_mktsegment) <= 101 - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM s"""


def shortlist_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return sampling.shortlist(c, ["c_nationkey", "c_mktsegment"], "c_custkey", 16, "s")


SHORTLIST_SQL = """
SELECT c_custkey, c_nationkey, c_mktsegment, sha256('s' || chr(10) || c_custkey) AS order_hash,
  row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY sha256('s' || chr(10) || c_custkey), c_custkey) AS rn FROM customer QUALIFY rn <= 16"""


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    counts = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return sampling.by_quota(c, sampling.largest_remainder(counts, "c_mktsegment", "n", 101), "c_mktsegment", "c_custkey", "q").select("c_custkey", "c_mktsegment", F.col("rn").cast("long").alias("rn"))


QUOTA_SAMPLE_SQL = f"""
WITH q AS ({QUOTA_SQL.strip()}),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('q' || chr(10) || c_custkey), c_custkey) AS rn FROM customer)
SELECT c_custkey, r.c_mktsegment, rn FROM r JOIN q ON q.c_mktsegment = r.c_mktsegment WHERE rn <= quota"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "bigint")
    return e.groupBy("event_type", F.schema_of_variant(F.variant_get(v, "$.k", "variant")).alias("kind")).agg(F.sum(k).alias("sum_k"), F.max(k).alias("max_k"), F.count_if(k % 2 == 0).alias("n_even"))


JSON_SQL = """
SELECT event_type, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.k') END AS kind, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
  max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0) AS n_even FROM events GROUP BY 1, 2"""


def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("provider"), "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


HEALTH_SQL = "SELECT user_id % 7 AS provider, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.numbered_groups(leads(spark, sf_dir).select("o_orderkey", "region"), ["region"], ["o_orderkey"], 999)
    return rows.groupBy("region", "packet").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


PACKETS_SQL = f"""WITH {LEADS_SQL},
p AS (SELECT region, o_orderkey, (row_number() OVER (PARTITION BY region ORDER BY o_orderkey) - 1) // 999 AS packet FROM leads)
SELECT region, packet, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM p GROUP BY 1, 2"""

QUERIES = {
    "overlay_full_join": (overlay_full_join, OVERLAY_SQL),
    "not_exists_unattested": (not_exists_unattested, UNATTESTED_SQL),
    "lateral_last_activity": (lateral_last_activity, LATERAL_SQL),
    "retention_due": (retention_due, RETENTION_SQL),
    "latest_n_per_key": (latest_n_per_key, LATEST_SQL),
    "transitions": (transitions, TRANSITIONS_SQL),
    "circuit_islands": (circuit_islands, ISLANDS_SQL),
    "hash_diff": (hash_diff, DIFF_SQL),
    "first_with_preference": (first_with_preference, PREFERENCE_SQL),
    "union_origins": (union_origins, ORIGINS_SQL),
    "marginal_yield": (marginal_yield, YIELD_SQL),
    "one_to_one_match": (one_to_one_match, ONE_SQL),
    "seeded_hash_sample": (seeded_hash_sample, SAMPLE_SQL),
    "largest_remainder_quota": (largest_remainder_quota, QUOTA_SQL),
    "shortlist_per_cell": (shortlist_per_cell, SHORTLIST_SQL),
    "quota_sample": (quota_sample, QUOTA_SAMPLE_SQL),
    "json_props": (json_props, JSON_SQL),
    "provider_health": (provider_health, HEALTH_SQL),
    "packets": (packets, PACKETS_SQL),
}
