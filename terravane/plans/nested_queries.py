"""JSON, arrays, maps, sets and the joins that take them apart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import evaluation, history, matching
from .common import table


def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return rows.select("o_orderkey", F.sha2(nested.stable_json(["status", "o_custkey", "o_orderpriority"]), 256).alias("hash"))


STABLE_SQL = """
SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","status":' || CASE WHEN o_orderstatus <> 'P' THEN '"' || o_orderstatus || '"' ELSE 'null' END || '}') AS hash FROM orders"""


def guarded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "{broken").when(k % 3 == 0, F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").withColumn("json", text)
    return rows.groupBy(nested.text_at(F.col("json"), "$.k").alias("text_k"), nested.parsed(F.col("json")).isNull().alias("malformed")).agg(F.count("*").alias("n"))


GUARDED_SQL = "SELECT CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN event_type END AS text_k, event_id % 5 = 0 AS malformed, count(*) AS n FROM events GROUP BY 1, 2"


def unnested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    pairs = lines.select("l_orderkey", F.posexplode(nested.unnested(F.col("x.l_partkey"), F.col("x.l_returnflag"))).alias("position", "p"))
    return pairs.select("l_orderkey", F.col("position").cast("long").alias("position"), F.col("p.key").alias("part"), F.col("p.value").alias("flag"))


PAIRS_SQL = """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS position, l_partkey AS part, l_returnflag AS flag FROM lineitem"""


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    by = lambda c: o.where(c).groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    m = lambda d: d.select("o_custkey", F.create_map(F.lit("status"), F.col("s"), F.lit("priority"), F.col("p")).alias("m"))
    j = m(by("o_orderkey % 2 = 0")).join(m(by("o_orderkey % 2 = 1")).withColumnRenamed("m", "n"), "o_custkey")
    both = nested.merged_lists(F.col("m"), F.col("n"))
    return j.select("o_custkey", F.array_join(F.array_sort(both["status"]), ",").alias("statuses"), F.size(both["priority"]).cast("long").alias("n_priorities"), nested.has_all(both["status"], ["F", "O"]).alias("has_both"))


PROVENANCE_SQL = """
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS n_priorities, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS has_both
FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0) > 0 AND count(*) FILTER (o_orderkey % 2 = 1) > 0"""


def united_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("EVEN"))).alias("a"))
    return c.groupBy("c_nationkey").agg(nested.united(F.collect_list(F.array_compact("a"))).alias("u")).select("c_nationkey", F.array_join("u", "|").alias("aliases"))


UNITED_SQL = """
SELECT c_nationkey, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT c_nationkey, c_mktsegment AS a FROM customer UNION ALL SELECT c_nationkey, 'EVEN' FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1"""


def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "venue_id")
    sources = o.select("venue_id", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).alias("url"))
    facts = o.select("venue_id", F.when(F.col("o_orderstatus") == "F", "website").otherwise("menu").alias("kind"), F.when(F.col("o_orderkey") % 5 == 0, "retired").otherwise("active").alias("lifecycle"), F.col("o_orderpriority").alias("url"))
    venues = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("venue_id"))
    return matching.candidate_sites(venues, sources, facts).groupBy("venue_id", "origin").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


CANDIDATES_SQL = """
WITH u AS (SELECT o_custkey AS venue_id, CAST(o_orderkey AS VARCHAR) AS url, 'source' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderpriority, 'fact' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0)
SELECT venue_id, origin, count(*) AS n, min(url) AS first_url FROM u JOIN customer ON c_custkey = venue_id AND c_mktsegment = 'BUILDING' GROUP BY 1, 2"""


def joined_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = lambda d: d.withColumnRenamed("o_orderkey", "venue_id")
    fixtures = v(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderpriority"))
    reviews = v(o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus"))
    predictions = v(o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("published").alias("outcome")))
    return matching.joined_entries(fixtures, reviews, predictions).groupBy("o_orderpriority", "o_orderstatus", "outcome").agg(F.count("*").alias("n"))


ENTRIES_SQL = """
SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'published' ELSE 'no_prediction' END AS outcome, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 GROUP BY 1, 2, 3"""


def attempts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    attempts = l.select(F.col("l_orderkey").alias("venue_id"), F.col("l_suppkey").alias("requested_url"), "l_linenumber")
    decisions = l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("venue_id"), F.col("l_suppkey").alias("requested_url"), F.lit("kept").alias("decision")).distinct()
    numbered = history.latest_n(matching.attempts_with_decisions(attempts, decisions), ["venue_id"], [F.asc("l_linenumber"), F.asc("requested_url")], 3, "attempt")
    return numbered.groupBy("venue_id").agg(F.count("*").alias("n"), F.count("decision").alias("n_decided"), F.max("attempt").cast("long").alias("last_attempt"))


ATTEMPTS_SQL = """
WITH l AS (SELECT l_orderkey AS v, l_suppkey AS u, l_linenumber FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS v, l_suppkey AS u FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT l.v, d.u AS decided, row_number() OVER (PARTITION BY l.v ORDER BY l_linenumber, l.u) AS n FROM l LEFT JOIN d ON d.v = l.v AND d.u = l.u)
SELECT v AS venue_id, count(*) AS n, count(decided) AS n_decided, max(n) AS last_attempt FROM n WHERE n <= 3 GROUP BY 1"""


def shared_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_orderstatus = 'P'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    both = matching.in_both(a, b, "o_custkey")
    return matching.concatenated(both.withColumn("part", F.lit("both")), b.select("o_custkey", "o_orderkey").withColumn("part", F.lit("urgent"))).groupBy("part").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("n_orders"))


COHORTS_SQL = """
SELECT 'both' AS part, count(*) AS n, 0 AS n_orders FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'urgent', count(*), count(o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT'"""


def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("url"), F.col("l_returnflag").alias("role"))  # noqa: E741
    return evaluation.fixture_scores(l.where("url % 3 <> 0"), l.where("url % 4 <> 0"), ["url", "role"])


SCORES_SQL = """
WITH l AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS u, l_returnflag AS r FROM lineitem)
SELECT case_id, count(*) FILTER (u % 3 <> 0 AND u % 4 <> 0) AS found, count(*) FILTER (u % 3 <> 0 AND u % 4 = 0) AS missed, count(*) FILTER (u % 3 = 0 AND u % 4 <> 0) AS extra, count(*) FILTER ((u % 3 <> 0) <> (u % 4 <> 0)) = 0 AS exact
FROM l WHERE u % 3 <> 0 OR u % 4 <> 0 GROUP BY 1"""


def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit(" - Roma | Menu"))).when(k % 4 == 1, F.concat(F.lit("Best "), "p_name")).when(k % 4 == 2, F.concat("p_name", F.lit(", Roma"))).otherwise(F.concat("p_name", F.lit(": orari")))
    return p.select("p_partkey", nested.name_from_title(title, "Roma").alias("name"), nested.later(F.lit("2024-01-01").cast("timestamp_ntz"), (k % 40).cast("int")).alias("valid_until"))


TITLES_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 AND length(p_name) BETWEEN 3 AND 55 THEN p_name END AS name, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 40 AS INT)) AS valid_until FROM part"


def run_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), F.when(k % 7 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("input_sha256"), F.when(k % 2 == 0, "warm").when(k % 9 == 0, "hot").otherwise("cold").alias("mode"), F.when(k % 3 == 0, k % 4 == 0).alias("cold_passed"), (k % 5).alias("max_requests"))
    return evaluation.run_faults(runs)


FAULTS_SQL = """
SELECT o_orderkey AS run_id, 'unpinned_input' AS violation FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'cold_run_not_passed' FROM orders WHERE o_orderkey % 2 = 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 = 0)
UNION ALL SELECT o_orderkey, 'no_budget' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'unknown_mode' FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 9 = 0"""

NAMES = {
    "stable_hashes": STABLE_SQL, "guarded_json": GUARDED_SQL, "unnested_pairs": PAIRS_SQL, "provenance": PROVENANCE_SQL, "united_aliases": UNITED_SQL, "site_candidates": CANDIDATES_SQL, "joined_entries": ENTRIES_SQL, "attempts_joined": ATTEMPTS_SQL,
    "shared_cohorts": COHORTS_SQL, "fixture_scores": SCORES_SQL, "title_names": TITLES_SQL, "run_faults": FAULTS_SQL,
}
QUERIES = {name: (globals()[name], sql) for name, sql in NAMES.items()}
