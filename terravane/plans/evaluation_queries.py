"""Rates, intervals, gates, evidence and queues."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import changes, evaluation, evidence, queue
from .common import table

Z2 = f"({stats.Z}::DOUBLE * {stats.Z}::DOUBLE)"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text").join(table(spark, sf_dir, "labels"), "doc_id")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(labelled(spark, sf_dir), ~F.contains("text", F.lit("!!")) & ~F.contains("text", F.lit("&&&")), F.col("quality") == 1, ["lang"])


CONFUSION_SQL = """
WITH r AS (SELECT lang, NOT contains(text, '!!') AND NOT contains(text, '&&&') AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM r GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall FROM c"""


def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.intervals(labelled(spark, sf_dir), ["lang"], F.col("quality") == 1)


WILSON_SQL = f"""
WITH c AS (SELECT lang, count(*) FILTER (quality = 1) AS successes, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT *, successes / total::DOUBLE AS p, total::DOUBLE AS n FROM c)
SELECT lang, successes, total,
  round((p + {Z2} / (2 * n) - {stats.Z}::DOUBLE * sqrt((p * (1 - p) + {Z2} / (4 * n)) / n)) / (1 + {Z2} / n), 6) AS lower,
  round((p + {Z2} / (2 * n) + {stats.Z}::DOUBLE * sqrt((p * (1 - p) + {Z2} / (4 * n)) / n)) / (1 + {Z2} / n), 6) AS upper FROM p"""


def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.publication(labelled(spark, sf_dir), ~F.contains("text", F.lit("!!")), F.col("quality") == 1, ["source", "lang"], least=0.6, needed=5)
    return found.select("source", "lang", "published", "correct", F.round("lower", 6).alias("lower"), "powered", "passed")


PUBLICATION_SQL = f"""
WITH c AS (SELECT source, lang, count(*) FILTER (NOT contains(text, '!!')) AS published, count(*) FILTER (NOT contains(text, '!!') AND quality = 1) AS correct FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
p AS (SELECT *, correct / nullif(published, 0)::DOUBLE AS p, published::DOUBLE AS n FROM c),
w AS (SELECT *, (p + {Z2} / (2 * n) - {stats.Z}::DOUBLE * sqrt((p * (1 - p) + {Z2} / (4 * n)) / n)) / (1 + {Z2} / n) AS lo FROM p)
SELECT source, lang, published, correct, CASE WHEN published > 0 THEN round(lo, 6) END AS lower, published >= 5 AND coalesce(lo, 0) >= 0.6::DOUBLE AS powered, published >= 5 AND coalesce(lo, 0) >= 0.6::DOUBLE AND correct = published AS passed FROM w"""


def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"), F.min("o_totalprice").alias("least"), F.count_if(F.col("o_orderstatus") == "P").alias("n_open"))
    return evaluation.gates(o, [("not_empty", F.col("n") > 0), ("unique_keys", F.col("n") == F.col("n_keys")), ("prices_positive", F.col("least") > 0), ("none_open", F.col("n_open") == 0)])


GATE_SQL = """
WITH m AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, min(o_totalprice) AS least, count(*) FILTER (o_orderstatus = 'P') AS n_open FROM orders),
g AS (SELECT 'not_empty' AS gate, n > 0 AS passed FROM m UNION ALL SELECT 'unique_keys', n = n_keys FROM m UNION ALL SELECT 'prices_positive', least > 0 FROM m UNION ALL SELECT 'none_open', n_open = 0 FROM m)
SELECT gate, passed, (SELECT bool_and(passed) FROM g) AS go FROM g"""


def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("role"))
    return evaluation.match_counts(lines.where("s % 5 <> 0"), lines.where("k % 4 <> 0"), ["k", "s", "role"], ["role"])


MATCH_SQL = """
WITH p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s, l_returnflag AS role FROM lineitem WHERE l_suppkey % 5 <> 0),
t AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s, l_returnflag AS role FROM lineitem WHERE l_orderkey % 4 <> 0),
j AS (SELECT coalesce(p.role, t.role) AS role, p.k IS NOT NULL AS hp, t.k IS NOT NULL AS ht FROM p FULL JOIN t ON p.k = t.k AND p.s = t.s AND p.role = t.role),
c AS (SELECT role, count(*) FILTER (hp AND ht) AS tp, count(*) FILTER (NOT ht) AS fp, count(*) FILTER (NOT hp) AS fn FROM j GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall FROM c"""


def sole_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("domain"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").cast("string").alias("url"))
    return evaluation.sole_prediction(rows.where("score > 150000"), ["o_custkey"], "domain", "score", "url")


SOLE_SQL = """
WITH r AS (SELECT o_custkey, o_orderstatus AS domain, o_totalprice AS score, CAST(o_orderkey AS VARCHAR) AS url FROM orders WHERE o_totalprice > 150000)
SELECT * FROM r WHERE (SELECT count(DISTINCT domain) FROM r x WHERE x.o_custkey = r.o_custkey) = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, url) = 1"""


def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("priced_over_1000", F.col("o_totalprice") >= 1000), ("dated_1995_or_later", F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")), ("settled", F.col("o_orderstatus") != "P")]
    return evaluation.violations(table(spark, sf_dir, "orders"), "o_orderkey", rules)


VIOLATIONS_SQL = """
SELECT o_orderkey, 'priced_over_1000' AS violation FROM orders WHERE NOT o_totalprice >= 1000
UNION ALL SELECT o_orderkey, 'dated_1995_or_later' FROM orders WHERE NOT o_orderdate >= TIMESTAMP '1995-01-01'
UNION ALL SELECT o_orderkey, 'settled' FROM orders WHERE o_orderstatus = 'P'"""


def group_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("present"), "l_suppkey")
    return evaluation.group_resolution(rows, "l_orderkey", "present", "l_suppkey")


RESOLUTION_SQL = """
SELECT l_orderkey, count(*) AS n_labels, count(DISTINCT l_suppkey) AS n_records, count(DISTINCT l_suppkey) = 1 AS resolved FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 2"""


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return evidence.with_ttl(e, ["user_id", "event_type"], "ts", F.col("event_type"), {"click": 30, "view": 14, "purchase": 7}, other=1)


UPSERT_SQL = """
SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + to_days(CASE event_type WHEN 'click' THEN 30 WHEN 'view' THEN 14 WHEN 'purchase' THEN 7 ELSE 1 END) AS valid_until FROM events GROUP BY 1, 2"""


def merged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("label"))
    latest = lambda d: d.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("label", "event_id").alias("label"))
    return changes.upsert(latest(e.where("event_id < 6000 AND user_id % 3 <> 0")), latest(e.where("event_id >= 6000 AND user_id % 5 <> 0")), ["user_id"], ["first_seen"], ["last_seen"], ["label"])


MERGED_SQL = """
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS label FROM events),
a AS (SELECT user_id, min(ts) AS f, max(ts) AS l, arg_max(label, event_id) AS label FROM e WHERE event_id < 6000 AND user_id % 3 <> 0 GROUP BY 1),
b AS (SELECT user_id, min(ts) AS f, max(ts) AS l, arg_max(label, event_id) AS label FROM e WHERE event_id >= 6000 AND user_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, least(a.f, b.f) AS first_seen, greatest(a.l, b.l) AS last_seen, coalesce(nullif(b.label, ''), a.label) AS label FROM a FULL JOIN b ON a.user_id = b.user_id"""


def retire_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return changes.retire_others(e, ["user_id", "event_type"], [F.desc("event_id")])


RETIRE_SQL = "SELECT user_id, event_type, event_id, value, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1 THEN 'active' ELSE 'retired' END AS lifecycle FROM events"


def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "user_id", F.expr("CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'contradicted' ELSE 'transient' END").alias("outcome"), (F.col("event_id") % 2 == 0).alias("has_evidence"),
        F.col("ts").alias("at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("retry_after"), "event_id",
    )
    return evidence.current_facts(e, ["user_id"], ["event_id"])


FACTS_SQL = """
WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'contradicted' ELSE 'transient' END AS outcome, event_id % 2 = 0 AS ev, ts, event_id FROM events),
m AS (SELECT user_id, min(ts) FILTER (outcome = 'accepted') AS first_seen, max(ts) FILTER (outcome = 'accepted') AS last_accepted, max(event_id) FILTER (outcome = 'accepted') AS ok,
  max(event_id) FILTER (outcome = 'contradicted' AND ev) AS no, max(event_id) FILTER (outcome = 'transient') AS soft, arg_max(ts, event_id) FILTER (outcome = 'transient') AS soft_ts, arg_max(outcome, event_id) AS last_outcome FROM e GROUP BY 1)
SELECT user_id, first_seen, last_accepted, CASE WHEN ok IS NULL OR soft > ok THEN soft_ts + INTERVAL 1 DAY END AS retry_after, CASE WHEN no IS NOT NULL AND (ok IS NULL OR no > ok) THEN 'retired' ELSE 'active' END AS lifecycle, last_outcome FROM m"""


def attestation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return evidence.attestation_events(e, ["user_id"], ["event_id"], ["event_type"])


ATTESTATION_SQL = """
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT user_id, event_id, event_type, CASE WHEN prev IS NULL THEN 'created' ELSE 'replaced' END AS event FROM e WHERE prev IS NULL OR prev <> event_type"""


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    attempts = e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_at"))
    delay = stats.backoff_seconds(F.col("attempts"), 60, 86400)
    return attempts.select("user_id", "attempts", delay.alias("delay_s"), (F.col("last_at") + F.make_dt_interval(secs=delay)).alias("next_at"))


BACKOFF_SQL = """
WITH a AS (SELECT user_id, count(*) AS attempts, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1),
d AS (SELECT *, CAST(least(86400, 60 * pow(2, attempts - 1)) AS BIGINT) AS delay_s FROM a)
SELECT user_id, attempts, delay_s, last_at + to_seconds(delay_s) AS next_at FROM d"""


def claim_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    jobs = e.select(
        F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "error", "retry").otherwise("done").alias("status"), (F.col("event_id") % 10 == 3).alias("cancel_requested"),
        F.col("ts").alias("next_attempt_at"), (F.col("user_id") % 5).alias("priority"), (F.col("user_id") % 7).alias("provider"), (F.col("user_id") % 31).alias("domain"),
    )
    running = e.where("event_type = 'click' AND event_id % 50 = 0").select((F.col("user_id") % 7).alias("provider"), (F.col("user_id") % 31).alias("domain"))
    found = queue.claimable(jobs, running, F.lit("2024-01-20").cast("timestamp_ntz"), {"provider": 6, "domain": 3}, count=10)
    return found.select("job_id", "status", "priority", "provider", "domain", "next_attempt_at")


CLAIM_SQL = """
WITH j AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'error' THEN 'retry' ELSE 'done' END AS status, event_id % 10 = 3 AS c, ts AS next_attempt_at, user_id % 5 AS priority, user_id % 7 AS provider, user_id % 31 AS domain FROM events),
r AS (SELECT user_id % 7 AS provider, user_id % 31 AS domain FROM events WHERE event_type = 'click' AND event_id % 50 = 0),
t AS (SELECT * FROM j WHERE status IN ('queued', 'retry') AND NOT c AND next_attempt_at <= TIMESTAMP '2024-01-20' ORDER BY priority DESC, next_attempt_at, job_id LIMIT 100)
SELECT job_id, status, priority, provider, domain, next_attempt_at FROM t WHERE (SELECT count(*) FROM r WHERE r.provider = t.provider) < 6 AND (SELECT count(*) FROM r WHERE r.domain = t.domain) < 3
ORDER BY priority DESC, next_attempt_at, job_id LIMIT 10"""


def circuit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("provider"), "event_id", "event_type")
    return queue.circuits(e, "provider", ["event_id"], F.col("event_type").isin("error", "view"), 2)


CIRCUIT_SQL = """
WITH e AS (SELECT user_id % 40 AS provider, event_id, event_type IN ('error', 'view') AS failed FROM events),
k AS (SELECT provider, max(event_id) FILTER (NOT failed) AS ok FROM e GROUP BY 1)
SELECT e.provider, count(*) FILTER (failed AND (ok IS NULL OR event_id > ok)) AS failures, count(*) FILTER (failed AND (ok IS NULL OR event_id > ok)) >= 2 AS open FROM e JOIN k ON k.provider = e.provider GROUP BY 1"""


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'error' THEN 'retry' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'dead_letter' ELSE 'done' END").alias("status"), F.col("ts").alias("next_attempt_at"), (F.col("event_id") % 10 == 3).alias("cancel_requested")
    )
    return queue.queue_status(e, F.lit("2024-01-20").cast("timestamp_ntz"))


QUEUE_SQL = """
SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS active, count(*) FILTER (event_type IN ('view', 'error') AND ts <= TIMESTAMP '2024-01-20') AS ready,
  count(*) FILTER (event_type = 'purchase') AS dead_letters, count(*) FILTER (event_id % 10 = 3) AS cancel_requested FROM events"""


def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4 + 1).alias("n"))
    return queue.running_budget(e, ["user_id"], ["event_id"], "n", 100)


BUDGET_SQL = "SELECT user_id, event_id, event_id % 4 + 1 AS n, CAST(sum(event_id % 4 + 1) OVER w AS BIGINT) AS used, sum(event_id % 4 + 1) OVER w <= 100 AS granted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


def paced_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 13 % 5000 + F.col("event_id") * 100).alias("arrival_ms"))
    return queue.paced(e, "user_id", "event_id", "arrival_ms", 30000)


PACED_SQL = """
WITH e AS (SELECT user_id, event_id, event_id * 13 % 5000 + event_id * 100 AS arrival_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT user_id, event_id, arrival_ms, max(arrival_ms - n * 30000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + n * 30000 AS launch_ms FROM e"""

NAMES = {
    "confusion_metrics": CONFUSION_SQL, "wilson_by_group": WILSON_SQL, "publication_gate": PUBLICATION_SQL, "gate_table": GATE_SQL, "match_metrics": MATCH_SQL, "sole_prediction": SOLE_SQL,
    "row_violations": VIOLATIONS_SQL, "group_resolution": RESOLUTION_SQL, "upsert_merge": UPSERT_SQL, "merged_versions": MERGED_SQL, "retire_others": RETIRE_SQL, "current_facts": FACTS_SQL,
    "attestation_events": ATTESTATION_SQL, "backoff_schedule": BACKOFF_SQL, "claim_eligible": CLAIM_SQL, "circuit_state": CIRCUIT_SQL, "queue_status": QUEUE_SQL, "running_budget": BUDGET_SQL, "paced_launches": PACED_SQL,
}
QUERIES = {name: (globals()[name], sql) for name, sql in NAMES.items()}
