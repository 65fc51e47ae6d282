"""Rules over pages and search results, reviews, jobs and sets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, text, url
from ..functions.html import title
from ..operators import changes, evaluation, evidence, facets, matching, queue, sampling, web
from ..operators.harvest import venue_ids
from .common import LEADS_SQL, leads, table

_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"
BLOCKED, DIRECTORIES, SOCIAL = ["spam-farm"], ["example.net"], ["therin.example.com", "therha.example.com"]


def website_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = url.website_kind(F.col("url"), BLOCKED, DIRECTORIES, SOCIAL)
    publisher = url.publisher_class(F.col("url"), {"directory": ["example.net"], "editorial": ["example.org"]}, r"^(?:blog|m)\.")
    quality = url.website_quality(F.col("url"), "spam|net$")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind"), publisher.alias("publisher"), quality.alias("quality")).agg(F.count("*").alias("n"))


KINDS_SQL = rf"""
WITH h AS (SELECT url, {_HOST} AS host FROM pages), d AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h)
SELECT CASE WHEN contains(host, 'spam-farm') THEN 'blocked' WHEN host = 'example.net' OR suffix(host, '.example.net') THEN 'directory'
    WHEN host IN ('therin.example.com', 'therha.example.com') OR suffix(host, '.therin.example.com') OR suffix(host, '.therha.example.com') THEN 'social' ELSE 'official' END AS kind,
  CASE WHEN domain = 'example.net' THEN 'directory' WHEN domain = 'example.org' THEN 'editorial' WHEN regexp_matches(host, '^(blog|m)\.') THEN 'menu_mirror' ELSE 'uncertain' END AS publisher,
  CASE WHEN regexp_matches(host, 'spam|net$') THEN 1 WHEN starts_with(url, 'https://') THEN 4 ELSE 3 END AS quality, count(*) AS n FROM d GROUP BY 1, 2, 3"""


def file_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.lit(30 * 86400) - F.col("event_id") * 200
    gone = filters.expired(age, F.col("event_type"), {"view": 30 * 86400, "click": 14 * 86400, "error": 86400})
    return table(spark, sf_dir, "events").groupBy("event_type", gone.alias("expired")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


RETENTION_SQL = """
SELECT event_type, coalesce(2592000 - event_id * 200 >= CASE event_type WHEN 'view' THEN 2592000 WHEN 'click' THEN 1209600 WHEN 'error' THEN 86400 END, false) AS expired, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2"""


def filtered_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    asked = {"status": ["F", "O", "P"], "segment": ["BUILDING", "NO SUCH"], "region": [], "priority": ["1-URGENT", "2-HIGH"]}
    known = {"status": ["F", "O", "P"], "segment": ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"], "region": ["EUROPE"], "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    rule = filters.all_of([*(filters.chosen(F.col(k), v, known[k]) for k, v in asked.items()), F.col("o_totalprice") >= 50000, None])
    return rows.where(rule).select("o_orderkey", "status", "segment", "priority", "o_totalprice")


FILTERED_SQL = f"WITH {LEADS_SQL} SELECT o_orderkey, status, segment, priority, o_totalprice FROM leads WHERE segment = 'BUILDING' AND priority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000"


def page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.page_kind(title(F.col("html")), F.col("url"), "^the ", "thtion", "ereha|enst")
    verdict = web.admission(found, F.filter(found, lambda r: r == "boilerplate"), ["list_page"], ["near_me_page"])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("reasons"), verdict.alias("verdict"))


PAGE_REASONS_SQL = r"""
WITH t AS (SELECT page_id, url, lower(coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), '')) AS t FROM pages),
r AS (SELECT page_id, list_filter([CASE WHEN regexp_matches(t, '^the ') THEN 'list_page' END, CASE WHEN regexp_matches(t, 'thtion') THEN 'near_me_page' END, CASE WHEN regexp_matches(t, 'ereha|enst') THEN 'boilerplate' END,
  CASE WHEN regexp_matches(url, '[?&](q|query|s)=') THEN 'search_page' END], lambda x: x IS NOT NULL) AS r FROM t)
SELECT page_id, array_to_string(r, ',') AS reasons, CASE WHEN list_contains(r, 'boilerplate') THEN 'contradicted' WHEN NOT list_contains(r, 'list_page') THEN 'no_identity' WHEN NOT list_contains(r, 'near_me_page') THEN 'no_place' ELSE 'admitted' END AS verdict FROM r"""


def garbage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("Via Roma "), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 10 == 0, "x").otherwise(F.col("p_name"))
    ok = web.not_garbage(name, F.col("p_brand"), F.col("p_size") > 25, "red|blue", ["Brand#11", "Brand#21"])
    return table(spark, sf_dir, "part").groupBy("p_brand", ok.alias("kept")).agg(F.count("*").alias("n"))


GARBAGE_SQL = r"""
WITH n AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN 'Via Roma ' || p_partkey WHEN p_partkey % 10 = 0 THEN 'x' ELSE p_name END AS name FROM part)
SELECT p_brand, length(lower(trim(name))) BETWEEN 3 AND 55 AND NOT regexp_matches(lower(trim(name)), 'red|blue') AND NOT regexp_matches(lower(trim(name)), '^(via|viale|piazza|corso|strada)\s.*\d') AND (p_size > 25 OR p_brand NOT IN ('Brand#11', 'Brand#21')) AS kept, count(*) AS n FROM n GROUP BY 1, 2"""


def automatic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = ["page_exact_name", "branded_domain", "page_municipality_match", "page_phone_match", "wrong_town"]
    found = filters.reasons([(n, k % p != 0) if p != 11 else (n, k % 11 == 0) for n, p in zip(names, (2, 3, 5, 7, 11))])
    cols = {"assessment_state": F.when(k % 13 == 0, "weak").otherwise("strongly_correlated"), "crawl_outcome": F.when(F.col("o_orderstatus") != "P", "succeeded"), "candidate_kind": F.lit("official"), "final_kind": F.when(k % 17 == 0, "directory").otherwise("official")}
    failures = web.first_party_failures(cols, found, ["wrong_town"])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(failures, ",").alias("failures"))
    return rows.groupBy("failures").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


AUTOMATIC_SQL = """
WITH r AS (SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'not_strongly_correlated' END, CASE WHEN o_orderstatus = 'P' THEN 'crawl_not_succeeded' END, CASE WHEN o_orderkey % 17 = 0 THEN 'unsupported_publisher' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'venue_name_not_compatible' END, CASE WHEN o_orderkey % 3 = 0 THEN 'publisher_domain_not_venue_branded' END, CASE WHEN o_orderkey % 5 = 0 THEN 'municipality_not_compatible' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'high_specificity_identity_missing' END, CASE WHEN o_orderkey % 11 = 0 THEN 'contradiction_present' END], lambda x: x IS NOT NULL), ',') AS failures FROM orders)
SELECT failures, count(*) AS n, min(k) AS first_key FROM r GROUP BY 1"""


def facts_of(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("venue_id"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("domain"), k.alias("fact_id"), F.when(F.col("o_orderstatus") == "P", "review").otherwise("accepted").alias("decision"),
        F.when(k % 5 == 0, "retired").otherwise("active").alias("lifecycle"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"), F.when(k % 4 == 0, F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("retry_after"),
    )


FACTS_SQL = "facts AS (SELECT o_custkey AS venue_id, 'd' || o_orderkey % 3 AS domain, o_orderkey AS fact_id, CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'accepted' END AS decision, CASE WHEN o_orderkey % 5 = 0 THEN 'retired' ELSE 'active' END AS lifecycle, o_orderdate + INTERVAL 30 DAY AS valid_until, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 7 DAY END AS retry_after FROM orders)"


def reusable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1996-06-01").cast("timestamp_ntz")
    c = F.col("c_custkey")
    attestations = table(spark, sf_dir, "customer").select(
        c.alias("venue_id"), F.concat(F.lit("d"), (c % 3).cast("string")).alias("publisher_domain"), F.when(c % 7 == 0, "revoked").otherwise("active").alias("lifecycle"), F.lit("verified").alias("decision"),
        F.lit("1996-01-01").cast("timestamp_ntz").alias("reviewed_at"), F.when(c % 2 == 0, F.lit("1997-01-01")).otherwise("1996-06-01").cast("timestamp_ntz").alias("expires_at"),
    )
    found = evidence.reusable(facts_of(spark, sf_dir), attestations, at)
    return found.groupBy("attested", "due").agg(F.count("*").alias("n"), F.sum("fact_id").alias("sum_ids"))


REUSABLE_SQL = f"""WITH {FACTS_SQL},
f AS (SELECT fact_id, EXISTS (SELECT 1 FROM customer WHERE c_custkey = venue_id AND 'd' || c_custkey % 3 = domain AND c_custkey % 7 <> 0 AND c_custkey % 2 = 0) AS attested,
  coalesce(TIMESTAMP '1996-06-01' >= valid_until, false) OR coalesce(TIMESTAMP '1996-06-01' >= retry_after, false) AS due FROM facts WHERE lifecycle = 'active' AND decision = 'accepted')
SELECT attested, due, count(*) AS n, CAST(sum(fact_id) AS BIGINT) AS sum_ids FROM f GROUP BY 1, 2"""


def retired_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = facts_of(spark, sf_dir).groupBy("venue_id", "domain").agg(F.max("lifecycle").alias("lifecycle"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("venue_id"), F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("source"), F.lit("active").alias("lifecycle"))
    after = evidence.cascade(lines, sites, "domain", "source")
    closed = evidence.closed(after, table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("venue_id")))
    return closed.groupBy("lifecycle", "source").agg(F.count("*").alias("n"))


DEPENDENTS_SQL = f"""WITH {FACTS_SQL},
s AS (SELECT venue_id, domain, max(lifecycle) AS lifecycle FROM facts GROUP BY 1, 2),
l AS (SELECT o_custkey AS venue_id, 'd' || l_partkey % 3 AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN s.lifecycle = 'retired' OR l.venue_id % 50 = 0 THEN 'retired' ELSE 'active' END AS lifecycle, source, count(*) AS n FROM l LEFT JOIN s ON s.venue_id = l.venue_id AND s.domain = source GROUP BY 1, 2"""


def decisions_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(c.alias("venue_id"), F.when(c % 3 == 0, "verified").otherwise("unchecked").alias("status"), F.when(c % 3 == 0, "a").alias("domain"))
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'error')")
    decisions = e.select(F.col("user_id").alias("venue_id"), "event_id", F.when(F.col("event_type") == "click", "approve").otherwise("reject").alias("decision"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("domain"))
    return evidence.review_overlay(base, decisions, ["event_id"])


OVERLAY_SQL = """
WITH d AS (SELECT user_id AS v, event_id, event_type = 'click' AS yes, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS domain FROM events WHERE event_type IN ('click', 'error')),
y AS (SELECT v, arg_max(domain, event_id) AS dom, max(event_id) AS last_yes FROM d WHERE yes GROUP BY 1),
b AS (SELECT c_custkey AS v, CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'unchecked' END AS status, coalesce(dom, CASE WHEN c_custkey % 3 = 0 THEN 'a' END) AS held, last_yes FROM customer LEFT JOIN y ON v = c_custkey),
n AS (SELECT b.v, bool_or(d.domain = held) AS lost, count(*) AS n FROM b JOIN d ON d.v = b.v AND NOT yes AND (last_yes IS NULL OR event_id > last_yes) GROUP BY 1)
SELECT b.v AS venue_id, CASE WHEN held IS NOT NULL AND NOT coalesce(lost, false) THEN 'verified' WHEN coalesce(n, 0) > 0 THEN 'rejected' ELSE status END AS status FROM b LEFT JOIN n ON n.v = b.v"""


def next_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_of(spark, sf_dir).select(F.lpad(F.col("venue_id").cast("string"), 8, "0").alias("venue_id"), "domain", "fact_id", "decision")
    decided = f.where("fact_id % 6 = 0")
    verified = f.where("fact_id % 40 = 1").select("venue_id")
    return evidence.next_for_review(f.select("venue_id", "domain").distinct(), decided, verified, ("00000300", "d1"))


NEXT_SQL = f"""WITH {FACTS_SQL}, f AS (SELECT lpad(CAST(venue_id AS VARCHAR), 8, '0') AS venue_id, domain, fact_id FROM facts),
r AS (SELECT DISTINCT venue_id, domain FROM f WHERE (venue_id, domain) NOT IN (SELECT (venue_id, domain) FROM f WHERE fact_id % 6 = 0) AND venue_id NOT IN (SELECT venue_id FROM f WHERE fact_id % 40 = 1) AND (venue_id > '00000300' OR (venue_id = '00000300' AND domain > 'd1')))
SELECT venue_id, domain, (SELECT count(*) FROM r) AS remaining FROM r ORDER BY 1, 2 LIMIT 1"""


def jobs_of(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        k.alias("job_id"), F.when(k % 3 == 0, "running").otherwise("queued").alias("status"), (k % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), (k % 10 == 6).alias("cancel_requested"), F.col("ts").alias("next_attempt_at"),
        F.when(k % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"), (F.col("user_id") % 7).alias("provider"), "event_type",
    )


JOBS_SQL = "jobs AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'queued' END AS status, event_id % 4 AS attempts, event_id % 10 = 6 AS cancel, ts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS lease, user_id % 7 AS provider, event_type FROM events)"


def lease_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = queue.recovered(jobs_of(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz"), 60, 3600)
    return found.groupBy("status").agg(F.count("*").alias("n"), F.max("next_attempt_at").alias("last_attempt_at"), F.count("lease_expires_at").alias("n_leased"))


LEASE_SQL = f"""WITH {JOBS_SQL}, l AS (SELECT *, status = 'running' AND lease <= TIMESTAMP '2024-01-20' AS lapsed FROM jobs)
SELECT CASE WHEN NOT lapsed THEN status WHEN cancel THEN 'cancelled' WHEN attempts >= 3 THEN 'dead_letter' ELSE 'retry' END AS status, count(*) AS n,
  max(CASE WHEN lapsed THEN TIMESTAMP '2024-01-20' + to_seconds(CAST(least(3600, 60 * pow(2, attempts - 1)) AS BIGINT)) ELSE ts END) AS last_attempt_at, count(lease) FILTER (NOT lapsed) AS n_leased
FROM (SELECT *, coalesce(lapsed, false) AS x FROM (SELECT * REPLACE (coalesce(lapsed, false) AS lapsed) FROM l)) GROUP BY 1"""


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_of(spark, sf_dir)
    outcome = F.create_map(F.lit("click"), F.lit("complete"), F.lit("error"), F.lit("fail"), F.lit("view"), F.lit("heartbeat"), F.lit("purchase"), F.lit("cancel"))
    at = F.col("next_attempt_at") + F.expr("INTERVAL 5 MINUTES")
    outcomes = jobs.where("status = 'running'").select("job_id", F.try_element_at(outcome, F.col("event_type")).alias("outcome"), at.alias("at"), (at + F.expr("INTERVAL 1 HOUR")).alias("lease")).where("outcome IS NOT NULL")
    found = queue.after_outcome(jobs, outcomes, 60, 3600)
    return found.groupBy("status", "event_type").agg(F.count("*").alias("n"), F.max("next_attempt_at").alias("last_attempt_at"), F.max("lease_expires_at").alias("last_lease"))


OUTCOMES_SQL = f"""WITH {JOBS_SQL},
o AS (SELECT *, CASE WHEN status = 'running' THEN CASE event_type WHEN 'click' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'cancel' END END AS o FROM jobs),
r AS (SELECT event_type, CASE WHEN o = 'complete' THEN 'completed' WHEN o = 'fail' AND attempts >= 3 THEN 'dead_letter' WHEN o = 'fail' THEN 'retry' WHEN o = 'cancel' THEN 'cancelled' ELSE status END AS status,
  CASE WHEN o = 'fail' THEN ts + INTERVAL 5 MINUTE + to_seconds(CAST(least(3600, 60 * pow(2, attempts - 1)) AS BIGINT)) ELSE ts END AS next_at, CASE WHEN o = 'heartbeat' THEN ts + INTERVAL 65 MINUTE WHEN o IS NULL THEN lease END AS lease FROM o)
SELECT status, event_type, count(*) AS n, max(next_at) AS last_attempt_at, max(lease) AS last_lease FROM r GROUP BY 1, 2"""


def quota_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 11 == 0, 402).when(k % 5 == 0, 429).when(k % 7 == 0, 500).otherwise(200)
    message = F.when(k % 10 == 0, "Monthly quota used").when(k % 13 == 0, "Too many requests").when(k % 17 == 0, "insufficient credit")
    signal = queue.quota_signal(status, message, F.when(k % 20 == 0, 0))
    outcome = web.search_outcome(status, k % 19 != 0, k % 23 != 0, k % 4)
    return table(spark, sf_dir, "events").groupBy(signal.alias("signal"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


SIGNALS_SQL = """
WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 11 = 0 THEN 402 WHEN event_id % 5 = 0 THEN 429 WHEN event_id % 7 = 0 THEN 500 ELSE 200 END AS s, lower(coalesce(CASE WHEN event_id % 10 = 0 THEN 'Monthly quota used' WHEN event_id % 13 = 0 THEN 'Too many requests' WHEN event_id % 17 = 0 THEN 'insufficient credit' END, '')) AS m FROM events)
SELECT CASE WHEN s = 402 OR regexp_matches(m, 'quota (exceeded|exhausted)|insufficient (credit|funds)|monthly limit') THEN 'exhausted' WHEN s = 429 AND k % 20 = 0 AND regexp_matches(m, 'month|quota') THEN 'exhausted' WHEN s = 429 OR regexp_matches(m, 'rate.?limit|too many requests') THEN 'rate_limited' ELSE 'none' END AS signal,
  CASE WHEN s IN (402, 429) THEN 'quota' WHEN k % 19 = 0 OR s >= 500 THEN 'transient' WHEN s >= 400 THEN 'rejected' WHEN k % 23 = 0 THEN 'unparsable' WHEN k % 4 = 0 THEN 'empty' ELSE 'results' END AS outcome, count(*) AS n FROM e GROUP BY 1, 2"""


def quota_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = spark.createDataFrame([(1, "exhausted", "2024-02-01"), (3, "rate_limited", "2024-01-05"), (5, "none", "2024-03-01")], "provider long, signal string, at string").select("provider", "signal", F.col("at").cast("timestamp_ntz").alias("resume_at"))
    found = queue.paused_for_quota(jobs_of(spark, sf_dir), signals)
    return found.groupBy("provider", "status").agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"), F.max("next_attempt_at").alias("last_attempt_at"))


PAUSE_SQL = f"""WITH {JOBS_SQL}, p AS (SELECT *, status = 'running' AND provider IN (1, 3) AS hit FROM jobs)
SELECT provider, CASE WHEN hit THEN 'queued' ELSE status END AS status, count(*) AS n, CAST(sum(CASE WHEN hit THEN greatest(attempts - 1, 0) ELSE attempts END) AS BIGINT) AS attempts,
  max(CASE WHEN NOT hit THEN ts WHEN provider = 1 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-05' END) AS last_attempt_at FROM p GROUP BY 1, 2"""


def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    rows = table(spark, sf_dir, "part").select(
        k, text.words_only(name).alias("name"), F.lit("roma").alias("place"), F.concat_ws(" ", F.when(k % 2 == 0, text.words_only(name)).otherwise(F.element_at(F.split(name, " "), 1)), F.when(k % 3 == 0, "roma")).alias("haystack"),
        F.when(k % 5 == 0, F.element_at(F.split(name, " "), 2)).otherwise("none").alias("domain_text"), (k % 7 == 0).alias("same_domain"), (k % 4 == 0).alias("is_pdf"), (k % 6 == 0).alias("has_food"), (k % 8 == 0).alias("has_menu"), (k % 9 == 0).alias("fallback"),
    )
    return web.search_score(rows).select("p_partkey", "score", "outcome", "confidence", F.array_join("reasons", ",").alias("reasons"))


_TOKENS = f"list_filter(string_split(p_name, ' '), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(w) for w in text.GENERIC_WORDS)}))"
SCORES_SQL = f"""
WITH p AS (SELECT p_partkey AS k, p_name, {_TOKENS} AS t, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[1] END || CASE WHEN p_partkey % 3 = 0 THEN ' roma' ELSE '' END AS h, CASE WHEN p_partkey % 5 = 0 THEN string_split(p_name, ' ')[2] ELSE 'none' END AS d FROM part),
r AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(' ' || h || ' ', ' ' || x || ' '))) / len(t) ELSE 0 END AS ratio, length(p_name) >= 4 AND contains(h, p_name) AS exact, contains(h, 'roma') AS place, len(list_filter(t, lambda x: contains(d, x))) > 0 AS branded FROM p),
s AS (SELECT *, CAST(round(ratio * 28) AS INT) + CASE WHEN k % 7 = 0 THEN 55 ELSE 0 END + CASE WHEN exact THEN 34 ELSE 0 END + CASE WHEN place THEN 16 ELSE 0 END + CASE WHEN branded THEN 18 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 8 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 6 ELSE 0 END
  - CASE WHEN len(t) = 0 THEN 30 ELSE 0 END - CASE WHEN k % 9 = 0 AND k % 7 <> 0 THEN 8 ELSE 0 END AS score FROM r)
SELECT k AS p_partkey, score, CASE WHEN (exact OR ratio >= 0.5 OR branded OR k % 7 = 0) AND CASE WHEN k % 7 = 0 THEN score >= 45 ELSE (place OR k % 6 = 0 OR k % 8 = 0 OR k % 4 = 0) AND score >= 52 END THEN 'accepted' WHEN score >= 40 THEN 'review' ELSE 'rejected' END AS outcome,
  CASE WHEN score >= 82 THEN 'high' WHEN score >= 62 THEN 'medium' ELSE 'low' END AS confidence,
  array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'official_domain' END, CASE WHEN exact THEN 'exact_name' END, CASE WHEN place THEN 'location' END, CASE WHEN branded THEN 'branded_domain' END, CASE WHEN k % 6 = 0 THEN 'restaurant_context' END, CASE WHEN k % 8 = 0 THEN 'menu_context' END, CASE WHEN k % 4 = 0 THEN 'pdf' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"""


def resource_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    roles = F.array(*[F.lit(r) for r in ("menu", "drinks", "menu_image", "booking", "order")])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("score"))
    rows = rows.select("l_orderkey", F.element_at(roles, (k % 5 + 1).cast("int")).alias("role"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"), "score", F.concat(F.lit("https://x.example/"), F.lpad(k.cast("string"), 8, "0")).alias("target"))
    return web.diverse_top(rows, ["l_orderkey"], 3, most_images=1)


_ROLE = "list_extract(['menu', 'drinks', 'menu_image', 'booking', 'order'], l_partkey % 5 + 1)"
RANKING_SQL = f"""
WITH r AS (SELECT l_orderkey, {_ROLE} AS role, CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CAST(sum(l_quantity) AS BIGINT) AS score, 'https://x.example/' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS target, 3 - l_partkey % 3 AS c FROM lineitem GROUP BY l_orderkey, l_partkey),
k AS (SELECT *, CASE role WHEN 'menu' THEN 7 WHEN 'drinks' THEN 6 WHEN 'order' THEN 5 WHEN 'booking' THEN 4 ELSE 2 END AS rr FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, role ORDER BY c DESC, score DESC, target) AS n FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN n > 1 THEN 1 ELSE 0 END, rr DESC, c DESC, score DESC, target) AS place FROM n WHERE role <> 'menu_image' OR n <= 1)
SELECT l_orderkey, role, confidence, score, target, place FROM p WHERE place <= 3"""


def resource_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k, (k % 7 != 0).alias("ok"), F.when(k % 13 == 0, 404).otherwise(200).alias("status"), F.when(k % 3 != 0, "menu").when(k % 2 == 0, "drinks").alias("role"), F.lit("menu").alias("expected_role"),
        F.when(k % 5 == 0, "stale").when(k % 4 == 0, "review").otherwise("current").alias("freshness"), (k % 6 != 0).alias("same_site"), (k % 11 == 0).alias("other_branch"),
    )
    return web.validated_resource(rows).groupBy("decision", "reason").agg(F.count("*").alias("n"))


VALIDATION_SQL = """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'menu' WHEN o_orderkey % 2 = 0 THEN 'drinks' END AS role FROM orders),
d AS (SELECT CASE WHEN k % 7 = 0 OR k % 13 = 0 THEN 'fetch_failed' WHEN k % 11 = 0 THEN 'other_branch' WHEN k % 5 = 0 THEN 'stale' WHEN role IS NULL THEN 'no_role_evidence' WHEN role <> 'menu' THEN 'role_differs' WHEN k % 4 = 0 THEN 'dated' WHEN k % 6 = 0 THEN 'off_site' END AS reason FROM r)
SELECT CASE WHEN reason IS NULL THEN 'accepted' WHEN reason IN ('role_differs', 'dated', 'off_site') THEN 'review' ELSE 'rejected' END AS decision, reason, count(*) AS n FROM d GROUP BY 1, 2"""


def resolved_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("venue"), F.when(k % 9 == 0, "attested").when(k % 4 == 0, "source").otherwise("search").alias("origin"), k.alias("position"), F.when(k % 6 == 0, "accepted").otherwise("rejected").alias("outcome"), k.cast("string").alias("url"))
    return web.resolved_sites(attempts, "venue", 4)


RESOLVED_SQL = """
WITH a AS (SELECT o_custkey AS venue, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders),
b AS (SELECT venue, min(n) FILTER (k % 6 = 0) AS hit, max(n) AS made, arg_min(CAST(k AS VARCHAR), n) FILTER (k % 6 = 0) AS website FROM a WHERE n <= 4 GROUP BY 1)
SELECT venue, website, coalesce(hit, made) AS attempts, CASE WHEN hit IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM b"""


def venue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    v = c.select(F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("town"), F.lit("TV").alias("province"), F.when(F.col("c_custkey") % 2 == 0, F.lit("31000")).alias("postcode"), F.when(F.col("c_custkey") % 3 == 0, F.lit("0422 1")).alias("phone"))
    return web.site_queries(v).select("venue_id", F.col("n").cast("long").alias("n"), "query")


VENUE_QUERIES_SQL = """
WITH q AS (SELECT c_custkey AS venue_id, list_filter(['"' || c_name || '" ' || c_mktsegment, '"' || c_name || '" ' || c_mktsegment || ' TV', CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || '" 31000' END, CASE WHEN c_custkey % 3 = 0 THEN '"' || c_name || '" 0422 1' END], lambda x: x IS NOT NULL) AS q FROM customer)
SELECT venue_id, unnest(range(len(q))) AS n, unnest(q) AS query FROM q"""


def reviewer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    decisions = o.where("o_orderkey % 5 <> 0").select("o_orderkey", (F.col("o_totalprice") > 120000).alias("accepted"))
    truth = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_right"))
    return evaluation.reviewer_audit(decisions, truth, "o_orderkey", F.col("accepted"), F.col("is_right"))


AUDIT_SQL = """
WITH j AS (SELECT o_orderstatus = 'F' AS r, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice > 120000 END AS a FROM orders WHERE o_orderkey % 2 = 0)
SELECT CASE WHEN coalesce(a, false) AND NOT r THEN 'accepted_wrong' WHEN a IS NULL AND r THEN 'missed_accept' WHEN NOT a AND r THEN 'false_rejection' ELSE 'right' END AS kind, count(*) AS n FROM j GROUP BY 1"""


def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return evaluation.policy_replay(o.select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_totalprice") < 90000, F.col("o_orderstatus"))


REPLAY_SQL = "SELECT CASE WHEN o_totalprice < 90000 THEN 'retain' ELSE 'reject' END AS policy, o_orderstatus AS label, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2"


def version_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_returnflag", "l_linestatus", "l_linenumber"]
    a, b = lines.where("l_orderkey % 2 = 0").select(*columns), lines.select(*columns)
    return changes.same_rows(a, b).groupBy("l_returnflag", "l_linestatus", "l_linenumber", "side").agg(F.count("*").alias("n"))


DIFFERENCE_SQL = """
SELECT l_returnflag, l_linestatus, l_linenumber, 'right' AS side, count(*) AS n FROM lineitem WHERE l_orderkey % 2 <> 0 GROUP BY 1, 2, 3"""


def harvested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    nested = F.to_json(F.struct(F.struct(F.concat(F.lit("venue:"), k.cast("string")).alias("venue_id"), F.array(F.struct(F.concat(F.lit("venue:x"), (k % 50).cast("string")).alias("canonical_venue_id"))).alias("rows")).alias("a"), F.lit("venue:no").alias("other")))
    return venue_ids(table(spark, sf_dir, "events").select(nested.alias("json")), "json")


HARVEST_SQL = "SELECT 'venue:' || event_id AS venue_id FROM events UNION SELECT 'venue:x' || event_id % 50 FROM events"


def outcome_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facets.histogram_map(table(spark, sf_dir, "events").withColumn("provider", F.col("user_id") % 7), ["provider"], "event_type")
    return found.select("provider", F.array_join(F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("outcomes"))


MAPS_SQL = "SELECT provider, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS outcomes FROM (SELECT user_id % 7 AS provider, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"


def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rolled = o.rollup("o_orderpriority").agg(F.count("*").alias("calls"), F.count_if(F.col("o_orderstatus") == "P").alias("invalid"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.countDistinct("o_orderstatus").alias("n_models"), F.grouping("o_orderpriority").cast("int").alias("is_total"))
    return rolled.withColumnRenamed("o_orderpriority", "stage")


TOTALS_SQL = "SELECT o_orderpriority AS stage, count(*) AS calls, count(*) FILTER (o_orderstatus = 'P') AS invalid, round(sum(o_totalprice), 2) AS cost, count(DISTINCT o_orderstatus) AS n_models, CAST(grouping(o_orderpriority) AS INT) AS is_total FROM orders GROUP BY ROLLUP (o_orderpriority)"


def change_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: table(spark, sf_dir, t).agg(F.concat_ws("/", F.max(c).cast("string"), F.count("*").cast("string")).alias("s")).scalar()
    return spark.range(1).select(F.concat_ws("|", one("orders", "o_orderkey"), one("customer", "c_custkey"), one("events", "event_id")).alias("stamp"))


STAMP_SQL = "SELECT (SELECT max(o_orderkey) || '/' || count(*) FROM orders) || '|' || (SELECT max(c_custkey) || '/' || count(*) FROM customer) || '|' || (SELECT max(event_id) || '/' || count(*) FROM events) AS stamp"


def first_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return matching.with_first(c, o, ["c_custkey"], ["o_orderkey"], ["o_orderkey", "o_totalprice"])


PARTNERS_SQL = """
SELECT c_custkey, c_name, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, count(o_orderkey) AS n_partners FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1, 2"""


def strict_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region_key")
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "region_key")
    return matching.strict_lookup(n, r, "region_key").select("n_nationkey", "n_name", "region_key", "r_name")


STRICT_SQL = "SELECT n_nationkey, n_name, n_regionkey AS region_key, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def phone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(F.when(k % 3 == 0, "+39 ").when(k % 3 == 1, "39").otherwise(""), F.lit("0422-"), F.lpad((k * 7919 % 100000).cast("string"), 6, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.phone_key(raw).alias("phone"), text.short_hash(raw).alias("hash"), text.slug(F.concat_ws(" ", F.lit("Caffè"), "c_name", "c_mktsegment")).alias("slug"))


PHONE_SQL = r"""
WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+39 ' WHEN 1 THEN '39' ELSE '' END || '0422-' || lpad(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 6, '0') AS raw, c_name, c_mktsegment FROM customer),
d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM r)
SELECT c_custkey, CASE WHEN length(d) > 10 AND starts_with(d, '39') THEN substr(d, 3) ELSE d END AS phone, left(sha256(raw), 8) AS hash,
  'caffe-' || regexp_replace(lower(c_name || '-' || c_mktsegment), '[^a-z0-9]+', '-', 'g') AS slug FROM d"""


def text_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cut = text.budgeted(F.col("text"), 400, 200)
    titled = text.title_case(F.translate("text", "ß", "s"))
    return d.select("doc_id", F.length(cut).cast("long").alias("n_kept"), F.sha2(cut, 256).alias("kept_sha"), F.sha2(titled, 256).alias("title_sha"))


BUDGETS_SQL = """
WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 400) || ' […] ' || right(text, 200) END AS c, translate(text, 'ß', 's') AS t FROM documents)
SELECT doc_id, length(c) AS n_kept, sha256(c) AS kept_sha, sha256(array_to_string(list_transform(string_split(t, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')) AS title_sha FROM c"""


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("uploaded_at")).agg(F.max("o_orderkey").alias("built_at"), F.count("*").alias("n"))
    return changes.keep_newest(v, [F.desc("uploaded_at"), F.desc("built_at")], 2)


VERSIONS_SQL = "SELECT CAST(o_orderdate AS DATE) AS uploaded_at, max(o_orderkey) AS built_at, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC, 2 DESC LIMIT 2"


def selection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("venue"), F.col("o_orderstatus").alias("region"))
    barred = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("venue"))
    return sampling.selection_faults(chosen, "venue", "region", 20, barred)


SELECTION_SQL = """
WITH s AS (SELECT o_custkey AS venue, o_orderstatus AS region FROM orders)
SELECT 'duplicate' AS fault, CAST(venue AS VARCHAR) AS of FROM s GROUP BY venue HAVING count(*) > 1
UNION ALL SELECT 'excluded', CAST(venue AS VARCHAR) FROM s WHERE venue IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
UNION ALL SELECT 'count', region FROM s GROUP BY region HAVING count(*) <> 20"""

NAMES = {
    "website_kinds": KINDS_SQL, "file_retention": RETENTION_SQL, "filtered_leads": FILTERED_SQL, "page_reasons": PAGE_REASONS_SQL, "garbage_names": GARBAGE_SQL, "automatic_rule": AUTOMATIC_SQL, "reusable_evidence": REUSABLE_SQL,
    "retired_dependents": DEPENDENTS_SQL, "decisions_overlay": OVERLAY_SQL, "next_review": NEXT_SQL, "lease_recovery": LEASE_SQL, "job_outcomes": OUTCOMES_SQL, "quota_signals": SIGNALS_SQL, "quota_pause": PAUSE_SQL,
    "search_scores": SCORES_SQL, "resource_ranking": RANKING_SQL, "resource_validation": VALIDATION_SQL, "resolved_sites": RESOLVED_SQL, "venue_queries": VENUE_QUERIES_SQL, "reviewer_audit": AUDIT_SQL, "policy_replay": REPLAY_SQL,
    "version_difference": DIFFERENCE_SQL, "harvested_ids": HARVEST_SQL, "outcome_maps": MAPS_SQL, "stage_totals": TOTALS_SQL, "change_stamp": STAMP_SQL, "first_partners": PARTNERS_SQL, "strict_regions": STRICT_SQL,
    "phone_keys": PHONE_SQL, "text_budgets": BUDGETS_SQL, "snapshot_versions": VERSIONS_SQL, "selection_faults": SELECTION_SQL,
}
QUERIES = {name: (globals()[name], sql) for name, sql in NAMES.items()}
