"""Contacts, activities, work lists, snapshots, and further scalar rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, html, stats, text
from ..operators import clustering, crm, evaluation, evidence, history, matching, queue, sampling, web
from .common import LEADS_SQL, leads, table
from .place_queries import projected
from .rule_queries import FACTS_SQL, facts_of


def contacts_of(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), k.alias("venue_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"), F.date_add(F.lit("1996-01-01").cast("date"), (k % 700).cast("int")).alias("updated_on"))


def pipeline_of(spark, sf_dir):
    k = F.col("o_custkey")
    last = table(spark, sf_dir, "orders").groupBy(k.alias("venue_id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"), F.max("o_orderdate").alias("d"))
    stage = F.when(F.col("p") == "1-URGENT", "won").when(F.col("p") == "2-HIGH", "lost").when(F.col("p") == "3-MEDIUM", "demo").otherwise("contacted")
    return last.select("venue_id", stage.alias("stage"), F.when(F.col("venue_id") % 3 != 0, F.to_date("d")).alias("next_action_on"))


def crm_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    stage = F.when(p == "1-URGENT", "won").when(p == "2-HIGH", "lost").when(p == "3-MEDIUM", "demo").otherwise("contacted")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("venue_id"), F.when(F.col("o_orderkey") % 2 == 0, "stage").otherwise("call").alias("kind"), stage.alias("stage_to"), F.to_date("o_orderdate").alias("happened_on"), (F.col("o_orderkey") % 1000).alias("contact_id"))


CRM_SQL = """
contacts AS (SELECT c_custkey AS id, c_custkey AS venue_id, c_name AS name, c_mktsegment AS email, DATE '1996-01-01' + CAST(c_custkey % 700 AS INT) AS updated_on FROM customer),
staged AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'won' WHEN '2-HIGH' THEN 'lost' WHEN '3-MEDIUM' THEN 'demo' ELSE 'contacted' END AS stage FROM orders),
pipeline AS (SELECT o_custkey AS venue_id, arg_max(stage, o_orderkey) AS stage, CASE WHEN o_custkey % 3 <> 0 THEN CAST(max(o_orderdate) AS DATE) END AS next_action_on FROM staged GROUP BY o_custkey),
ev AS (SELECT o_orderkey AS id, o_custkey AS venue_id, CASE WHEN o_orderkey % 2 = 0 THEN 'stage' ELSE 'call' END AS kind, stage AS stage_to, CAST(o_orderdate AS DATE) AS happened_on, o_orderkey % 1000 AS contact_id FROM staged),
due AS (
  SELECT id, CASE WHEN lost THEN stage || ' since ' || stage_on ELSE 'quiet since ' || last END AS reason FROM (
    SELECT c.id, p.stage, t.stage_on, greatest(l.last_on, c.updated_on) AS last, p.stage IN ('lost', 'do_not_contact') AND t.stage_on < DATE '1997-08-01' AS lost, coalesce(p.stage, '') <> 'won' AND greatest(l.last_on, c.updated_on) < DATE '1996-08-01' AS quiet
    FROM contacts c LEFT JOIN pipeline p ON p.venue_id = c.venue_id LEFT JOIN (SELECT venue_id, max(happened_on) AS last_on FROM ev GROUP BY 1) l ON l.venue_id = c.venue_id
    LEFT JOIN (SELECT e.venue_id, arg_max(happened_on, e.id) AS stage_on FROM ev e JOIN pipeline q ON q.venue_id = e.venue_id AND kind = 'stage' AND stage_to = q.stage GROUP BY 1) t ON t.venue_id = c.venue_id) WHERE lost OR quiet)
"""
DAY = "1998-08-01"


def due_of(spark, sf_dir):
    return crm.retention_due(contacts_of(spark, sf_dir), pipeline_of(spark, sf_dir), crm_events(spark, sf_dir), F.lit(DAY).cast("date"))


def contacts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return due_of(spark, sf_dir).select("id", "reason")


DUE_SQL = f"WITH {CRM_SQL} SELECT id, reason FROM due"


def contacts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = crm.contacts_page(contacts_of(spark, sf_dir), due_of(spark, sf_dir), "BUIL", ["name", "email"], "name", ["Customer#000000020", 20], 25)
    return page.select("id", "name", "email", "reason", "rn", "has_next")


CONTACTS_SQL = f"""WITH {CRM_SQL},
r AS (SELECT c.id, name, email, reason, row_number() OVER (ORDER BY name, c.id) AS rn FROM contacts c LEFT JOIN due ON due.id = c.id WHERE (contains(lower(name), 'buil') OR contains(lower(email), 'buil')) AND (name > 'Customer#000000020' OR (name = 'Customer#000000020' AND c.id > 20)))
SELECT id, name, email, reason, rn, (SELECT count(*) FROM r) > 25 AS has_next FROM r WHERE rn <= 25"""


def activities_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crm.activities_page(crm_events(spark, sf_dir), pipeline_of(spark, sf_dir), contacts_of(spark, sf_dir), ["call"], ["demo", "won"], "1995-01-01", "1997-12-31", None, 30)
    return found.select("id", "venue_id", "happened_on", "stage", "contact", "rn")


ACTIVITIES_SQL = f"""WITH {CRM_SQL}
SELECT e.id, e.venue_id, happened_on, p.stage, c.name AS contact, row_number() OVER (ORDER BY happened_on DESC, e.id DESC) AS rn FROM ev e JOIN pipeline p ON p.venue_id = e.venue_id AND p.stage IN ('demo', 'won') LEFT JOIN contacts c ON c.id = contact_id
WHERE kind = 'call' AND happened_on BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' QUALIFY rn <= 30"""


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = contacts_of(spark, sf_dir).groupBy("venue_id").agg(F.count("*").alias("n_contacts"))
    return crm.worklist(pipeline_of(spark, sf_dir), counts, ["demo", "contacted"], 50)


WORKLIST_SQL = f"""WITH {CRM_SQL}
SELECT p.venue_id, stage, next_action_on, n_contacts FROM pipeline p LEFT JOIN (SELECT venue_id, count(*) AS n_contacts FROM contacts GROUP BY 1) c ON c.venue_id = p.venue_id WHERE stage IN ('demo', 'contacted') ORDER BY next_action_on NULLS LAST, p.venue_id LIMIT 50"""


def deleted_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(1, 4000, 7).select("id", F.lit("asked").alias("reason"), F.lit(DAY).cast("date").alias("happened_on"))
    contacts, events = crm.without_contact(contacts_of(spark, sf_dir), crm_events(spark, sf_dir), gone)
    kept = contacts.groupBy((F.col("venue_id") % 10).alias("v")).agg(F.count("*").alias("n_contacts"))
    notes = events.where("kind = 'contact_deleted'").groupBy((F.col("venue_id") % 10).alias("v")).agg(F.count("*").alias("n_notes"))
    return kept.join(notes, "v", "full_outer")


DELETED_SQL = f"""WITH {CRM_SQL}
SELECT venue_id % 10 AS v, count(*) FILTER (id % 7 <> 1 OR id >= 4000) AS n_contacts, nullif(count(*) FILTER (id % 7 = 1 AND id < 4000), 0) AS n_notes FROM contacts GROUP BY 1"""


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.stage_history(crm_events(spark, sf_dir)).select("id", "venue_id", "stage_from", "stage_to")


STAGES_SQL = f"WITH {CRM_SQL} SELECT id, venue_id, lag(stage_to) OVER (PARTITION BY venue_id ORDER BY id) AS stage_from, stage_to FROM ev WHERE kind = 'stage'"


def automatic_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = crm_events(spark, sf_dir).where("kind = 'stage'").select("venue_id", "id", F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("stage_to")).alias("stage"))
    return steps.groupBy("venue_id").agg(F.max_by("stage", "id").alias("last"), F.min_by("stage", "id").alias("first")).select("venue_id", queue.automatic_stage(F.col("first"), F.col("last")).alias("stage"))


_PLACE = "list_position(['new', 'contacted', 'demo', 'signed_up', 'won', 'lost', 'do_not_contact'], {})"
AUTO_SQL = f"""WITH {CRM_SQL},
s AS (SELECT venue_id, id, CASE WHEN id % 3 = 0 THEN 'new' ELSE stage_to END AS stage FROM ev WHERE kind = 'stage'), m AS (SELECT venue_id, arg_max(stage, id) AS last, arg_min(stage, id) AS first FROM s GROUP BY 1)
SELECT venue_id, CASE WHEN first NOT IN ('won', 'lost', 'do_not_contact') AND {_PLACE.format('last')} > {_PLACE.format('first')} THEN last ELSE first END AS stage FROM m"""


def lead_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e = facts_of(spark, sf_dir), table(spark, sf_dir, "events")
    venues = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("name"))
    sources = f.select("venue_id", F.col("fact_id").alias("source_record_id"), F.concat(F.lit("s"), "domain").alias("url"))
    sites = f.where("decision = 'accepted'").select("venue_id", "domain", F.col("fact_id").cast("string").alias("url"))
    owned = f.where("fact_id % 4 = 0").select("venue_id", "domain")
    assessed = e.select(F.col("user_id").alias("venue_id"), F.col("event_type").alias("state"), F.col("ts").alias("checked_at"), F.col("event_id").alias("assessment_id"))
    return crm.snapshot(venues, sources, owned, sites, assessed)


SNAPSHOT_SQL = f"""WITH {FACTS_SQL},
s AS (SELECT venue_id, min(fact_id) AS source_record_id, arg_min('s' || domain, fact_id) AS source_url, count(*) AS n_sources FROM facts GROUP BY 1),
w AS (SELECT venue_id, min(CAST(fact_id AS VARCHAR)) AS website FROM facts WHERE decision = 'accepted' AND (venue_id, domain) IN (SELECT (venue_id, domain) FROM facts WHERE fact_id % 4 = 0) GROUP BY 1),
a AS (SELECT user_id AS venue_id, arg_max(event_type, ROW(ts, event_id)) AS state FROM events GROUP BY 1)
SELECT c_custkey AS venue_id, c_name AS name, source_record_id, source_url, coalesce(n_sources, 0) AS n_sources, website, state FROM customer LEFT JOIN s ON s.venue_id = c_custkey LEFT JOIN w ON w.venue_id = c_custkey LEFT JOIN a ON a.venue_id = c_custkey"""


def published_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_of(spark, sf_dir)
    batch = f.select("venue_id", "domain", "fact_id", F.when(F.col("fact_id") % 7 == 0, "other").otherwise("frozen").alias("reviewer"))
    found = evidence.publishable(batch, f.where("fact_id % 30 = 0"), f.where("fact_id % 8 = 0"), "frozen")
    return found.groupBy("domain").agg(F.count("*").alias("n"), F.sum("fact_id").alias("sum_ids"))


PUBLISHED_SQL = f"""WITH {FACTS_SQL}
SELECT domain, count(*) AS n, CAST(sum(fact_id) AS BIGINT) AS sum_ids FROM facts WHERE fact_id % 7 <> 0 AND venue_id NOT IN (SELECT venue_id FROM facts WHERE fact_id % 30 = 0) AND (venue_id, domain) NOT IN (SELECT (venue_id, domain) FROM facts WHERE fact_id % 8 = 0) GROUP BY 1"""


def revoked_attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("venue_id"), "o_orderkey", F.col("o_orderdate").alias("reviewed_at"), F.lit("active").alias("lifecycle"))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("venue_id"), F.col("o_orderdate").alias("revoked_at"))
    return evidence.revoked(o, gone, ["venue_id"]).groupBy("lifecycle").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("sum_ids"))


REVOKED_SQL = """
WITH g AS (SELECT o_custkey AS v, max(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT CASE WHEN d >= o_orderdate THEN 'revoked' ELSE 'active' END AS lifecycle, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS sum_ids FROM orders LEFT JOIN g ON v = o_custkey GROUP BY 1"""


def replayed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    d = e.select(F.col("user_id").alias("venue_id"), k.alias("decision_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "reject").otherwise("skip").alias("decision"), F.when(k % 3 != 0, "d").alias("domain"))
    venues = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("venue_id"))
    return evidence.replayed(d, venues).groupBy("error").agg(F.count("*").alias("n"), F.min("decision_id").alias("first_id"))


REPLAYED_SQL = """
WITH d AS (SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_custkey % 4 <> 0) THEN 'unknown_venue' WHEN event_type NOT IN ('click', 'view') THEN 'unknown_decision' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'missing_website' END AS error FROM events)
SELECT error, count(*) AS n, min(event_id) AS first_id FROM d GROUP BY 1"""


def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("venue_id"), (F.col("event_id") % 13).alias("document"), F.col("event_id").alias("position"), "event_type")
    return evidence.first_documents(e)


FIRST_DOCUMENTS_SQL = "SELECT user_id AS venue_id, event_id % 13 AS document, event_id AS position, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 13, event_id) = 1"


def round_robin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.round_robin(leads(spark, sf_dir).select("o_orderkey", "region", "status"), ["region"], ["o_orderkey"], 4)
    ranked = rows.withColumn("status_rank", F.dense_rank().over(W.partitionBy("region").orderBy("status")))
    return ranked.groupBy("region", "group", F.col("status_rank").cast("long").alias("status_rank")).agg(F.count("*").alias("n"))


ROBIN_SQL = f"""WITH {LEADS_SQL}, r AS (SELECT region, (row_number() OVER (PARTITION BY region ORDER BY o_orderkey) - 1) % 4 AS g, dense_rank() OVER (PARTITION BY region ORDER BY status) AS status_rank FROM leads)
SELECT region, g AS "group", status_rank, count(*) AS n FROM r GROUP BY 1, 2, 3"""


def named_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", "p_brand").alias("names"))
    cases = spark.createDataFrame([("c1", "Brand#11"), ("c2", "Brand#99"), ("c3", "Brand#23")], "case_id string, name string")
    found = matching.by_any_name(p, cases, "names", "name")
    return found.groupBy("case_id").agg(F.max("n_matches").alias("n_matches"), F.min("p_partkey").alias("first_part"))


CASES_SQL = """
WITH c(case_id, name) AS (VALUES ('c1', 'Brand#11'), ('c2', 'Brand#99'), ('c3', 'Brand#23'))
SELECT case_id, count(p_partkey) AS n_matches, min(p_partkey) AS first_part FROM c LEFT JOIN part ON (p_name = name OR p_brand = name) GROUP BY 1"""


def cluster_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = projected(spark, sf_dir).withColumn("zoom", F.lit(6))
    return clustering.tile_items(fixed, 6, 16, 11).select("c_custkey", "px", "py")


_X, _Y = "lon / 360 + 0.5::DOUBLE", "0.5::DOUBLE - 0.25::DOUBLE * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()"
TILE_SQL = f"""
WITH placed AS (SELECT c_custkey, 6.0::DOUBLE + (c_custkey * 7919 % 13000) / 1000.0::DOUBLE AS lon, 36.0::DOUBLE + (c_custkey * 104729 % 11000) / 1000.0::DOUBLE AS lat FROM customer),
p AS (SELECT c_custkey, {_X} AS x, {_Y} AS y FROM placed), m AS (SELECT {clustering.WORLD_PX * 64}::DOUBLE AS world, {clustering.TILE_PX} AS t, {clustering.BUFFER_PX} AS b)
SELECT c_custkey, CAST(floor(x * world - 16 * t + 0.5) AS INT) AS px, CAST(floor(y * world - 11 * t + 0.5) AS INT) AS py FROM p, m
WHERE x BETWEEN (16 * t - b) / world AND (17 * t + b) / world AND y BETWEEN (11 * t - b) / world AND (12 * t + b) / world"""


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.page_facts(F.col("html"))
    rows = table(spark, sf_dir, "pages").withColumn("f", facts)
    quoted = web.quoted_in(F.array(F.lower(F.left("f.title", F.lit(12)))), F.lower("f.text"))
    return rows.select("page_id", F.col("f.title").alias("title"), "f.canonical", F.size("f.types").alias("n_types"), F.size("f.phones").alias("n_phones"), F.length("f.text").cast("long").alias("n_text"), quoted.alias("is_quoted"))


PAGE_FACTS_SQL = r"""
WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g') AS bare FROM pages),
v AS (SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<link\b[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '') AS canonical,
  len(list_distinct(regexp_extract_all(html, '"@type"\s*:\s*"([^"]+)"', 1))) AS n_types, left(trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 30000) AS t FROM b)
SELECT page_id, title, canonical, CAST(n_types AS INT) AS n_types, 0 AS n_phones, length(t) AS n_text, length(left(title, 12)) >= 8 AND contains(lower(t), lower(left(title, 12))) AS is_quoted FROM v"""


def day_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("event_type") == "none").alias("n_none"), F.max(F.to_date("ts")).alias("last_day"))
    return by.select(
        "user_id", stats.size_stratum(F.col("n")).alias("stratum"), stats.ratio(F.col("n_errors"), F.col("n")).alias("error_rate"), stats.ratio(F.col("n_errors"), F.col("n_none")).alias("undefined"), stats.ratio(F.col("n_errors"), F.col("n_none"), empty=0.0).alias("zero"),
        stats.day_number(F.col("last_day")).cast("long").alias("day"), stats.round_half_up(F.col("n") / -4.0).alias("half_up"),
    )


RATIOS_SQL = """
WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n < 25 THEN 'small' WHEN n < 150 THEN 'medium' ELSE 'large' END AS stratum, round(e / n::DOUBLE, 4) AS error_rate, NULL::DOUBLE AS undefined, 0::DOUBLE AS zero, date_diff('day', DATE '1970-01-01', d) AS day, floor(n / -4.0::DOUBLE + 0.5::DOUBLE) / 1 AS half_up FROM b"""


def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return evaluation.fingerprint(rows, ["n_nationkey", "n_name"], ["n_regionkey"])


FINGERPRINT_SQL = """
WITH h AS (SELECT n_regionkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS h FROM nation)
SELECT n_regionkey, sha256(string_agg(h, chr(10) ORDER BY h)) AS fingerprint, count(*) AS n FROM h GROUP BY 1"""


def next_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sampling.next_batch(c.where("c_mktsegment = 'BUILDING'"), c.where("c_custkey % 3 = 0"), "c_custkey", 50)


BATCH_SQL = "SELECT c_custkey, c_mktsegment, sha256(CAST(c_custkey AS VARCHAR)) AS order_hash FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 0 ORDER BY order_hash, c_custkey LIMIT 50"


def local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", text.words_only(F.concat_ws(" ", F.lit("Bar"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "Roma"))).alias("name"))
    address = text.street_number(F.concat_ws(" ", F.lit("via"), F.element_at(F.split("name", " "), 2), (F.col("p_partkey") % 90).cast("string")))
    far = geo.tile(F.col("p_partkey") / 100000.0, 5)
    return p.select("p_partkey", F.array_join(text.local_aliases(F.col("name"), F.lit("roma")), "|").alias("aliases"), address["street"].alias("street"), address["number"].alias("number"), far.alias("tile"))


LOCAL_SQL = r"""
WITH n AS (SELECT p_partkey, trim(regexp_replace(lower('bar ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' roma' ELSE '' END), '[^a-z0-9]+', ' ', 'g')) AS name FROM part),
b AS (SELECT *, CASE WHEN suffix(name, ' roma') THEN trim(left(name, length(name) - 4)) ELSE name END AS bare FROM n)
SELECT p_partkey, CASE WHEN name = bare THEN name ELSE name || '|' || bare END || '|' || substr(bare, 5) AS aliases, 'via ' || string_split(name, ' ')[2] AS street, CAST(p_partkey % 90 AS VARCHAR) AS number, CAST(least(floor(p_partkey / 100000.0::DOUBLE * 32), 31) AS BIGINT) AS tile FROM b"""

NAMES = {
    "contacts_due": DUE_SQL, "contacts_page": CONTACTS_SQL, "activities_page": ACTIVITIES_SQL, "worklist": WORKLIST_SQL, "deleted_contacts": DELETED_SQL, "stage_events": STAGES_SQL, "automatic_stages": AUTO_SQL, "lead_snapshot": SNAPSHOT_SQL,
    "published_batch": PUBLISHED_SQL, "revoked_attestations": REVOKED_SQL, "replayed_decisions": REPLAYED_SQL, "first_documents": FIRST_DOCUMENTS_SQL, "round_robin_groups": ROBIN_SQL, "named_cases": CASES_SQL, "cluster_tile": TILE_SQL,
    "page_facts": PAGE_FACTS_SQL, "day_ratios": RATIOS_SQL, "content_fingerprints": FINGERPRINT_SQL, "next_batches": BATCH_SQL, "local_names": LOCAL_SQL,
}
QUERIES = {name: (globals()[name], sql) for name, sql in NAMES.items()}
