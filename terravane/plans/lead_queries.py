"""Faceted, sorted, paged and searched leads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, text
from ..functions.stats import nearest_rank
from ..operators import facets, paging
from .common import LEADS_SQL, PLACED_SQL, leads, placed_customers, table

FACETS = {"status": ["F", "O"], "priority": ["1-URGENT", "2-HIGH"], "segment": ["BUILDING", "AUTOMOBILE", "MACHINERY"]}


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    chosen = {k: F.col(k).isin(v) for k, v in FACETS.items()}
    return facets.self_excluding_facets(rows, chosen, view=F.col("o_totalprice") > 100000)


def _in(k):
    return f"{k} IN ({', '.join(repr(x) for x in FACETS[k])})"


FACET_SQL = f"WITH {LEADS_SQL}" + " UNION ALL ".join(
    f"""
SELECT '{k}' AS facet, {k} AS code, count(*) FILTER ({' AND '.join(_in(x) for x in FACETS if x != k)}) AS total,
  count(*) FILTER ({' AND '.join(_in(x) for x in FACETS if x != k)} AND o_totalprice > 100000) AS in_view
FROM leads GROUP BY {k}"""
    for k in FACETS
)


def meta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.counts_by_each(leads(spark, sf_dir), ["region", "nation", "status", "priority"])


META_SQL = f"""WITH {LEADS_SQL}
SELECT CASE WHEN grouping(region) = 0 THEN 'region' WHEN grouping(nation) = 0 THEN 'nation' WHEN grouping(status) = 0 THEN 'status' ELSE 'priority' END AS dimension,
  coalesce(region, nation, status, priority) AS value, count(*) AS n
FROM leads GROUP BY GROUPING SETS ((region), (nation), (status), (priority))"""


def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = filters.first_true(
        [
            ("verified", (F.col("o_orderstatus") == "F") & ~F.col("returned")),
            ("rejected", F.col("returned") & (F.col("o_orderstatus") == "F")),
            ("no_website", F.col("l_orderkey").isNull()),
            ("unchecked", F.col("o_orderstatus") == "O"),
            ("unreachable", F.col("discount") > 0.09),
            ("directory", F.col("quantity") > 150),
        ],
        "unresolved",
    )
    return rows.groupBy(status.alias("lead_status")).agg(F.count("*").alias("n"))


STATUS_SQL = """
WITH lines AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, max(l_discount) AS discount, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_orderstatus = 'F' AND NOT returned THEN 'verified' WHEN returned AND o_orderstatus = 'F' THEN 'rejected' WHEN l_orderkey IS NULL THEN 'no_website'
  WHEN o_orderstatus = 'O' THEN 'unchecked' WHEN discount > 0.09::DOUBLE THEN 'unreachable' WHEN quantity > 150 THEN 'directory' ELSE 'unresolved' END AS lead_status, count(*) AS n
FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY 1"""

TODAY = "1997-06-15"


def due_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("next_on", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")))
    bucket = filters.due_bucket(F.col("next_on"), F.lit(TODAY).cast("date"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("next_on").alias("first_on"), F.max("next_on").alias("last_on"))


DUE_SQL = f"""
WITH rows AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS next_on FROM orders)
SELECT CASE WHEN next_on IS NULL THEN 'none' WHEN next_on < DATE '{TODAY}' THEN 'overdue' WHEN next_on = DATE '{TODAY}' THEN 'today' WHEN next_on <= DATE '{TODAY}' + 7 THEN 'week' ELSE 'later' END AS bucket,
  count(*) AS n, min(next_on) AS first_on, max(next_on) AS last_on FROM rows GROUP BY 1"""

BOX = (8.0, 38.0, 14.5, 44.0)


def bbox_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed_customers(spark, sf_dir).where(filters.inside(F.col("lon"), F.col("lat"), BOX))
    named = rows.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return facets.bounds(named, ["n_name"], "lon", "lat")


BBOX_SQL = f"""WITH {PLACED_SQL}
SELECT n_name, count(*) AS n, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM placed JOIN nation ON c_nationkey = n_nationkey
WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY 1"""


def lead_page_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).where(F.col("segment").isin(FACETS["segment"])).withColumn("price", F.when(F.col("status") != "P", F.col("o_totalprice"))).select("o_orderkey", "status", "price", "c_name")
    order = paging.ordering("price", True, ["c_name", "o_orderkey"])
    return paging.with_total(paging.page(rows, order, offset=150, size=50), rows)


PAGE_SQL = f"""WITH {LEADS_SQL},
rows AS (SELECT o_orderkey, status, CASE WHEN status <> 'P' THEN o_totalprice END AS price, c_name FROM leads WHERE {_in('segment')}),
numbered AS (SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST, c_name, o_orderkey) AS rn, count(*) OVER () AS total FROM rows)
SELECT * FROM numbered WHERE rn > 150 AND rn <= 200"""


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    cursor = rows.where("event_id = 500").select("ts", "event_id").first()
    return paging.keyset_page(rows, ["ts", "event_id"], list(cursor) if cursor else None, 40, descending=True)


KEYSET_SQL = """
WITH c AS (SELECT ts, event_id FROM events WHERE event_id = 500),
rest AS (SELECT e.event_id, e.ts, event_type FROM events e, c WHERE e.ts < c.ts OR (e.ts = c.ts AND e.event_id < c.event_id)),
more AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM rest QUALIFY rn <= 41)
SELECT event_id, ts, event_type, rn, (SELECT count(*) FROM more) > 40 AS has_next FROM more WHERE rn <= 40"""


def towns_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = named.groupBy("n_name").agg(F.count("*").alias("n"))
    return paging.page(counts, [F.desc("n"), F.asc("n_name")], 0, 10)


TOWNS_SQL = "SELECT * FROM (SELECT n_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, n_name) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) WHERE rn <= 10"


def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", text.fold_latin(F.col("p_name")).alias("folded"))
    return paging.prefix_search(parts, "folded", "b", ["p_partkey"])


PREFIX_SQL = """
WITH p AS (SELECT p_partkey, lower(strip_accents(p_name)) AS folded FROM part)
SELECT p_partkey, folded, starts_with(folded, 'b') AS is_prefix FROM p WHERE starts_with(folded, 'b') OR regexp_matches(folded, '(^|[^a-z0-9])b') ORDER BY is_prefix DESC, folded, p_partkey LIMIT 10"""


def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.contains(text.fold_latin(F.col("text")), F.lit("elle"))
    return docs.where(hit).groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


SEARCH_SQL = "SELECT lang, source, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE contains(lower(strip_accents(text)), 'elle') GROUP BY 1, 2"


def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.venue_name(text.words_only(F.col("text"))).alias("folded"))
    core = text.core_name(F.col("folded"))
    return docs.select("doc_id", F.length("folded").cast("long").alias("n_folded"), F.sha2("folded", 256).alias("folded_sha"), F.length(core).cast("long").alias("n_core"), F.size(text.meaningful(F.col("folded"))).cast("long").alias("n_tokens"))


_GENERIC = "|".join(text.GENERIC_WORDS)
FOLD_SQL = rf"""
WITH f AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' (?:{'|'.join(text.LEGAL_SUFFIXES)})$', '')) AS folded FROM documents),
c AS (SELECT *, CASE WHEN regexp_full_match(folded, '(?:(?:{_GENERIC}) )+') THEN folded ELSE regexp_replace(folded, '^(?:(?:{_GENERIC}) )+', '') END AS core FROM f)
SELECT doc_id, length(folded) AS n_folded, sha256(folded) AS folded_sha, length(core) AS n_core,
  len(list_filter(string_split(folded, ' '), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(w) for w in text.GENERIC_WORDS)})))::BIGINT AS n_tokens FROM c"""


def csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    label = F.concat(F.col("c_name"), F.when(F.col("o_orderkey") % 3 == 0, ', "Ltd"').otherwise(""))
    return rows.select("o_orderkey", text.csv_line([F.col("o_orderkey"), label, F.col("status"), F.when(F.col("status") != "P", F.col("segment"))]).alias("line"))


CSV_SQL = f"""WITH {LEADS_SQL},
l AS (SELECT *, c_name || CASE WHEN o_orderkey % 3 = 0 THEN ', "Ltd"' ELSE '' END AS label FROM leads)
SELECT o_orderkey, o_orderkey || ',' || CASE WHEN regexp_matches(label, '[",\\r\\n]') THEN '"' || replace(label, '"', '""') || '"' ELSE label END || ',' || status || ',' || CASE WHEN status <> 'P' THEN segment ELSE '' END AS line FROM l"""


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(nearest_rank("o_totalprice", 0.5).alias("p50"), nearest_rank("o_totalprice", 0.95).alias("p95"), F.count("*").alias("n"))


PERCENTILE_SQL = "SELECT o_orderstatus AS status, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, count(*) AS n FROM orders GROUP BY 1"

QUERIES = {
    "facet_counts": (facet_counts, FACET_SQL),
    "meta_counts": (meta_counts, META_SQL),
    "status_case": (status_case, STATUS_SQL),
    "due_buckets": (due_buckets, DUE_SQL),
    "bbox_bounds": (bbox_bounds, BBOX_SQL),
    "lead_page_sorted": (lead_page_sorted, PAGE_SQL),
    "keyset_page": (keyset_page, KEYSET_SQL),
    "towns_busiest": (towns_busiest, TOWNS_SQL),
    "prefix_search": (prefix_search, PREFIX_SQL),
    "search_folded": (search_folded, SEARCH_SQL),
    "text_fold": (text_fold, FOLD_SQL),
    "csv_line": (csv_line, CSV_SQL),
    "percentile_nearest_rank": (percentile_nearest_rank, PERCENTILE_SQL),
}
