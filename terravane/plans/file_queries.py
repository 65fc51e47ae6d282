"""Queries over files: the given tables are written in the formats of the sources, or to the sinks, and read back."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import paging
from ..sources import captured, places, sinks
from ..tables import new_path
from .common import LEADS_SQL, PLACED_SQL, leads, placed_customers, table

CATEGORIES = ["bar", "restaurant", "bank", "pub"]
FOOD = {"bar": "bar", "restaurant": "restaurant", "pub": "pub"}
BOX = (7.0, 37.0, 18.0, 46.5)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as place records in JSON: ``n, nation, text``."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (k % 4 + 1).cast("int"))
    properties = F.struct(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.when(k % 5 != 0, (k % 100) / F.lit(100.0)).alias("confidence"),
        F.struct(F.when(k % 11 != 0, F.concat(F.lit('Bar "{'), F.col("c_name"))).alias("primary")).alias("names"), F.struct(kind.alias("primary")).alias("categories"),
        F.array(F.struct(F.concat(F.lit("Via Roma "), (k % 17).cast("string")).alias("freeform"))).alias("addresses"), F.array(F.concat(F.lit("site"), k.cast("string"), F.lit(".example.com"))).alias("websites"),
    )
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return placed_customers(spark, sf_dir).select(k.alias("n"), F.col("c_nationkey").alias("nation"), F.to_json(feature).alias("text"))


def _admitted(records: DataFrame) -> DataFrame:
    return places.admitted(records, FOOD, BOX).select("place_id", "name", "type", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "address", "website", "reason")


ADMITTED_SQL = f"""WITH {PLACED_SQL},
p AS (SELECT c_custkey AS k, lon, lat, {CATEGORIES}[c_custkey % 4 + 1] AS kind, CASE WHEN c_custkey % 11 <> 0 THEN 'Bar "{{' || c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 100 / 100.0::DOUBLE END AS confidence FROM placed)
SELECT 'p' || k AS place_id, name, CASE WHEN kind <> 'bank' THEN kind END AS type, round(lon, 6) AS lon, round(lat, 6) AS lat, 'Via Roma ' || k % 17 AS address, 'http://site' || k || '.example.com' AS website,
  CASE WHEN NOT (lon BETWEEN 7.0 AND 18.0 AND lat BETWEEN 37.0 AND 46.5) THEN 'outside_region_bbox' WHEN kind = 'bank' THEN 'non_food_category' WHEN name IS NULL THEN 'missing_name' WHEN confidence < 0.9 THEN 'low_confidence' END AS reason FROM p"""


def places_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records a line, blank lines between (SRC-01, SRC-03)."""
    path = f"{new_path(spark)}.geojsonl"
    features(spark, sf_dir).select(F.explode(F.array("text", F.lit(""))).alias("line")).write.text(path)
    return _admitted(places.extract(spark, path))


def places_in_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature collection a nation, each one file (SRC-02, SRC-03)."""
    path = f"{new_path(spark)}.json"
    # The ends of a collection stand in the lines of its first and last feature: a union of lines and ends need not keep a nation in one task.
    order = W.partitionBy("nation").orderBy("n")
    rows = features(spark, sf_dir).select("nation", "text", F.row_number().over(order).alias("at"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    head = F.when(F.col("at") == 1, '{"type":"FeatureCollection","name":{"features":[{}]},"features":[\n').otherwise(",")
    lines = rows.select("nation", "at", F.concat(head, F.col("text"), F.when(F.col("last"), "\n]}").otherwise("")).alias("line"))
    lines.repartition("nation").sortWithinPartitions("nation", "at").select("nation", "line").write.partitionBy("nation").text(path)
    return _admitted(places.extract(spark, path))


def boundary_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as squares in a boundary file, and the customers in them (SRC-04, JN-01)."""
    path = f"{new_path(spark)}.geojson"
    n = F.col("n_nationkey")
    west, south = F.lit(6.0) + n % 5 * 2.6, F.lit(36.0) + F.floor(n / 5) * 2.2
    corner = lambda dx, dy: F.array(west + dx, south + dy)
    ring = F.array(corner(0.0, 0.0), corner(2.5, 0.0), corner(2.5, 2.1), corner(0.0, 2.1), corner(0.0, 0.0))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.lpad(n.cast("string"), 6, "0").alias("istat_code"), F.col("n_name").alias("municipality")).alias("properties"))
    areas = table(spark, sf_dir, "nation").select(F.to_json(feature).alias("text")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("text")), ","), F.lit("]}")).alias("text"))
    areas.coalesce(1).write.text(path)
    points = placed_customers(spark, sf_dir).select(F.col("c_custkey").alias("place_id"), (F.col("lon") + 0.00011).alias("lon"), (F.col("lat") + 0.00007).alias("lat"), F.lit(None).cast("string").alias("reason"))
    return places.assigned(points, places.boundaries(spark, path)).select("place_id", "istat_code", "reason")


AREAS_SQL = f"""WITH {PLACED_SQL},
p AS (SELECT c_custkey AS place_id, lon + 0.00011::DOUBLE AS x, lat + 0.00007::DOUBLE AS y FROM placed),
a AS (SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS istat_code, 6.0::DOUBLE + n_nationkey % 5 * 2.6::DOUBLE AS west, 36.0::DOUBLE + n_nationkey // 5 * 2.2::DOUBLE AS south FROM nation)
SELECT place_id, istat_code, CASE WHEN istat_code IS NULL THEN 'outside_boundaries' END AS reason FROM p LEFT JOIN a ON x BETWEEN west AND west + 2.5 AND y BETWEEN south AND south + 2.1"""


def captured_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches captured as JSON, one file a query, with the pages of a domain as their results (SRC-11, SRC-15)."""
    path = new_path(spark)
    pages = table(spark, sf_dir, "pages").withColumn("query", F.col("page_id") % 40)
    result = F.struct("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "url", F.lit("s").alias("snippet"))
    found = pages.groupBy("query").agg(F.array_sort(F.collect_list(result)).alias("results"))
    rows = found.select(F.to_json(F.struct(F.col("query").alias("query_position"), F.concat(F.lit("q"), F.col("query").cast("string")).alias("query"), F.lit("p").alias("provider"), "results")).alias("value"), F.concat(F.lit("search-"), F.col("query").cast("string")).alias("name"))
    rows.write.partitionBy("name").text(path)
    documents = places.documents_matching(spark, path, "*.txt")
    return captured.search_results(documents).select("query_position", "query", "rank", "title", "url")


RESULTS_SQL = """
SELECT page_id % 40 AS query_position, 'q' || page_id % 40 AS query, CAST(row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) - 1 AS INT) AS rank, 'Page ' || page_id AS title, url FROM pages"""


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads as lines, with quotes and breaks in them, behind a header (SNK-02)."""
    path = new_path(spark)
    rows = leads(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat("c_name", F.when(F.col("o_orderkey") % 2 == 0, ', "x"').otherwise(""))).alias("name"), "nation", "status")
    sinks.write_csv(rows, ["id", "name", "nation", "status"], path)
    lines = spark.read.option("lineSep", "\r\n").text(f"{path}/*")
    # The reader takes the byte-order mark off.
    return lines.select(F.col("value").alias("line"))


CSV_SQL = f"""WITH {LEADS_SQL}
SELECT o_orderkey || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '"' || c_name || ', ' || repeat('"', 2) || 'x' || repeat('"', 3) ELSE c_name END || ',' || nation || ',' || status AS line FROM leads UNION ALL SELECT 'id,name,nation,status'"""


def published_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that readers get after two were published, one of them twice (SNK-01, SNK-03)."""
    folder = new_path(spark)
    rows = leads(spark, sf_dir).select("o_orderkey", "nation", "status", "segment")
    sinks.write_snapshot(rows.where("status <> 'F'"), folder)
    sinks.write_snapshot(rows.where("status <> 'O'"), folder)
    sinks.write_snapshot(rows.where("status <> 'F'").repartition(3), folder)
    return sinks.read_snapshot(spark, folder)


PUBLISHED_SQL = f"WITH {LEADS_SQL} SELECT o_orderkey, nation, status, segment FROM leads WHERE status <> 'F'"


def legacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as venues, their orders as facts, with attestations of which some have expired (SNK-07)."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k, site = F.col("o_custkey"), F.concat(F.lit("https://www.s"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".example.it/"), F.col("o_orderkey").cast("string"))
    venues = c.select(F.col("c_custkey").cast("string").alias("venue_id"), F.col("c_name").alias("display_name"), F.col("c_nationkey").cast("string").alias("municipality"), F.when(F.col("c_custkey") % 7 == 0, "retired").otherwise("active").alias("lifecycle"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "website").otherwise("resource")
    facts = o.select(k.cast("string").alias("venue_id"), kind.alias("kind"), site.alias("url"), F.col("o_orderpriority").alias("role"), F.when(F.col("o_orderkey") % 5 == 0, "rejected").otherwise("accepted").alias("decision"), F.lit("active").alias("lifecycle"))
    at = lambda day: F.lit(day).cast("timestamp")
    domain = F.concat(F.lit("s"), (k % 3).cast("string"), F.lit(".example.it"))
    attested = c.withColumnRenamed("c_custkey", "o_custkey").select(
        k.cast("string").alias("venue_id"), F.when(k % 4 == 0, "example.it").otherwise(domain).alias("domain"), F.lit("verified").alias("decision"), F.lit("active").alias("lifecycle"),
        at("2024-01-01").alias("reviewed_at"), F.when(k % 2 == 0, at("2024-12-31")).otherwise(at("2024-06-01")).alias("expires_at"),
    )
    found = sinks.legacy_export(venues, facts, attested, at("2024-06-01"))
    return found.select("name", "canonical_venue_id", "website", F.array_join(F.transform("resources", lambda r: r["url"]), " ").alias("resources"))


LEGACY_SQL = """
WITH f AS (SELECT o_custkey AS k, o_orderkey % 2 = 0 AS site, 'https://www.s' || o_orderkey % 3 || '.example.it/' || o_orderkey AS url FROM orders WHERE o_orderkey % 5 <> 0),
w AS (SELECT k, min(url) AS website FROM f WHERE site AND k % 4 = 0 GROUP BY k), r AS (SELECT k, string_agg(url, ' ' ORDER BY url) AS resources FROM f WHERE NOT site GROUP BY k)
SELECT c_name AS name, c_custkey::VARCHAR AS canonical_venue_id, website, CASE WHEN website IS NOT NULL THEN coalesce(resources, '') ELSE '' END AS resources
FROM customer LEFT JOIN w ON w.k = c_custkey LEFT JOIN r ON r.k = c_custkey WHERE c_custkey % 7 <> 0"""


def _by_price() -> list[Column]:
    return paging.ordering("o_totalprice", True, ["o_orderkey"])


def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lead with its place in the whole order, out of ranges (SRT-02, WIN-01)."""
    return paging.pages(leads(spark, sf_dir).select("o_orderkey", "o_totalprice"), _by_price(), rows_a_range=1 << 12).ranked()


RANKS_SQL = f"WITH {LEADS_SQL} SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM leads"


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last full page but one of fifty leads (SRT-03)."""
    index = paging.pages(leads(spark, sf_dir).select("o_orderkey", "o_totalprice", "nation"), _by_price(), rows_a_range=1 << 12)
    return index.page((index.total // 50 - 2) * 50, 50)


DEEP_SQL = f"""WITH {LEADS_SQL}, r AS (SELECT o_orderkey, o_totalprice, nation, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM leads)
SELECT o_orderkey, o_totalprice, nation, rn FROM r WHERE rn > (n // 50 - 2) * 50 AND rn <= (n // 50 - 1) * 50"""

QUERIES = {
    "places_by_line": (places_by_line, ADMITTED_SQL),
    "places_in_collections": (places_in_collections, ADMITTED_SQL),
    "boundary_areas": (boundary_areas, AREAS_SQL),
    "captured_results": (captured_results, RESULTS_SQL),
    "csv_export": (csv_export, CSV_SQL),
    "published_leads": (published_leads, PUBLISHED_SQL),
    "legacy_scan": (legacy_scan, LEGACY_SQL),
    "global_ranks": (global_ranks, RANKS_SQL),
    "deep_page": (deep_page, DEEP_SQL),
}
