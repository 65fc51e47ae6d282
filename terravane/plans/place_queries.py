"""Pages, addresses, maps and entities."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, html, stats, url
from ..operators import clustering, entity, facets, sampling, spatial, web
from ..tables import cut
from .common import LEADS_SQL, PLACED_SQL, leads, placed_customers, table


def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.sites_by_domain(table(spark, sf_dir, "pages"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"
DOMAIN_SQL = rf"""
WITH h AS (SELECT url, string_split({_HOST}, '.') AS l FROM pages)
SELECT CASE WHEN len(l) <= 2 THEN array_to_string(l, '.') ELSE array_to_string(l[-2:], '.') END AS domain, count(*) AS n_pages, min(url) AS first_url FROM h GROUP BY 1"""


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Parameters in an order that sorting by whole pairs would change.
    asked = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("b=2&a=2&utm_x=1&a=1&a-b=3&z"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").withColumn("url", asked).select("page_id", url.candidate_url(F.col("url")).alias("candidate"), url.website_key(F.col("url")).alias("site"), url.canonical_url(F.col("url"), True).alias("canonical"))


URL_SQL = rf"""
WITH p AS (SELECT page_id, regexp_extract(u, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(u, '^[a-z]+://([^/?]*)', 1)) AS auth, regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS q
  FROM (SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=2&a=2&utm_x=1&a=1&a-b=3&z' ELSE url END, '#.*$', '') AS u FROM pages)),
k AS (SELECT *, list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref|source)(=|$)', 'i')), lambda x, i: struct_pack(n := split_part(x, '=', 1), i := i, q := x))), lambda s: s.q) AS kept,
  list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref|source)(=|$)', 'i')) AS ordered, regexp_replace(path, '/+$', '') AS short FROM p)
SELECT page_id, scheme || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS candidate,
  regexp_replace(auth, '^www\.', '') || CASE WHEN short = '' THEN '/' ELSE short END AS site,
  'https://' || regexp_replace(auth, '^www\.', '') || short || CASE WHEN len(ordered) > 0 THEN '?' || array_to_string(ordered, '&') ELSE '' END AS canonical FROM k"""


def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(h).alias("title"), F.length(html.visible_text(h)).cast("long").alias("n_text"), F.sha2(html.visible_text(h), 256).alias("text_sha"), F.size(html.links(h)).cast("long").alias("n_links"))


HTML_SQL = r"""
WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g') AS bare FROM pages),
v AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS visible FROM b)
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, length(visible) AS n_text, sha256(visible) AS text_sha,
  len(regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?i)<a\b[^>]*?href="([^"]*)"', 1)) AS n_links FROM v"""


def freshness_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    label = F.concat(F.col("p_name"), F.lit(" "), F.when(F.col("p_partkey") % 6 < 5, (F.col("p_partkey") % 6 + 2021).cast("string")).otherwise("menu"), F.when(F.col("p_partkey") % 4 == 0, " summer").otherwise(""))
    fresh = stats.freshness(label, 2024, F.col("p_partkey") % 4 == 0)
    return p.groupBy(fresh.alias("freshness"), "p_size").agg(F.count("*").alias("n"))


FRESH_SQL = r"""
WITH l AS (SELECT p_size, p_partkey, p_name || ' ' || CASE WHEN p_partkey % 6 < 5 THEN CAST(p_partkey % 6 + 2021 AS VARCHAR) ELSE 'menu' END AS label FROM part),
y AS (SELECT *, list_max(list_transform(regexp_extract_all(label, '\b(20[0-9]{2})\b', 1), lambda x: CAST(x AS INT))) AS y FROM l)
SELECT CASE WHEN y > 2024 THEN 'review' WHEN y < 2024 AND (p_partkey % 4 = 0 OR 2024 - y >= 2) THEN 'stale' WHEN y < 2024 THEN 'review' WHEN y = 2024 THEN 'current' ELSE 'undated' END AS freshness, p_size, count(*) AS n FROM y GROUP BY 1, 2"""


def haversine_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(41.9), F.lit(12.5))
    return placed_customers(spark, sf_dir).select("c_custkey", F.round(m, 3).alias("metres"), F.when(m <= 100000, "near").when(m <= 300000, "mid").otherwise("far").alias("band"))


HAVERSINE_SQL = f"""WITH {PLACED_SQL},
a AS (SELECT c_custkey, pow(sin(radians(41.9::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(41.9::DOUBLE)) * pow(sin(radians(12.5::DOUBLE - lon) / 2), 2) AS a FROM placed),
m AS (SELECT c_custkey, {geo.EARTH_M}::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) AS m FROM a)
SELECT c_custkey, round(m, 3) AS metres, CASE WHEN m <= 100000 THEN 'near' WHEN m <= 300000 THEN 'mid' ELSE 'far' END AS band FROM m"""


def projected(spark, sf_dir):
    return placed_customers(spark, sf_dir).select("c_custkey", geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"), (F.col("c_mktsegment") == "BUILDING").alias("flagged"))


def mercator_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.grid_clusters(projected(spark, sf_dir), 8, cells_a_tile=4)
    return found.select("gx", "gy", "n", "flagged", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


TILES_SQL = f"""WITH {PLACED_SQL},
p AS (SELECT lon / 360 + 0.5::DOUBLE AS x, greatest(least(0.5::DOUBLE - 0.25::DOUBLE * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi(), 1), 0) AS y, c_mktsegment = 'BUILDING' AS f FROM placed)
SELECT CAST(least(floor(x * 1024), 1023) AS BIGINT) AS gx, CAST(least(floor(y * 1024), 1023) AS BIGINT) AS gy, count(*) AS n, count(*) FILTER (f) AS flagged, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM p GROUP BY 1, 2"""

SHAPES = {
    "north": [[[(6.0, 43.0), (19.0, 43.0), (19.0, 47.0), (6.0, 47.0)]]],
    "island": [[[(8.0, 38.2), (10.0, 38.2), (10.0, 41.5), (8.0, 41.5)], [(8.6, 39.0), (9.4, 39.0), (9.4, 40.0), (8.6, 40.0)]]],
    "centre": [[[(11.0, 41.0), (13.03, 44.1), (14.9, 41.2)]]],
    "south": [[[(14.0, 37.0), (18.0, 40.0), (15.0, 40.5)]], [[(12.0, 36.2), (14.0, 36.2), (13.0, 38.1)]]],
}


def shapes(spark: SparkSession) -> DataFrame:
    rows = [(k, [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in v]) for k, v in SHAPES.items()]
    return spark.createDataFrame(rows, f"code string, rings {geo.RINGS}")


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = placed_customers(spark, sf_dir).select("c_custkey", (F.col("lon") + 0.000313).alias("lon"), (F.col("lat") + 0.000171).alias("lat"))
    return spatial.assign(points, shapes(spark), "c_custkey", "code", "lon", "lat").select("c_custkey", "code", "status")


_EDGES = ", ".join(f"('{k}', {p}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, v in SHAPES.items() for p, polygon in enumerate(v) for ring in polygon for a, b in zip(ring, ring[1:] + ring[:1]))
PIP_SQL = f"""WITH {PLACED_SQL},
p AS (SELECT c_custkey, lon + 0.000313::DOUBLE AS x, lat + 0.000171::DOUBLE AS y FROM placed),
e(code, polygon, ax, ay, bx, by_) AS (VALUES {_EDGES}),
c AS (SELECT c_custkey, code, polygon FROM p, e WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
h AS (SELECT c_custkey, count(DISTINCT code) AS hits, min(code) AS code FROM c GROUP BY 1)
SELECT p.c_custkey, CASE WHEN hits = 1 THEN code END AS code, CASE WHEN hits IS NULL THEN 'outside' WHEN hits = 1 THEN 'assigned' ELSE 'ambiguous' END AS status FROM p LEFT JOIN h ON h.c_custkey = p.c_custkey"""


def grid_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.candidates(placed_customers(spark, sf_dir).select("c_custkey", "lon", "lat"), shapes(spark), "lon", "lat")
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


_BOXES = ", ".join("('{}', {}, {}, {}, {})".format(k, *[f(c) for c in zip(*[p for polygon in v for ring in polygon for p in ring]) for f in (min, max)]) for k, v in SHAPES.items())
BOXJOIN_SQL = f"""WITH {PLACED_SQL}, b(code, west, east, south, north) AS (VALUES {_BOXES})
SELECT code, count(*) AS n, min(c_custkey) AS first_key FROM placed JOIN b ON lon BETWEEN west::DOUBLE AND east::DOUBLE AND lat BETWEEN south::DOUBLE AND north::DOUBLE GROUP BY 1"""


def records(spark, sf_dir):
    """Customers as place records, with few names, phones and streets, so that some agree."""
    k = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ("Trattoria Aurora", "Osteria Bella", "Aurora", "Bar Centrale", "Ristorante Centrale srl", "La Pergola", "Pergola Nova", "Da Mario")])
    return placed_customers(spark, sf_dir).select(
        k.alias("id"), F.col("c_nationkey").alias("town"), F.concat_ws(" ", F.element_at(words, (k % 8 + 1).cast("int")), F.when(k % 3 == 0, "II")).alias("name"), F.array().cast("array<string>").alias("aliases"),
        F.when(k % 4 != 0, F.concat(F.lit("+39 0422 "), (F.lit(700000) + k % 23).cast("string"))).alias("phone"), F.when(k % 5 != 0, F.concat(F.lit("https://www.site"), (k % 29).cast("string"), F.lit(".example.com/"))).alias("website"),
        F.concat(F.lit("Via Roma "), (k % 17).cast("string")).alias("address"), F.lit("Via Roma").alias("street"), (k % 17).cast("string").alias("house_number"), F.lpad((F.lit(31000) + k % 3).cast("string"), 5, "0").alias("postcode"),
        F.lit(None).cast("string").alias("place_id"), F.lit(None).cast("string").alias("locality"), F.when(k % 5 == 0, "overture_places").when(k % 5 == 1, "crawl").otherwise("site").alias("source"), (F.lit(45.0) + k % 7 / F.lit(10000.0)).alias("lat"), (F.lit(12.0) + k % 11 / F.lit(10000.0)).alias("lon"),
    )


def pair_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The keys are read by every block and both sides of the pairs.
    keys = cut(entity.prepared(records(spark, sf_dir)))
    found = entity.evidence_pairs(keys)
    return found.select("left", "right", F.array_join("evidence", ",").alias("evidence"), F.array_join("conflicts", ",").alias("conflicts"), "score", "merge", "review")


_NAMES = "['trattoria aurora', 'osteria bella', 'aurora', 'bar centrale', 'ristorante centrale srl', 'la pergola', 'pergola nova', 'da mario']"
_CORES = "['aurora', 'bella', 'aurora', 'centrale', 'centrale', 'pergola', 'pergola nova', 'da mario']"
PAIR_SQL = f"""
WITH r AS (SELECT c_custkey AS k, c_nationkey AS town, {_NAMES}[c_custkey % 8 + 1] || CASE WHEN c_custkey % 3 = 0 THEN ' ii' ELSE '' END AS raw, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 23 END AS phone, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 29 END AS site,
  c_custkey % 17 AS number, c_custkey % 3 AS postcode, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS source, 45.0::DOUBLE + c_custkey % 7 / 10000.0::DOUBLE AS lat, 12.0::DOUBLE + c_custkey % 11 / 10000.0::DOUBLE AS lon FROM customer),
n AS (SELECT *, regexp_replace(raw, ' srl$', '') AS name, regexp_replace(regexp_replace(raw, ' srl$', ''), '^(trattoria|osteria|bar|ristorante|la) ', '') AS core FROM r),
p AS (SELECT a.k AS "left", b.k AS "right", a.name = b.name AS exact, a.core = b.core AS core, (contains(a.core, b.core) OR contains(b.core, a.core)) AND least(length(a.core), length(b.core)) >= 4 AS part,
  coalesce(a.phone = b.phone, false) AS ph, coalesce(a.site = b.site, false) AS si, a.number = b.number AS ad, a.postcode = b.postcode AS po, coalesce(a.phone <> b.phone, false) AS phx, a.postcode <> b.postcode AS pox, a.number <> b.number AS nux, a.source <> b.source AND 0 IN (a.source, b.source) AS witness,
  {geo.EARTH_M}::DOUBLE * 2 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS m
  FROM n a JOIN n b ON a.town = b.town AND a.k < b.k),
c AS (SELECT *, list_filter([CASE WHEN exact THEN 'name_exact' WHEN core OR part THEN 'name_alias' END, CASE WHEN ph THEN 'phone_exact' END, CASE WHEN si THEN 'website_exact' END, CASE WHEN ad THEN 'address_exact' END,
    CASE WHEN po THEN 'postcode_exact' END, CASE WHEN m <= 30 THEN 'distance_30' WHEN m <= 100 THEN 'distance_100' WHEN m <= 250 THEN 'distance_250' END,
    CASE WHEN witness AND (ph OR si OR ad OR m <= 250) THEN 'independent_source_records' END], lambda x: x IS NOT NULL) AS ev,
  list_filter([CASE WHEN phx THEN 'phone_conflict' END, CASE WHEN pox THEN 'postcode_conflict' END, CASE WHEN nux THEN 'house_number_conflict' END], lambda x: x IS NOT NULL) AS cf,
  CASE WHEN exact THEN 50 WHEN core THEN 35 WHEN part THEN 25 ELSE 0 END + CASE WHEN ph THEN 45 ELSE 0 END + CASE WHEN si THEN 45 ELSE 0 END + CASE WHEN ad THEN 35 ELSE 0 END + CASE WHEN po THEN 10 ELSE 0 END + CASE WHEN m <= 30 THEN 35 WHEN m <= 100 THEN 25 WHEN m <= 250 THEN 15 ELSE 0 END AS score
  FROM p WHERE exact OR core OR part OR (ph AND (si OR ad))),
d AS (SELECT *, len(cf) = 0 AND (ph OR si OR ad OR m <= 250) AND (((exact OR core OR part) AND score >= 60) OR (ph AND (si OR ad) AND score >= 90)) AS merge FROM c)
SELECT "left", "right", array_to_string(ev, ',') AS evidence, array_to_string(cf, ',') AS conflicts, CAST(score AS INT) AS score, merge, NOT merge AND (exact OR core OR part) AND len(cf) = 0 AND score >= 35 AS review FROM d"""


TYPES, SITES = ["restaurant", "pizzeria", "restaurant", "bar"], ["https://www.facebook.com/x", "http://a.example.it/", "https://b.example.it/", "c.example"]


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of seven customers as records of one venue."""
    k = F.col("c_custkey")
    at = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    kind, site = at(TYPES, F.floor(k / 3)), F.when(k % 5 != 0, F.concat(at(SITES, k), F.lit("?"), k.cast("string")))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.when(k % 4 != 0, kind).alias("type"), site.alias("website"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("phone"),
        F.when(k % 2 == 0, k / F.lit(7.0)).alias("lat"), F.when(k % 3 == 0, k / F.lit(9.0)).alias("lon"),
        F.create_map(F.lit("name"), F.array(at(["a", "b"], k)), F.lit("website"), F.array(k.cast("string")), F.lit("phone"), F.array(k.cast("string")), F.lit("lat"), F.array(k.cast("string"))).alias("provenance"),
    )
    venues = entity.survivors(rows, rows.select("id", F.floor(F.col("id") / 7).alias("group")), ["name", "phone"], website="website", place=("lat", "lon"), kind="type", provenance="provenance")
    source = lambda f: F.array_join(F.coalesce(F.col("provenance")[f], F.array().cast("array<string>")), ",")
    return venues.select("group", "name", "phone", "website", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "type", F.array_join("members", ",").alias("members"), *[source(f).alias(f"{f}_from") for f in ("name", "website", "phone", "lat")])


MERGED_SQL = f"""
WITH r AS (SELECT c_custkey AS id, c_custkey // 7 AS g, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN {TYPES}[(c_custkey // 3) % 4 + 1] END AS type, CASE WHEN c_custkey % 5 <> 0 THEN {SITES}[c_custkey % 4 + 1] || '?' || c_custkey END AS website,
  CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 0 END AS quality, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS phone,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey / 7.0::DOUBLE END AS lat, CASE WHEN c_custkey % 6 = 0 THEN c_custkey / 9.0::DOUBLE END AS lon, ['a', 'b'][c_custkey % 2 + 1] AS p FROM customer),
f AS (SELECT g, arg_min(name, id) AS name, arg_min(phone, id) FILTER (phone IS NOT NULL) AS phone, arg_min(id, id) FILTER (phone IS NOT NULL) AS phone_id, arg_min(id, id * 10 - quality * 100000000000) FILTER (website IS NOT NULL) AS site_id, arg_min(id, id) FILTER (lat IS NOT NULL) AS place_id,
  arg_min(type, id) FILTER (type IS NOT NULL) AS first_type, arg_min(type, id) FILTER (type <> 'restaurant') AS other_type, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, list(p ORDER BY id) AS ps FROM r GROUP BY g)
SELECT f.g AS "group", f.name, f.phone, s.website, round(p.lat, 9) AS lat, round(p.lon, 9) AS lon, CASE WHEN first_type = 'restaurant' THEN coalesce(other_type, first_type) ELSE first_type END AS type, members,
  array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), ',') AS name_from, coalesce(site_id::VARCHAR, '') AS website_from, coalesce(phone_id::VARCHAR, '') AS phone_from, coalesce(place_id::VARCHAR, '') AS lat_from
FROM f LEFT JOIN r s ON s.id = site_id LEFT JOIN r p ON p.id = place_id"""


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    keys = cut(entity.prepared(rows))
    groups = entity.greedy_groups(keys, entity.evidence_pairs(keys, mergeable=True))
    venues = entity.survivors(rows, groups, ["town", "name", "phone", "website", "address"])
    return entity.canonical_ids(venues, F.col("town").cast("string"), "name").select("venue_id", "group", "name", "phone", F.size("members").cast("long").alias("n_members"))


def map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.greedy_clusters(projected(spark, sf_dir), key="c_custkey")


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return leads(spark, sf_dir).select(
        "region", k.alias("venue_id"), sampling.order_hash("u", k).alias("order_hash"), F.col("segment").alias("type"), F.col("nation").alias("town"), F.when(k % 2 == 0, "known").otherwise("missing").alias("website"),
        F.when(k % 3 == 0, "small").when(k % 3 == 1, "medium").otherwise("large").alias("size"), F.when(k % 5 == 0, "tourism_focus").otherwise("general_market").alias("tourism"),
        F.when(k % 7 == 0, "known_chain").otherwise("independent_or_unknown").alias("chain"), F.when(k % 11 == 0, "included").otherwise("standard").alias("language"),
    )


def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.diverse_slots(strata(spark, sf_dir))


def powered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.powered_holdout(strata(spark, sf_dir).drop("order_hash"), "powered")


def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {"menu": ["nicht", "and", "se", "des"], "booking": ["the", "la", "de"], "order": ["is", "le", "que"]}
    found = web.resources(table(spark, sf_dir, "pages"), terms=terms).withColumns({"confidence": F.when(F.col("position") < 3, "high").otherwise("low"), "score": F.length("label")})
    return web.diverse_top(found, ["page"], 6).select("page", "role", "target", "label", "place")


def inventory_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    venues = rows.where("status <> 'P'")
    return facets.inventory(rows, venues, regions, ["region", "nation"], F.col("priority") == "1-URGENT")


INVENTORY_SQL = f"""WITH {LEADS_SQL},
b AS (SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT region, nation, count(*) AS records, count(*) FILTER (status <> 'P') AS venues, count(*) FILTER (status <> 'P' AND priority = '1-URGENT') AS with_site FROM leads GROUP BY 1, 2)
SELECT region, nation, coalesce(records, 0) AS records, coalesce(venues, 0) AS venues, coalesce(with_site, 0) AS with_site, coalesce(records, 0) - coalesce(venues, 0) AS duplicates, round(with_site / nullif(venues, 0)::DOUBLE, 4) AS coverage FROM b LEFT JOIN a USING (region, nation)"""

QUERIES = {
    "registrable_domain": (registrable_domains, DOMAIN_SQL),
    "url_normalize": (url_normalize, URL_SQL),
    "html_title_links": (html_title_links, HTML_SQL),
    "freshness_years": (freshness_years, FRESH_SQL),
    "haversine_band": (haversine_band, HAVERSINE_SQL),
    "mercator_tiles": (mercator_tiles, TILES_SQL),
    "point_in_polygon": (point_in_polygon, PIP_SQL),
    "grid_box_join": (grid_box_join, BOXJOIN_SQL),
    "pair_evidence_score": (pair_evidence_score, PAIR_SQL),
    "inventory_by_region": (inventory_by_region, INVENTORY_SQL),
    "merged_records": (merged_records, MERGED_SQL),
    "entity_groups": (entity_groups, None),
    "map_clusters": (map_clusters, None),
    "diverse_selection": (diverse_selection, None),
    "powered_selection": (powered_selection, None),
    "page_resources": (page_resources, None),
}
