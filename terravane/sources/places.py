"""Place records, boundaries and manifests from files, and the import of an extract."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import first_true, inside, reasons
from ..functions.text import words_only
from ..functions.url import with_scheme
from ..operators.spatial import assign
from . import json_array

PLACE = """
struct<type: string, geometry: struct<type: string, coordinates: array<double>>,
  properties: struct<id: string, confidence: double, names: struct<primary: string>, categories: struct<primary: string, alternate: array<string>>,
    addresses: array<struct<freeform: string, locality: string, postcode: string, country: string, street: string, house_number: string, country_code: string>>,
    websites: array<string>, phones: array<string>, sources: array<struct<dataset: string, record_id: string>>>>"""
BOUNDARY = """
struct<type: string, geometry: struct<type: string, coordinates: string>,
  properties: struct<istat_code: string, municipality: string, province_code: string, province: string, region_code: string, region: string>>"""
LEAST_CONFIDENCE = 0.9


def geojson_sequence(spark: SparkSession, path: str, schema: str = PLACE) -> DataFrame:
    """A record a line, line feeds alone end lines, blank lines are skipped, and a malformed record fails the read (SRC-01)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.rtrim("value").alias("line"), F.input_file_name().alias("path")).where("line <> ''")
    parsed = lines.select("path", "line", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    # Filters above may be evaluated before the one on blank lines, so these are let pass here too.
    bad = (F.col("line") != "") & (F.col("r").isNull() | F.col("r.type").isNull())
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed record in "), F.col("path"), F.lit(": "), F.left("line", F.lit(80))))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select("r.*")


def extract(spark: SparkSession, path: str, schema: str = PLACE) -> DataFrame:
    """A local extract: lines, a feature collection, an array, or ``{places: []}`` (SRC-02).

    The last three may be one file of any size; many tasks read it. A malformed record fails the read.
    """
    if path.endswith((".jsonl", ".ndjson", ".geojsonl", ".geojsonseq")):
        return geojson_sequence(spark, path, schema)
    parsed = json_array.records(spark, path).withColumn("r", F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    checked = F.when(F.col("r").isNull() | F.col("r.type").isNull(), F.raise_error(F.concat(F.lit("malformed record in "), F.col("file"), F.lit(": "), F.left("text", F.lit(80))))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select("r.*")


def local_evidence(address: Column, locality: str, postcodes: list[str], country: str) -> dict[str, Column]:
    """What an address says for and against a place (FLT-10)."""
    town, code, land = words_only(address["locality"]), F.regexp_replace(address["postcode"], "[^0-9]", ""), F.upper(F.coalesce(address["country"], address["country_code"]))
    here = " ".join(locality.lower().split())
    for_it = reasons([("locality", town == here), ("postcode", code.isin(postcodes)), ("country", land == country)])
    against = F.coalesce((land != "") & (land != country), F.lit(False)) | F.coalesce((code != "") & ~code.isin(postcodes), F.lit(False)) & ~F.coalesce(town == here, F.lit(False))
    return {"evidence": for_it, "contradiction": against}


def admitted(records: DataFrame, food: dict[str, str], box: tuple[float, float, float, float], contradiction: Column | None = None) -> DataFrame:
    """Place records as venues, with the first ``reason`` against each, null for those admitted (FLT-08, FLT-09, SRC-03).

    A missing confidence passes. The primary category decides; alternates count only where there is none.
    """
    p, g = F.col("properties"), F.col("geometry.coordinates")
    table = F.create_map(*[F.lit(x) for k, v in food.items() for x in (k, v)])
    primary = p["categories"]["primary"]
    alternates = F.transform(F.coalesce(p["categories"]["alternate"], F.array().cast("array<string>")), lambda c: F.try_element_at(table, c))
    kind = F.when(primary.isNotNull(), F.try_element_at(table, primary)).otherwise(F.try_element_at(F.array_compact(alternates), F.lit(1)))
    x, y = F.try_element_at(g, F.lit(1)), F.try_element_at(g, F.lit(2))
    name = F.nullif(F.trim(p["names"]["primary"]), F.lit(""))
    reason = first_true([
        ("missing_id", F.coalesce(F.trim(p["id"]), F.lit("")) == ""),
        ("invalid_geometry", F.coalesce(F.col("geometry.type") != "Point", F.lit(True)) | x.isNull() | y.isNull()),
        ("outside_region_bbox", ~inside(x, y, box)),
        ("non_food_category", kind.isNull()),
        ("missing_name", name.isNull()),
        ("low_confidence", F.coalesce(p["confidence"] < LEAST_CONFIDENCE, F.lit(False))),
        ("address_contradiction", contradiction if contradiction is not None else F.lit(False)),
    ])
    first = F.try_element_at(p["addresses"], F.lit(1))
    return records.select(
        p["id"].alias("place_id"), name.alias("name"), kind.alias("type"), x.alias("lon"), y.alias("lat"), first["freeform"].alias("address"), first["locality"].alias("locality"), first["postcode"].alias("postcode"),
        with_scheme(F.try_element_at(p["websites"], F.lit(1))).alias("website"), F.try_element_at(p["phones"], F.lit(1)).alias("phone"), reason.alias("reason"),
    )


def drop_counts(mapped: DataFrame) -> DataFrame:
    return mapped.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def boundaries(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """Municipalities with their rings as multipolygons; repeated or missing codes fail (SRC-04)."""
    whole = spark.read.option("wholetext", "true").text(path)
    each = whole.select(F.explode(F.from_json("value", f"struct<features: array<{BOUNDARY.strip()}>>")["features"]).alias("f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    nested = F.when(F.col("f.geometry.type") == "Polygon", F.array(polygon)).otherwise(multi)
    rings = F.transform(nested, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))
    rows = each.select("f.properties.*", rings.alias("rings"))
    rows = rows if region is None else rows.where(F.col("region_code") == region)
    twice = rows.groupBy("istat_code").agg(F.count("*").alias("n"))
    code = F.when(F.col("istat_code").isNull() | (F.col("n") > 1), F.raise_error(F.concat(F.lit("bad boundary code: "), F.coalesce("istat_code", F.lit("none"))))).otherwise(F.col("istat_code"))
    return rows.join(twice, "istat_code", "left").withColumn("istat_code", code).drop("n")


def assigned(mapped: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Admitted places with their municipality; those outside all, or on an edge, get a reason too."""
    good = mapped.where("reason IS NULL").drop("reason")
    placed = assign(good, municipalities, "place_id", "istat_code", "lon", "lat")
    why = F.when(F.col("status") == "outside", "outside_boundaries").when(F.col("status") == "ambiguous", "ambiguous_boundary")
    return placed.withColumn("reason", why).drop("status")


def elements(captured: DataFrame, kinds: list[str]) -> DataFrame:
    """Map elements of a captured answer as records: known kinds, names of two letters or more, finite coordinates (SRC-07)."""
    tags, lon, lat = F.col("tags"), F.coalesce("lon", F.col("center.lon")), F.coalesce("lat", F.col("center.lat"))
    name = F.trim(F.try_element_at(tags, F.lit("name")))
    kind = F.coalesce(F.try_element_at(tags, F.lit("amenity")), F.try_element_at(tags, F.lit("shop")), F.try_element_at(tags, F.lit("tourism")))
    rows = captured.select(F.concat_ws("/", "type", "id").alias("osm_id"), name.alias("name"), kind.alias("kind"), lon.alias("lon"), lat.alias("lat"), F.try_element_at(tags, F.lit("website")).alias("website"), F.try_element_at(tags, F.lit("phone")).alias("phone"))
    finite = ~F.isnan("lon") & ~F.isnan("lat") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return rows.where(F.col("kind").isin(kinds) & (F.length("name") >= 2) & finite)


def best_town(results: DataFrame, keys: list[str]) -> DataFrame:
    """The first relation with a box, else the first row with one (SRC-08)."""
    valid = results.where(F.size("boundingbox") == 4)
    order = F.struct((F.col("osm_type") != "relation").cast("int").alias("o"), F.col("position"))
    return valid.groupBy(*keys).agg(F.min_by(F.struct("osm_type", "osm_id", "boundingbox"), order).alias("town")).select(*keys, "town.*")


def documents_matching(spark: SparkSession, folder: str, name_glob: str) -> DataFrame:
    """JSON documents whose names match, with where each came from (SRC-15)."""
    return spark.read.option("multiLine", "true").option("pathGlobFilter", name_glob).json(folder).withColumn("path", F.input_file_name())


def run_manifest(spark: SparkSession, name: str, make, enabled: bool = True) -> tuple[DataFrame | None, dict]:
    """The rows of a source and one record of its health: disabled, failed, degraded (none found) or succeeded (SRC-17)."""
    if not enabled:
        return None, {"source": name, "status": "disabled", "records": 0, "error": None}
    try:
        rows = make(spark)
        n = rows.count()
    except Exception as error:  # noqa: BLE001  a source that fails must not stop the others
        return None, {"source": name, "status": "failed", "records": 0, "error": str(error)[:200]}
    return rows, {"source": name, "status": "succeeded" if n else "degraded", "records": n, "error": None}
