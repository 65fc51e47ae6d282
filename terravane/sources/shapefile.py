"""Polygon layers of shapefiles as rows of attributes and multipolygons."""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import RINGS, utm_to_lonlat

POLYGONS = {5, 15, 25}


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def holds(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((spans & (point[0] < x)).sum() % 2)


def multipolygon(record: bytes) -> list[list[np.ndarray]]:
    """The polygons of a record's content: clockwise rings are outer ones, the others holes of the one that holds them."""
    if len(record) < 44 or struct.unpack_from("<i", record)[0] not in POLYGONS:
        return []
    n_parts, n_points = struct.unpack_from("<ii", record, 36)
    parts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    points = np.frombuffer(record, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    rings = [points[a:b] for a, b in zip(parts, parts[1:])]
    rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
    shapes = [[r] for r in rings if signed_area(r) < 0]
    for hole in (r for r in rings if signed_area(r) >= 0):
        owner = next((s for s in shapes if holds(s[0], hole[0])), shapes[-1] if shapes else None)
        if owner is None:
            shapes.append([hole])
        else:
            owner.append(hole)
    return shapes


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned number of some bytes, the first of them at ``at`` from 0."""
    sign = lambda i: F.conv(F.hex(F.substring(content, F.lit(at) + 1 + i, F.lit(1))), 16, 10).cast("long")
    return sum((sign(i) * 256 ** (i if little else size - 1 - i) for i in range(size)), F.lit(0).cast("long"))


def _places(shp: pa.Array) -> pa.Array:
    """Where the records of a file without an index are: each tells its own length."""
    out = []
    for content in shp.to_pylist():
        at, found = 100, []
        while content and at + 8 <= len(content):
            (words,) = struct.unpack_from(">i", content, at + 4)
            found.append({"at": at + 8, "size": 2 * words})
            at += 8 + 2 * words
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])))


def _shapes(batches):
    for batch in batches:
        rings = [[[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p] for p in multipolygon(content)] for content in batch.column(2).to_pylist()]
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rings, kind)], ["layer", "n", "rings"])


def layers(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """``layer, attributes, rings`` of the polygon shapefiles in a folder, or of those ``named`` (SRC-05).

    A file is read by one task, which only cuts it: by the places in its index ``.shx``, or where there is none by the
    lengths the records tell. The records of all layers are then dealt out evenly, and many tasks read the shapes of
    one layer. Rows of attributes have a fixed width and are cut likewise, inside the JVM, and meet the shapes by
    layer and number. Deleted rows keep their place; a shape that is no polygon has no rings.
    """
    glob = "{" + ",".join(f"{n}.{{shp,dbf,shx}}" for n in names) + "}" if names else "*.{shp,dbf,shx}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.(?:shp|dbf|shx)$", 1).alias("layer"), F.regexp_extract("path", r"\.(shp|dbf|shx)$", 1).alias("kind"), "content")
    of = lambda kind: named.where(F.col("kind") == kind).select("layer", F.col("content").alias(kind))
    both = of("shp").join(of("dbf").select("layer"), "layer", "left_semi").join(of("shx"), "layer", "left")
    last = ((F.length("shx") - 100) / 8 - 1).cast("long")
    indexed = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct((_number(F.col("shx"), 100 + 8 * i, 4) * 2 + 8).alias("at"), (_number(F.col("shx"), 104 + 8 * i, 4) * 2).alias("size")))
    told = F.arrow_udf("array<struct<at: long, size: long>>")(_places)
    places = F.when(F.col("shx").isNull(), told(F.when(F.col("shx").isNull(), F.col("shp")))).when(last < 0, F.array()).otherwise(indexed)
    cut = F.transform(places, lambda p: F.substring(F.col("shp"), (p["at"] + 1).cast("int"), p["size"].cast("int")))
    contents = both.select("layer", F.posexplode(cut).alias("n", "content")).repartition(F.col("layer"), F.col("n"))
    shapes = contents.mapInArrow(_shapes, f"layer string, n int, rings {RINGS}")
    return shapes.join(_attributes(of("dbf")), ["layer", "n"]).select("layer", "attributes", "rings")


def _attributes(tables: DataFrame) -> DataFrame:
    """``layer, n, attributes`` of dBASE files: the head tells how many rows there are, how wide, and the fields."""
    d = F.col("dbf")
    head = tables.select("layer", "dbf", _number(d, 4, 4, True).alias("rows"), _number(d, 8, 2, True).alias("head"), _number(d, 10, 2, True).alias("width"))
    # Descriptions of fields stand between the first 32 bytes and a byte that ends the head.
    slots = F.sequence(F.lit(0).cast("long"), F.floor((F.col("head") - 33) / 32) - 1)
    name = lambda i: F.regexp_extract(F.decode(F.substring(d, (33 + 32 * i).cast("int"), F.lit(11)), "ISO-8859-1"), "^[^\\x00]*", 0)
    fields = F.transform(slots, lambda i: F.struct(name(i).alias("name"), _number(d, 32 + 32 * i + 16, 1).alias("size")))
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<name: string, at: long, size: long>>").alias("fields"))
    placed = F.aggregate(fields, start, lambda acc, f: F.struct((acc["at"] + f["size"]).alias("at"), F.concat(acc["fields"], F.array(F.struct(f["name"].alias("name"), acc["at"].alias("at"), f["size"].alias("size")))).alias("fields")), lambda acc: acc["fields"])
    wide = head.where("rows > 0").withColumn("fields", placed)
    rows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda i: F.substring(d, (F.col("head") + i * F.col("width") + 1).cast("int"), F.col("width").cast("int")))
    each = wide.select("layer", "fields", F.posexplode(rows).alias("n", "row"))
    value = lambda f: F.trim(F.decode(F.substring("row", (f["at"] + 1).cast("int"), f["size"].cast("int")), "UTF-8"))
    return each.select("layer", "n", F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], value(f)))).alias("attributes"))


def reprojected(rows: DataFrame, zone: int = 32) -> DataFrame:
    """UTM rings as longitudes and latitudes."""
    return rows.withColumn("rings", F.transform("rings", lambda p: F.transform(p, lambda r: F.transform(r, lambda c: utm_to_lonlat(c["x"], c["y"], zone)))))


def municipalities(towns: DataFrame, provinces: DataFrame, regions: DataFrame, wanted: Column, zone: int = 32) -> DataFrame:
    """Chosen towns with the names of their province and region; one without fails (JN-19, SRC-05)."""
    a = lambda key: F.try_element_at("attributes", F.lit(key))
    t = towns.where(wanted).select(a("PRO_COM_T").alias("istat_code"), a("COMUNE").alias("municipality"), a("COD_PROV").alias("cod_prov"), a("COD_REG").alias("cod_reg"), "rings")
    p = provinces.select(a("COD_PROV").alias("cod_prov"), a("SIGLA").alias("province_code"), a("DEN_UTS").alias("province")).dropDuplicates(["cod_prov"])
    r = regions.select(a("COD_REG").alias("cod_reg"), a("DEN_REG").alias("region")).dropDuplicates(["cod_reg"])
    j = t.join(p, "cod_prov", "left").join(r, "cod_reg", "left")
    known = F.when(F.col("province").isNull() | F.col("region").isNull(), F.raise_error(F.concat(F.lit("no province or region for "), "istat_code"))).otherwise(F.col("istat_code"))
    return reprojected(j.withColumn("istat_code", known).withColumnRenamed("cod_reg", "region_code").drop("cod_prov"), zone)
