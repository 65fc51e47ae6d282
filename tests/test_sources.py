"""Shapefiles, manifests, captured searches and the lead index."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.plans.api import LeadIndex
from terravane.sources import captured, shapefile


def shp_of(shapes):
    body = b""
    for i, rings in enumerate(shapes, 1):
        points = [p for ring in rings for p in ring]
        starts, at = [], 0
        for ring in rings:
            starts.append(at)
            at += len(ring)
        record = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i, len(record) // 2) + record
    return bytes(100) + body


def dbf_of(names, rows):
    width = 1 + 20 * len(names)
    head = 32 + 32 * len(names) + 1
    out = bytes(4) + struct.pack("<IHH", len(rows), head, width) + bytes(20)
    out += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([20]) + bytes(15) for n in names) + b"\r"
    return out + b"".join(b" " + b"".join(str(v).encode().ljust(20) for v in r) for r in rows)


def test_shapefile(spark, tmp_path):
    outer, hole = [(500000, 0), (500000, 1000), (501000, 1000), (501000, 0), (500000, 0)], [(500200, 200), (500400, 200), (500400, 400), (500200, 400), (500200, 200)]
    layers = {"towns": (["PRO_COM_T", "COMUNE", "COD_PROV", "COD_REG"], [("001", "Uno", 1, 5)], [[outer, hole]]), "provinces": (["COD_PROV", "SIGLA", "DEN_UTS"], [(1, "TV", "Treviso")], [[outer]]), "regions": (["COD_REG", "DEN_REG"], [(5, "Veneto")], [[outer]])}
    for name, (fields, rows, shapes) in layers.items():
        (tmp_path / f"{name}.shp").write_bytes(shp_of(shapes))
        (tmp_path / f"{name}.dbf").write_bytes(dbf_of(fields, rows))
    every = shapefile.layers(spark, str(tmp_path))
    of = lambda n: every.where(F.col("layer") == n)
    row = shapefile.municipalities(of("towns"), of("provinces"), of("regions"), F.lit(True)).first()
    assert (row.municipality, row.province, row.region) == ("Uno", "Treviso", "Veneto")
    assert [len(r) for p in row.rings for r in p] == [4, 4]
    assert row.rings[0][0][0].x == pytest.approx(9, abs=1e-9) and row.rings[0][0][0].y == pytest.approx(0, abs=1e-9)


def shx_of(shapes):
    shp, at, out = shp_of(shapes), 100, bytes(100)
    while at < len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        out += struct.pack(">2i", at // 2, words)
        at += 8 + 2 * words
    return out


@pytest.mark.parametrize("index", [True, False])
def test_many_tasks_read_one_layer(spark, tmp_path, index):
    """Two hundred shapes with holes and several parts, other kinds of shapes, and text in two encodings."""
    box = lambda x, y, s, turn: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)][:: -1 if turn else 1]
    shapes = [[box(i, 0, 5, False), box(i + 1, 1, 1, True), *([box(i + 10, 0, 2, False)] if i % 3 == 0 else [])] for i in range(200)]
    rows = [(f"{i:03d}", f"Forlì {i}", i * 7) for i in range(200)]
    (tmp_path / "a.shp").write_bytes(shp_of(shapes))
    (tmp_path / "a.dbf").write_bytes(dbf_of(["CODE", "NAME", "N"], rows))
    if index:
        (tmp_path / "a.shx").write_bytes(shx_of(shapes))
    (tmp_path / "lonely.shp").write_bytes(shp_of(shapes))
    for suffix, content in (("shp", bytes(100)), ("dbf", dbf_of(["CODE"], [])), ("shx", bytes(100))):
        (tmp_path / f"empty.{suffix}").write_bytes(content)
    found = shapefile.layers(spark, str(tmp_path))
    got = {r["attributes"]["CODE"]: r for r in found.collect()}
    assert len(got) == 200 and {r["layer"] for r in got.values()} == {"a"}
    for i, row in enumerate(rows):
        r = got[row[0]]
        assert r["attributes"] == {"CODE": row[0], "NAME": row[1], "N": str(row[2])}
        outer = [[(p["x"], p["y"]) for p in ring] for polygon in r["rings"] for ring in polygon]
        assert sorted(outer) == sorted([[(float(x), float(y)) for x, y in ring[:-1]] for ring in shapes[i]])
        assert [len(p) for p in r["rings"]] == ([2, 1] if i % 3 == 0 else [2])
    assert shapefile.layers(spark, str(tmp_path), ["empty"]).collect() == []
    # The shapes of a layer are dealt out before they are read.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [layer" in plan.split("MapInArrow")[1].split("Join")[0]


def test_shapes_that_are_no_polygons_have_no_rings():
    assert shapefile.multipolygon(struct.pack("<i2d", 1, 0.0, 0.0)) == [] and shapefile.multipolygon(b"") == []
    assert shapefile.multipolygon(struct.pack("<i", 0) + bytes(60)) == []


def test_reprojection(spark):
    # A metre of northing along the central meridian is 1 / 0.9996 metres of the ellipsoid's meridian arc.
    a, f = geo.SEMI_AXIS_M, geo.FLATTENING
    n = f / (2 - f)
    lat = math.radians(45)
    e2 = f * (2 - f)
    steps = 20_000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * lat / steps) ** 2) ** 1.5 for i in range(steps)) * lat / steps
    got = spark.range(1).select(geo.utm_to_lonlat(F.lit(500000.0), F.lit(arc * 0.9996), 32).alias("p")).first()["p"]
    assert got.x == pytest.approx(9, abs=1e-9) and got.y == pytest.approx(45, abs=2e-8) and n > 0


def test_manifest(spark, tmp_path):
    (tmp_path / "scan.json").write_text(json.dumps({"restaurants": []}))
    (tmp_path / "truth.json").write_text(json.dumps({"cases": [{"id": "c1", "selector": {"name": "Bar"}, "expected": {"venue": True}}]}))
    (tmp_path / "base.json").write_text(json.dumps({"municipalities": [{"id": "a", "scan": "scan.json", "cases": []}, {"id": "b", "scan": "missing.json", "cases": []}]}))
    base = json.loads((tmp_path / "base.json").read_text())
    base["municipalities"][1]["scan"] = "scan.json"
    (tmp_path / "base.json").write_text(json.dumps(base))
    (tmp_path / "v2.json").write_text(json.dumps({"extends": "base.json", "municipalities": [{"id": "b", "truth_set": "truth.json"}]}))
    found = captured.manifest(spark, str(tmp_path / "v2.json"))
    assert [m["id"] for m in found["municipalities"]] == ["a", "b"] and found["municipalities"][1]["scan"] == {"restaurants": []}
    assert captured.cases(spark, found).first().name == "Bar"


def test_captured_searches(spark):
    schema = "query_position int, query string, provider string, results array<struct<title: string, url: string, snippet: string>>"
    rows = [(0, "q0", "p", [("Da Uno - Pagine", "https://dir.example/uno?x=1", ""), ("Due", "https://due.example/", "")]), (1, "q1", "p", [("Due", "https://due.example/", ""), ("Uno bis | Pagine", "https://dir.example/uno", "")]), (9, "q9", "p", [("Late", "https://late.example/", "")])]
    results = captured.search_results(spark.createDataFrame(rows, schema))
    once, by_query = captured.discovered(results, F.lit("admitted"))
    assert once.count() == 3
    assert {r.query_position: (r.n_keys, r.n_new) for r in by_query.collect()} == {0: (2, 2), 1: (2, 1)}
    assert [(r.path, r.name) for r in captured.directory_entries(results, "dir.example").collect()] == [("/uno", "Da Uno")]


def test_lead_index(spark):
    schema = "venue_id string, name string, status string, category string, region string, province string, municipality string, stage string, lon double, lat double, website string, phone string, next_on date"
    rows = [(f"v{i}", f"Bar {chr(65 + i % 5)}è", ["verified", "unchecked", "no_website"][i % 3], ["bar", "pub"][i % 2], "R", "P" if i % 4 else "Q", "Oderzo" if i % 4 else "Treviso", "demo" if i % 5 == 0 else None, 12.0 + i / 100, 45.0, None, "1" if i % 2 else None, None) for i in range(60)]
    index = LeadIndex(spark.createDataFrame(rows, schema))
    got = index.table(size=20, status=["verified"], query="BAR AE").collect()
    assert all(r.status == "verified" and r.name == "Bar Aè" for r in got) and got[0].total == len(got) == 4
    facets = {(r.facet, r.code): r.total for r in index.summary(status=["verified"], has_phone=True).collect()}
    assert facets["status", "unchecked"] == 10 and facets["category", "pub"] == 10
    assert index.locate("oderzo").first().n == 45 and index.towns(1).first().truncated
    assert sum(r.n for r in index.tile(4, 4, 2).collect()) == 60
    assert index.find("bar").count() == 10 and index.export(sample=7, seed="s").count() == 7
    assert index.export().first().line.startswith("v0,Bar Aè,verified,bar,R,Q,Treviso,45.0,12.0,,")
    assert {r.value: r.n for r in index.meta().where("dimension = 'category'").collect()} == {"bar": 30, "pub": 30}
