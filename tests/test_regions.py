"""Points in regions by the cover of cells, against the test of every point with every whole region."""

import math
import random

import pytest

from terravane.functions import geo
from terravane.operators import spatial

SCHEMA = f"code string, rings {geo.RINGS}"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def star(cx, cy, n, inner, outer, seed):
    rng = random.Random(seed)
    return ring([(cx + math.cos(2 * math.pi * i / n) * rng.uniform(inner, outer), cy + math.sin(2 * math.pi * i / n) * rng.uniform(inner, outer)) for i in range(n)])


@pytest.fixture(scope="module")
def regions(spark):
    square = lambda a, b, c, d: ring([(a, b), (c, b), (c, d), (a, d)])
    rows = [
        ("star", [[star(7.3, 45.2, 400, 1.0, 1.9, 1)]]),
        ("holes", [[square(0, 0, 6, 4), square(1, 1, 2.5, 2.5), star(4.4, 2.2, 30, 0.3, 0.7, 2)]]),
        ("parts", [[square(-3, -3, -1, -1)], [square(-1, -3, 0.35, -1)], [star(-5, 2, 60, 0.5, 0.9, 3)]]),
        ("thin", [[ring([(-8, -8), (9.7, 8.3), (9.70001, 8.3)])]]),
        ("over", [[square(5, 3, 8, 46)]]),
        ("none", []),
        ("null", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def points(spark, regions):
    rng = random.Random(9)
    rows = [(rng.uniform(-9, 10), rng.uniform(-9, 48)) for _ in range(600)] + [(rng.uniform(5, 9), rng.uniform(43, 47.5)) for _ in range(400)] + [(rng.uniform(-6, 7), rng.uniform(-4, 5)) for _ in range(500)]
    corners = [(p["x"], p["y"]) for r in regions.collect() for polygon in r["rings"] or () for a_ring in polygon for p in a_ring[:40]]
    edges = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(corners, corners[1:])]
    rows += corners + edges + [(x + 1e-12, y) for x, y in corners[:50]] + [(x / 10, y / 10) for x in range(-35, 65, 3) for y in range(-32, 42, 3)]
    rows += [(None, 1.0), (1.0, None), (0.5, 0.5), (0.5, 0.5)]
    return spark.createDataFrame([(i % 1500, x, y, "kept") for i, (x, y) in enumerate(rows)], "id long, lon double, lat double, note string")


@pytest.mark.parametrize("size", [0.1, 0.37, 3.0])
def test_cover_gives_what_whole_rings_give(spark, regions, points, size):
    from pyspark.sql import functions as F

    box = F.col("box")
    pairs = points.where("lon is not null and lat is not null").select("lon", "lat").distinct().crossJoin(regions.where("rings is not null").withColumn("box", geo.box_of(F.col("rings"))))
    pairs = pairs.where(F.col("lon").between(box["west"], box["east"]) & F.col("lat").between(box["south"], box["north"])).withColumn("place", geo.place_in(F.col("lon"), F.col("lat"), F.col("rings"))).where("place <> 'outside'")
    want = {}
    for r in pairs.select("lon", "lat", "code", "place").collect():
        want.setdefault((r["lon"], r["lat"]), []).append((r["code"], r["place"]))
    got = spatial.assign(points, regions, "id", "code", "lon", "lat", size=size).collect()
    assert len(got) == points.count() and all(r["note"] == "kept" for r in got)
    for r in got:
        hits = want.get((r["lon"], r["lat"]), [])
        if len(hits) == 1 and hits[0][1] == "inside":
            assert (r["code"], r["status"]) == (hits[0][0], "assigned")
        else:
            assert (r["code"], r["status"]) == (None, "ambiguous" if hits else "outside"), (r, hits)
    assert {r["status"] for r in got} == {"assigned", "ambiguous", "outside"}


def test_inner_cells_are_coarse_and_strips_hold_few_edges(spark, regions):
    """No ring is copied: a strip holds the edges that reach it, and the inside is covered by large cells too."""
    found = spatial.cover(regions.where("code = 'star'"))
    whole = 400
    widest = found.strips.selectExpr("aggregate(flatten(polygons), 0, (n, e) -> n + size(e)) AS n").agg({"n": "max"}).first()[0]
    assert widest < whole / 4
    assert {r["level"] for r in found.cells.where("inner").select("level").distinct().collect()} == {0, 1}
    area = sum((0.1 * 4 ** r["level"]) ** 2 for r in found.cells.where("inner").collect())
    assert 2.5 < area < math.pi * 1.9**2


def test_a_point_on_one_polygons_edge_is_on_the_boundary_even_inside_another(spark):
    from pyspark.sql import functions as F

    square = lambda a, b, c, d: ring([(a, b), (c, b), (c, d), (a, d)])
    rows = [(1.0, 1.0, "inside"), (2.0, 1.0, "boundary"), (4.0, 1.0, "boundary"), (5.0, 1.0, "outside")]
    frame = spark.createDataFrame([(x, y, want, [[square(0, 0, 4, 2)], [square(2, 0, 3, 2)]]) for x, y, want in rows], f"x double, y double, want string, rings {geo.RINGS}")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", geo.place_in(F.col("x"), F.col("y"), F.col("rings"))).collect())


def test_empty_tables(spark, regions, points):
    assert spatial.assign(points.where("false"), regions, "id", "code", "lon", "lat").collect() == []
    assert {r["status"] for r in spatial.assign(points, regions.where("false"), "id", "code", "lon", "lat").collect()} == {"outside"}
