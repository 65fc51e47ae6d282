"""Map clusters against a plain pass over all items."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import clustering
from terravane.plans.catalog import QUERIES
from terravane.plans.place_queries import projected

SF = "/root/testdata/sf0.01"


def plain(points):
    """(key, x, y, flagged) to {zoom: clusters}; every pair of items is looked at."""
    items = sorted((k, x, y, 1, f, 17, k) for k, x, y, f in points)
    levels = {17: items}
    for zoom in range(16, 3, -1):
        r, used, out = 60 / (256 * 2**zoom), set(), []
        for i, (k, x, y, n, f, e, v) in enumerate(items):
            if i in used:
                continue
            group = [j for j in range(i, len(items)) if j not in used and (items[j][1] - x) ** 2 + (items[j][2] - y) ** 2 <= r * r]
            used.update(group)
            if len(group) == 1:
                out.append(items[i])
                continue
            total = sum(items[j][3] for j in group)
            mean = [sum(items[j][c] * items[j][3] for j in group) / total for c in (1, 2)]
            out.append((k, *mean, total, sum(items[j][4] for j in group), zoom + 1, None))
        levels[zoom] = items = out
    return levels


def rows(levels):
    return sorted(((z, round(x, 8), round(y, 8), n, f, e, v) for z, items in levels.items() for _, x, y, n, f, e, v in items), key=str)


def got(df):
    return sorted(((r["zoom"], round(r["x"], 8), round(r["y"], 8), r["n"], r["flagged"], r["expand_zoom"], r["id"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def scattered(spark):
    """A third of all points in one small place, some at the very same one, the rest wide apart."""
    rng = random.Random(4)
    r16 = clustering.radius(16)
    rows = [(0.5 + rng.uniform(-2, 2) * r16, 0.4 + rng.uniform(-2, 2) * r16) for _ in range(70)] + [(0.5, 0.4)] * 30
    rows += [(0.5 + rng.uniform(-1, 1) * 2.0**-k, 0.4 + rng.uniform(-1, 1) * 2.0**-k) for k in range(2, 17) for _ in range(12)]
    rng.shuffle(rows)
    return [(i, x, y, i % 3 == 0) for i, (x, y) in enumerate(rows)]


def table(spark, points):
    return spark.createDataFrame(points, "id long, x double, y double, flagged boolean")


def test_small_levels_equal_the_plain_pass(spark, scattered):
    assert got(clustering.greedy_clusters(table(spark, scattered))) == rows(plain(scattered))


def test_levels_of_any_size_equal_the_plain_pass(spark, scattered, monkeypatch):
    """No level is folded whole, blocks are tiny, and a round looks at two points of a cell only."""
    monkeypatch.setattr(clustering, "BLOCK", 4)
    monkeypatch.setattr(clustering, "HALO", 3)
    monkeypatch.setattr(clustering, "FIRST", 2)
    some = [p for p in scattered if p[0] % 2]
    want = rows({z: c for z, c in plain(some).items() if z >= 12})
    monkeypatch.setattr(clustering, "MIN_ZOOM", 12)
    assert got(clustering.greedy_clusters(table(spark, some), small=0)) == want


def test_a_chain_in_order_is_decided_in_rounds(spark, monkeypatch):
    """Each point depends on the one before, over many blocks."""
    monkeypatch.setattr(clustering, "MIN_ZOOM", 16)
    monkeypatch.setattr(clustering, "BLOCK", 8)
    step = clustering.radius(16) * 0.75
    points = [(i, 0.3 + i * step, 0.3, False) for i in range(40)]
    assert got(clustering.greedy_clusters(table(spark, points), small=0)) == rows({z: c for z, c in plain(points).items() if z >= 16})


def test_the_query_equals_the_plain_pass_at_every_zoom(spark):
    points = [(r["c_custkey"], r["x"], r["y"], int(r["flagged"])) for r in projected(spark, SF).collect()]
    assert got(QUERIES["map_clusters"](spark, SF)) == rows(plain(points))


def test_expansion_is_carried_on_and_order_is_by_number(spark):
    """Ten and two differ as numbers and as text; the pair merges at zoom 10 only."""
    gap = clustering.radius(10) * 0.9
    points = [(2, 0.5, 0.5, True), (10, 0.5 + gap, 0.5, False), (3, 0.9, 0.9, False)]
    found = {(r["zoom"], r["n"]): r for r in clustering.greedy_clusters(table(spark, points)).where("x < 0.6").collect()}
    assert {found[z, 2]["expand_zoom"] for z in range(4, 11)} == {11}
    assert math.isclose(found[4, 2]["x"], 0.5 + gap / 2)
    assert (11, 2) not in found


def test_points_without_places_and_empty_tables(spark):
    points = [(1, None, 0.5, True), (None, 0.5, 0.5, None), (None, 0.5, 0.5, True), (4, 0.5, None, False)]
    found = clustering.greedy_clusters(table(spark, points))
    assert {(r["zoom"], r["n"], r["flagged"]) for r in found.where("zoom < 17").collect()} == {(z, 2, 1) for z in range(4, 17)}
    assert clustering.greedy_clusters(table(spark, [])).collect() == []


def test_tiles_hold_each_item_once(spark, scattered):
    levels = clustering.greedy_clusters(table(spark, scattered)).cache()
    for zoom in (4, 9, 17):
        world = 256 * 2**zoom
        tiles = {(int(r["x"] * world // 512), int(r["y"] * world // 512)) for r in levels.where(F.col("zoom") == clustering.level_of(zoom)).collect()}
        tiles = {(x + dx, y + dy) for x, y in tiles for dx in (-1, 0, 1) for dy in (-1, 0, 1)} if len(tiles) < 4 else tiles
        if len(tiles) < 30:
            owned = sum(r["n"] for x, y in tiles for r in clustering.tile_items(levels, zoom, x, y).collect() if 0 <= r["px"] < 512 and 0 <= r["py"] < 512)
            assert owned == len(scattered)
