"""Map clusters: greedy ones in the order of the points, counts on a fixed grid, and tiles of either."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import tile
from ..tables import cut

# The zooms, the pixels of the world at zoom zero and of a tile, and radius and margin in pixels.
MIN_ZOOM, MAX_ZOOM, WORLD_PX, TILE_PX, RADIUS_PX, BUFFER_PX = 4, 16, 256, 512, 60, 48

#: Levels of at most so many items are folded by one task, with all levels above them on the map.
SMALL = 1 << 16
#: Cells of a block's side, the margin around it, and how many cells the radius reaches.
BLOCK, HALO, REACH = 32, 8, 2
#: Points of a cell that a round looks at.
FIRST = 8

ITEM = ["order", "x", "y", "n", "flagged", "expand_zoom", "id"]


def radius(zoom: int) -> float:
    """The radius as a part of the map's width."""
    return RADIUS_PX / (WORLD_PX * 2**zoom)


def greedy_clusters(points: DataFrame, x: str = "x", y: str = "y", flag: str = "flagged", key: str = "id", small: int = SMALL) -> DataFrame:
    """``zoom, x, y, n, flagged, expand_zoom, id`` for the points themselves (zoom 17) and for zooms 16 to 4 (GEO-05).

    At each zoom the items of the zoom below are gone through in order, points by ``key``, clusters by their first
    item; an item that is left takes all others that are left within the radius. The cluster lies at the centroid,
    weighted by counts. ``expand_zoom`` is the zoom at which it splits, carried on while nothing is added to it;
    ``id`` is the point's key while it stands alone.

    The result is that of the pass over all items, whatever their distribution: an item becomes the centre of a
    cluster if no earlier centre is within the radius, which depends on earlier items near it only. So blocks of
    the map, with a margin, decide theirs at the same time, in rounds; what cannot be decided without items beyond
    the margin, or beyond the first of a cell, waits for the next. No block has more than a bounded number of rows.
    Every item then joins the first centre within its reach. A level of at most ``small`` items, and what follows from
    it, is folded in one task. Points without coordinates are in no cluster; keys may repeat or be null.
    """
    placed = points.select(F.col(key).alias("order"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col(flag).cast("long"), F.lit(0).cast("long")).alias("flagged"))
    placed = placed.where("x is not null and y is not null").withColumn("expand_zoom", F.lit(MAX_ZOOM + 1)).withColumn("id", F.col("order"))
    # Points at one place are always in one cluster, that of the first of them.
    alone = F.when(F.count("*") == 1, F.min("id")).alias("id")
    items = placed.groupBy("x", "y").agg(F.min("order").alias("order"), F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.min("expand_zoom").alias("expand_zoom"), alone)
    now = cut(items.select(*ITEM))
    levels = [placed.select(F.lit(MAX_ZOOM + 1).alias("zoom"), *ITEM)]
    for zoom in range(MAX_ZOOM, MIN_ZOOM - 1, -1):
        if now.count() <= small:
            levels.append(_folded(now, zoom))
            break
        now = cut(_level(now, zoom))
        levels.append(now.select(F.lit(zoom).alias("zoom"), *ITEM))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("zoom", "x", "y", "n", "flagged", "expand_zoom", "id")


def _folded(items: DataFrame, first: int) -> DataFrame:
    kind = dict(items.dtypes)["order"]

    def run(batches):
        if held := [b for b in batches if len(b)]:
            level = pd.concat(held)
            for zoom in range(first, MIN_ZOOM - 1, -1):
                level = fold_level(level, zoom)
                yield level.assign(zoom=zoom)[["zoom", *ITEM]]

    return items.repartition(1).mapInPandas(run, f"zoom int, order {kind}, x double, y double, n long, flagged long, expand_zoom int, id {kind}")


def fold_level(items: pd.DataFrame, zoom: int) -> pd.DataFrame:
    """One level, item by item in order."""
    r = radius(zoom)
    items = items.sort_values(["order", "x", "y"], na_position="first").reset_index(drop=True)
    xs, ys = items["x"].to_numpy(), items["y"].to_numpy()
    cells = defaultdict(list)
    at = list(zip((xs // r).astype(int).tolist(), (ys // r).astype(int).tolist()))
    for i, c in enumerate(at):
        cells[c].append(i)
    centre = np.full(len(items), -1)
    for i, (cx, cy) in enumerate(at):
        if centre[i] >= 0:
            continue
        near = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ()) if centre[j] < 0])
        centre[near[(xs[near] - xs[i]) ** 2 + (ys[near] - ys[i]) ** 2 <= r * r]] = i
    weighed = items.assign(centre=centre, wx=items["x"] * items["n"], wy=items["y"] * items["n"], size=1)
    sums = weighed.groupby("centre", as_index=False)[["n", "flagged", "wx", "wy", "size"]].sum()
    out = items.iloc[sums["centre"].to_numpy()].reset_index(drop=True)
    merged = (sums["size"] > 1).to_numpy()
    out["x"] = np.where(merged, sums["wx"] / sums["n"], out["x"])
    out["y"] = np.where(merged, sums["wy"] / sums["n"], out["y"])
    out["n"], out["flagged"] = sums["n"], sums["flagged"]
    out["expand_zoom"] = np.where(merged, zoom + 1, out["expand_zoom"])
    out["id"] = out["id"].where(~merged, None)
    return out[ITEM]


def _side(zoom: int) -> float:
    """Cells whose points are all within the radius of each other."""
    return radius(zoom) / math.sqrt(2)


def _level(items: DataFrame, zoom: int) -> DataFrame:
    """One level of any size."""
    s = _side(zoom)
    items = items.withColumn("cx", F.floor(F.col("x") / s)).withColumn("cy", F.floor(F.col("y") / s))
    centres = None
    while True:
        left = items
        if centres is not None:
            left = items.join(_by_cell(centres), ["cx", "cy"], "left").where(~F.exists(F.coalesce("near", F.array().cast(_near_type(items))), _within(zoom))).drop("near")
        found = cut(_decided(left, zoom))
        if found.isEmpty():
            break
        centres = found if centres is None else centres.unionByName(found)
    first = F.array_min(F.filter("near", _within(zoom)))["at"].alias("centre")
    joined = items.join(_by_cell(centres), ["cx", "cy"]).select(first, F.struct("order", "x", "y").alias("at"), *ITEM)
    own = lambda c: F.max(F.when(F.col("at") == F.col("centre"), F.col(c)))
    single = F.count("*") == 1
    mean = lambda c: F.when(single, own(c)).otherwise(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    sums = joined.groupBy("centre").agg(mean("x"), mean("y"), F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.when(single, own("expand_zoom")).otherwise(zoom + 1).alias("expand_zoom"), F.when(single, own("id")).alias("id"))
    return sums.select(F.col("centre.order").alias("order"), *ITEM[1:])


def _near_type(items: DataFrame) -> str:
    return f"array<struct<at:struct<order:{dict(items.dtypes)['order']},x:double,y:double>>>"


def _within(zoom: int):
    r = radius(zoom)

    def test(c: Column) -> Column:
        dx, dy = F.col("x") - c["at"]["x"], F.col("y") - c["at"]["y"]
        return dx * dx + dy * dy <= r * r

    return test


def _by_cell(centres: DataFrame) -> DataFrame:
    """For each cell the centres whose radius may reach it: at most one of each cell around."""
    around = lambda c: F.explode(F.sequence(F.col(c) - REACH, F.col(c) + REACH)).alias(c)
    wide = centres.select(F.struct("order", "x", "y").alias("at"), around("cx"), "cy").select("at", "cx", around("cy"))
    return wide.groupBy("cx", "cy").agg(F.collect_list(F.struct("at")).alias("near"))


def _decided(left: DataFrame, zoom: int) -> DataFrame:
    """The items of ``left``, none of which is within the radius of a known centre, that are certain to be centres."""
    w = W.partitionBy("cx", "cy").orderBy("order", "x", "y")
    seen = left.select("order", "x", "y", "cx", "cy").withColumn("place", F.row_number().over(w)).where(F.col("place") <= FIRST + 1)
    around = lambda c: F.sequence(F.floor((F.col(c) - HALO) / BLOCK), F.floor((F.col(c) + HALO) / BLOCK))
    dealt = seen.withColumn("bx", F.explode(around("cx"))).withColumn("by", F.explode(around("cy")))
    kind = dict(left.dtypes)["order"]
    r2 = radius(zoom) ** 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf["bx"].iloc[0]) * BLOCK, int(pdf["by"].iloc[0]) * BLOCK
        pdf = pdf.sort_values(["order", "x", "y"], na_position="first")
        centres, unknown, closed, keep = defaultdict(list), defaultdict(list), set(), []
        edge = HALO - REACH
        rows = zip(*[pdf[c].tolist() for c in ("x", "y", "cx", "cy", "place")])
        for i, (px, py, cx, cy, place) in enumerate(rows):
            cells = [(cx + dx, cy + dy) for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1)]
            close = lambda held: any((px - qx) ** 2 + (py - qy) ** 2 <= r2 for c in cells for qx, qy in held.get(c, ()))  # noqa: B023, E731
            if place > FIRST:
                # More points of this cell follow, which this round doesn't see.
                closed.add((cx, cy))
            elif close(centres):
                continue
            elif not (bx - edge <= cx < bx + BLOCK + edge and by - edge <= cy < by + BLOCK + edge) or not closed.isdisjoint(cells) or close(unknown):
                unknown[cx, cy].append((px, py))
            else:
                centres[cx, cy].append((px, py))
                if bx <= cx < bx + BLOCK and by <= cy < by + BLOCK:
                    keep.append(i)
        return pdf.iloc[keep][["order", "x", "y", "cx", "cy"]]

    return dealt.groupBy("bx", "by").applyInPandas(run, f"order {kind}, x double, y double, cx long, cy long")


def grid_clusters(points: DataFrame, zoom: int, x: str = "x", y: str = "y", cells_a_tile: int = 8, flag: str = "flagged") -> DataFrame:
    """Counts and centroids on a fixed grid, exact at any size (GEO-07)."""
    fine = zoom + int(np.log2(cells_a_tile))
    keyed = points.withColumn("gx", tile(F.col(x), fine)).withColumn("gy", tile(F.col(y), fine))
    return keyed.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("flagged"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def level_of(zoom: int) -> int:
    """The level that a map at this zoom shows."""
    return max(MIN_ZOOM, min(MAX_ZOOM + 1, zoom))


def tile_items(clusters: DataFrame, zoom: int, tx: int, ty: int) -> DataFrame:
    """What a tile of a map zoom shows, with the pixels in it, and what lies within the margin around it (GEO-06).

    Below the lowest level the tile shows that one, beyond the highest the points themselves.
    """
    world, level = float(WORLD_PX * 2**zoom), level_of(zoom)
    within = lambda c, t: F.col(c).between((t * TILE_PX - BUFFER_PX) / world, ((t + 1) * TILE_PX + BUFFER_PX) / world)
    pixel = lambda c, t: F.floor(F.col(c) * world - t * TILE_PX + 0.5).cast("int")
    near = clusters.where((F.col("zoom") == level) & within("x", tx) & within("y", ty))
    return near.withColumn("px", pixel("x", tx)).withColumn("py", pixel("y", ty))
