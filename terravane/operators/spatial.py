"""Points to regions: by a cover of each region with cells of several sizes, or by the boxes of regions."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import box_of, cell, cells, edges_of, place_among, place_of, tolerance
from ..tables import cut

CELL = 0.1
#: Sizes of cells; each is four times the one before.
LEVELS = 3
#: Edges count for cells this near them too; more than any tolerance on coordinates below a thousand.
MARGIN = 1e-7


def indexed(regions: DataFrame, region: str = "code", rings: str = "rings", size: float = CELL) -> DataFrame:
    """A row for each region and grid cell that its box touches, with the box (GEO-01)."""
    boxed = regions.select(region, box_of(F.col(rings)).alias("box"))
    by_x = boxed.withColumn("cx", F.explode(cells(F.col("box.west"), F.col("box.east"), size)))
    return by_x.withColumn("cy", F.explode(cells(F.col("box.south"), F.col("box.north"), size)))


def candidates(points: DataFrame, regions: DataFrame, x: str, y: str, region: str = "code", rings: str = "rings", size: float = CELL) -> DataFrame:
    """Points with the regions in whose box they lie. A small table of regions is broadcast by Spark; a large one is shuffled by cell."""
    at = points.withColumn("cx", cell(F.col(x), size)).withColumn("cy", cell(F.col(y), size))
    hit = at.join(indexed(regions, region, rings, size), ["cx", "cy"])
    return hit.where(F.col(x).between(F.col("box.west"), F.col("box.east")) & F.col(y).between(F.col("box.south"), F.col("box.north"))).drop("cx", "cy", "box")


class Cover(NamedTuple):
    """The cells of all regions, and the edges of their borders by strips; both written tables."""

    #: ``level, cx, cy, region, inner``: cells inside a region, and small ones that its border may touch.
    cells: DataFrame
    #: ``region, cy, polygons, box``: for each strip of small cells the edges that reach it, by polygon and ring.
    strips: DataFrame
    size: float


def cover(regions: DataFrame, region: str = "code", rings: str = "rings", size: float = CELL, levels: int = LEVELS) -> Cover:
    """Regions as disjoint cells (GEO-01). A point in a cell without border needs no test.

    Rings are taken apart into edges once. An edge goes to the strips of cells that it passes, clipped to them, and
    marks the cells that it touches there. Cells without such a mark are wholly inside or outside, which their centre
    tells; they are as large as the border allows, so their number grows with its length, not with the area.
    """
    shapes = regions.select(F.col(region).alias("region"), F.col(rings).alias("rings"), box_of(F.col(rings)).alias("box")).where("box.west is not null")
    polygons = shapes.select("region", F.posexplode("rings").alias("polygon", "p"))
    every = polygons.select("region", "polygon", F.posexplode("p").alias("ring", "r")).select("region", "polygon", "ring", F.explode(edges_of(F.col("r"))).alias("e"))
    e = F.col("e")
    low, high = F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by")
    passed = every.withColumn("cy", F.explode(cells(low - MARGIN, high + MARGIN, size)))
    by_ring = passed.groupBy("region", "cy", "polygon", "ring").agg(F.collect_list("e").alias("edges"))
    by_polygon = by_ring.groupBy("region", "cy", "polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "edges"))).alias("rings"))
    # A strip that no outer ring reaches is outside of the polygon.
    by_polygon = by_polygon.where(F.col("rings")[0]["ring"] == 0).select("region", "cy", F.transform("rings", lambda r: r["edges"]).alias("rings"))
    strips = cut(by_polygon.groupBy("region", "cy").agg(F.collect_list("rings").alias("polygons")).join(shapes.select("region", "box"), "region"))

    def at(bound: Column) -> Column:
        """Where an edge passes a level line, kept within its ends."""
        part = (F.greatest(F.least(bound, high), low) - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return e["ax"] + (e["bx"] - e["ax"]) * part

    west, east = F.least("e.ax", "e.bx"), F.greatest("e.ax", "e.bx")
    one, other = at(F.col("cy") * size - MARGIN), at((F.col("cy") + 1) * size + MARGIN)
    slack = MARGIN + F.coalesce(tolerance(e) / F.nullif(F.abs(e["by"] - e["ay"]), F.lit(0.0)), F.lit(0.0))
    left, right = F.greatest(F.least(one, other) - slack, west - MARGIN), F.least(F.greatest(one, other) + slack, east + MARGIN)
    level = F.col("e.ay") == F.col("e.by")
    touched = passed.select("region", "cy", F.explode(cells(F.when(level, west - MARGIN).otherwise(left), F.when(level, east + MARGIN).otherwise(right), size)).alias("cx"))
    border = cut(touched.select("region", "cx", "cy").distinct())

    coarse = lambda k: border.select("region", F.shiftright("cx", 2 * k).alias("cx"), F.shiftright("cy", 2 * k).alias("cy")).distinct()
    wide = size * 4 ** (levels - 1)
    boxed = shapes.select("region", F.explode(cells(F.col("box.west"), F.col("box.east"), wide)).alias("cx"), "box")
    tried = boxed.select("region", "cx", F.explode(cells(F.col("box.south"), F.col("box.north"), wide)).alias("cy"))
    found = [border.select(F.lit(0).alias("level"), "cx", "cy", "region", F.lit(False).alias("inner"))]
    for k in range(levels - 1, -1, -1):
        marked = coarse(k)
        free = tried.join(marked, ["region", "cx", "cy"], "left_anti")
        middle = lambda c, k=k: (F.col(c) + 0.5) * (size * 4**k)
        asked = free.select("region", F.col("cx").alias("free_x"), F.col("cy").alias("free_y"), middle("cx").alias("x"), middle("cy").alias("y")).withColumn("cy", cell(F.col("y"), size))
        held = asked.join(strips, ["region", "cy"]).where(_place(F.col("x"), F.col("y")) == "inside")
        found.append(held.select(F.lit(k).alias("level"), F.col("free_x").alias("cx"), F.col("free_y").alias("cy"), "region", F.lit(True).alias("inner")))
        steps = lambda c: F.explode(F.sequence(F.shiftleft(c, 2), F.shiftleft(c, 2) + 3)).alias(c)
        tried = marked.select("region", steps("cx"), "cy").select("region", "cx", steps("cy"))
    every_cell = found[0]
    for more in found[1:]:
        every_cell = every_cell.unionByName(more)
    return Cover(cut(every_cell), strips, size)


def _place(x: Column, y: Column) -> Column:
    return place_of(F.transform("polygons", lambda p: F.transform(p, lambda edges: place_among(x, y, edges))))


def assign(points: DataFrame, regions: DataFrame | Cover, key: str, region: str, x: str, y: str, rings: str = "rings", size: float = CELL) -> DataFrame:
    """Each point's region and status: assigned (inside exactly one, on no edge), outside, or ambiguous (JN-01).

    Points without coordinates are outside. Places are looked up in the cover, which may be given ready in place of
    the regions, once for each distinct place; only those in a cell at a border are tested, against the edges of their
    strip. Rows that repeat a key or place keep a row each.
    """
    found = regions if isinstance(regions, Cover) else cover(regions, region, rings, size)
    places = points.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").distinct()
    placed = places.withColumn("fine_x", cell(F.col("x"), found.size)).withColumn("fine_y", cell(F.col("y"), found.size))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    keyed = placed.select("x", "y", "fine_x", "fine_y", levels).withColumn("cx", F.expr("shiftright(fine_x, 2 * level)")).withColumn("cy", F.expr("shiftright(fine_y, 2 * level)"))
    hit = keyed.join(found.cells, ["level", "cx", "cy"]).select("x", "y", "fine_y", "region", "inner")
    inner = hit.where("inner").select("x", "y", "region", F.lit("inside").alias("place"))
    near = hit.where("not inner").select("x", "y", "region", F.col("fine_y").alias("cy")).join(found.strips, ["region", "cy"])
    near = near.where(F.col("x").between(F.col("box.west"), F.col("box.east")) & F.col("y").between(F.col("box.south"), F.col("box.north")))
    near = near.select("x", "y", "region", _place(F.col("x"), F.col("y")).alias("place")).where("place <> 'outside'")
    hits = inner.unionByName(near).groupBy(F.col("x").alias(x), F.col("y").alias(y)).agg(F.count("*").alias("__hits"), F.count_if(F.col("place") == "boundary").alias("__edges"), F.min("region").alias("__region"))
    single = (F.col("__hits") == 1) & (F.col("__edges") == 0)
    status = F.when(F.col("__hits").isNull(), "outside").when(single, "assigned").otherwise("ambiguous")
    mine = points.select(*dict.fromkeys([key, *points.columns])).drop(region)
    return mine.join(hits, [x, y], "left").withColumn("status", status).withColumn(region, F.when(single, F.col("__region"))).drop("__hits", "__edges", "__region")


def merged_regions(regions: DataFrame, changes: DataFrame, code: str, rings: str = "rings") -> DataFrame:
    """Successors with the polygons of all their predecessors in place of these (SRC-06).

    ``changes(successor, predecessors)``; predecessors' polygons are concatenated in the order given.
    """
    pairs = changes.select("successor", F.posexplode("predecessors").alias("n", code))
    joined = pairs.join(regions.select(code, rings), code)
    made = joined.groupBy("successor").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", rings))), lambda s: s[rings])).alias(rings))
    rest = regions.select(code, rings).join(pairs.select(code).distinct(), code, "left_anti")
    return rest.unionByName(made.withColumnRenamed("successor", code))


def whole_box(regions: DataFrame, rings: str = "rings") -> DataFrame:
    """The box of all regions."""
    b = regions.select(box_of(F.col(rings)).alias("b"))
    return b.agg(F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"))


def outside_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return ~(x.between(box[0], box[2]) & y.between(box[1], box[3]))
