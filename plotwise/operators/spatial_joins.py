"""Joins of features with viewports, points and ranges. Each finds its candidates by an equi-join on grid cells or buckets, then tests exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions.curve import _TINY, GRID, grid_cell
from plotwise.operators.selection import Box
from plotwise.storage import saved

#: The finest level has 2**16 cells an axis; only even levels are used.
FINEST = 16


def usable(box: str = "") -> Column:
    """Finite sides in order."""
    sides = [F.col(f"{box}{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    ok = (sides[0] <= sides[2]) & (sides[1] <= sides[3])
    for s in sides:
        ok = ok & ~F.isnan(s) & (F.abs(s) < float("inf"))
    return ok


def box_level(extent: Box) -> Column:
    """The finest even level whose cells are as large as the box: there it covers two cells an axis at most. Level k has 2**k cells an axis."""
    share = F.greatest((F.col("xmax") - F.col("xmin")) / max(extent[2] - extent[0], _TINY), (F.col("ymax") - F.col("ymin")) / max(extent[3] - extent[1], _TINY))
    level = F.least(F.lit(float(FINEST)), F.greatest(F.lit(0.0), F.floor(-F.log2(F.greatest(share, F.lit(2.0**-FINEST))))))
    return (F.floor(level / 2) * 2).cast("int")


def _cell(v: Column, lo: float, hi: float, level: Column) -> Column:
    cells = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(0.0), F.least(cells - 1, F.floor((v - lo) / max(hi - lo, _TINY) * cells))).cast("long")


def _key(tag: int, level: Column, c: Column, r: Column) -> Column:
    return F.shiftleft((level + tag * 32).cast("long"), 34) + F.shiftleft(c, 17) + r


def _dealt(boxes: DataFrame, extent: Box, levels: Column, tag: int) -> DataFrame:
    """A row (_level, _key) for each cell of each box at each of its levels."""
    at = boxes.withColumn("_level", F.explode(levels))
    level = F.col("_level")
    cols = F.sequence(_cell(F.col("xmin"), extent[0], extent[2], level), _cell(F.col("xmax"), extent[0], extent[2], level))
    rows = F.sequence(_cell(F.col("ymin"), extent[1], extent[3], level), _cell(F.col("ymax"), extent[1], extent[3], level))
    spread = at.withColumn("_c", F.explode(cols)).withColumn("_r", F.explode(rows))
    return spread.withColumn("_key", _key(tag, level, F.col("_c"), F.col("_r"))).drop("_c", "_r")


def bbox_join(features: DataFrame, views: DataFrame, extent: Box) -> DataFrame:
    """(view_id, id) of all features whose box meets a viewport. features: id, xmin..ymax; views: view_id, xmin..ymax; extent: that of the features.

    Boxes live on a grid of levels, each on the level of its size, so neither side is ever too wide for its cells.  A pair meets on the
    coarser of its two levels: a feature is put in its own cells, and on the coarser levels that viewports live on; a viewport in its own cells
    and on the levels of features down to its own.  So the cells follow the sizes of the boxes, and what meets in one grows with the result.
    A pair may meet in up to four cells, and is kept in the one that holds the lower left corner of what both cover, so no second shuffle
    removes duplicates.  An unusable box meets nothing; where the extent has no span everything lies in one cell, so nothing is lost."""
    level = box_level(extent)
    features, views = features.where(usable()).withColumn("_own", level), views.where(usable()).withColumn("_own", level)
    used_f, used_v = ([r[0] for r in side.select("_own").distinct().collect()] for side in (features, views))  # nine levels at most
    own, every = F.array("_own"), F.array().cast("array<int>")

    def among(used: list[int], keep) -> Column:
        return F.filter(F.array(*map(F.lit, sorted(used))).cast("array<int>"), keep) if used else every

    f = _dealt(features, extent, own, 0).unionByName(_dealt(features, extent, among(used_v, lambda k: k < F.col("_own")), 1))
    v = _dealt(views, extent, among(used_f, lambda k: k <= F.col("_own")), 0).unionByName(_dealt(views, extent, own, 1))
    v = v.select("view_id", "_key", *(F.col(c).alias(f"v_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    meets = (F.col("xmin") <= F.col("v_xmax")) & (F.col("xmax") >= F.col("v_xmin")) & (F.col("ymin") <= F.col("v_ymax")) & (F.col("ymax") >= F.col("v_ymin"))
    corner_c = _cell(F.greatest("xmin", "v_xmin"), extent[0], extent[2], F.col("_level"))
    corner_r = _cell(F.greatest("ymin", "v_ymin"), extent[1], extent[3], F.col("_level"))
    here = F.col("_key").bitwiseAND(F.lit((1 << 34) - 1)) == F.shiftleft(corner_c, 17) + corner_r
    return f.join(v, "_key").where(meets & here).select("view_id", "id")


def occupancy(features: DataFrame, extent: Box, grid: int = GRID, most: int = 1024) -> DataFrame:
    """(cell, n) of the grid's occupied cells, by the boxes that cover `most` cells or fewer."""
    c0, c1 = grid_cell(F.col("xmin"), extent[0], extent[2], grid), grid_cell(F.col("xmax"), extent[0], extent[2], grid)
    r0, r1 = grid_cell(F.col("ymin"), extent[1], extent[3], grid), grid_cell(F.col("ymax"), extent[1], extent[3], grid)
    narrow = features.where((c1 - c0 + 1) * (r1 - r0 + 1) <= most)
    cells = narrow.select(F.explode(F.sequence(c0, c1)).alias("c"), r0.alias("r0"), r1.alias("r1")).select("c", F.explode(F.sequence("r0", "r1")).alias("r"))
    cells = cells.select((F.col("c") * grid + F.col("r")).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n"))


_LEVELS = 64


def dyadic_blocks(ranges: DataFrame) -> DataFrame:
    """(_level, _block) of the blocks of 2**_level ids, beginning at a multiple of that, that make up each [lo, hi]: at most two a level. An empty range has none."""
    level = ranges.where("lo <= hi").select(F.col("lo").cast("long"), F.col("hi").cast("long"), F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("_level"))
    mask = "CASE WHEN _level = 0 THEN 0L ELSE shiftrightunsigned(-1L, 64 - _level) END"
    ends = level.select(
        "_level",
        F.expr(f"shiftright(lo, _level) + CAST((lo & {mask}) <> 0 AS BIGINT)").alias("first"),  # the first block from lo on, and the last up to hi
        F.expr(f"shiftright(hi, _level) - CAST((hi & {mask}) <> {mask} AS BIGINT)").alias("last"),
    )
    odd, even = F.when(F.expr("(first & 1) = 1"), F.col("first")), F.when(F.expr("(last & 1) = 0"), F.col("last"))  # those that no block of the next level takes in
    return ends.where("first <= last").select("_level", F.explode(F.array_compact(F.array(odd, even))).alias("_block"))


def range_semi_join(features: DataFrame, ranges: DataFrame) -> DataFrame:
    """Features whose id lies in any [lo, hi], each as often as it comes; ids and bounds are any longs.

    A range becomes blocks of a power of two of ids, at most two of each size, however wide it is; blocks within another's are left out.  A feature
    asks for the block that holds it, at the sizes that are used.  So it meets one block at most, by an equi-join, and nothing is put into buckets
    of a fixed width.  Blocks few enough are broadcast by Spark, and then no feature moves."""
    blocks = dyadic_blocks(ranges).distinct()
    used = sorted(r[0] for r in blocks.select("_level").distinct().collect())  # 64 at most
    if not used:
        return features.limit(0)
    levels = F.array(*map(F.lit, used))
    above = blocks.select("_level", "_block", F.explode(F.filter(levels, lambda k: k > F.col("_level"))).alias("up"))
    inner = above.select("_level", "_block", F.col("up").alias("u"), F.expr("shiftright(_block, up - _level)").alias("b")).join(blocks.select(F.col("_level").alias("u"), F.col("_block").alias("b")), ["u", "b"], "left_semi")
    outer = blocks.join(inner.select("_level", "_block").distinct(), ["_level", "_block"], "left_anti")
    asked = features.withColumn("_level", F.explode(levels)).withColumn("_block", F.expr("shiftright(CAST(id AS BIGINT), _level)"))
    return asked.join(outer, ["_level", "_block"], "left_semi").drop("_level", "_block")


#: Edges that a cell of a polygon's own grid is meant to hold, the most cells an axis, and the edges up to which a polygon needs no grid.
_CELL_EDGES, _MOST_CELLS, _FEW_EDGES = 8, 1024, 32


def polygon_grids(edges: DataFrame, flat: bool = False) -> DataFrame:
    """(id, g, w, h, bx, by, bounds) of each polygon: a grid of its own with g + 1 cells an axis, as many as its edges ask for.

    Borders are moved by odd shares of a cell, so that coordinates on some raster don't lie on them.  Shapes without area have no grid, but if flat."""
    sides = [F.min(F.least("x1", "x2")).alias("left"), F.max(F.greatest("x1", "x2")).alias("right"), F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high")]
    stats = edges.groupBy("id").agg(F.count("*").alias("n"), *sides)
    if flat:
        for lo, hi in (("left", "right"), ("low", "high")):
            stats = stats.withColumn(hi, F.when(F.col(lo) == F.col(hi), F.col(lo) + F.greatest(F.abs(lo), F.lit(1.0))).otherwise(F.col(hi)))
    stats = stats.where("left < right AND low < high")
    g = F.least(F.lit(_MOST_CELLS), F.ceil(F.sqrt(F.col("n") / _CELL_EDGES))).cast("int")
    sized = stats.withColumn("g", g).withColumn("w", (F.col("right") - F.col("left")) / F.col("g")).withColumn("h", (F.col("high") - F.col("low")) / F.col("g"))
    return sized.select("*", (F.col("left") - F.lit(0.3719) * F.col("w")).alias("bx"), (F.col("low") - F.lit(0.4137) * F.col("h")).alias("by"))


def _between(y: Column) -> Column:
    """Whether an edge crosses a height: one end above it, the other not."""
    return (F.col("y1") > y) != (F.col("y2") > y)


def _crossing(y: Column) -> Column:
    """Where an edge crosses a height."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")


def _cell_of(v: Column, origin: str, size: str) -> Column:
    return F.least(F.col("g"), F.greatest(F.lit(0), F.floor((v - F.col(origin)) / F.col(size)).cast("int")))


def edges_in_cells(at: DataFrame) -> DataFrame:
    """The edges, which have the columns of their grids, once in each cell (c, r) that they pass."""
    pad = 1e-6  # of a cell: a cell too many changes nothing
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    wide = at.withColumn("c", F.explode(F.sequence(_cell_of(lo - pad * F.col("w"), "bx", "w"), _cell_of(hi + pad * F.col("w"), "bx", "w"))))
    begin = F.least(hi, F.greatest(lo, F.col("bx") + F.col("c") * F.col("w")))
    end = F.least(hi, F.greatest(lo, F.col("bx") + (F.col("c") + 1) * F.col("w")))

    def height(x: Column) -> Column:
        return F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))

    low = F.coalesce(F.least(height(begin), height(end)), F.least("y1", "y2")) - pad * F.col("h")
    high = F.coalesce(F.greatest(height(begin), height(end)), F.greatest("y1", "y2")) + pad * F.col("h")
    return wide.withColumn("r", F.explode(F.sequence(_cell_of(low, "by", "h"), _cell_of(high, "by", "h"))))


def edge_index(edges: DataFrame, grids: DataFrame) -> DataFrame:
    """(id, c, r, ...) of each edge in each cell of its polygon's grid that it passes, and (id, c, r, odd) of the cells whose corner is inside.

    The corner is the right end of a cell's lower side.  A point's parity is the corner's, changed by the edges between the two, all of which pass the cell:
    those between the point and the right side at its height, and those that cross the right side between that height and the corner."""
    at = edges.join(grids, "id")
    dealt = edges_in_cells(at)
    dealt = dealt.withColumn("side", F.col("bx") + (F.col("c") + 1) * F.col("w")).withColumn("base", F.col("by") + F.col("r") * F.col("h"))
    spans = (F.col("x1") > F.col("side")) != (F.col("x2") > F.col("side"))
    tip = F.when(F.col("x1") > F.col("side"), F.col("y1")).otherwise(F.col("y2"))  # of an edge that crosses the side's line, the height of its right end
    from_base = (tip > F.col("base")) != (_between(F.col("base")) & F.coalesce(F.col("side") < _crossing(F.col("base")), F.lit(False)))
    passing = dealt.select("id", "c", "r", "x1", "y1", "x2", "y2", "side", F.when(spans, tip).alias("tip"), F.when(spans, from_base).alias("from_base"), F.lit(False).alias("odd"))

    rows = F.sequence(_cell_of(F.least("y1", "y2"), "by", "h"), _cell_of(F.greatest("y1", "y2"), "by", "h"))
    base = F.col("by") + F.col("r") * F.col("h")
    crossed = at.withColumn("r", F.explode(rows)).where(_between(base))
    before = F.least(F.col("g") + 1, F.greatest(F.lit(0), F.ceil((_crossing(base) - F.col("bx")) / F.col("w") - 1).cast("int")))  # cells whose corner is to the left
    ends = crossed.select("id", "r", before.alias("j")).groupBy("id", "r", "j").agg(F.count("*").alias("n")).where("n % 2 = 1 AND j > 0")
    from_right = Window.partitionBy("id", "r").orderBy(F.desc("j"))  # of one row of one grid
    spans_of = ends.select("id", "r", "j", F.count("*").over(from_right).alias("k"), F.lead("j", 1, 0).over(from_right).alias("next")).where("k % 2 = 1")
    inside = spans_of.select("id", F.explode(F.sequence("next", F.col("j") - 1)).alias("c"), "r", F.lit(True).alias("odd"))
    return passing.unionByName(inside, allowMissingColumns=True)


def pick_points(points: DataFrame, polygons: DataFrame, edges: DataFrame, extent: Box) -> DataFrame:
    """(point_id, id): the highest polygon id that holds each point, by the even-odd rule over all rings, so that a hole is outside.

    points: point_id, x, y; polygons: id, xmin..ymax; edges: id, x1, y1, x2, y2, of closed rings.  A point meets the polygons whose boxes hold it, and of
    each only the edges in its cell of that polygon's own grid, so what it costs doesn't grow with the polygon; of one with few edges, all."""
    as_boxes = points.select(F.col("point_id").alias("view_id"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    candidates = bbox_join(polygons, as_boxes, extent).select(F.col("view_id").alias("point_id"), "id").join(points, "point_id")
    right = _between(F.col("y")) & F.coalesce(F.col("x") < _crossing(F.col("y")), F.lit(False))
    grids = saved(polygon_grids(edges).where(F.col("n") > _FEW_EDGES), "polygon-grids")
    if grids.isEmpty():
        return _highest(candidates.join(edges, "id").select("point_id", "id", right.alias("changes")))
    own = grids.select("id")
    few = candidates.join(edges.join(own, "id", "left_anti"), "id").select("point_id", "id", right.alias("changes"))
    placed = candidates.join(grids, "id").where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("low")) & (F.col("y") < F.col("high")))
    c, r = F.floor((F.col("x") - F.col("bx")) / F.col("w")).cast("int"), F.floor((F.col("y") - F.col("by")) / F.col("h")).cast("int")
    met = placed.select("point_id", "id", "x", "y", c.alias("c"), r.alias("r")).join(edge_index(edges, grids), ["id", "c", "r"])
    beyond = F.when(F.col("tip").isNotNull(), (F.col("tip") > F.col("y")) != F.col("from_base")).otherwise(_between(F.col("y")) & F.coalesce(F.col("side") < _crossing(F.col("y")), F.lit(False)))
    many = met.select("point_id", "id", F.when(F.col("odd"), F.lit(True)).otherwise(right != beyond).alias("changes"))
    return _highest(few.unionByName(many))


def _highest(changes: DataFrame) -> DataFrame:
    """The highest polygon of each point with an odd number of changes."""
    inside = changes.groupBy("point_id", "id").agg(F.bit_xor(F.col("changes").cast("int")).alias("parity")).where("parity = 1")
    return inside.groupBy("point_id").agg(F.max("id").alias("id"))


def nearest_grid_cell(x: Column, y: Column, e0: float, n0: float, pitch: float, cols: int, rows: int) -> Column:
    """Number of the grid feature whose centre is nearest, in closed form."""

    def axis(v: Column, origin: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - origin - pitch / 2) / pitch + 0.5))).cast("long")

    return axis(y, n0, rows) * cols + axis(x, e0, cols)
