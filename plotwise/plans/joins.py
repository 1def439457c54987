"""Queries on joining features with viewports, points, ranges and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions.curve import grid_cell
from plotwise.operators.spatial_joins import bbox_join, nearest_grid_cell, occupancy, pick_points, range_semi_join
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import E0, N0, PARCELS_SQL, PITCH, grid_cols, parcels, table
from plotwise.plans.layout import _VIEWPORT_TABLE_SQL, groups_of, view_table

_FLAT = ["id", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax"]
_SPANNING_SQL = """fs AS (SELECT id, xmin, ymin, xmax, ymax FROM p UNION ALL SELECT -1 - o_orderkey, 2600000.0, 1200000.0, 2600000.0 + cols * 40, 1200000.0 + cols * 40 FROM orders CROSS JOIN g WHERE o_orderkey < 3)"""


def grid_extent(cols: int) -> tuple[float, float, float, float]:
    return (E0, N0, E0 + cols * PITCH, N0 + cols * PITCH)


def with_spanning(spark: SparkSession, sf_dir: str, cols: int) -> DataFrame:
    """Parcels with flat bounds, and three features over the whole grid."""
    flat = parcels(spark, sf_dir, cols).select(*_FLAT)
    ext = grid_extent(cols)
    wide = table(spark, sf_dir, "orders").where("o_orderkey < 3").select((-1 - F.col("o_orderkey")).alias("id"), *(F.lit(v).alias(c) for v, c in zip(ext, ("xmin", "ymin", "xmax", "ymax"), strict=True)))
    return flat.unionByName(wide)


@query(
    "viewport_join",
    f"WITH {PARCELS_SQL}, {_VIEWPORT_TABLE_SQL}, {_SPANNING_SQL} SELECT view_id, fs.id FROM fs JOIN vw ON fs.xmin <= vw.xmax AND fs.xmax >= vw.xmin AND fs.ymin <= vw.ymax AND fs.ymax >= vw.ymin",
)
def viewport_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return bbox_join(with_spanning(spark, sf_dir, cols), view_table(spark, sf_dir, cols), grid_extent(cols))


_CELL = "CAST(trunc(greatest(0, least(255, ({v} - {o}) / (cols * 40.0::DOUBLE) * 255))) AS INT)"


@query(
    "grid_occupancy",
    f"""WITH {PARCELS_SQL}, c AS (SELECT id, {_CELL.format(v="xmin", o=2600000)} AS c0, {_CELL.format(v="xmax", o=2600000)} AS c1, {_CELL.format(v="ymin", o=1200000)} AS r0, {_CELL.format(v="ymax", o=1200000)} AS r1 FROM p CROSS JOIN g),
    e AS (SELECT id, unnest(generate_series(c0, c1)) AS c, r0, r1 FROM c), f AS (SELECT c, unnest(generate_series(r0, r1)) AS r FROM e) SELECT (c * 256 + r)::INT AS cell, count(*) AS n FROM f GROUP BY ALL""",
)
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return occupancy(parcels(spark, sf_dir, cols).select(*_FLAT), grid_extent(cols))


@query(
    "grid_declared_bytes",
    f"""WITH {PARCELS_SQL}, c AS (SELECT id, {_CELL.format(v="xmin", o=2600000)} AS c0, {_CELL.format(v="xmax", o=2600000)} AS c1, {_CELL.format(v="ymin", o=1200000)} AS r0, {_CELL.format(v="ymax", o=1200000)} AS r1 FROM p CROSS JOIN g)
    SELECT count(*) AS n_features, sum((c1 - c0 + 1) * (r1 - r0 + 1))::BIGINT AS n_entries, (count(*) * 40 + sum((c1 - c0 + 1) * (r1 - r0 + 1)) * 4)::BIGINT AS declared_bytes FROM c""",
)
def grid_declared_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    ext = grid_extent(cols)
    wide = grid_cell(F.col("bbox.xmax"), ext[0], ext[2]) - grid_cell(F.col("bbox.xmin"), ext[0], ext[2]) + 1
    high = grid_cell(F.col("bbox.ymax"), ext[1], ext[3]) - grid_cell(F.col("bbox.ymin"), ext[1], ext[3]) + 1
    sums = parcels(spark, sf_dir, cols).agg(F.count("*").alias("n_features"), F.sum((wide * high).cast("long")).alias("n_entries"))
    return sums.select("*", (F.col("n_features") * 40 + F.col("n_entries") * 4).alias("declared_bytes"))


@query("id_range_semi_join", f"WITH {PARCELS_SQL} SELECT id, zone FROM p WHERE EXISTS (SELECT 1 FROM supplier WHERE id BETWEEN s_suppkey * 20 AND s_suppkey * 20 + s_suppkey % 30)")
def id_range_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    ranges = table(spark, sf_dir, "supplier").select((k * 20).alias("lo"), (k * 20 + k % 30).alias("hi"))
    return range_semi_join(parcels(spark, sf_dir).select("id", "zone"), ranges)


_WIDE = """w AS (SELECT id, zone, id * 30000000000000 + (id * 7919) % 1000003 AS wide_id FROM p),
r AS (SELECT s_suppkey * 4000000000000000 + s_suppkey % 97 AS lo, s_suppkey * 4000000000000000 + CASE WHEN s_suppkey % 50 = 1 THEN 1::BIGINT << 61 ELSE (1::BIGINT << (10 + s_suppkey % 40)) END AS hi FROM supplier WHERE s_suppkey % 5 = 1)"""


def wide_shift(spark: SparkSession, sf_dir: str) -> int:
    """The power of two by which wide ids must lie closer to be longs; 0 as long as they are."""
    k = F.col("s_suppkey")
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    some, widest = table(spark, sf_dir, "supplier").where(k % 5 == 1).agg(F.coalesce(F.max(k), F.lit(0)), F.coalesce(F.max(F.when(k % 50 == 1, k)), F.lit(0))).first()

    def top(shift: int) -> int:
        return max(last * (30000000000000 >> shift) + 1000003, some * (4000000000000000 >> shift) + (1 << 49), widest * (4000000000000000 >> shift) + (1 << 61))

    return next(shift for shift in range(64) if top(shift) < 1 << 63)


@query("id_range_wide", f"WITH {PARCELS_SQL}, {_WIDE} SELECT wide_id AS id, zone FROM w WHERE EXISTS (SELECT 1 FROM r WHERE wide_id BETWEEN lo AND hi AND hi < 2000000000000000000) OR EXISTS (SELECT 1 FROM (SELECT min(lo) AS lo, max(hi) AS hi FROM r WHERE hi >= 2000000000000000000) WHERE wide_id BETWEEN lo + 100000000000000000 AND hi)")
def id_range_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids far apart, and ranges of a thousand to 2**61 of them, within each other.

    Where the SQL's products pass 64 bits, ids and ranges lie closer by the same power of two, so that all of them are longs."""
    k, i = F.col("s_suppkey"), F.col("id")
    apart = wide_shift(spark, sf_dir)
    lo = k * (4000000000000000 >> apart)
    wide = F.when(k % 50 == 1, F.lit(1 << 61)).otherwise(F.expr("shiftleft(1L, cast(10 + s_suppkey % 40 as int))"))
    ranges = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 1").select((lo + k % 97).alias("lo"), (lo + wide).alias("hi"))
    whole = ranges.where("hi >= 2000000000000000000").agg((F.min("lo") + 100000000000000000).alias("lo"), F.max("hi").alias("hi"))
    features = parcels(spark, sf_dir).select((i * (30000000000000 >> apart) + i * 7919 % 1000003).alias("id"), "zone")
    return range_semi_join(features, ranges.where("hi < 2000000000000000000").unionByName(whole))


@query(
    "ordering_join",
    f"WITH {PARCELS_SQL} SELECT id, l_linenumber AS place, value FROM p JOIN lineitem ON l_orderkey = id WHERE l_returnflag = 'R'",
)
def ordering_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features joined to an ordering table on identity: duplicates there multiply rows, missing ids drop them."""
    order = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"))
    return parcels(spark, sf_dir).join(order, "id").select("id", "place", "value")


@query(
    "ordering_join_check",
    """WITH l AS (SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM orders) AS n_features, count(*) AS n_joined,
    CASE WHEN count(*) = (SELECT count(*) FROM orders) THEN 'preserved' ELSE 'row_count_changed' END AS verdict FROM l JOIN orders ON o_orderkey = id""",
)
def ordering_join_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    features = parcels(spark, sf_dir).select("id")
    counts = features.agg(F.count("*").alias("n_features")).join(features.join(order, "id").agg(F.count("*").alias("n_joined")))
    return counts.select("*", F.when(F.col("n_features") == F.col("n_joined"), "preserved").otherwise("row_count_changed").alias("verdict"))


_OVERLAY_SQL = """gc AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS cols FROM customer),
ov AS (SELECT c_custkey AS id, 2600000.0::DOUBLE + (c_custkey % cols) * 40 + 20 AS cx, 1200000.0::DOUBLE + (c_custkey // cols) * 40 + 20 AS cy FROM customer CROSS JOIN gc),
pt AS (SELECT event_id AS point_id, 2600000.0::DOUBLE + (event_id * 7919 % (cols * 160)) * 0.25 AS x, 1200000.0::DOUBLE + (event_id * 104729 % (cols * 160)) * 0.25 AS y FROM events CROSS JOIN gc)"""


def overlays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(polygons, edges, points, cols): overlapping squares of half-size 28 for customers, every seventh with a square hole, and a point for each event."""
    from plotwise.plans.fixtures import ceil_sqrt

    customer = table(spark, sf_dir, "customer")
    cols = ceil_sqrt(customer.count())
    k = F.col("c_custkey")
    centre = customer.select(k.alias("id"), (F.lit(E0) + (k % cols) * PITCH + 20).alias("cx"), (F.lit(N0) + F.expr(f"c_custkey div {cols}") * PITCH + 20).alias("cy"))
    boxes = centre.select("id", (F.col("cx") - 28).alias("xmin"), (F.col("cy") - 28).alias("ymin"), (F.col("cx") + 28).alias("xmax"), (F.col("cy") + 28).alias("ymax"))
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]

    def ring(half: float):
        return [F.struct((F.col("cx") + a * half).alias("x1"), (F.col("cy") + b * half).alias("y1"), (F.col("cx") + c * half).alias("x2"), (F.col("cy") + d * half).alias("y2")) for (a, b), (c, d) in zip(corners[:-1], corners[1:], strict=True)]

    edges = centre.select("id", F.explode(F.when(F.col("id") % 7 == 0, F.array(*ring(28.0), *ring(6.0))).otherwise(F.array(*ring(28.0)))).alias("e")).select("id", "e.*")
    e = F.col("event_id")
    points = table(spark, sf_dir, "events").select(e.alias("point_id"), (F.lit(E0) + (e * 7919 % (cols * 160)) * 0.25).alias("x"), (F.lit(N0) + (e * 104729 % (cols * 160)) * 0.25).alias("y"))
    return boxes, edges, points, cols


@query(
    "point_pick",
    f"""WITH {_OVERLAY_SQL}, hit AS (SELECT point_id, id FROM pt JOIN ov ON x >= cx - 28 AND x < cx + 28 AND y >= cy - 28 AND y < cy + 28
    AND NOT (id % 7 = 0 AND x >= cx - 6 AND x < cx + 6 AND y >= cy - 6 AND y < cy + 6)) SELECT point_id, max(id) AS id FROM hit GROUP BY point_id""",
)
def point_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, edges, points, cols = overlays(spark, sf_dir)
    return pick_points(points, boxes, edges, (E0 - 8, N0 - 8, E0 + cols * PITCH + 8, N0 + cols * PITCH + 8))


@query(
    "nearest_feature",
    f"""WITH {_OVERLAY_SQL}, n AS (SELECT point_id, CAST(greatest(0, least(cols - 1, floor((y - 1200000 - 20) / 40 + 0.5))) AS BIGINT) * cols + CAST(greatest(0, least(cols - 1, floor((x - 2600000 - 20) / 40 + 0.5))) AS BIGINT) AS id FROM pt CROSS JOIN gc)
    SELECT point_id, id, c_mktsegment AS segment FROM n LEFT JOIN customer ON c_custkey = id""",
)
def nearest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, points, cols = overlays(spark, sf_dir)
    near = points.select("point_id", nearest_grid_cell(F.col("x"), F.col("y"), E0, N0, PITCH, cols, cols).alias("id"))
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return near.join(named, "id", "left").select("point_id", "id", "segment")


@query(
    "pick_indirection",
    f"""WITH {PARCELS_SQL}, m AS (SELECT max(id) // 200 + 3 AS n FROM p), picks AS (SELECT event_id AS pick_id, (user_id * 104729 + event_id // 7) % n AS batch, (event_id * 31) % 250 AS ordinal FROM events CROSS JOIN m),
    b AS (SELECT id // 200 AS batch, id % 200 AS ordinal, id, xmin, ymin FROM p) SELECT pick_id, b.id, b.xmin AS anchor_x, b.ymin AS anchor_y FROM picks LEFT JOIN b USING (batch, ordinal)""",
)
def pick_indirection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, ordinal) of a pick to the feature there and its anchor; beyond a batch's end: null. Many picks fall in the same batches, as users look at one place."""
    features = parcels(spark, sf_dir)
    n = (features.agg(F.max("id")).first()[0] or 0) // 200 + 3
    batch = (F.col("user_id") * 104729 + F.expr("event_id div 7")) % n
    picks = table(spark, sf_dir, "events").select(F.col("event_id").alias("pick_id"), batch.alias("batch"), (F.col("event_id") * 31 % 250).alias("ordinal"))
    batches = features.select(F.expr("id div 200").alias("batch"), (F.col("id") % 200).alias("ordinal"), "id", F.col("bbox.xmin").alias("anchor_x"), F.col("bbox.ymin").alias("anchor_y"))
    return picks.join(batches, ["batch", "ordinal"], "left").select("pick_id", "id", "anchor_x", "anchor_y")


@query(
    "pick_indirection_all",
    f"""WITH {PARCELS_SQL}, m AS (SELECT max(id) // 200 + 3 AS n FROM p), picks AS (SELECT event_id AS pick_id, (event_id * 7919 + user_id) % n AS batch, (event_id * 31) % 250 AS ordinal FROM events CROSS JOIN m),
    b AS (SELECT id // 200 AS batch, id % 200 AS ordinal, id, xmin, ymin FROM p) SELECT pick_id, b.id, b.xmin AS anchor_x, b.ymin AS anchor_y FROM picks LEFT JOIN b USING (batch, ordinal)""",
)
def pick_indirection_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks over the batches of all parcels, and two batches beyond the last."""
    features = parcels(spark, sf_dir)
    n = (features.agg(F.max("id")).first()[0] or 0) // 200 + 3
    picks = table(spark, sf_dir, "events").select(F.col("event_id").alias("pick_id"), ((F.col("event_id") * 7919 + F.col("user_id")) % n).alias("batch"), (F.col("event_id") * 31 % 250).alias("ordinal"))
    batches = features.select(F.expr("id div 200").alias("batch"), (F.col("id") % 200).alias("ordinal"), "id", F.col("bbox.xmin").alias("anchor_x"), F.col("bbox.ymin").alias("anchor_y"))
    return picks.join(batches, ["batch", "ordinal"], "left").select("pick_id", "id", "anchor_x", "anchor_y")
