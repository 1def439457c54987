"""Queries on geometry bytes, vertices and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions.wkb import by_feature, geometry_facts, header_class, to_wkb, vertex_table
from plotwise.operators.digests import LEVELS, set_digest
from plotwise.operators.linting import lint, lint_crossings
from plotwise.operators.selection import extent
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import PARCELS_SQL, parcels

_SHAPES = {
    0: ((-16, -16), (16, -16), (16, 16), (-16, 16), (-16, -16)),
    1: ((-16, -8), (-8, -16), (8, -16), (16, -8), (16, 8), (8, 16), (-8, 16), (-16, 8), (-16, -8)),
    2: ((-16, 0), (-8, -16), (8, -16), (16, 0), (8, 16), (-8, 16), (-16, 0)),
}
_HOLE = ((-4, -4), (-4, 4), (4, 4), (4, -4), (-4, -4))


def parcel_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring, pos, x, y): a square, octagon or hexagon in each parcel, every seventh with a hole."""

    def points(shape, ring: int):
        return [F.struct(F.lit(ring).alias("ring"), F.lit(k).alias("pos"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for k, (dx, dy) in enumerate(shape)]

    outer = F.when(F.col("id") % 3 == 0, F.array(*points(_SHAPES[0], 0))).when(F.col("id") % 3 == 1, F.array(*points(_SHAPES[1], 0))).otherwise(F.array(*points(_SHAPES[2], 0)))
    both = F.when(F.col("id") % 7 == 0, F.concat(outer, F.array(*points(_HOLE, 1)))).otherwise(outer)
    centre = parcels(spark, sf_dir).select("id", ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("cx"), ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("cy"))
    at = centre.select("*", F.explode(both).alias("v"))
    return at.select("id", "v.ring", "v.pos", (F.col("cx") + F.col("v.dx")).alias("x"), (F.col("cy") + F.col("v.dy")).alias("y"))


_TEMPLATE = ", ".join(f"({k}, 0, {pos}, {dx}, {dy})" for k, shape in _SHAPES.items() for pos, (dx, dy) in enumerate(shape))
_HOLES = ", ".join(f"({pos}, {dx}, {dy})" for pos, (dx, dy) in enumerate(_HOLE))
_VERTICES_SQL = f"""{PARCELS_SQL}, vx AS (SELECT id, ring::INT AS ring, pos::INT AS pos, xmin + 16 + dx AS x, ymin + 16 + dy AS y FROM p JOIN (VALUES {_TEMPLATE}) t(k, ring, pos, dx, dy) ON id % 3 = k
UNION ALL SELECT id, 1, pos, xmin + 16 + dx, ymin + 16 + dy FROM p CROSS JOIN (VALUES {_HOLES}) h(pos, dx, dy) WHERE id % 7 = 0)"""


_TURN = "sign((x{1} - x{0}) * (y{2} - y{0}) - (y{1} - y{0}) * (x{2} - x{0}))"
_BETWEEN = "x{2} BETWEEN least(x{0}, x{1}) AND greatest(x{0}, x{1}) AND y{2} BETWEEN least(y{0}, y{1}) AND greatest(y{0}, y{1})"
_ENDS = [(a, b, c) for a, b in ((1, 2), (3, 4)) for c in ((3, 4) if a == 1 else (1, 2))]


@query(
    "geometry_crossings",
    f"""WITH {_VERTICES_SQL}, o AS (SELECT id, ring, pos, CASE WHEN id % 20 = 8 AND pos = 1 THEN lead(x) OVER w WHEN id % 20 = 8 AND pos = 2 THEN lag(x) OVER w WHEN id % 20 = 9 AND pos = 2 THEN first(x) OVER w ELSE x END AS x,
      CASE WHEN id % 20 = 8 AND pos = 1 THEN lead(y) OVER w WHEN id % 20 = 8 AND pos = 2 THEN lag(y) OVER w WHEN id % 20 = 9 AND pos = 2 THEN first(y) OVER w ELSE y END AS y FROM vx WINDOW w AS (PARTITION BY id, ring ORDER BY pos)),
    s AS (SELECT id, ring, pos AS k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY id, ring) - 1 AS m FROM o WINDOW w AS (PARTITION BY id, ring ORDER BY pos)),
    pr AS (SELECT a.id, a.ring, a.k, b.ring AS ring2, b.k AS k2, a.m, a.x1, a.y1, a.x2, a.y2, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4 FROM s a JOIN s b ON a.id = b.id AND (a.ring < b.ring OR (a.ring = b.ring AND a.k < b.k)) WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL),
    t AS (SELECT *, {", ".join(f"{_TURN.format(*e)} AS t{e[2]}, {_BETWEEN.format(*e)} AS on{e[2]}" for e in _ENDS)} FROM pr),
    j AS (SELECT id, ring, CASE WHEN ring = ring2 AND k2 = k + 1 THEN CASE WHEN t4 = 0 AND t1 = 0 AND (on4 OR on1) THEN 'ring-spike' END WHEN ring = ring2 AND k = 0 AND k2 = m - 1 THEN CASE WHEN t3 = 0 AND t2 = 0 AND (on3 OR on2) THEN 'ring-spike' END
      WHEN t3 * t4 < 0 AND t1 * t2 < 0 THEN CASE WHEN ring = ring2 THEN 'ring-self-crossing' ELSE 'rings-cross' END
      WHEN {" OR ".join(f"(t{c} = 0 AND on{c})" for c in (1, 2, 3, 4))} THEN CASE WHEN ring = ring2 THEN 'ring-self-touch' ELSE 'rings-touch' END END AS issue FROM t)
    SELECT id, ring, issue, count(*) AS n FROM j WHERE issue IS NOT NULL GROUP BY ALL""",
)
def geometry_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of which one in twenty has two vertices changed over, and one touches its first vertex again."""
    from pyspark.sql import Window

    w = Window.partitionBy("id", "ring").orderBy("pos")
    tied, touching = F.col("id") % 20 == 8, (F.col("id") % 20 == 9) & (F.col("pos") == 2)

    def moved(c: str):
        return F.when(tied & (F.col("pos") == 1), F.lead(c).over(w)).when(tied & (F.col("pos") == 2), F.lag(c).over(w)).when(touching, F.first(c).over(w)).otherwise(F.col(c)).alias(c)

    return lint_crossings(by_feature(parcel_vertices(spark, sf_dir)).select("id", "ring", "pos", moved("x"), moved("y")))


def spoilt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, geometry): WKB of the parcels, with a fault in nine of fifty."""
    g, k = F.col("geometry"), F.col("id") % 50
    n = F.octet_length(g)
    body = F.substring(g, 2, 1 << 30)

    def raw(hexes: str):
        return F.unhex(F.lit(hexes))

    bad = (
        F.when(k == 1, F.lit(None).cast("binary"))
        .when(k == 2, raw(""))
        .when(k == 3, F.concat(raw("02"), body))
        .when(k == 4, F.concat(raw("0103000020"), F.substring(g, 6, 1 << 30)))
        .when(k == 5, F.concat(raw("0101000000"), F.substring(g, 6, 1 << 30)))
        .when(k == 6, raw("010300000000000000"))
        .when(k == 7, F.expr("substring(geometry, 1, octet_length(geometry) - 3)"))
        .when(k == 8, F.concat(g, raw("00")))
        .when(k == 9, F.expr("concat(substring(geometry, 1, octet_length(geometry) - 1), unhex('7F'))"))
        .otherwise(g)
    )
    return to_wkb(parcel_vertices(spark, sf_dir)).select("id", bad.alias("geometry")).where(n.isNotNull() | F.lit(True))


_CLASSES = {1: "geometry_null", 2: "empty", 3: "bad_byte_order", 4: "ewkb_flags", 5: "not_polygon", 6: "no_rings", 7: "truncated", 8: "trailing_bytes", 9: "ring_unclosed"}
_CLASS_SQL = "CASE id % 50 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CLASSES.items()) + " END"


@query("vertex_table", f"WITH {_VERTICES_SQL} SELECT * FROM vx")
def vertex_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices written as WKB and read back."""
    return vertex_table(to_wkb(parcel_vertices(spark, sf_dir)))


@query("wkb_validity", f"SELECT o_orderkey AS id, {_CLASS_SQL.replace('id', 'o_orderkey', 1)} AS refusal FROM orders")
def wkb_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_facts(spoilt_features(spark, sf_dir)).select("id", "refusal")


@query("wkb_header_class", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 < 7 THEN {_CLASS_SQL.replace('id', 'o_orderkey', 1)} END AS refusal FROM orders")
def wkb_header_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoilt_features(spark, sf_dir).select("id", header_class(F.col("geometry")).alias("refusal"))


@query(
    "geometry_facts",
    f"""WITH {_VERTICES_SQL} SELECT id, NULL::VARCHAR AS refusal, (max(ring) + 1)::INT AS rings, count(*)::INT AS vertices, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM vx WHERE id % 50 NOT BETWEEN 1 AND 9 GROUP BY id
    UNION ALL SELECT o_orderkey, {_CLASS_SQL.replace("id", "o_orderkey", 1)}, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 50 BETWEEN 1 AND 9""",
)
def geometry_facts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_facts(spoilt_features(spark, sf_dir)).drop("coordinate_xor", "digest")


@query("feature_bboxes", f"WITH {_VERTICES_SQL} SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM vx GROUP BY id")
def feature_bboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-feature boxes from the vertex table: partial aggregates before the shuffle."""
    return parcel_vertices(spark, sf_dir).groupBy("id").agg(*extent(F.col("x"), F.col("y"), F.col("x"), F.col("y")))


@query(
    "dataset_facts",
    f"""WITH {_VERTICES_SQL}, f AS (SELECT id, count(*) AS v, max(ring) + 1 AS r FROM vx GROUP BY id) SELECT coalesce(zone, '(null)') AS category, count(*) AS n_features, sum(v)::BIGINT AS n_vertices, sum(r)::BIGINT AS n_rings,
    min(v)::INT AS min_vertices, max(v)::INT AS max_vertices FROM f JOIN p USING (id) GROUP BY ALL""",
)
def dataset_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, vertices and rings by category, null included; the whole is the sum."""
    facts = geometry_facts(to_wkb(parcel_vertices(spark, sf_dir))).select("id", "vertices", "rings")
    zones = parcels(spark, sf_dir).select("id", F.coalesce("zone", F.lit("(null)")).alias("category"))
    # Spark takes exploded vertices for as few rows as the features, so without the hint it would broadcast a row a feature
    return facts.join(zones.hint("merge"), "id").groupBy("category").agg(
        F.count("*").alias("n_features"), F.sum("vertices").alias("n_vertices"), F.sum("rings").alias("n_rings"), F.min("vertices").alias("min_vertices"), F.max("vertices").alias("max_vertices")
    )


@query("coordinate_xor")
def coordinate_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XOR of the bit patterns of all coordinates, in two levels; tests hold it against a plain loop."""
    facts = geometry_facts(to_wkb(parcel_vertices(spark, sf_dir)))
    return facts.agg(F.count("*").alias("n_features"), F.bit_xor("coordinate_xor").alias("coordinate_xor"))


@query("feature_digests")
def feature_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_facts(to_wkb(parcel_vertices(spark, sf_dir))).select("id", "digest")


_DIGEST_SQL = "l0 AS (SELECT id // 1024 AS k, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR) || ':' || digest, '|' ORDER BY id)) AS d FROM src GROUP BY ALL)," + ",".join(
    f"l{j + 1} AS (SELECT {up} AS k, sum(n) AS n, sha256(string_agg(CAST(l{j}.k AS VARCHAR) || ':' || d, '|' ORDER BY l{j}.k)) AS d FROM l{j} GROUP BY {up})" for j, up in enumerate([f"l{j}.k // 4096" for j in range(LEVELS)])
) + f" SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(CAST(k AS VARCHAR) || ':' || d, '|' ORDER BY k)) AS digest FROM l{LEVELS}"


@query("set_digest", f"WITH src AS (SELECT o_orderkey AS id, sha256(o_orderpriority) AS digest FROM orders), {_DIGEST_SQL}")
def set_digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotwise.plans.fixtures import table

    return set_digest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("digest")))


@query("rechunk_invariance", "SELECT count(*) AS n_rows, true AS same FROM orders")
def rechunk_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set digest of the features, cut two ways: the same."""
    features = geometry_facts(to_wkb(parcel_vertices(spark, sf_dir))).select("id", "digest")
    a, b = set_digest(features), set_digest(features.repartition(7, "digest")).select(F.col("digest").alias("other"))
    return a.join(b).select("n_rows", (F.col("digest") == F.col("other")).alias("same"))


@query(
    "geometry_lint",
    f"""WITH {_VERTICES_SQL}, o AS (SELECT *, CASE WHEN id % 20 = 4 AND pos = 2 THEN lag(x) OVER w ELSE x END AS x2, CASE WHEN id % 20 = 4 AND pos = 2 THEN lag(y) OVER w ELSE y END AS y2 FROM vx WINDOW w AS (PARTITION BY id, ring ORDER BY pos)),
    d AS (SELECT id, ring, pos, x2, y2, lag(x2) OVER w AS px, lag(y2) OVER w AS py FROM o WINDOW w AS (PARTITION BY id, ring ORDER BY pos))
    SELECT id, ring, 'duplicate-consecutive-vertex' AS issue, count(*) AS n FROM d WHERE x2 = px AND y2 = py GROUP BY ALL
    UNION ALL SELECT id, ring, 'ring-too-short', count(*) FROM vx WHERE id % 20 = 6 AND pos < 3 GROUP BY ALL
    UNION ALL SELECT id, ring, 'ring-unclosed', count(*) FROM vx WHERE id % 20 = 6 AND pos < 3 GROUP BY ALL""",
)
def geometry_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = parcel_vertices(spark, sf_dir)
    w = Window.partitionBy("id", "ring").orderBy("pos")
    copied = (F.col("id") % 20 == 4) & (F.col("pos") == 2)
    v = v.select("id", "ring", "pos", F.when(copied, F.lag("x").over(w)).otherwise(F.col("x")).alias("x"), F.when(copied, F.lag("y").over(w)).otherwise(F.col("y")).alias("y"))
    return lint(v.where(~((F.col("id") % 20 == 6) & (F.col("pos") >= 3))))
