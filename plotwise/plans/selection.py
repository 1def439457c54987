"""Queries on selecting and admitting features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators.admission import admit_predicate, admit_projection, bbox_refusal, identity_candidates, identity_refusal, identity_scan, schema_table, viewport_refusal
from plotwise.operators.selection import bbox_intersects, extent, select_features
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import E0, N0, PARCELS_SQL, grid_cols, parcels, table, viewports

_BOX = ["bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax"]
_NEAR = "xmin <= 2600000 + (cols // 2) * 40 + 20 AND xmax >= 2600000 AND ymin <= 1200000 + (cols // 2) * 40 + 20 AND ymax >= 1200000"
_64TH = "xmin <= 2600000 + (cols // 8) * 40 + 20 AND xmax >= 2600000 AND ymin <= 1200000 + (cols // 8) * 40 + 20 AND ymax >= 1200000"
_FAR = "xmin <= 2600000 + (cols // 2) * 40 + 20 AND xmax >= 2600000 AND ymin <= 1200000 + (cols - 1) * 40 + 20 AND ymax >= 1200000 + (cols - 1) * 40 - (cols // 2) * 40"


@query("viewport_filter", f"WITH {PARCELS_SQL} SELECT id, zone, xmin, ymin, xmax, ymax FROM p CROSS JOIN g WHERE zone IN ('1-URGENT', '5-LOW') AND {_NEAR}")
def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return select_features(parcels(spark, sf_dir, cols), viewports(cols)["near-quarter"], "zone IN ('1-URGENT', '5-LOW')", ["zone", *_BOX])


@query("feature_scan", f"WITH {PARCELS_SQL} SELECT id, zone, value FROM p")
def feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_features(parcels(spark, sf_dir), columns=["zone", "value"])


@query("viewport_64th", f"WITH {PARCELS_SQL} SELECT id, zone, value FROM p CROSS JOIN g WHERE {_64TH}")
def viewport_64th(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return select_features(parcels(spark, sf_dir, cols), viewports(cols)["1-64"], columns=["zone", "value"])


@query(
    "viewport_counts",
    f"""WITH {PARCELS_SQL} SELECT * FROM (
    SELECT 'whole' AS viewport, count(*) AS n, min(id) AS min_id, max(id) AS max_id FROM p
    UNION ALL SELECT 'near-quarter', count(*), min(id), max(id) FROM p CROSS JOIN g WHERE {_NEAR}
    UNION ALL SELECT 'far-quarter', count(*), min(id), max(id) FROM p CROSS JOIN g WHERE {_FAR}
    UNION ALL SELECT '1-64', count(*), min(id), max(id) FROM p CROSS JOIN g WHERE {_64TH})""",
)
def viewport_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All standing viewports in one scan: a feature is exploded to the viewports that it meets."""
    cols = grid_cols(spark, sf_dir)
    names = [F.when(F.lit(True) if box is None else bbox_intersects(box), F.lit(name)) for name, box in viewports(cols).items()]
    met = parcels(spark, sf_dir, cols).select("id", F.explode(F.array_compact(F.array(*names))).alias("viewport"))
    return met.groupBy("viewport").agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


@query("mapped_identity_projection", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_acctbal BETWEEN 0 AND 5000")
def mapped_identity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_features(
        table(spark, sf_dir, "customer"), predicate="c_acctbal BETWEEN 0 AND 5000", columns=[F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")], identity="c_custkey"
    )


@query("ordered_limit", f"WITH {PARCELS_SQL} SELECT id, zone FROM p WHERE zone LIKE '1%' ORDER BY id LIMIT 100")
def ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_features(parcels(spark, sf_dir), predicate="zone LIKE '1%'", columns=["zone"]).orderBy("id").limit(100)


@query("identity_order", f"WITH {PARCELS_SQL} SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM p")
def identity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals in identity order without one task: ranges are counted, and each row adds its range's offset to its place in it."""
    from plotwise.operators.sequences import global_ordinal

    return global_ordinal(parcels(spark, sf_dir).select("id"), "id", "ordinal")


#: Filters asked of the parcels, with what admission must say; the texts are this query's parameters.
_FILTERS = [
    ("zone = '1-URGENT'", None),
    ("id BETWEEN 5 AND 1000 AND zone IN ('1-URGENT','5-LOW')", None),
    ("zone ILIKE '5-l%'", None),
    ("NOT (id > 300 OR id < 20)", None),
    ("value * 2 >= 500000 AND zone IS NOT NULL", None),
    ("1=1) --", "construct_not_admitted"),
    ("1=1; DROP TABLE x", "not_a_single_expression"),
    ("zone IN (SELECT 1)", "construct_not_admitted"),
    ("random() < 0.5", "construct_not_admitted"),
    ("nowhere = 1", "unknown_column"),
    ("id + 1", "not_boolean"),
    ("bbox = 1", "column_not_filterable"),
    ("zone = 'a') OR (1=1", "unparsable"),
]


@query(
    "filter_admission",
    f"WITH {PARCELS_SQL} "
    + " UNION ALL ".join(
        f"SELECT {k}::INT AS filter_no, '{r or 'admitted'}' AS verdict, " + ("NULL::BIGINT" if r else f"(SELECT count(*) FROM p WHERE {t})") + " AS n_rows" for k, (t, r) in enumerate(_FILTERS)
    ),
)
def filter_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each filter and, for those admitted, the rows that it keeps: one scan for all."""
    features = parcels(spark, sf_dir)
    verdicts = [admit_predicate(spark, text, features.schema) for text, _ in _FILTERS]
    counts = [F.count_if(F.expr(text)) if v is None else F.lit(None).cast("long") for (text, _), v in zip(_FILTERS, verdicts, strict=True)]
    entries = [F.struct(F.lit(k).alias("filter_no"), F.lit(v or "admitted").alias("verdict"), c.alias("n_rows")) for k, (c, v) in enumerate(zip(counts, verdicts, strict=True))]
    return features.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")


@query(
    "schema_probe",
    """SELECT t AS "table", (row_number() OVER (PARTITION BY t ORDER BY ordinal) - 1)::INT AS ordinal, name, type, n_values FROM (
    SELECT 'orders' AS t, 0 AS ordinal, 'o_orderkey' AS name, 'bigint' AS type, (SELECT count(o_orderkey) FROM orders) AS n_values
    UNION ALL SELECT 'orders', 1, 'o_custkey', 'bigint', (SELECT count(o_custkey) FROM orders)
    UNION ALL SELECT 'orders', 2, 'o_orderstatus', 'string', (SELECT count(o_orderstatus) FROM orders)
    UNION ALL SELECT 'orders', 3, 'o_totalprice', 'double', (SELECT count(o_totalprice) FROM orders)
    UNION ALL SELECT 'orders', 4, 'o_orderdate', 'timestamp', (SELECT count(o_orderdate) FROM orders)
    UNION ALL SELECT 'orders', 5, 'o_orderpriority', 'string', (SELECT count(o_orderpriority) FROM orders))""",
)
def schema_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in order with their types, and how many values each has."""
    orders = table(spark, sf_dir, "orders")
    entries = [
        F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("name"), F.lit(kind.replace("_ntz", "")).alias("type"), F.count(name).alias("n_values")) for k, name, kind, _ in schema_table(orders)
    ]
    return orders.agg(F.array(*entries).alias("e")).select(F.lit("orders").alias("table"), F.explode("e").alias("e")).select("table", "e.*")


@query(
    "projection_admission",
    """SELECT * FROM (VALUES ('zone', 'admitted'), ('value', 'admitted'), ('bbox', 'attribute_unpublishable'), ('id', 'attribute_is_identity'), ('zone', 'attribute_duplicated'), ('height', 'attribute_unknown')) v("column", verdict)
    CROSS JOIN (SELECT count(*) AS n_rows FROM orders)""",
)
def projection_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = parcels(spark, sf_dir)
    found = admit_projection(features.schema, ["zone", "value", "bbox", "id", "zone", "height"])
    entries = [F.struct(F.lit(name).alias("column"), F.lit(refusal or "admitted").alias("verdict")) for name, refusal in found]
    return features.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*entries)).alias("e"), "n_rows").select("e.*", "n_rows")


_LAKE = {"orders": ("o_orderkey", "o_custkey"), "events": ("event_id", "user_id"), "customer": ("c_custkey",), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey")}


@query(
    "identity_census",
    " UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", count({c}) AS n_values, min({c}) >= 0 AS admissible FROM {t}""" for t, cs in _LAKE.items() for c in cs),
)
def identity_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate identity columns of a lake of tables (64-bit integers, in schema order), each with what one scan of its table says."""
    out = None
    for name in _LAKE:
        df = table(spark, sf_dir, name)
        entries = [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.count(c).alias("n_values"), (F.min(c) >= 0).alias("admissible")) for c in identity_candidates(df.schema)]
        rows = df.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


_VIEWS_SQL = """v AS (SELECT s_suppkey AS view_id, CASE s_suppkey % 4 WHEN 0 THEN 'EPSG:2056' WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN NULL ELSE 'EPSG:2056' END AS view_crs,
   CASE WHEN s_suppkey % 3 = 0 THEN '(definition-only)' ELSE 'EPSG:2056' END AS dataset_crs, s_suppkey % 5 <> 0 AS has_bbox FROM supplier)"""


@query(
    "viewport_crs_check",
    f"""WITH {_VIEWS_SQL} SELECT view_id, CASE WHEN NOT has_bbox OR view_crs IS NULL THEN NULL WHEN dataset_crs = '(definition-only)' THEN 'viewport_crs_unidentifiable'
    WHEN view_crs <> dataset_crs THEN 'viewport_crs_mismatch' END AS refusal FROM v""",
)
def viewport_crs_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    crs = F.when(key % 4 == 0, "EPSG:2056").when(key % 4 == 1, "EPSG:4326").when(key % 4 == 3, "EPSG:2056")
    own = F.when(key % 3 == 0, "(definition-only)").otherwise("EPSG:2056")
    return table(spark, sf_dir, "supplier").select(key.alias("view_id"), viewport_refusal(crs, own, key % 5 != 0).alias("refusal"))


@query(
    "bbox_quality",
    f"""WITH {PARCELS_SQL} SELECT id, CASE WHEN id % 50 = 1 THEN 'bbox_non_finite' WHEN id % 50 = 2 THEN 'bbox_non_finite' WHEN id % 50 = 3 THEN 'bbox_inverted' END AS refusal FROM p""",
)
def bbox_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with some boxes spoilt: NaN, infinite and inverted sides."""
    k = F.col("id") % 50
    xmin = F.when(k == 1, float("nan")).when(k == 2, float("-inf")).otherwise(F.col("bbox.xmin"))
    xmax = F.when(k == 3, F.col("bbox.xmin") - 1).otherwise(F.col("bbox.xmax"))
    spoilt = parcels(spark, sf_dir).select("id", F.struct(xmin.alias("xmin"), "bbox.ymin", xmax.alias("xmax"), "bbox.ymax").alias("bbox"))
    return spoilt.select("id", bbox_refusal().alias("refusal"))


@query(
    "identity_quarantine",
    "SELECT event_id AS row_no, CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN -user_id ELSE user_id END AS id, CASE WHEN user_id % 10 = 0 THEN 'identity_null' ELSE 'identity_negative' END AS refusal FROM events WHERE user_id % 10 IN (0, 1) AND user_id > 0",
)
def identity_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events").where("user_id > 0").select(F.col("event_id").alias("row_no"), F.when(user % 10 == 1, -user).when(user % 10 != 0, user).alias("id"))
    return rows.withColumn("refusal", identity_refusal(F.col("id"))).where("refusal IS NOT NULL")


@query(
    "identity_scan_unique",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct, 0::BIGINT AS n_null, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id,
    CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN 'unique' ELSE 'identity_duplicate' END AS verdict, max(o_orderkey) < 9007199254740992 AS js_exact FROM orders""",
)
def identity_scan_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_scan(table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    "identity_scan_duplicate",
    """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_distinct, 0::BIGINT AS n_null, min(l_orderkey) AS min_id, max(l_orderkey) AS max_id,
    CASE WHEN count(DISTINCT l_orderkey) = count(*) THEN 'unique' ELSE 'identity_duplicate' END AS verdict, max(l_orderkey) < 9007199254740992 AS js_exact FROM lineitem""",
)
def identity_scan_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_scan(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("selected_extent", f"WITH {PARCELS_SQL} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM p WHERE zone = '2-HIGH'")
def selected_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcels(spark, sf_dir).where("zone = '2-HIGH'").agg(*extent(F.col("bbox.xmin"), F.col("bbox.ymin"), F.col("bbox.xmax"), F.col("bbox.ymax")))


@query(
    "dataset_description",
    f"""WITH {PARCELS_SQL} SELECT 'EPSG:2056' AS crs, 'caller_asserted' AS crs_source, 'native' AS id_source, 'verified' AS id_uniqueness, count(*) AS row_count, 'counted' AS row_count_basis,
    min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, 'covering' AS extent_basis, NULL::VARCHAR AS license, 'not-declared' AS license_basis FROM p""",
)
def dataset_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotwise.dataset import Dataset

    return Dataset(parcels(spark, sf_dir), crs="EPSG:2056", crs_source="caller_asserted").describe()


@query(
    "filter_is_subset",
    f"""WITH {PARCELS_SQL}, f AS (SELECT * FROM p WHERE value > 200000 AND zone IS NOT NULL) SELECT count(*) AS n_filtered, 0::BIGINT AS n_outside, (SELECT count(*) FROM p) AS n_all FROM f""",
)
def filter_is_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered rows, how many of them the unfiltered selection lacks (row by row), and all rows."""
    from plotwise.operators.comparison import rows_outside

    whole = select_features(parcels(spark, sf_dir), columns=["zone", "value"])
    part = select_features(parcels(spark, sf_dir), predicate="value > 200000 AND zone IS NOT NULL", columns=["zone", "value"])
    return (
        part.agg(F.count("*").alias("n_filtered"))
        .join(rows_outside(part, whole).agg(F.count("*").alias("n_outside")))
        .join(whole.agg(F.count("*").alias("n_all")))
    )
