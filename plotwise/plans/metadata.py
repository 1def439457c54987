"""Queries on file metadata, CRS, generated features, views and work across tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions.geo_metadata import admit_crs, admit_encoding, definition_provenance, fit_zoom, geo_fields, view_bbox
from plotwise.operators.edits import create_edited, open_edited
from plotwise.operators.lake import attribute_join, duplicate_batches, lineage_grade, newest_generation, overlay, profile, replay_tickets, resident_totals, similar_columns, throttled
from plotwise.operators.sequences import spread
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import E0, N0, PARCELS_SQL, parcels, table
from plotwise.sources.attributes import read_attributes
from plotwise.sources.footers import footer_inventory, row_group_statistics
from plotwise.sources.generate import categorize, generate_features
from plotwise.storage import shared_folder

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("footer_inventory", " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS n_rows FROM {t}""" for t in _TABLES))
def footer_inventory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables by their footers alone."""
    out = None
    for name in _TABLES:
        rows = footer_inventory(spark, f"{sf_dir}/{name}.parquet").agg(F.sum("n_rows").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


_BOUNDS = (("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("events", "event_id"), ("part", "p_partkey"))


@query("footer_bounds", " UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", min({c}) AS min, max({c}) AS max, count(*) - count({c}) AS nulls FROM {t}""" for t, c in _BOUNDS))
def footer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of id columns from row-group statistics."""
    out = None
    for name, column in _BOUNDS:
        groups = row_group_statistics(spark, f"{sf_dir}/{name}.parquet").where(F.col("column") == column)
        rows = groups.agg(F.min("min_long").alias("min"), F.max("max_long").alias("max"), F.sum("nulls").alias("nulls")).select(F.lit(name).alias("table"), F.lit(column).alias("column"), "min", "max", "nulls")
        out = rows if out is None else out.unionByName(rows)
    return out


def geo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, geo): a `geo` document for each customer."""
    k = F.col("c_custkey")
    axes = (
        F.when(k % 5 == 0, F.lit('[{"name":"Easting","direction":"east"},{"name":"Northing","direction":"north"}]'))
        .when(k % 5 == 1, F.lit('[{"name":"Geodetic latitude","direction":"north"},{"name":"Geodetic longitude","direction":"east"}]'))
        .when(k % 5 == 2, F.lit('[{"name":"Longitude","direction":"East"},{"name":"Latitude","direction":"North"}]'))
        .when(k % 5 == 3, F.lit('[{"name":"Up","direction":"up"}]'))
        .otherwise(F.lit('[{"name":"N","direction":"north"},{"name":"E","direction":"east"}]'))
    )
    ident = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"id":{"authority":"EPSG","code":'), (2000 + k % 90).cast("string"), F.lit("}")))
    crs = F.when(k % 7 == 5, F.lit("")).when(k % 7 == 6, F.lit(',"crs":null')).otherwise(F.concat(F.lit(',"crs":{"coordinate_system":{"axis":'), axes, F.lit("}"), ident, F.lit("}")))
    kind = F.when(k % 11 == 10, '["Polygon","Point"]').otherwise('["Polygon"]')
    encoding = F.when(k % 13 == 12, "WKT").otherwise("WKB")
    doc = F.concat(
        F.lit('{"version":"1.1.0","primary_column":"geometry","columns":{"geometry":{"encoding":"'), encoding, F.lit('","geometry_types":'), kind, crs, F.lit(',"covering":{"bbox":{"xmin":["bbox","xmin"],"ymin":["bbox","ymin"]}}}}}')
    )
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("id"), doc.alias("geo"))


_GEO_SQL = """gd AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 5 THEN 'absent' WHEN 6 THEN 'null' ELSE 'declared' END AS crs_state, CASE WHEN c_custkey % 7 IN (5, 6) THEN NULL WHEN c_custkey % 3 = 0 THEN '(definition-only)' ELSE 'EPSG:' || CAST(2000 + c_custkey % 90 AS VARCHAR) END AS crs_id,
  CASE WHEN c_custkey % 7 IN (5, 6) THEN NULL ELSE CASE c_custkey % 5 WHEN 0 THEN 'easting_northing' WHEN 1 THEN 'latitude_longitude' WHEN 2 THEN 'longitude_latitude' WHEN 4 THEN 'northing_easting' END END AS axis_order, CASE WHEN c_custkey % 13 = 12 THEN 'WKT' ELSE 'WKB' END AS encoding, c_custkey % 11 = 10 AS mixed FROM customer)"""


@query("geo_metadata", f"WITH {_GEO_SQL} SELECT id, '1.1.0' AS version, 'geometry' AS primary_column, encoding, crs_state, crs_id, axis_order, 'bbox.xmin' AS covering_xmin FROM gd")
def geo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_documents(spark, sf_dir).select("id", geo_fields(F.col("geo")).alias("g")).select("id", "g.version", "g.primary_column", "g.encoding", "g.crs_state", "g.crs_id", "g.axis_order", "g.covering_xmin")


@query(
    "crs_admission",
    f"""WITH {_GEO_SQL} SELECT id, CASE WHEN crs_state = 'declared' AND id % 4 = 0 THEN 'crs_assertion_conflict' WHEN crs_state = 'declared' AND axis_order IS NULL THEN 'axis_order_unestablished' WHEN crs_state = 'declared' AND axis_order NOT IN ('easting_northing', 'longitude_latitude') THEN 'axis_order_refused'
    WHEN crs_state = 'declared' THEN 'file' WHEN id % 4 <> 0 THEN 'crs_undeclared' WHEN id % 8 = 4 THEN 'crs_identifier_blank' ELSE 'caller_asserted' END AS verdict FROM gd""",
)
def crs_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    docs = geo_documents(spark, sf_dir).select("id", geo_fields(F.col("geo")).alias("g"))
    definition = F.lit('{"coordinate_system":{"axis":[{"name":"E","direction":"east"},{"name":"N","direction":"north"}]}}')
    asserted = F.when(k % 8 == 4, " ").when(k % 4 == 0, "EPSG:2056")
    return docs.select("id", admit_crs(F.col("g.crs_state"), F.col("g.axis_order"), asserted, F.when(k % 4 == 0, definition)).alias("verdict"))


@query("encoding_admission", f"WITH {_GEO_SQL} SELECT id, CASE WHEN id % 17 = 3 THEN 'geometry_column_missing' WHEN id % 17 = 4 THEN 'geometry_column_not_binary' WHEN encoding <> 'WKB' THEN 'encoding_not_admitted' WHEN mixed THEN 'geometry_type_not_admitted' END AS refusal FROM gd")
def encoding_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = geo_documents(spark, sf_dir).select("id", geo_fields(F.col("geo")).alias("g"))
    kind = F.when(F.col("id") % 17 == 4, "string").when(F.col("id") % 17 != 3, "binary")
    return docs.select("id", admit_encoding(F.col("g.encoding"), F.col("g.geometry_types"), kind).alias("refusal"))


@query(
    "crs_provenance",
    """WITH cat AS (SELECT s_suppkey AS cat_id, sha256('def-' || CAST(s_suppkey AS VARCHAR)) AS h FROM supplier), d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'def-' || CAST(c_custkey % 30 AS VARCHAR) END AS def FROM customer)
    SELECT id, CASE WHEN def IS NULL THEN NULL WHEN h IS NOT NULL THEN 'catalog:' || CAST(cat_id AS VARCHAR) || '@sha256:' || substr(h, 1, 12) ELSE 'pasted' END AS provenance FROM d LEFT JOIN cat ON sha256(def) = h""",
)
def crs_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cat_id"), F.sha2(F.concat(F.lit("def-"), F.col("s_suppkey").cast("string")).cast("binary"), 256).alias("h"))
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 != 0, F.concat(F.lit("def-"), (k % 30).cast("string"))).alias("def"))
    joined = asked.join(catalog, F.sha2(F.col("def").cast("binary"), 256) == F.col("h"), "left")
    return joined.select("id", definition_provenance(F.col("def"), F.col("cat_id"), F.col("h")).alias("provenance"))


@query(
    "view_boxes",
    """SELECT event_id AS view_id, 2600000 + user_id * 10 - 800 / pow(2.0, user_id % 6) / 2 AS xmin, 1200000 + user_id * 20 - 600 / pow(2.0, user_id % 6) / 2 AS ymin, 2600000 + user_id * 10 + 800 / pow(2.0, user_id % 6) / 2 AS xmax, 1200000 + user_id * 20 + 600 / pow(2.0, user_id % 6) / 2 AS ymax FROM events""",
)
def view_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    box = view_bbox(F.lit(E0) + u * 10, F.lit(N0) + u * 20, u % 6, 800.0, 600.0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("view_id"), box.alias("b")).select("view_id", "b.*")


@query(
    "fit_zoom",
    "SELECT event_id AS view_id, round(coalesce(greatest(-20, least(21, least(log2(720 / nullif(value, 0)), log2(540 / nullif(value * 2, 0))))), 0), 9) AS zoom FROM events",
)
def fit_zoom_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("view_id"), F.round(fit_zoom(F.col("value"), F.col("value") * 2, 800.0, 600.0), 9).alias("zoom"))


@query("feature_categories")
def feature_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of each order by (seed, id); tests hold it against plain integers."""
    return categorize(table(spark, sf_dir, "orders"), 0x5EED, "o_orderkey")


@query(
    "generated_features",
    """WITH n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS cols FROM customer) SELECT c_custkey AS id, 2600000 + (c_custkey % cols) * 40 + 20 - 16.0::DOUBLE AS xmin, 1200000 + (c_custkey // cols) * 40 + 20 + 16.0::DOUBLE AS ymax, c_custkey % 7 = 0 AS hole, true AS vertices_ok FROM customer CROSS JOIN n""",
)
def generated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many features as customers."""
    made = generate_features(spark, table(spark, sf_dir, "customer").count(), 7)
    return made.select("id", "bbox.xmin", "bbox.ymax", "hole", F.col("vertices").between(4, 28).alias("vertices_ok"))


@query(
    "attribute_join_report",
    "WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT count(f.k) AS features, count(*) FILTER (f.k IS NOT NULL AND a.k IS NOT NULL)::BIGINT AS matched, count(*) FILTER (f.k IS NULL)::BIGINT AS unmatched_attributes, count(*) FILTER (f.k IS NOT NULL AND a.k IS NOT NULL) / count(f.k) AS match_rate FROM f FULL JOIN a ON f.k = a.k",
)
def attribute_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    attributes = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return attribute_join(features, attributes, "k")[1]


@query(
    "attribute_file_report",
    """WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 5) SELECT count(f.k) AS features, count(*) FILTER (f.k IS NOT NULL AND a.k IS NOT NULL)::BIGINT AS matched, count(*) FILTER (f.k IS NULL)::BIGINT AS unmatched_attributes,
    count(*) FILTER (f.k IS NOT NULL AND a.k IS NOT NULL) / count(f.k) AS match_rate, (SELECT count(*) FROM customer WHERE c_custkey % 13 = 5) AS broken FROM f FULL JOIN a ON f.k = a.k""",
)
def attribute_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV, some with a balance that is no number, read with their schema and joined to the orders' customers."""
    balance = F.when(F.col("c_custkey") % 13 == 5, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    folder = shared_folder(spark, "attributes")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", balance.alias("balance")).write.option("header", True).option("escape", '"').csv(folder)
    rows, broken = read_attributes(spark, folder, "k long, c_mktsegment string, balance double")
    features = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return attribute_join(features, rows, "k")[1].crossJoin(broken.agg(F.count("k").alias("broken")))  # one row each


@query(
    "column_profile",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT min(o_custkey)::DOUBLE AS lo, max(o_custkey)::DOUBLE AS hi FROM orders)
    SELECT 'o_totalprice' AS "column", least(floor((o_totalprice - lo) / (hi - lo) * 8), 7)::INT AS bin, count(*) AS n, 0::BIGINT AS nulls, min(lo) AS min, max(hi) AS max FROM orders CROSS JOIN s GROUP BY ALL
    UNION ALL SELECT 'o_custkey', least(floor((o_custkey - lo) / (hi - lo) * 8), 7)::INT AS bin, count(*), 0::BIGINT, min(lo), max(hi) FROM orders CROSS JOIN c GROUP BY ALL""",
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])


@query(
    "edit_overlay",
    f"""WITH {PARCELS_SQL}, d AS (SELECT user_id * 3 AS id, event_type AS zone, value, event_id AS version, event_type = 'error' AS deleted FROM events), l AS (SELECT id, arg_max(zone, version) AS zone, arg_max(value, version) AS value, arg_max(deleted, version) AS deleted FROM d GROUP BY id)
    SELECT id, zone, value FROM p WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, zone, value FROM l WHERE NOT deleted""",
)
def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = parcels(spark, sf_dir).select("id", "zone", "value")
    deltas = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("id"), F.col("event_type").alias("zone"), "value", F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"))
    return overlay(base, deltas)


@query(
    "edit_commits",
    f"""WITH {PARCELS_SQL}, d AS (SELECT user_id * 3 AS id, event_type AS zone, value, event_id AS version, event_id % 5 AS step, event_type = 'error' AS deleted FROM events),
    l AS (SELECT id, arg_max(zone, (step, version)) AS zone, arg_max(value, (step, version)) AS value, arg_max(deleted, (step, version)) AS deleted FROM d GROUP BY id)
    SELECT id, zone, value FROM p WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, zone, value FROM l WHERE NOT deleted""",
)
def edit_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five commits of edits over files that stay as they are, compacted and opened again: a row is as the last commit that knows its id has it."""
    base = shared_folder(spark, "edited-base")
    parcels(spark, sf_dir).select("id", "zone", "value").write.parquet(base)
    made = create_edited(spark, base, shared_folder(spark, "edited"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("id"), F.col("event_type").alias("zone"), "value", F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"))
    for step in range(5):
        made = made.edit(events.where(F.col("version") % 5 == step))
    made.compact(fan=3)
    return open_edited(spark, made.folder).rows()


@query(
    "lineage_grades",
    """WITH RECURSIVE n AS (SELECT c_custkey AS node, c_nationkey % 4 AS rank FROM customer), e AS (SELECT c_custkey AS node, c_custkey // 2 AS input FROM customer WHERE c_custkey > 1), r(node, anc) AS (SELECT node, node FROM n UNION SELECT r.node, e.input FROM r JOIN e ON e.node = r.anc)
    SELECT r.node, max(n.rank)::INT AS grade FROM r JOIN n ON n.node = r.anc GROUP BY r.node""",
)
def lineage_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nodes = customer.select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 4).alias("rank"))
    edges = customer.where("c_custkey > 1").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 2").alias("input"))
    return lineage_grade(nodes, edges)


_SIMILAR = (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("region", "r_regionkey"))
_SIMILAR_SQL = " UNION ".join(f"""SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}""" for t, c in _SIMILAR)


@query(
    "similar_columns",
    f"""WITH v AS ({_SIMILAR_SQL}), s AS (SELECT col, count(*) AS n FROM v GROUP BY col), c AS (SELECT a.col AS l, b.col AS r, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND a.col < b.col GROUP BY ALL)
    SELECT l AS "left", r AS "right", round((c.n / least(x.n, y.n) * 3 + 1 - levenshtein(l, r) / greatest(length(l), length(r))) / 4, 6) AS confidence FROM c JOIN s x ON x.col = l JOIN s y ON y.col = r WHERE round((c.n / least(x.n, y.n) * 3 + 1 - levenshtein(l, r) / greatest(length(l), length(r))) / 4, 6) >= 0.5""",
)
def similar_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = None
    for name, column in _SIMILAR:
        rows = table(spark, sf_dir, name).select(F.lit(column).alias("column"), F.col(column).cast("string").alias("value")).distinct()
        values = rows if values is None else values.unionByName(rows)
    return similar_columns(values)


@query("duplicate_batches", "SELECT user_id AS stream, minute(ts) AS seq, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.minute("ts").cast("long").alias("seq"))
    return duplicate_batches(batches, "stream", "seq")


@query("newest_generation", "WITH g AS (SELECT event_type AS dataset, event_id, user_id % 5 AS generation FROM events) SELECT dataset, event_id, generation FROM g QUALIFY generation = max(generation) OVER (PARTITION BY dataset)")
def newest_generation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), "event_id", (F.col("user_id") % 5).alias("generation"))
    return newest_generation(batches, "dataset", "generation")


_FOLD_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, (event_id * 7919) % 200000 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r(user_id, event_id, v, k, total, admitted) AS (SELECT user_id, event_id, v, k, CASE WHEN v <= 2000000 THEN v ELSE 0 END, v <= 2000000 FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.v, o.k, r.total + CASE WHEN r.total + o.v <= 2000000 THEN o.v ELSE 0 END, r.total + o.v <= 2000000 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)"""


@query("resident_ceiling", f"{_FOLD_SQL} SELECT user_id, event_id, v AS vertices, admitted FROM r")
def resident_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 200000).alias("vertices"))
    return resident_totals(batches, "user_id", ["event_id"], "vertices")


_THROTTLE_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, event_id * 37 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 37, event_id) AS k FROM events),
r(user_id, event_id, k, last, accepted) AS (SELECT user_id, event_id, k, ms, true FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.ms - r.last >= 120 THEN o.ms ELSE r.last END, o.ms - r.last >= 120 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)"""


@query("throttled_requests", f"{_THROTTLE_SQL} SELECT user_id, event_id, accepted FROM r")
def throttled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 37).alias("ms"))
    return throttled(requests, "user_id", ["event_id"], "ms")


_LIFECYCLE_SQL = """WITH e AS (SELECT event_id // 3 AS ticket, CASE event_id % 3 WHEN 0 THEN 'mint' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'redeem' ELSE 'cancel' END ELSE 'redeem' END AS action, event_id + (event_id % 3) * ((event_id // 3) % 25) AS at_s, (event_id // 3) % 11 AS dataset FROM events WHERE event_id % 41 <> 0),
    m AS (SELECT ticket, min(at_s) FILTER (action = 'mint') AS mint FROM e GROUP BY ticket), l AS (SELECT e.ticket, arg_min(action, (at_s, action)) FILTER (action <> 'mint' AND at_s BETWEEN mint AND mint + 29) AS fin FROM e JOIN m ON m.ticket = e.ticket GROUP BY e.ticket)
    SELECT DISTINCT dataset, e.ticket, mint AS minted_s, CASE WHEN mint IS NULL THEN 'unknown' WHEN fin IS NULL THEN 'expired' WHEN fin = 'redeem' THEN 'redeemed' ELSE 'cancelled' END AS state FROM e JOIN m ON m.ticket = e.ticket JOIN l ON l.ticket = e.ticket"""


def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticket, action, at_s, dataset): three events a ticket, some missing, not in the order of their times."""
    k, t = F.col("event_id"), F.expr("event_id div 3")
    action = F.when(k % 3 == 0, "mint").when(k % 3 == 1, F.when(k % 2 == 0, "redeem").otherwise("cancel")).otherwise("redeem")
    return table(spark, sf_dir, "events").where("event_id % 41 <> 0").select(t.alias("ticket"), action.alias("action"), (k + (k % 3) * (t % 25)).alias("at_s"), (t % 11).alias("dataset"))


@query("ticket_lifecycle", _LIFECYCLE_SQL)
def ticket_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_tickets(ticket_events(spark, sf_dir), "dataset", ["at_s"])
