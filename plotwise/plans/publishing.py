"""Queries on publishing, verification, styles and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions.wkb import to_wkb, with_vertex_counts
from plotwise.operators.publish import (
    CutPolicy,
    PublishRefused,
    admit_artifacts,
    admit_license,
    attribute_bytes,
    compare_publishes,
    contiguous,
    cut_partitions,
    file_hashes,
    ladder_target,
    logical_uri,
    operation_digest,
    partition_manifest,
    publish,
    recheck_pins,
    unsafe_path,
    verify_assets,
    verify_bundle,
)
from plotwise.operators.sequences import range_count, spread
from plotwise.operators.style import legend, resolve, style_violations
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import PARCELS_SQL, parcels, table
from plotwise.plans.geometry import parcel_vertices
from plotwise.storage import shared_folder

#: Targets scaled down so that both triggers matter on these tables; the rule is the same.
_POLICY = CutPolicy(target_bytes=1 << 16, max_rows=300)

_SIZED_SQL = f"""{PARCELS_SQL}, sz AS (SELECT id, zone, CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 7 END + CASE WHEN id % 7 = 0 THEN 5 ELSE 0 END AS verts, CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END AS rings,
  1 + CASE WHEN zone IS NULL THEN 0 ELSE strlen(zone) + 4 END + 1 + 8 AS attr, value, xmin, ymin, xmax, ymax FROM p),
sw AS (SELECT *, 9 + rings * 4 + verts * 16 AS wkb FROM sz)"""


def sized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with their WKB size, vertices and attribute bytes; sizes follow from the shape, so no bytes are made."""
    k = F.col("id")
    verts = F.when(k % 3 == 0, 5).when(k % 3 == 1, 9).otherwise(7) + F.when(k % 7 == 0, 5).otherwise(0)
    rings = F.when(k % 7 == 0, 2).otherwise(1)
    features = parcels(spark, sf_dir)
    return features.select("*", verts.alias("verts"), (9 + rings * 4 + verts * 16).alias("wkb_len"), attribute_bytes(features.schema, ["zone", "value"]).alias("attr_bytes"))


def shaped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with their geometry; WKB size and vertices are read from it."""
    shapes = to_wkb(parcel_vertices(spark, sf_dir))
    return with_vertex_counts(parcels(spark, sf_dir).join(shapes.hint("merge"), "id")).withColumn("wkb_len", F.octet_length("geometry"))


#: The cut as one scan: for each row where a part that began there would end, then from part to part. (On these sizes the guess grows from row to row.)
_CUT_SQL = f"""WITH RECURSIVE {_SIZED_SQL}, n AS (SELECT row_number() OVER (ORDER BY id) AS k, id, 20 * verts + 12 + attr AS w, 20 * (wkb // 16) + 12 + attr AS guess FROM sw),
q AS MATERIALIZED (SELECT k, id, w, sum(w) OVER (ORDER BY k)::BIGINT AS s, (sum(w) OVER (ORDER BY k) - w + guess)::BIGINT AS q, count(*) OVER () AS n FROM n),
st AS (SELECT k AS i, s - w + 65536 AS room, n FROM q),
ea AS (SELECT st.i, q.k AS a FROM st ASOF LEFT JOIN q ON q.s >= st.room),
eb AS (SELECT st.i, q.k - 1 AS b FROM st ASOF LEFT JOIN q ON q.q > st.room),
el AS (SELECT i, least(a, b, i + 299, n) AS hi, a, b FROM st JOIN ea USING (i) JOIN eb USING (i)),
e AS MATERIALIZED (SELECT i, hi, CASE WHEN hi = a THEN 'size-target' WHEN hi = i + 299 THEN 'row-ceiling' WHEN hi = b THEN 'size-target' ELSE 'stream-end' END AS why FROM el),
c(part, lo, hi, why) AS (SELECT 0, i, hi, why FROM e WHERE i = 1 UNION ALL SELECT part + 1, e.i, e.hi, e.why FROM c JOIN e ON e.i = c.hi + 1),
cut AS (SELECT q.id, c.part::BIGINT AS part, why AS cut_by FROM q JOIN c ON q.k BETWEEN c.lo AND c.hi)"""


@query("partition_cut", f"{_CUT_SQL} SELECT id, part, cut_by FROM cut")
def partition_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_partitions(sized_features(spark, sf_dir), _POLICY).drop("oversize")


@query("cut_counts", f"{_CUT_SQL} SELECT cut_by, count(DISTINCT part) AS parts, count(*) AS n_rows FROM cut GROUP BY cut_by")
def cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_part = cut_partitions(sized_features(spark, sf_dir), _POLICY).groupBy("cut_by", "part").agg(F.count("*").alias("n"))
    return by_part.groupBy("cut_by").agg(F.count("*").alias("parts"), F.sum("n").alias("n_rows"))


@query(
    "partition_manifest",
    f"{_CUT_SQL} SELECT part, count(*) AS n_rows, min(id) AS id_lo, max(id) AS id_hi, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM cut JOIN p USING (id) GROUP BY part",
)
def partition_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = sized_features(spark, sf_dir)
    return partition_manifest(features.join(cut_partitions(features, _POLICY).select("id", "part"), "id"))


@query("attribute_sizes", f"WITH {_SIZED_SQL} SELECT id, attr::INT AS attr_bytes FROM sw")
def attribute_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_features(spark, sf_dir).select("id", "attr_bytes")


@query(
    "batch_ladder",
    "SELECT event_id, greatest(32768, least(65536 * pow(4, least(event_id % 12, 8)), 1048576))::BIGINT AS target_bytes FROM events",
)
def batch_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ladder_target(F.col("event_id") % 12).alias("target_bytes"))


@query(
    "published_rows",
    f"{_CUT_SQL} SELECT part, 'data/part=' || lpad(CAST(part AS VARCHAR), 5, '0') AS folder, count(*) AS n_rows, min(id) AS id_lo, max(id) AS id_hi, sum(wkb)::BIGINT AS geometry_bytes, sum(strlen(coalesce(zone, '')))::BIGINT AS zone_bytes FROM cut JOIN sw USING (id) GROUP BY part",
)
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publish, read back through the paths of its manifest: rows and geometry."""
    dest = shared_folder(spark, "bundle")
    manifest = publish(shaped_features(spark, sf_dir), ["zone", "value"], dest, _POLICY)
    rows = spark.read.parquet(f"{dest}/data").select("id", "zone", "geometry", F.regexp_extract("_metadata.file_path", r"(data/part=\d+/[^/]+)$", 1).alias("path"))
    held = rows.groupBy("path").agg(
        F.count("*").alias("n_rows"), F.min("id").alias("id_lo"), F.max("id").alias("id_hi"), F.sum(F.octet_length("geometry")).alias("geometry_bytes"), F.sum(F.octet_length(F.coalesce("zone", F.lit("")))).alias("zone_bytes")
    )
    return manifest.select("part", "path").join(held, "path").withColumn("folder", F.regexp_extract("path", r"^(data/part=\d+)/", 1)).drop("path")


_BUNDLE_SQL = """s AS (SELECT DISTINCT part, CASE part % 7 WHEN 1 THEN 'hash-mismatch' WHEN 2 THEN 'bytes-mismatch' WHEN 3 THEN 'asset-extra' WHEN 4 THEN 'rows-mismatch' ELSE 'ok' END AS state FROM cut)
SELECT 'data/part=' || lpad(CAST(part AS VARCHAR), 5, '0') AS path, state FROM s
UNION ALL SELECT 'data/part=99999', 'asset-missing' UNION ALL SELECT '../x', 'unsafe-path' UNION ALL SELECT '(numbering)', 'not-contiguous' UNION ALL SELECT '(rows)', 'row-sum-mismatch' UNION ALL SELECT '(envelope)', 'ok' UNION ALL SELECT '(schema)', 'ok'"""


@query("bundle_audit", f"{_CUT_SQL}, {_BUNDLE_SQL}")
def bundle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written bundle against a manifest with a fault of each kind."""
    dest = shared_folder(spark, "bundle")
    manifest = publish(shaped_features(spark, sf_dir), ["zone", "value"], dest, _POLICY)
    k = F.col("part") % 7
    spoilt = (
        manifest.where(k != 3)
        .withColumn("content_hash", F.when(k == 1, "0").otherwise(F.col("content_hash")))
        .withColumn("bytes", F.col("bytes") + F.when(k == 2, 1).otherwise(0))
        .withColumn("n_rows", F.col("n_rows") + F.when(k == 4, 1).otherwise(0))
    )
    more = spark.createDataFrame([(99999, "data/part=99999/x.parquet"), (99998, "../x")], "part long, path string")
    found = verify_bundle(spark, dest, spoilt.unionByName(more, allowMissingColumns=True))
    return found.select(F.regexp_replace("path", r"^(data/part=\d+)/.*$", "$1").alias("path"), "state")


@query("bundle_whole", f"{_CUT_SQL} SELECT DISTINCT 'data/part=' || lpad(CAST(part AS VARCHAR), 5, '0') AS path, 'ok' AS state FROM cut UNION ALL SELECT v, 'ok' FROM (VALUES ('(numbering)'), ('(rows)'), ('(envelope)'), ('(schema)')) t(v)")
def bundle_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle with style and license, as it was written."""
    dest = shared_folder(spark, "bundle")
    style = '{"style_version":1,"layer":{"geometry":"polygon","fill_color":{"literal":"#00ff00"},"fill_opacity":{"literal":"0.5"},"outline_color":{"literal":"#000000"},"outline_width":{"literal":"1"}}}'
    publish(shaped_features(spark, sf_dir), ["zone", "value"], dest, _POLICY, style=style, license={"source": "ODbL", "redistribution": "yes"})
    return verify_bundle(spark, dest).select(F.regexp_replace("path", r"^(data/part=\d+)/.*$", "$1").alias("path"), "state")


_SPOILT = ("clean", "null", "negative", "repeated", "none")

_REFUSALS_SQL = f"""{_CUT_SQL}, k(spoilt, refusal) AS (VALUES ('clean', NULL), ('null', 'identity_null'), ('negative', 'identity_negative'), ('repeated', 'identity_duplicate'), ('none', NULL)),
t AS (SELECT count(DISTINCT part) AS parts, count(*) AS n_rows FROM cut)
SELECT spoilt, refusal, CASE WHEN refusal IS NOT NULL THEN NULL WHEN spoilt = 'none' THEN 0 ELSE parts END AS parts, CASE WHEN refusal IS NOT NULL THEN NULL WHEN spoilt = 'none' THEN 0 ELSE n_rows END AS n_rows,
  CASE WHEN refusal IS NULL THEN 'ok' END AS verified FROM k, t"""


@query("publish_refusals", _REFUSALS_SQL)
def publish_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishes of all parcels, as they are, with one id spoilt, and of none: what is refused, and what was written of the others."""
    features = sized_features(spark, sf_dir).drop("attr_bytes")
    first = features.agg(F.min("id"), F.max("id")).first()
    change = {"null": F.lit(None).cast("long"), "negative": F.lit(-1).cast("long"), "repeated": F.lit(first[1]).cast("long")}
    found = []
    for spoilt in _SPOILT:
        rows = features.where(F.lit(spoilt != "none"))
        if spoilt in change:
            rows = rows.withColumn("id", F.when(F.col("id") == first[0], change[spoilt]).otherwise(F.col("id")))
        dest = shared_folder(spark, "bundle")
        try:
            written = contiguous(publish(rows, ["zone", "value"], dest, _POLICY)).first()
            states = {r["state"] for r in verify_bundle(spark, dest).select("state").distinct().collect()}
            found.append((spoilt, None, written["parts"], written["n_rows"], ",".join(sorted(states))))
        except PublishRefused as refused:
            found.append((spoilt, refused.code, None, None, None))
    return spark.createDataFrame(found, "spoilt string, refusal string, parts long, n_rows long, verified string")


@query("publish_totals", f"{_CUT_SQL} SELECT count(DISTINCT part) AS parts, true AS contiguous, count(*) AS n_rows FROM cut")
def publish_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = sized_features(spark, sf_dir)
    return contiguous(partition_manifest(features.join(cut_partitions(features, _POLICY).select("id", "part"), "id")))


@query("publish_deterministic", f"{_CUT_SQL} SELECT DISTINCT part, 'identical' AS state FROM cut")
def publish_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two publishes of the same features, dealt otherwise the second time, part by part, by the hash of the files written."""
    features = shaped_features(spark, sf_dir)
    first = publish(features, ["zone", "value"], shared_folder(spark, "bundle"), _POLICY)
    return compare_publishes(first, publish(features.repartition(range_count(features, 2 << 20) + 5), ["zone", "value"], shared_folder(spark, "bundle"), _POLICY))


_ASSETS_SQL = """mf AS (SELECT CASE WHEN s_suppkey % 11 = 10 THEN '../part-' ELSE 'data/part-' END || CAST(s_suppkey AS VARCHAR) AS path, s_suppkey * 10 AS bytes, sha256(s_name) AS content_hash, s_nationkey AS n_rows FROM supplier WHERE s_suppkey % 13 <> 5),
ob AS (SELECT CASE WHEN s_suppkey % 11 = 10 THEN '../part-' ELSE 'data/part-' END || CAST(s_suppkey AS VARCHAR) AS path, s_suppkey * 10 + CASE WHEN s_suppkey % 7 = 3 THEN 1 ELSE 0 END AS bytes, CASE WHEN s_suppkey % 7 = 4 THEN 'other' ELSE sha256(s_name) END AS content_hash, s_nationkey + CASE WHEN s_suppkey % 7 = 5 THEN 1 ELSE 0 END AS n_rows FROM supplier WHERE s_suppkey % 9 <> 7)"""


def asset_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(
        k.alias("k"),
        F.concat(F.when(k % 11 == 10, "../part-").otherwise("data/part-"), k.cast("string")).alias("path"),
        (k * 10).alias("bytes"),
        F.sha2(F.col("s_name").cast("binary"), 256).alias("content_hash"),
        F.col("s_nationkey").alias("n_rows"),
    )
    k = F.col("k")
    observed = base.where(k % 9 != 7).select(
        "path",
        (F.col("bytes") + F.when(k % 7 == 3, 1).otherwise(0)).alias("bytes"),
        F.when(k % 7 == 4, "other").otherwise(F.col("content_hash")).alias("content_hash"),
        (F.col("n_rows") + F.when(k % 7 == 5, 1).otherwise(0)).alias("n_rows"),
    )
    return base.where(k % 13 != 5).drop("k"), observed


@query(
    "bundle_verification",
    f"""WITH {_ASSETS_SQL} SELECT coalesce(mf.path, ob.path) AS path, CASE WHEN mf.path IS NULL THEN 'asset-extra' WHEN starts_with(mf.path, '..') THEN 'unsafe-path' WHEN ob.path IS NULL THEN 'asset-missing' WHEN mf.bytes <> ob.bytes THEN 'bytes-mismatch'
    WHEN mf.content_hash <> ob.content_hash THEN 'hash-mismatch' WHEN mf.n_rows <> ob.n_rows THEN 'rows-mismatch' ELSE 'ok' END AS state FROM mf FULL JOIN ob ON mf.path = ob.path""",
)
def bundle_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_assets(*asset_tables(spark, sf_dir))


@query(
    "pin_recheck",
    f"WITH {_ASSETS_SQL} SELECT mf.path, CASE WHEN ob.path IS NULL THEN 'unverifiable' WHEN mf.content_hash = ob.content_hash AND mf.bytes = ob.bytes THEN 'unchanged' ELSE 'changed' END AS status FROM mf LEFT JOIN ob ON mf.path = ob.path",
)
def pin_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recheck_pins(*asset_tables(spark, sf_dir))


@query("file_content_hashes")
def file_content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of the files of all tables; tests hold them against hashlib."""
    files = file_hashes(spark, sf_dir)
    return files.select(F.regexp_extract("path", r"/([^/]+)\.parquet(/[^/]*)?$", 1).alias("table"), "bytes", "content_hash")


@query(
    "artifact_admission",
    """WITH rq AS (SELECT c_custkey AS request, 'idx/' || CAST(c_custkey % 97 AS VARCHAR) AS path, c_custkey % 3 AS grid, c_nationkey % 2 AS version, c_mktsegment AS content_hash FROM customer),
    rg AS (SELECT 'idx/' || CAST(s_suppkey AS VARCHAR) AS path, s_suppkey % 3 AS grid, 0 AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS content_hash FROM supplier)
    SELECT request, CASE WHEN rg.path IS NULL THEN 'absent' WHEN rq.grid <> rg.grid OR rq.version <> rg.version THEN 'key_mismatch' WHEN rq.content_hash <> rg.content_hash THEN 'source_changed' ELSE 'hit' END AS verdict FROM rq LEFT JOIN rg ON rq.path = rg.path""",
)
def artifact_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    requests = table(spark, sf_dir, "customer").select(
        k.alias("request"), F.concat(F.lit("idx/"), (k % 97).cast("string")).alias("path"), (k % 3).alias("grid"), (F.col("c_nationkey") % 2).alias("version"), F.col("c_mktsegment").alias("content_hash")
    )
    registry = table(spark, sf_dir, "supplier").select(F.concat(F.lit("idx/"), s.cast("string")).alias("path"), (s % 3).alias("grid"), F.lit(0).alias("version"), F.when(s % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("content_hash"))
    return admit_artifacts(requests, registry, ["grid", "version"])


@query(
    "operation_digests",
    """SELECT c_custkey AS id, sha256('{"dataset":"' || c_mktsegment || '","rows":' || CAST(c_custkey AS VARCHAR) || ',"license":' || CASE WHEN c_nationkey % 2 = 0 THEN 'null' ELSE '"odbl"' END || '}') AS digest FROM customer""",
)
def operation_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("rows"), F.when(F.col("c_nationkey") % 2 != 0, "odbl").alias("license")]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), operation_digest(fields).alias("digest"))


_LICENSE_SQL = """lc AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 IN (1, 2) THEN 'ODbL' END AS source, CASE WHEN s_suppkey % 6 = 3 THEN 'The surveyors' END AS attribution,
  CASE s_suppkey % 5 WHEN 0 THEN 'Permitted' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END AS redistribution, CASE WHEN s_suppkey % 6 IN (2, 4) THEN 'CC-BY' WHEN s_suppkey % 6 = 5 THEN ' ' END AS operator, CASE WHEN s_suppkey % 4 = 0 THEN 'forbidden' ELSE 'permitted' END AS op_redist FROM supplier),
l2 AS (SELECT *, source IS NOT NULL OR attribution IS NOT NULL OR redistribution IS NOT NULL AS declares, CASE WHEN lower(redistribution) IN ('permitted', 'allowed', 'yes') THEN 'permitted' WHEN lower(redistribution) IN ('forbidden', 'prohibited', 'no') THEN 'forbidden' ELSE 'unknown' END AS says FROM lc)"""


@query(
    "license_admission",
    f"""WITH {_LICENSE_SQL} SELECT id, CASE WHEN declares AND operator IS NOT NULL THEN 'declared-twice' WHEN declares AND says = 'forbidden' THEN 'not-carryable' WHEN declares THEN 'declared-by-source' WHEN operator IS NOT NULL AND trim(operator) = '' THEN 'operator-empty'
    WHEN operator IS NOT NULL AND op_redist = 'forbidden' THEN 'not-carryable' WHEN operator IS NOT NULL THEN 'declared-by-operator' ELSE 'not-declared' END AS state, CASE WHEN declares THEN says WHEN operator IS NOT NULL THEN op_redist END AS redistribution FROM l2""",
)
def license_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    found = admit_license(
        F.when((k % 6).isin(1, 2), "ODbL"),
        F.when(k % 6 == 3, "The surveyors"),
        F.when(k % 5 == 0, "Permitted").when(k % 5 == 1, "no").when(k % 5 == 2, "maybe"),
        F.when((k % 6).isin(2, 4), "CC-BY").when(k % 6 == 5, " "),
        F.when(k % 4 == 0, "forbidden").otherwise("permitted"),
    )
    return table(spark, sf_dir, "supplier").select(k.alias("id"), found.alias("l")).select("id", "l.*")


@query(
    "dataset_uris",
    """SELECT p_partkey AS id, CASE WHEN regexp_full_match(nm, '[A-Za-z0-9._-]{1,128}') AND NOT contains(nm, '..') THEN 'spatial://dataset/' || nm END AS uri
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'a..' || p_brand ELSE repeat('x', 100 + p_size) END AS nm FROM part)""",
)
def dataset_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k % 4 == 2, F.concat(F.lit("a.."), "p_brand")).otherwise(F.expr("repeat('x', 100 + p_size)"))
    return table(spark, sf_dir, "part").select(k.alias("id"), logical_uri(name).alias("uri"))


_PATHS_SQL = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'data/part-' || CAST(page_id AS VARCHAR) WHEN 1 THEN '/data/x' WHEN 2 THEN 'data/../x' WHEN 3 THEN 'data//x' ELSE url END AS path FROM pages)"


@query("asset_paths", f"SELECT page_id, path = '' OR starts_with(path, '/') OR contains(path, '\\') OR contains(path, ':') OR list_has_any(string_split(path, '/'), ['..', '.', '']) AS unsafe FROM {_PATHS_SQL}")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("data/part-"), k.cast("string"))).when(k % 5 == 1, "/data/x").when(k % 5 == 2, "data/../x").when(k % 5 == 3, "data//x").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", unsafe_path(path).alias("unsafe"))


@query("styled_features", f"WITH {PARCELS_SQL} SELECT id, zone, CASE WHEN zone IS NULL THEN '#cccccc' WHEN zone = '1-URGENT' THEN '#ff0000' WHEN zone = '5-LOW' THEN '#00ff00' ELSE '#888888' END AS fill_color FROM p")
def styled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("1-URGENT", "#ff0000"), ("5-LOW", "#00ff00")], "when string, then string")
    return resolve(parcels(spark, sf_dir).select("id", "zone"), "zone", rules, "#cccccc", "#888888", "fill_color")


def style_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(style_id, doc): a style for each customer, some with a fault."""
    k = F.col("c_custkey")
    case = F.concat(F.lit('{"when":"'), F.col("c_mktsegment"), F.lit('","then":"#0000ff"}'))
    cases = F.when(k % 8 == 1, F.lit("")).when(k % 8 == 2, F.concat(case, F.lit(","), case)).otherwise(F.concat(case, F.lit(',{"when":"~","then":"#00ff00"}')))
    on_null = F.when(k % 8 == 3, F.lit("")).otherwise(F.lit(',"on_null":"#cccccc"'))
    column = F.when(k % 8 == 4, "height").otherwise("zone")
    fill = F.concat(F.lit('{"match":{"column":"'), column, F.lit('","cases":['), cases, F.lit("]"), on_null, F.lit(',"on_unmatched":"#888888"}}'))
    opacity = F.when(k % 8 == 5, F.lit('{"literal":"1.5"}')).otherwise(F.lit('{"literal":"0.5"}'))
    version = F.when(k % 8 == 6, "2").otherwise("1")
    doc = F.concat(F.lit('{"style_version":'), version, F.lit(',"layer":{"geometry":"polygon","fill_color":'), fill, F.lit(',"fill_opacity":'), opacity, F.lit(',"outline_color":{"literal":"#000000"},"outline_width":{"literal":"1"}}}'))
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("style_id"), F.when(k % 8 == 7, F.lit("{")).otherwise(doc).alias("doc"))


@query(
    "style_validation",
    """SELECT c_custkey AS style_id, CASE c_custkey % 8 WHEN 1 THEN 'fill_color:no-case' WHEN 2 THEN 'fill_color:duplicate-case' WHEN 3 THEN 'fill_color:branch-missing' WHEN 4 THEN 'fill_color:match-column' WHEN 5 THEN 'fill_opacity:value' WHEN 6 THEN 'unsupported-version' WHEN 7 THEN 'not-json' ELSE '' END AS violations FROM customer""",
)
def style_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_documents(spark, sf_dir).select("style_id", F.array_join(style_violations(F.col("doc"), F.array(F.lit("zone"))), ",").alias("violations"))


@query(
    "style_legend",
    """WITH s AS (SELECT c_custkey AS style_id, c_mktsegment AS seg, c_custkey % 8 AS r FROM customer WHERE c_custkey % 8 <> 7),
    e AS (SELECT style_id, 0 AS k, 'case' AS kind, seg AS value, '#0000ff' AS fill_color FROM s WHERE r <> 1
      UNION ALL SELECT style_id, 1, 'case', CASE WHEN r = 2 THEN seg ELSE '~' END, CASE WHEN r = 2 THEN '#0000ff' ELSE '#00ff00' END FROM s WHERE r <> 1
      UNION ALL SELECT style_id, 2, 'null', NULL, CASE WHEN r <> 3 THEN '#cccccc' END FROM s UNION ALL SELECT style_id, 3, 'unmatched', NULL, '#888888' FROM s)
    SELECT style_id, (row_number() OVER (PARTITION BY style_id ORDER BY k) - 1)::INT AS position, kind, value, fill_color FROM e""",
)
def style_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend(style_documents(spark, sf_dir))


@query("wkb_bundle_rows", f"WITH {_SIZED_SQL} SELECT id, wkb::BIGINT AS wkb_len FROM sw")
def wkb_bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that the cut rule reckons with are those of the bytes made."""
    return to_wkb(parcel_vertices(spark, sf_dir)).select("id", F.octet_length("geometry").cast("long").alias("wkb_len"))
