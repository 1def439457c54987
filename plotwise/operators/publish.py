"""Publishing: cutting ordered features into partitions, writing them with a manifest, verifying what was written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwise.operators.cutting import Cut, CutPolicy, cut_partitions
from plotwise.operators.selection import extent
from plotwise.operators.style import style_violations
from plotwise.sources.bundle import MANIFEST, BundleSource
from plotwise.sources.footers import file_system, readable_by_tasks
from plotwise.storage import exists

__all__ = ["CutPolicy", "cut_partitions"]

#: The first batches grow fourfold from 64 KiB to 1 MiB, and none is under 32 KiB.
LADDER_START, LADDER_TOP, LADDER_FLOOR = 65536, 1048576, 32768


def attribute_bytes(schema: T.StructType, columns: Sequence[str]) -> Column:
    """Estimated bytes of a row's attributes: one for validity, and by type its width or its text and four."""
    total = F.lit(0)
    width = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.DoubleType: 8}
    for name in columns:
        kind = type(schema[name].dataType)
        size = F.octet_length(name) + 4 if kind is T.StringType else F.lit(width[kind])
        total = total + 1 + F.when(F.col(name).isNull(), 0).otherwise(size)
    return total


def ladder_target(batch_no: Column) -> Column:
    """Target bytes of a stream's batch by its number, from 0."""
    steps = F.least(batch_no, F.lit(8))
    return F.greatest(F.lit(LADDER_FLOOR), F.least(F.lit(float(LADDER_START)) * F.pow(F.lit(4.0), steps), F.lit(float(LADDER_TOP)))).cast("long")


def partition_manifest(features: DataFrame) -> DataFrame:
    """(part, n_rows, id_lo, id_hi, xmin..ymax) of features with `part` and `bbox`."""
    return features.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.min("id").alias("id_lo"), F.max("id").alias("id_hi"), *extent(F.col("bbox.xmin"), F.col("bbox.ymin"), F.col("bbox.xmax"), F.col("bbox.ymax"))
    )


#: Bytes of a file that are held while it is hashed.
_CHUNK = 8 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            files, name = file_system(path)
            digest = hashlib.sha256()
            with files.open_input_stream(name) as source:
                while chunk := source.read(_CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(found, pa.string())], names=["path", "bytes", "content_hash"])


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes, content_hash) of all files below a path.

    Tasks read a file in chunks where Arrow knows the file system, whatever the file's size; on others Spark's binary reader gives a file whole, so
    that none may be above 2 GB there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    if not readable_by_tasks(files):
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"))
    listed = files.select("path", F.col("length").alias("bytes"))
    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_hashed, "path string, bytes long, content_hash string")


_DATA_FILE = r"(data/part=\d+/[^/]+)$"


class PublishRefused(ValueError):
    """Nothing was written; `code` is stable."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _preflight(spark: SparkSession, features: DataFrame, columns: Sequence[str], dest: str, style: str | None, license: dict[str, str | None] | None, pins: tuple[DataFrame, DataFrame] | None) -> None:
    """All that can be refused before a byte is written, in the order in which it is told."""
    if exists(spark, dest):
        raise PublishRefused("destination_exists", dest)
    if license is not None:
        words = [F.lit(license.get(k)).cast("string") for k in ("source", "attribution", "redistribution", "operator", "operator_redistribution")]
        state = spark.range(1).select(admit_license(*words)["state"].alias("s")).first()["s"]
        if state not in ("declared-by-source", "declared-by-operator"):
            raise PublishRefused("license_refused", state)
    if pins is not None and (changed := recheck_pins(*pins).where("status <> 'unchanged'").first()):
        raise PublishRefused("source_changed", changed["path"])
    if style is not None:
        text = [c for c in columns if isinstance(features.schema[c].dataType, T.StringType)]
        found = spark.range(1).select(style_violations(F.lit(style), F.array(*map(F.lit, text)).cast("array<string>")).alias("v")).first()["v"]
        if found:
            raise PublishRefused("style_refused", ",".join(found))


def publish(
    features: DataFrame,
    columns: Sequence[str],
    dest: str,
    policy: CutPolicy = CutPolicy(),
    style: str | None = None,
    license: dict[str, str | None] | None = None,
    pins: tuple[DataFrame, DataFrame] | None = None,
    keys: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Write a bundle: data/part=NNNNN (a file each), manifest, style.json and build-info.json; gives back the manifest, read from it.

    features: id, bbox, wkb_len, verts, the columns and, where there is one, geometry.  They are dealt to ranges of ids once, with all their columns;
    the cut reads the sizes there.  Null, negative or repeated ids are refused (identity_null, identity_negative, identity_duplicate), and verts below
    0 (geometry_refused), before anything is written; if what the write tasks counted isn't what came in, what was written is taken away (rows_changed).  No features: a bundle
    without parts.  build-info.json is written last, so a failed job leaves no bundle.  The manifest has what the tasks wrote: paths, bytes,
    hashes, rows and bounds.  pins: (path, content_hash, bytes) of the sources when they were opened, and now.  keys: footer metadata of all files."""
    spark = features.sparkSession
    _preflight(spark, features, columns, dest, style, license, pins)
    own = ["id", *columns, "bbox", *(c for c in ["geometry"] if c in features.columns)]
    sized = features.withColumn("attr_bytes", attribute_bytes(features.schema, columns)).select(*own, "verts", "wkb_len", "attr_bytes")
    cut = Cut(sized, policy, partitions)
    n, refusal = cut.refusal()
    if refusal:
        raise PublishRefused(refusal)
    rows = cut.rows().select(*own, "part").repartition(cut.ranges, "part").sortWithinPartitions("part", "id")
    spark.dataSource.register(BundleSource)
    schema = [[f.name, f.dataType.simpleString()] for f in rows.drop("part").schema]
    facts = {"schema": json.dumps(schema), "license": json.dumps(license), "keys": json.dumps(keys or {}), "rows": str(n)}
    writer = rows.write.format("plotwise_bundle").mode("append").options(**facts)
    (writer if style is None else writer.option("style", style)).save(dest)
    return read_manifest(spark, dest)


def read_manifest(spark: SparkSession, bundle: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{bundle}/manifest")


def _build_info(spark: SparkSession, bundle: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{bundle}/build-info.json").collect()))  # one line


def observed_parts(spark: SparkSession, bundle: str) -> DataFrame:
    """(part, path, bytes, content_hash, n_rows, bounds) of the data files that a bundle has; only ids and boxes are read, and each file once for its hash."""
    relative = F.regexp_extract("path", _DATA_FILE, 1)
    if not exists(spark, f"{bundle}/data"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema("id long, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>").parquet(f"{bundle}/data").select("id", "bbox", F.regexp_extract("_metadata.file_path", _DATA_FILE, 1).alias("part"))
    facts = partition_manifest(rows).withColumnRenamed("part", "path")
    hashes = file_hashes(spark, f"{bundle}/data").select(relative.alias("path"), "bytes", "content_hash")
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("long")
    return hashes.join(facts, "path", "left").select(part.alias("part"), "path", "bytes", "content_hash", "n_rows", "id_lo", "id_hi", "xmin", "ymin", "xmax", "ymax")


def _whole(parts: DataFrame) -> dict:
    """Rows and bounds of all parts."""
    return parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *(f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax")))).first().asDict()


def verify_bundle(spark: SparkSession, bundle: str, manifest: DataFrame | None = None) -> DataFrame:
    """(path, state) of every data file that a bundle names or has, and of the whole: (numbering), (rows), (envelope), (schema).

    The files themselves are read: bytes, hashes, rows and bounds."""
    manifest = read_manifest(spark, bundle) if manifest is None else manifest
    observed = observed_parts(spark, bundle)
    info, now = _build_info(spark, bundle), _whole(observed)
    stored = spark.read.parquet(f"{bundle}/data").drop("part").schema if exists(spark, f"{bundle}/data") else None
    schema = info["schema"] if stored is None else [[f.name, f.dataType.simpleString()] for f in stored]
    numbered = contiguous(manifest).first()
    sides = ("xmin", "ymin", "xmax", "ymax")
    whole = [
        ("(numbering)", "ok" if numbered["contiguous"] else "not-contiguous"),
        ("(rows)", "ok" if numbered["n_rows"] == info["n_rows"] == now["n_rows"] else "row-sum-mismatch"),
        ("(envelope)", "ok" if all(info[s] == now[s] for s in sides) else "envelope-mismatch"),
        ("(schema)", "ok" if info["schema"] == schema else "schema-mismatch"),
    ]
    return verify_assets(manifest, observed).unionByName(spark.createDataFrame(whole, "path string, state string"))


def unsafe_path(path: Column) -> Column:
    """Whether an asset's path could lead out of its bundle, or mean two things on two systems."""
    return (path == "") | path.startswith("/") | path.contains("\\") | path.contains(":") | F.exists(F.split(path, "/", -1), lambda c: c.isin("..", ".", ""))


def verify_assets(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, state) of each asset: ok, unsafe-path, asset-missing, asset-extra, bytes-mismatch, hash-mismatch, rows-mismatch. Both: path, bytes, content_hash, n_rows."""
    right = observed.select(*(F.col(c).alias(f"o_{c}") for c in ("path", "bytes", "content_hash", "n_rows")))
    both = manifest.join(right, manifest["path"] == right["o_path"], "full_outer")
    state = (
        F.when(F.col("path").isNull(), "asset-extra")
        .when(unsafe_path(F.col("path")), "unsafe-path")
        .when(F.col("o_path").isNull(), "asset-missing")
        .when(F.col("bytes") != F.col("o_bytes"), "bytes-mismatch")
        .when(F.col("content_hash") != F.col("o_content_hash"), "hash-mismatch")
        .when(F.col("n_rows") != F.col("o_n_rows"), "rows-mismatch")
        .otherwise("ok")
    )
    return both.select(F.coalesce("path", "o_path").alias("path"), state.alias("state"))


def contiguous(manifest: DataFrame) -> DataFrame:
    """One row: parts, whether they are numbered 0..n-1 without a gap, and the rows of all."""
    return manifest.agg(F.count("*").alias("parts"), F.coalesce((F.min("part") == 0) & (F.max("part") == F.count("*") - 1) & (F.count_distinct("part") == F.count("*")), F.lit(True)).alias("contiguous"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def compare_publishes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, state) of two manifests: identical, differs, only_a, only_b."""
    right = b.select(F.col("part").alias("_part"), F.col("content_hash").alias("_hash"))
    both = a.select("part", "content_hash").join(right, F.col("part") == F.col("_part"), "full_outer")
    state = F.when(F.col("_part").isNull(), "only_a").when(F.col("part").isNull(), "only_b").when(F.col("content_hash") == F.col("_hash"), "identical").otherwise("differs")
    return both.select(F.coalesce("part", "_part").alias("part"), state.alias("state"))


def recheck_pins(pinned: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed, or unverifiable where nothing can be read now. Both: path, content_hash, bytes."""
    right = now.select(F.col("path").alias("_path"), F.col("content_hash").alias("_hash"), F.col("bytes").alias("_bytes"))
    both = pinned.join(right, pinned["path"] == right["_path"], "left")
    status = F.when(F.col("_hash").isNull(), "unverifiable").when((F.col("content_hash") == F.col("_hash")) & (F.col("bytes") == F.col("_bytes")), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def admit_artifacts(requests: DataFrame, registry: DataFrame, key: Sequence[str]) -> DataFrame:
    """(request, verdict): hit, absent, key_mismatch, source_changed. A derived artifact is found by path and admitted by its whole key and the source's hash."""
    right = registry.select(F.col("path").alias("_path"), F.struct(*key).alias("_key"), F.col("content_hash").alias("_hash"))
    both = requests.withColumn("_want", F.struct(*key)).join(right, F.col("path") == F.col("_path"), "left")
    verdict = F.when(F.col("_path").isNull(), "absent").when(F.col("_want") != F.col("_key"), "key_mismatch").when(F.col("content_hash") != F.col("_hash"), "source_changed").otherwise("hit")
    return both.select("request", verdict.alias("verdict"))


def operation_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of a request's canonical JSON: the fields in the order given, nulls written; software versions and paths are not among them."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)


def admit_license(source: Column, attribution: Column, redistribution: Column, operator: Column, operator_redistribution: Column) -> Column:
    """struct(state, redistribution) from what the source declares and what the operator does.

    Fixed values: permitted, allowed, yes; forbidden, prohibited, no; any other word is unknown."""
    word = F.lower(redistribution)
    source_says = F.when(word.isin("permitted", "allowed", "yes"), "permitted").when(word.isin("forbidden", "prohibited", "no"), "forbidden").otherwise("unknown")
    declares = source.isNotNull() | attribution.isNotNull() | redistribution.isNotNull()
    state = (
        F.when(declares & operator.isNotNull(), "declared-twice")
        .when(declares & (source_says == "forbidden"), "not-carryable")
        .when(declares, "declared-by-source")
        .when(operator.isNotNull() & (F.trim(operator) == ""), "operator-empty")
        .when(operator.isNotNull() & (operator_redistribution == "forbidden"), "not-carryable")
        .when(operator.isNotNull(), "declared-by-operator")
        .otherwise("not-declared")
    )
    return F.struct(state.alias("state"), F.when(declares, source_says).when(operator.isNotNull(), operator_redistribution).alias("redistribution"))


def logical_uri(name: Column) -> Column:
    """`spatial://dataset/<name>` for an admissible dataset name, else null. The scheme and the characters of a name."""
    good = name.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~name.contains("..")
    return F.when(good, F.concat(F.lit("spatial://dataset/"), name))
