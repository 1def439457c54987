"""The dataset a user opens: describe it, select from it, project it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions.geo_metadata import admit_crs, admit_encoding, geo_fields
from plotwise.functions.wkb import with_vertex_counts
from plotwise.operators.admission import admit_predicate, admit_projection, identity_scan
from plotwise.operators.layout import in_order
from plotwise.operators.publish import CutPolicy, PublishRefused, publish
from plotwise.operators.selection import Box, extent, select_features
from plotwise.sources.footers import declared
from plotwise.sources.geoparquet import carried_keys, write_files


class Refused(ValueError):
    """A whole-dataset refusal; `code` is stable."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Dataset:
    features: DataFrame
    identity: str = "id"
    crs: str | None = None
    crs_source: str = "undeclared"
    license: str | None = None
    verified: bool = True
    path: str | None = None

    def describe(self) -> DataFrame:
        """One row of facts; what isn't known has a basis that says so, never a guess."""
        names = self.features.columns
        sides = ("xmin", "ymin", "xmax", "ymax")
        known = "bbox" in names
        bounds = extent(*(F.col(f"bbox.{c}") for c in sides)) if known else [F.lit(None).cast("double").alias(c) for c in sides]
        counted = self.features.agg(F.count("*").alias("row_count"), *bounds)
        return counted.select(
            F.lit(self.crs).cast("string").alias("crs"),
            F.lit(self.crs_source).alias("crs_source"),
            F.lit("native" if self.identity == "id" else "mapped").alias("id_source"),
            F.lit("verified" if self.verified else "declared-not-verified").alias("id_uniqueness"),
            "row_count",
            F.lit("counted").alias("row_count_basis"),
            *sides,
            F.lit("covering" if known else "unknown").alias("extent_basis"),
            F.lit(self.license).cast("string").alias("license"),
            F.lit("declared-by-source" if self.license else "not-declared").alias("license_basis"),
        )

    def viewport(self, bbox: Box | None = None, bbox_crs: str | None = None, filter: str | None = None, columns: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        if bbox is not None and bbox_crs is not None and bbox_crs != self.crs:
            raise Refused("viewport_crs_unidentifiable" if self.crs in (None, "(definition-only)") else "viewport_crs_mismatch", bbox_crs)
        if filter is not None and (code := admit_predicate(self.features.sparkSession, filter, self.features.schema, self.identity)):
            raise Refused(code, filter[:80])
        return select_features(self.features, bbox, filter, self._admitted(columns), self.identity, limit)

    def project(self, columns: Sequence[str]) -> DataFrame:
        return select_features(self.features, columns=self._admitted(columns), identity=self.identity)

    def rewrite(self, dest: str, order: str, extent: Box | None = None, rows_per_file: int = 8192, partitions: int | None = None) -> Dataset:
        """The same features in a declared order, in new files that carry the footer keys of the old ones, opened again."""
        spark = self.features.sparkSession
        if self.path is None or not (keys := carried_keys(spark, self.path)).get("geo"):
            raise Refused("geo_metadata_absent", "a copy could not be opened")
        ordered = in_order(self.features, order, extent, partitions, self.identity)
        files = write_files(ordered, dest, keys, rows_per_file)
        if (written := files.agg(F.sum("n_rows").alias("n")).first()["n"] or 0) != (n := self.features.count()):
            raise ValueError(f"row_count_changed: {n} rows in, {written} written")
        return open_dataset(spark, dest, identity=self.identity)

    def publish(self, columns: Sequence[str], dest: str, policy: CutPolicy = CutPolicy(), style: str | None = None, license: dict[str, str | None] | None = None) -> DataFrame:
        """A bundle of these features, with the sizes read from their geometry; gives back its manifest."""
        rows = with_vertex_counts(self.features.withColumnRenamed(self.identity, "id")).withColumn("wkb_len", F.coalesce(F.octet_length("geometry"), F.lit(0)))
        keys = carried_keys(rows.sparkSession, self.path) if self.path else None
        try:
            return publish(rows, self._admitted(columns), dest, policy, style, license if license is not None else {"source": self.license} if self.license else None, keys=keys)
        except PublishRefused as refused:
            if refused.code in ("destination_exists", "license_refused", "style_refused", "source_changed"):
                raise
            raise Refused(refused.code) from refused

    def _admitted(self, columns: Sequence[str]) -> list[str]:
        for name, refusal in admit_projection(self.features.schema, columns, self.identity):
            if refusal:
                raise Refused(refusal, name)
        return list(columns)


def _admit_geo(spark: SparkSession, features: DataFrame, keys: dict[str, str | None], asserted: str | None, definition: str | None) -> tuple[str, str, str | None]:
    """(crs, its source, column of the boxes) from what the files declare and the caller asserts; refuses what can't be placed or read."""
    geo = F.lit(keys["geo"]).cast("string")
    fields = geo_fields(geo)
    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    asked = spark.range(1).select(fields.alias("g")).select(
        "g.*",
        admit_crs(F.col("g.crs_state"), F.col("g.axis_order"), F.lit(asserted).cast("string"), F.lit(definition).cast("string")).alias("verdict"),
    )
    g = asked.first()
    if keys["geo"] is not None:
        column = F.lit(kinds.get(g["primary_column"])).cast("string")
        types = F.lit(None).cast("array<string>") if g["geometry_types"] is None else F.array(*map(F.lit, g["geometry_types"])).cast("array<string>")
        if refusal := spark.range(1).select(admit_encoding(F.lit(g["encoding"]).cast("string"), types, column).alias("r")).first()["r"]:
            raise Refused(refusal, g["primary_column"] or "")
    if g["verdict"] not in ("file", "caller_asserted"):
        raise Refused(g["verdict"], asserted or "")
    covering = (g["covering_xmin"] or "bbox.xmin").rpartition(".")[0]
    return (g["crs_id"] if g["verdict"] == "file" else asserted), g["verdict"], covering if covering in kinds else None


def open_dataset(
    spark: SparkSession, path: str, crs_assertion: str | None = None, crs_definition: str | None = None, identity: str = "id", skip_uniqueness: bool = False
) -> Dataset:
    """Read Parquet features: what their footers declare first, then their identity in one pass over that column.

    Files that declare no CRS are opened only with one that the caller asserts, by identifier and definition (PROJJSON); files that declare
    one, only without.  The axes must be east, then north; the geometry WKB polygons in a binary column."""
    keys = declared(spark, path)
    features = spark.read.parquet(path)
    crs, source, covering = _admit_geo(spark, features, keys, crs_assertion, crs_definition)
    if identity not in features.columns:
        raise Refused("identity_unknown", identity)
    if not skip_uniqueness and (verdict := identity_scan(features, identity).first()["verdict"]) != "unique":
        raise Refused(verdict, identity)
    if covering not in (None, "bbox"):
        features = features.withColumnRenamed(covering, "bbox")
    return Dataset(features, identity, crs, source, keys["license"], verified=not skip_uniqueness, path=path)
