"""Admitting predicates, projections, viewports and identities before any row is read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES, MAX_DEPTH, MAX_ATTRIBUTES = 4096, 32, 32

#: Catalyst expressions that the filter language admits.
_NODES = frozenset(
    "EqualTo Not GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or In IsNull IsNotNull Like ILike Add Subtract Multiply Divide UnaryMinus UnaryPositive Literal UnresolvedAttribute".split()
)
_COMMENT = re.compile(r"--|/\*|\*/")
_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'")

#: Types of attributes that can be published or filtered.
_ADMISSIBLE = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)


def _walk(node, depth: int, names: set[str]) -> str | None:
    """The first refusal in an unresolved expression tree, if any; collects the column names."""
    if depth > MAX_DEPTH:
        return "too_deep"
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        if node.nameParts().mkString(".").lower() != "between" or node.arguments().size() != 3:
            return "construct_not_admitted"
    elif kind == "UnresolvedAttribute":
        if node.nameParts().size() != 1:
            return "construct_not_admitted"
        names.add(node.nameParts().head())
    elif kind not in _NODES:
        return "construct_not_admitted"
    children = node.children()
    for i in range(children.size()):
        if refusal := _walk(children.apply(i), depth + 1, names):
            return refusal
    return None


def admit_predicate(spark: SparkSession, text: str, schema: T.StructType, identity: str = "id") -> str | None:
    """None if Spark may run the text as a filter over the schema; else the code of the refusal.

    Spark's own parser reads the text, so it must be one whole expression; an allowlist of its node classes then refuses functions, casts,
    subqueries, parameters and stars, and a zero-row relation resolves names and types."""
    if len(text.encode()) > MAX_BYTES:
        return "too_long"
    bare = _STRING.sub("''", text)
    if ";" in bare:
        return "not_a_single_expression"
    if _COMMENT.search(bare):
        return "construct_not_admitted"
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as error:  # ParseException, or a Java stack overflow on absurd nesting
        if isinstance(error, ParseException) or "ParseException" in str(error) or "StackOverflow" in str(error):
            return "unparsable"
        raise
    names: set[str] = set()
    if refusal := _walk(tree, 1, names):
        return refusal
    fields = {f.name.lower(): f for f in schema.fields}
    for name in sorted(names):
        field = fields.get(name.lower())
        if field is None:
            return "unknown_column"
        if name.lower() == "id" and identity.lower() != "id":
            return "identity_alias_ambiguous"
        if not isinstance(field.dataType, _ADMISSIBLE):
            return "column_not_filterable"
    try:
        checked = spark.createDataFrame([], schema).select(F.expr(text).alias("p")).schema["p"].dataType
    except AnalysisException:
        return "rejected_by_binder"
    return None if isinstance(checked, T.BooleanType) else "not_boolean"


def admit_projection(schema: T.StructType, columns: Sequence[str], identity: str = "id", geometry: str = "geometry") -> list[tuple[str, str | None]]:
    """Each column with its refusal, or None. Names are compared as they are."""
    fields = {f.name: f for f in schema.fields}
    found, seen = [], set()
    for k, name in enumerate(columns):
        field = fields.get(name)
        if k >= MAX_ATTRIBUTES:
            refusal = "too_many_attributes"
        elif name in seen:
            refusal = "attribute_duplicated"
        elif field is None:
            refusal = "attribute_unknown"
        elif name == geometry:
            refusal = "attribute_is_geometry"
        elif name == identity:
            refusal = "attribute_is_identity"
        elif not isinstance(field.dataType, _ADMISSIBLE):
            refusal = "attribute_unpublishable"
        else:
            refusal = None
        seen.add(name)
        found.append((name, refusal))
    return found


def schema_table(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """(ordinal, name, type, nullable) of each column, from the schema alone."""
    return [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]


def identity_candidates(schema: T.StructType) -> list[str]:
    """64-bit integer columns in schema order, but for names with a comma."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.LongType) and "," not in f.name]


def viewport_refusal(view_crs: Column, dataset_crs: Column, has_bbox: Column) -> Column:
    """Why a viewport can't be asked of a dataset: another CRS, or one that has a definition only. A viewport without a CRS is in the dataset's."""
    asked = has_bbox & view_crs.isNotNull()
    return (
        F.when(asked & (dataset_crs.isNull() | (dataset_crs == "(definition-only)")), "viewport_crs_unidentifiable")
        .when(asked & (view_crs != dataset_crs), "viewport_crs_mismatch")
        .otherwise(F.lit(None).cast("string"))
    )


def bbox_refusal(bbox: str = "bbox") -> Column:
    """Why a covering box is unusable: non_finite before inverted; null if it is good."""
    sides = [F.col(f"{bbox}.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    bad = None
    for s in sides:
        here = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
        bad = here if bad is None else bad | here
    inverted = (sides[0] > sides[2]) | (sides[1] > sides[3])
    return F.when(bad, "bbox_non_finite").when(inverted, "bbox_inverted").otherwise(F.lit(None).cast("string"))


def identity_refusal(identity: Column) -> Column:
    return F.when(identity.isNull(), "identity_null").when(identity < 0, "identity_negative").otherwise(F.lit(None).cast("string"))


def identity_scan(features: DataFrame, identity: str = "id") -> DataFrame:
    """One row: rows, distinct, nulls, least and greatest id, the verdict, and whether all ids are exact as doubles.

    Two levels: ids are counted by value first, so that the distinct count is a plain sum and a hot id is combined before the shuffle."""
    by_id = features.groupBy(F.col(identity).alias("id")).agg(F.count("*").alias("n"))
    one = by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("id").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )
    verdict = (
        F.when(F.col("n_null") > 0, "identity_null")
        .when(F.col("min_id") < 0, "identity_negative")
        .when(F.col("n_distinct") < F.col("n_rows"), "identity_duplicate")
        .otherwise("unique")
    )
    return one.select("*", verdict.alias("verdict"), (F.coalesce("max_id", F.lit(0)) < F.lit(1 << 53)).alias("js_exact"))
