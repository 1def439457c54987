"""Styles: a table of documents to violations, and values to draw parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.once import once

PROPERTIES = ("fill_color", "fill_opacity", "outline_color", "outline_width")
MAX_CASES, MAX_WIDTH = 64, 64.0
_VALUE = "struct<literal:string,match:struct<`column`:string,cases:array<struct<when:string,then:string>>,on_null:string,on_unmatched:string>>"
STYLE = f"struct<style_version:int,layer:struct<geometry:string,{','.join(f'{p}:{_VALUE}' for p in PROPERTIES)}>>"


def style_violations(doc: Column, text_columns: Column) -> Column:
    """Array of violations of a style document (JSON text); empty if it is good. text_columns: the published text columns of its dataset."""
    return once(F.from_json(doc, STYLE), lambda s: _violations(doc, s, text_columns))


def _violations(doc: Column, s: Column, text_columns: Column) -> Column:
    layer = s["layer"]
    matched = [layer[p]["match"].isNotNull() for p in PROPERTIES]
    n_match = sum((F.when(m, 1).otherwise(0) for m in matched), F.lit(0))
    found = [
        F.when(s.isNull() | (s["style_version"].isNull() & layer.isNull()), "not-json"),
        F.when(layer.isNotNull() & ~s["style_version"].eqNullSafe(F.lit(1)), "unsupported-version"),
        F.when(layer.isNotNull() & ~layer["geometry"].eqNullSafe(F.lit("polygon")), "geometry"),
        F.when(_unknown(doc), "unknown-key"),
        F.when(n_match > 1, "second-match"),
    ]
    for p in PROPERTIES:
        v, m = layer[p], layer[p]["match"]
        every = F.when(m.isNotNull(), F.concat(F.transform(m["cases"], lambda c: c["then"]), F.array(m["on_null"], m["on_unmatched"]))).otherwise(F.array(v["literal"]))
        if p.endswith("color"):
            bad = F.exists(every, lambda x: x.isNotNull() & ~x.rlike("^#[0-9a-fA-F]{6}$"))
        else:
            top = 1.0 if p.endswith("opacity") else MAX_WIDTH
            bad = F.exists(every, _outside(top))
        cases = F.transform(m["cases"], lambda c: c["when"])
        found += [
            F.when(layer.isNotNull() & (v.isNull() | (v["literal"].isNull() & m.isNull())), f"{p}:missing"),
            F.when(bad, f"{p}:value"),
            F.when(m.isNotNull() & (F.coalesce(F.array_size(m["cases"]), F.lit(0)) < 1), f"{p}:no-case"),
            F.when(F.array_size(m["cases"]) > MAX_CASES, f"{p}:too-many-cases"),
            F.when(F.array_size(F.array_distinct(cases)) < F.array_size(cases), f"{p}:duplicate-case"),
            F.when(m.isNotNull() & (m["on_null"].isNull() | m["on_unmatched"].isNull()), f"{p}:branch-missing"),
            F.when(m.isNotNull() & ~F.array_contains(text_columns, F.coalesce(m["column"], F.lit(""))), f"{p}:match-column"),
        ]
    return F.array_compact(F.array(*found))


def _unknown(doc: Column) -> Column:
    """Whether an object of the document, at any level, has a key that it shouldn't."""

    def other(path: str, *known: str) -> Column:
        keys = F.json_object_keys(F.get_json_object(doc, path))
        return F.coalesce(F.exists(keys, lambda k: ~k.isin(*known)), F.lit(False))

    found = other("$", "style_version", "layer") | other("$.layer", "geometry", *PROPERTIES)
    for p in PROPERTIES:
        cases = F.from_json(F.get_json_object(doc, f"$.layer.{p}.match.cases"), "array<map<string,string>>")
        strange = F.exists(cases, lambda c: F.exists(F.map_keys(c), lambda k: ~k.isin("when", "then")))
        found = found | other(f"$.layer.{p}", "literal", "match") | other(f"$.layer.{p}.match", "column", "cases", "on_null", "on_unmatched") | F.coalesce(strange, F.lit(False))
    return found


def _outside(top: float):
    return lambda x: x.isNotNull() & ~F.coalesce(x.try_cast("double").between(0.0, top), F.lit(False))


def resolve(features: DataFrame, key: str, rules: DataFrame, on_null: str, on_unmatched: str, name: str) -> DataFrame:
    """The features with the value that a match gives their key: its case, or the branch for null, or that for the unlisted.

    rules: (when, then); more than MAX_CASES are refused (too-many-cases), as they are where a style is validated, and so is a value with two of them
    (duplicate-case), which would give a feature two rows."""
    named = [r["when"] for r in rules.select("when").limit(MAX_CASES + 1).collect()]
    if len(named) > MAX_CASES or len(set(named)) < len(named):
        raise ValueError("style_refused: " + ("too-many-cases" if len(named) > MAX_CASES else "duplicate-case"))
    small = F.broadcast(rules.select(F.col("when").alias("_when"), F.col("then").alias("_then")))
    joined = features.join(small, features[key] == small["_when"], "left")
    value = F.when(F.col(key).isNull(), on_null).when(F.col("_when").isNull(), on_unmatched).otherwise(F.col("_then"))
    return joined.select(*features.columns, value.alias(name))


def legend(styles: DataFrame) -> DataFrame:
    """(style_id, position, kind, value, fill_color) of each style's legend: declared cases in order, then null, then unmatched."""
    m = F.from_json("doc", STYLE)["layer"]["fill_color"]["match"]
    cases = F.transform(m["cases"], lambda c: F.struct(F.lit("case").alias("kind"), c["when"].alias("value"), c["then"].alias("fill_color")))

    def branch(kind: str, then: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"), then.alias("fill_color")))

    every = F.concat(cases, branch("null", m["on_null"]), branch("unmatched", m["on_unmatched"]))
    return styles.where(m.isNotNull()).select("style_id", F.posexplode(every).alias("position", "e")).select("style_id", "position", "e.*")
