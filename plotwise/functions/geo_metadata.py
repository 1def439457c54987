"""The `geo` metadata of GeoParquet files, as column expressions over its JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwise.functions.once import once

AXIS = "array<struct<name:string,direction:string>>"
MAX_DEFINITION_BYTES = 65536


def geo_fields(geo: Column) -> Column:
    """struct of what a file's `geo` JSON declares for its primary column; crs_state is declared, null or absent."""
    columns = F.from_json(F.get_json_object(geo, "$.columns"), "map<string,string>")
    found = once(F.get_json_object(geo, "$.primary_column"), lambda primary: F.struct(primary.alias("primary"), columns[primary].alias("own")))
    read = once(found, lambda f: F.struct(f["primary"].alias("primary"), f["own"].alias("own"), F.get_json_object(f["own"], "$.crs").alias("crs")))
    return once(read, lambda r: _fields(geo, r["primary"], r["own"], r["crs"]))


def _fields(geo: Column, primary: Column, own: Column, crs: Column) -> Column:
    has_crs = F.array_contains(F.json_object_keys(own), "crs")
    state = F.when(~F.coalesce(has_crs, F.lit(False)), "absent").when(crs.isNull(), "null").otherwise("declared")
    covering = F.from_json(F.get_json_object(own, "$.covering.bbox"), "map<string,array<string>>")
    return F.struct(
        F.get_json_object(geo, "$.version").alias("version"),
        primary.alias("primary_column"),
        F.get_json_object(own, "$.encoding").alias("encoding"),
        F.from_json(F.get_json_object(own, "$.geometry_types"), "array<string>").alias("geometry_types"),
        state.alias("crs_state"),
        crs.alias("crs"),
        crs_identifier(crs).alias("crs_id"),
        axis_order(crs).alias("axis_order"),
        F.array_join(covering["xmin"], ".").alias("covering_xmin"),
    )


def crs_identifier(projjson: Column) -> Column:
    """`authority:code`, or (definition-only) for a definition without one; null for no definition."""
    authority, code = F.get_json_object(projjson, "$.id.authority"), F.get_json_object(projjson, "$.id.code")
    return F.when(projjson.isNotNull(), F.coalesce(F.concat(authority, F.lit(":"), code), F.lit("(definition-only)")))


def axis_order(projjson: Column) -> Column:
    """easting_northing, longitude_latitude, northing_easting or latitude_longitude; null if the first two axes aren't east and north."""
    return once(F.from_json(F.get_json_object(projjson, "$.coordinate_system.axis"), AXIS), _axis_order)


def _axis_order(axes: Column) -> Column:
    a, b = F.get(axes, F.lit(0)), F.get(axes, F.lit(1))
    names = F.concat_ws(" ", F.lower(a["name"]), F.lower(b["name"]))
    geographic = names.contains("longitude") | names.contains("latitude")
    first, second = F.lower(a["direction"]), F.lower(b["direction"])
    return F.when((first == "east") & (second == "north"), F.when(geographic, "longitude_latitude").otherwise("easting_northing")).when(
        (first == "north") & (second == "east"), F.when(geographic, "latitude_longitude").otherwise("northing_easting")
    )


def admit_crs(state: Column, axis: Column, asserted: Column, asserted_definition: Column) -> Column:
    """What comes of a file's CRS and a caller's: file, caller_asserted, or a refusal. asserted: identifier; asserted_definition: PROJJSON."""
    declared = state == "declared"
    good_axis = ("easting_northing", "longitude_latitude")
    own_axis = F.coalesce(axis.isin(*good_axis), F.lit(False))
    given_axis = F.coalesce(axis_order(asserted_definition).isin(*good_axis), F.lit(False))
    return (
        F.when(declared & asserted.isNotNull(), "crs_assertion_conflict")
        .when(declared & axis.isNull(), "axis_order_unestablished")
        .when(declared & ~own_axis, "axis_order_refused")
        .when(declared, "file")
        .when(asserted.isNull(), "crs_undeclared")
        .when(F.trim(asserted) == "", "crs_identifier_blank")
        .when(F.octet_length(asserted_definition) > MAX_DEFINITION_BYTES, "crs_definition_too_long")
        .when(axis_order(asserted_definition).isNull(), "axis_order_unestablished")
        .when(~given_axis, "axis_order_refused")
        .otherwise("caller_asserted")
    )


def admit_encoding(encoding: Column, geometry_types: Column, column_type: Column) -> Column:
    """Refusal of a file's geometry column, or null: WKB polygons in a binary column only."""
    return (
        F.when(column_type.isNull(), "geometry_column_missing")
        .when(column_type != "binary", "geometry_column_not_binary")
        .when(~encoding.eqNullSafe(F.lit("WKB")), "encoding_not_admitted")
        .when(F.exists(F.coalesce(geometry_types, F.array().cast("array<string>")), lambda t: t != "Polygon"), "geometry_type_not_admitted")
    )


def definition_provenance(definition: Column, catalog_id: Column, catalog_hash: Column) -> Column:
    """`catalog:<id>@sha256:<12 hex>` where the definition's hash is in the catalog, else pasted."""
    return F.when(definition.isNull(), F.lit(None).cast("string")).when(catalog_id.isNotNull(), F.concat(F.lit("catalog:"), catalog_id, F.lit("@sha256:"), F.substring(catalog_hash, 1, 12))).otherwise("pasted")


def view_bbox(cx: Column, cy: Column, zoom: Column, width: Column | float, height: Column | float) -> Column:
    """struct(xmin, ymin, xmax, ymax) of a view: 2**zoom pixels a unit."""
    scale = F.pow(F.lit(2.0), zoom)
    half_w, half_h = F.lit(width) / scale / 2, F.lit(height) / scale / 2
    return F.struct((cx - half_w).alias("xmin"), (cy - half_h).alias("ymin"), (cx + half_w).alias("xmax"), (cy + half_h).alias("ymax"))


def fit_zoom(span_x: Column, span_y: Column, width: float, height: float, margin: float = 0.1) -> Column:
    """Zoom at which a box fits a view with a margin, from -20 to 21; 0 for a box without extent."""
    room = 1 - margin
    zoom = F.least(F.log2(F.lit(width * room) / F.nullif(span_x, F.lit(0.0))), F.log2(F.lit(height * room) / F.nullif(span_y, F.lit(0.0))))
    return F.coalesce(F.greatest(F.lit(-20.0), F.least(F.lit(21.0), zoom)), F.lit(0.0))
