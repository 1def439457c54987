"""Queries over stored GeoParquet files: opened by their footers, rewritten, pruned by row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.dataset import Dataset, open_dataset
from plotwise.functions.wkb import to_wkb
from plotwise.operators.layout import group_selection
from plotwise.operators.spatial_joins import bbox_join
from plotwise.operators.trials import ratio_gates
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import E0, N0, PARCELS_SQL, PITCH, grid_cols, parcels, viewports
from plotwise.plans.geometry import parcel_vertices
from plotwise.plans.layout import declared_extent
from plotwise.plans.publishing import _SIZED_SQL
from plotwise.sources.footers import row_group_bounds
from plotwise.sources.geoparquet import geo_key, write_files
from plotwise.storage import shared_folder

CRS = '{"coordinate_system":{"axis":[{"direction":"east","name":"Easting"},{"direction":"north","name":"Northing"}]},"id":{"authority":"EPSG","code":2056},"type":"ProjectedCRS"}'


def stored(spark: SparkSession, sf_dir: str, order: str = "source-identity", rows_per_file: int = 4096) -> Dataset:
    """The parcels with their geometry as GeoParquet files in the shared folder, opened."""
    cols = grid_cols(spark, sf_dir)
    features = parcels(spark, sf_dir, cols).join(to_wkb(parcel_vertices(spark, sf_dir)), "id").select("id", "zone", "value", "bbox", "geometry")
    folder = shared_folder(spark, "parcels")
    write_files(features.repartitionByRange("id").sortWithinPartitions("id"), folder, {"geo": geo_key(CRS), "license": "ODbL", "redistribution": "yes"}, rows_per_file)
    dataset = open_dataset(spark, folder)
    return dataset if order == "source-identity" else dataset.rewrite(shared_folder(spark, "parcels-laid-out"), order, declared_extent(cols), rows_per_file)


@query(
    "geoparquet_description",
    f"""WITH {PARCELS_SQL} SELECT 'EPSG:2056' AS crs, 'file' AS crs_source, 'native' AS id_source, 'verified' AS id_uniqueness, count(*) AS row_count, 'counted' AS row_count_basis,
    min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, 'covering' AS extent_basis, 'ODbL' AS license, 'declared-by-source' AS license_basis FROM p""",
)
def geoparquet_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, opened by what the footers declare, and described."""
    return stored(spark, sf_dir).describe()


@query("geoparquet_rewrite", f"WITH {_SIZED_SQL} SELECT id, zone, value, wkb::INT AS wkb_len, xmin, ymax, 'EPSG:2056' AS crs, 'ODbL' AS license FROM sw")
def geoparquet_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid out along the curve with its footer keys, and opened again: the same rows."""
    again = stored(spark, sf_dir, "hilbert16")
    return again.features.select("id", "zone", "value", F.octet_length("geometry").alias("wkb_len"), "bbox.xmin", "bbox.ymax", F.lit(again.crs).alias("crs"), F.lit(again.license).alias("license"))


@query(
    "stored_row_groups",
    f"WITH {PARCELS_SQL} SELECT count(*) AS n_rows, min(id) AS id_lo, max(id) AS id_hi, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM p",
)
def stored_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dataset's rows and bounds from row-group statistics alone."""
    groups = row_group_bounds(spark, stored(spark, sf_dir, "hilbert16").path)
    return groups.agg(
        F.sum("n_rows").alias("n_rows"), F.min("id_lo").alias("id_lo"), F.max("id_hi").alias("id_hi"), F.min("g_xmin").alias("xmin"), F.min("g_ymin").alias("ymin"), F.max("g_xmax").alias("xmax"), F.max("g_ymax").alias("ymax")
    )


@query("pruned_viewports")
def pruned_viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, view_id, kept, total, plan, kept_bytes, total_bytes): what the standing viewports read of two stored layouts, by footer statistics. Tests hold the kept groups against the rows."""
    cols = grid_cols(spark, sf_dir)
    far = (E0 - PITCH, N0 - PITCH, E0 + (cols + 1) * PITCH, N0 + (cols + 1) * PITCH)
    views = spark.createDataFrame([(name, *(box or far)) for name, box in viewports(cols).items()], "view_id string, xmin double, ymin double, xmax double, ymax double")
    out = None
    for order in ("source-identity", "hilbert16"):
        groups = row_group_bounds(spark, stored(spark, sf_dir, order, 1024).path)
        numbered = groups.select(F.xxhash64("file", "row_group").alias("id"), *(F.col(f"g_{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "bytes")
        read = bbox_join(numbered, views, far).join(numbered.select("id", "bytes"), "id").groupBy("view_id").agg(F.sum("bytes").alias("kept_bytes"))
        total = groups.agg(F.sum("bytes")).first()[0]
        found = group_selection(groups, views).join(read, "view_id", "left").select(F.lit(order).alias("layout"), "*", F.lit(total).alias("total_bytes"))
        out = found if out is None else out.unionByName(found)
    return out


@query("read_volume_measured")
def read_volume_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view_id, control, candidate, ratio, verdict): the gates fed by bytes measured in the stored files, identity order against the curve. Tests hold the bytes against the footers."""
    measured = pruned_viewports(spark, sf_dir).select("view_id", F.when(F.col("layout") == "hilbert16", "candidate").otherwise("control").alias("layout"), F.coalesce("kept_bytes", F.lit(0)).alias("read_bytes"))
    return ratio_gates(measured, F.when(F.col("view_id") == "whole", 1.005).otherwise(0.70))
