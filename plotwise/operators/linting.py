"""Spatial linting over a vertex table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwise.functions.geo_metadata import geo_fields
from plotwise.operators.spatial_joins import edges_in_cells, polygon_grids
from plotwise.sources.footers import footer_inventory

#: Vertices up to which a feature's segments need no grid to meet.
_FEW = 32


def lint(vertices: DataFrame) -> DataFrame:
    """(id, ring, issue, n): repeated consecutive vertices; rings of fewer than four vertices, or not closed, with their vertex counts.

    One sort by ring: neighbours come from a window over the ring, ends from an aggregate over the same partitioning."""
    w = Window.partitionBy("id", "ring").orderBy("pos")
    marked = vertices.withColumn("_again", (F.col("x") == F.lag("x").over(w)) & (F.col("y") == F.lag("y").over(w)))
    point = F.struct("x", "y")
    rings = marked.groupBy("id", "ring").agg(F.count_if("_again").alias("again"), F.count("*").alias("n"), F.min_by(point, "pos").alias("first"), F.max_by(point, "pos").alias("last"))

    def issue(when, name: str, n: str):
        return F.when(when, F.struct(F.lit(name).alias("issue"), F.col(n).alias("n")))

    issues = F.array_compact(
        F.array(
            issue(F.col("again") > 0, "duplicate-consecutive-vertex", "again"),
            issue(F.col("n") < 4, "ring-too-short", "n"),
            issue(~F.col("first").eqNullSafe(F.col("last")), "ring-unclosed", "n"),
        )
    )
    return rings.select("id", "ring", F.explode(issues).alias("i")).select("id", "ring", "i.*")


def ring_segments(vertices: DataFrame) -> DataFrame:
    """(id, ring, k, m, closed, x1, y1, x2, y2): the segments of each ring, numbered from 0, m in all; those without length are left out."""
    by = Window.partitionBy("id", "ring")
    following = vertices.select("id", "ring", "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(by.orderBy("pos")).alias("x2"), F.lead("y").over(by.orderBy("pos")).alias("y2"))
    long = following.where("x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)").withColumn("k", F.row_number().over(by.orderBy("pos")) - 1)
    whole = by.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closed = (F.first("x1").over(whole) == F.last("x2").over(whole)) & (F.first("y1").over(whole) == F.last("y2").over(whole))
    return long.select("id", "ring", "k", F.count("*").over(whole).alias("m"), closed.alias("closed"), "x1", "y1", "x2", "y2")


def _turn(a: str, b: str, c: str) -> Column:
    """On which side of a to b the point c lies: 1, -1, or 0 on the line. Exact where the products of the coordinates' differences are."""

    def d(p: str, q: str, axis: str) -> Column:
        return F.col(axis + q) - F.col(axis + p)

    return F.signum(d(a, b, "x") * d(a, c, "y") - d(a, b, "y") * d(a, c, "x"))


def _on(a: str, b: str, c: str) -> Column:
    """Whether c, which lies on the line, is between a and b."""
    return (F.col("x" + c).between(F.least("x" + a, "x" + b), F.greatest("x" + a, "x" + b))) & (F.col("y" + c).between(F.least("y" + a, "y" + b), F.greatest("y" + a, "y" + b)))


def lint_crossings(vertices: DataFrame) -> DataFrame:
    """(id, ring, issue, n): pairs of segments of a feature that meet where they shouldn't, by the lesser of their rings.

    ring-self-crossing and rings-cross: the insides of two segments have one point in common.  ring-self-touch and rings-touch: an end of one lies on the
    other; neighbours in a ring share an end anyway.  ring-spike: neighbours that lie on one another.  Segments are put in the cells of their feature's
    own grid, as many as it has segments, and meet those of the same cells only; a ring inside another without touching it is no issue.  The few segments
    of a small feature meet as they are, where its vertices were dealt to, so they aren't shuffled again."""
    counted = vertices.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    own = ["id", "ring", "k", "m", "closed", "x1", "y1", "x2", "y2"]
    few = ring_segments(counted.where(F.col("_n") <= _FEW)).select(own)
    segments = ring_segments(counted.where(F.col("_n") > _FEW))
    cells = edges_in_cells(segments.join(polygon_grids(segments, flat=True), "id")).select(*own, "c", "r")
    return _crossings(few, ["id"]).unionByName(_crossings(cells, ["id", "c", "r"]).distinct()).groupBy("id", "ring", "issue").agg(F.count("*").alias("n"))  # a pair may meet in several cells


def _crossings(segments: DataFrame, meet: list[str]) -> DataFrame:
    """(id, ring, k, ring2, k2, issue) of the pairs of segments with the same `meet`."""
    other = segments.select(*meet, F.col("ring").alias("ring2"), F.col("k").alias("k2"), F.col("x1").alias("x3"), F.col("y1").alias("y3"), F.col("x2").alias("x4"), F.col("y2").alias("y4"))
    pairs = segments.join(other.hint("merge"), meet).where("ring < ring2 OR (ring = ring2 AND k < k2)")
    t3, t4, t1, t2 = _turn("1", "2", "3"), _turn("1", "2", "4"), _turn("3", "4", "1"), _turn("3", "4", "2")
    crosses = (t3 * t4 < 0) & (t1 * t2 < 0)
    ends = [(t3 == 0) & _on("1", "2", "3"), (t4 == 0) & _on("1", "2", "4"), (t1 == 0) & _on("3", "4", "1"), (t2 == 0) & _on("3", "4", "2")]
    touches = ends[0] | ends[1] | ends[2] | ends[3]
    same = F.col("ring") == F.col("ring2")
    after = same & (F.col("k2") == F.col("k") + 1)
    around = same & F.col("closed") & (F.col("k") == 0) & (F.col("k2") == F.col("m") - 1)
    back_after, back_around = ends[1] | ends[2], ends[0] | ends[3]  # beyond the shared end, one lies on the other
    issue = (
        F.when(after & around, F.when(ends[0] & ends[1], "ring-spike"))  # a ring of two segments
        .when(after, F.when(back_after & (t4 == 0) & (t1 == 0), "ring-spike"))
        .when(around, F.when(back_around & (t3 == 0) & (t2 == 0), "ring-spike"))
        .when(crosses, F.when(same, "ring-self-crossing").otherwise("rings-cross"))
        .when(touches, F.when(same, "ring-self-touch").otherwise("rings-touch"))
    )
    return pairs.select("id", "ring", "k", "ring2", "k2", issue.alias("issue")).where("issue IS NOT NULL")


def mixed_crs(spark: SparkSession, path: str) -> DataFrame:
    """(crs, files) of the Parquet files below a path, if they don't all declare the same; no row if they do. Null: none is declared."""
    crs = footer_inventory(spark, path).select(geo_fields(F.col("geo"))["crs_id"].alias("crs"))
    found = crs.groupBy("crs").agg(F.count("*").alias("files"))
    several = found.agg(F.count("*").alias("kinds"))
    return found.join(several).where("kinds > 1").select("crs", "files")
