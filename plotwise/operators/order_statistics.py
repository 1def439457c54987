"""Order statistics of cells of any size, exact: a cell with most of the rows is never gathered into one task.

A rank is sought between two bounds. A pass sketches the values between them (sketches merge, so they are summed before the shuffle), takes the sketch's
quantiles on both sides of the rank as cuts, and counts exactly what lies below, at, between and above the cuts; the part that holds the rank is sought in
next. It has at most some 1.2 % of the values, or a single one, so two or three passes reach a part that may be counted value by value.

Cases. Null values have no rank; a cell of nulls alone has null statistics. A null cell is a cell. Ties count each. NaN is greater than any number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwise.operators.sequences import placed
from plotwise.operators.trials import nearest_rank
from plotwise.storage import saved

#: Cells, and parts of a cell, of so many values at most are handled in one group.
MOST = 100_000
GRID, ACCURACY = 256, 10_000
#: Ranks sought of large cells are broadcast up to so many rows (five small values each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def _within(values: DataFrame, asks: DataFrame) -> DataFrame:
    """The values of asks' cells between their bounds, with the asks' columns."""
    asks = asks.withColumnRenamed("cell", "_cell")
    asks = F.broadcast(asks) if asks.count() <= BROADCAST_ROWS else asks
    return values.join(asks, F.col("cell").eqNullSafe(F.col("_cell")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("_cell")


def _narrowed(values: DataFrame, asks: DataFrame) -> DataFrame:
    """The asks with closer bounds: rank is then counted from the lower one, and held is the number of values between them."""
    quantiles = F.percentile_approx("v", [k / GRID for k in range(1, GRID)], ACCURACY)
    at = F.col("rank") / F.col("held") * GRID
    sketched = _within(values, asks).groupBy("cell", "name", "rank", "lo", "hi", "held").agg(quantiles.alias("q"))
    low, high = F.get("q", (F.floor(at) - 2).cast("int")), F.get("q", F.ceil(at).cast("int"))
    cuts = saved(sketched.select("cell", "name", "rank", "lo", "hi", F.coalesce(low, "lo").alias("a"), F.coalesce(high, "hi").alias("b")), "rank-cuts")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    part = F.when(v < a, 0).when(v == a, 1).when(v < b, 2).when(v == b, 3).otherwise(4)
    parts = _within(values, cuts).groupBy("cell", "name", "rank", part.alias("part")).agg(F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = F.sum("held").over(Window.partitionBy("cell", "name").orderBy("part")) - F.col("held")  # five rows a rank
    found = parts.withColumn("before", before).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("held")))
    return found.select("cell", "name", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", "held")


def _counted(values: DataFrame, asks: DataFrame) -> DataFrame:
    """(cell, name, v) of asks that hold few values."""
    counts = _within(values, asks).groupBy("cell", "name", "rank", "v").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(Window.partitionBy("cell", "name").orderBy("v"))
    return counts.withColumn("reached", reached).where(F.col("reached") >= F.col("rank")).groupBy("cell", "name").agg(F.min("v").alias("v"))


def select_ranks(values: DataFrame, asks: DataFrame, most: int = MOST) -> DataFrame:
    """(cell, name, v): the value at each rank. values: cell, v; asks: cell, name, rank (from 1, counted from lo), lo, hi, held."""
    found = []
    while True:
        single = F.col("lo") == F.col("hi")
        found.append(asks.where(single).select("cell", "name", F.col("lo").alias("v")))
        found.append(_counted(values, asks.where(~single & (F.col("held") <= most))))
        asks = asks.where(~single & (F.col("held") > most))
        if asks.isEmpty():
            return reduce(DataFrame.unionByName, found)
        asks = saved(_narrowed(values, asks), "ranks")


def nearest_ranks(rows: DataFrame, cell: str, value: str, shares: dict[str, float], most: int = MOST) -> DataFrame:
    """(cell, n, min, max, and a column for each share): nearest-rank percentiles, observed values. n counts all rows, nulls too.

    Cells of `most` values at most are grouped; only the larger ones, of which there are few, are searched by passes over the rows."""
    values = rows.select(F.col(cell).alias("cell"), F.col(value).alias("v"))
    facts = saved(values.groupBy("cell").agg(F.count("*").alias("n"), F.count("v").alias("k"), F.min("v").alias("min"), F.max("v").alias("max")), "cells")
    large = facts.where(F.col("k") > most)
    names = large.select(F.col("cell").alias("_cell"))
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    small = values.join(names, F.col("cell").eqNullSafe(F.col("_cell")), "left_anti").groupBy("cell").agg(*(nearest_rank("v", p).alias(name) for name, p in shares.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items())))
    rank = F.greatest(F.ceil(F.col("k") * F.col("s.p")).cast("long"), F.lit(1))
    asks = large.withColumn("s", each).select("cell", "s.name", rank.alias("rank"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("k").alias("held"))
    ranked = select_ranks(values, asks, most).groupBy("cell").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    found = small.unionByName(ranked).withColumnRenamed("cell", "_cell")
    return facts.join(found, F.col("cell").eqNullSafe(F.col("_cell"))).select(F.col("cell").alias(cell), "n", "min", "max", *shares)


def pair_wins(a: DataFrame, b: DataFrame, least: int = 7, of: int = 49, wins: int = 42, most: int = MOST) -> DataFrame:
    """(cell, n_a, n_b, wins, verdict) as `trials.pairwise_wins`, for cells of any size; nulls in x are left out.

    Equal values are counted first; a cell's values then lie in ranges, and a range's wins are its own and those over the a's of the ranges before,
    of which one row a range is known. Wins are decimals, as products may pass 64 bits."""
    both = a.select("cell", "x", F.lit(1).alias("a")).unionByName(b.select("cell", "x", F.lit(0).alias("a"))).where("x IS NOT NULL")
    values = placed(both.groupBy("cell", "x").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b")), ["cell", "x"])
    below = F.coalesce(F.sum("a").over(Window.partitionBy("_range", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def times(x: str, y: str):
        return F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(18,0)")

    ranges = values.withColumn("below", below).groupBy("_range", "cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(times("b", "below")).alias("inner"))
    before = F.coalesce(F.sum("a").over(Window.partitionBy("cell").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranges.withColumn("before", before).groupBy("cell").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(times("b", "before") + F.col("inner")).cast("decimal(38,0)").alias("wins"))
    halves = nearest_ranks(both.select(F.struct("cell", "a").alias("side"), "x"), "side", "x", {"p50": 0.5}, most)
    medians = halves.groupBy(F.col("side.cell").alias("_cell")).agg(*(F.max(F.when(F.col("side.a") == k, F.col("p50"))).alias(f"p50_{s}") for k, s in ((1, "a"), (0, "b"))))
    share = F.lit(of).cast("decimal(9,0)") * F.col("wins") >= F.lit(wins).cast("decimal(9,0)") * times("n_a", "n_b")
    verdict = F.when((F.col("n_a") < least) | (F.col("n_b") < least), "unmeasured").when((F.col("p50_a") < F.col("p50_b")) & share, "wins").otherwise("no-win")
    return won.join(medians, F.col("cell").eqNullSafe(F.col("_cell"))).select("cell", "n_a", "n_b", "wins", verdict.alias("verdict"))
