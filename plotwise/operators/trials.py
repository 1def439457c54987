"""Statistics of measurement trials. A cell is a group of repeated trials, and small; there may be any number of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plotwise.functions.java import java_function
from plotwise.storage import stored_bytes

#: Two-sided 97.5th percentiles of Student's t for n = 3 to 26 values; beyond, there is no interval.
T_QUANTILES = (4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.16, 2.145, 2.131, 2.12, 2.11, 2.101, 2.093, 2.086, 2.08, 2.074, 2.069, 2.064, 2.06)


def nearest_rank(value: str, p: float) -> Column:
    """The nearest-rank percentile of a column: an observed value, never one between two."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def cell_summary(trials: DataFrame, cell: str, value: str) -> DataFrame:
    return trials.groupBy(cell).agg(
        F.count("*").alias("n"),
        F.min(value).alias("min"),
        nearest_rank(value, 0.5).alias("p50"),
        nearest_rank(value, 0.95).alias("p95"),
        F.max(value).alias("max"),
        F.sort_array(F.collect_list(value)).alias("samples"),
    )


def admissible_cells(trials: DataFrame, least: int, row_counts: int = 1, cell: str = "cell") -> DataFrame:
    """(cell, n, reasons): an empty list admits the cell. trials: cell, error, n_rows, plan."""
    facts = trials.groupBy(cell).agg(F.count("*").alias("n"), F.count_if("error").alias("errors"), F.count_distinct("n_rows").alias("kinds"), F.count_distinct("plan").alias("plans"))
    reasons = F.array(
        F.when(F.col("errors") > 0, "errored-trials"),
        F.when(F.col("n") < least, "wrong-n"),
        F.when(F.col("kinds") > row_counts, "row-count-varies"),
        F.when(F.col("plans") > 1, "plan-varies"),
    )
    return facts.select(cell, "n", F.array_compact(reasons).alias("reasons"))


def admission_of_cells(trials: DataFrame, declared: DataFrame) -> DataFrame:
    """(cell, n, reasons): n counts the trials without an error, which all other reasons are about; an empty list admits the cell.

    trials: cell, error, n_rows, digest, plan, cut_policy (a null is a value of its own); declared: cell, want_n, want_rows (null: not predicted), want_cut.
    A cell without a declaration is judged by its trials alone, one without trials has that reason. What may vary is compared by its least and greatest
    value, so sums of a cell are small; whether a wanted value is among them is asked of the distinct values."""
    ok = ~F.coalesce("error", F.lit(False))

    def varies(name: str) -> Column:
        x = F.when(ok, F.col(name))
        some = F.count(x)
        return ((F.min(x) < F.max(x)) | ((some > 0) & (some < F.count_if(ok)))).alias(f"{name}_varies")

    facts = trials.groupBy("cell").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), *map(varies, ("n_rows", "digest", "plan", "cut_policy")))
    wanted = declared.select(F.col("cell").alias("_cell"), "want_n", "want_rows", "want_cut")

    def met(name: str, want: str) -> DataFrame:
        held = trials.where(ok).select("cell", name).distinct()
        return held.join(wanted, F.col("cell").eqNullSafe(F.col("_cell")) & (F.col(name) == F.col(want))).select(F.col("cell").alias("_met"), F.lit(True).alias(f"has_{want}"))

    judged = facts.withColumn("_tried", F.lit(True)).join(wanted, F.col("cell").eqNullSafe(F.col("_cell")), "full_outer").withColumn("cell", F.coalesce("cell", "_cell"))
    for name, want in (("n_rows", "want_rows"), ("cut_policy", "want_cut")):
        judged = judged.join(met(name, want), F.col("cell").eqNullSafe(F.col("_met")), "left").drop("_met")
    some = F.coalesce("n", F.lit(0)) > 0
    reasons = F.array(
        F.when(F.col("_tried").isNull(), "no-trial"),
        F.when(F.col("errors") > 0, "errored-trials"),
        F.when((F.col("n") == 0), "no-successful-trial"),
        F.when(some & (F.col("n") != F.col("want_n")), "wrong-n"),
        F.when(some & F.col("n_rows_varies"), "row-count-varies"),
        F.when(some & F.col("want_rows").isNotNull() & F.col("has_want_rows").isNull(), "row-count-unpredicted"),
        F.when(some & F.col("digest_varies"), "digest-varies"),
        F.when(some & F.col("plan_varies"), "plan-varies"),
        F.when(some & F.col("cut_policy_varies"), "cut-policy-varies"),
        F.when(some & F.col("want_cut").isNotNull() & F.col("has_want_cut").isNull(), "cut-policy-undeclared"),
    )
    return judged.select("cell", F.coalesce("n", F.lit(0)).alias("n"), F.array_compact(reasons).alias("reasons"))


def pairwise_wins(a: DataFrame, b: DataFrame, least: int = 7, of: int = 49, wins: int = 42) -> DataFrame:
    """(cell, n_a, n_b, wins, verdict) over (cell, x) of two candidates: pairs in which a is strictly less, and whether they make the gate's share.

    No pairs are made: both samples are sorted together by cell, and each b counts the a's below it."""
    both = a.select("cell", "x", F.lit(0).alias("side")).unionByName(b.select("cell", "x", F.lit(1).alias("side")))
    # equal values: b comes first (side descending), so an equal a isn't below it
    before = Window.partitionBy("cell").orderBy("x", F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(1 - F.col("side")).over(before), F.lit(0))
    ranked = both.withColumn("below", F.when(F.col("side") == 1, below).otherwise(F.lit(0)))
    half_a, half_b = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x) FILTER (WHERE side = 0)"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x) FILTER (WHERE side = 1)")
    sums = ranked.groupBy("cell").agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"), F.sum("below").alias("wins"), half_a.alias("p50_a"), half_b.alias("p50_b"))
    verdict = (
        F.when((F.col("n_a") < least) | (F.col("n_b") < least), "unmeasured")
        .when((F.col("p50_a") < F.col("p50_b")) & (of * F.col("wins") >= wins * F.col("n_a") * F.col("n_b")), "wins")
        .otherwise("no-win")
    )
    return sums.select("cell", "n_a", "n_b", "wins", verdict.alias("verdict"))


def ratio_gates(volumes: DataFrame, gate: Column) -> DataFrame:
    """(view_id, control, candidate, ratio, verdict) of bytes read by layout."""
    sums = volumes.groupBy("view_id").pivot("layout", ["control", "candidate"]).agg(F.sum("read_bytes"))
    ratio = F.col("candidate") / F.col("control")
    return sums.select("view_id", "control", "candidate", ratio.alias("ratio"), F.when(ratio.isNull(), "unmeasured").when(ratio <= gate, "pass").otherwise("fail").alias("verdict"))


def span_share(trials: DataFrame, cell: str, part: str, whole: str, flag: float = 0.4) -> DataFrame:
    """Median of the trials' shares, and share of the medians; they differ, and the first decides."""
    shared = trials.withColumn("_share", F.col(part) / F.col(whole))
    found = shared.groupBy(cell).agg(nearest_rank("_share", 0.5).alias("p50_of_shares"), (nearest_rank(part, 0.5) / nearest_rank(whole, 0.5)).alias("share_of_p50s"))
    return found.withColumn("dominant", F.col("p50_of_shares") >= flag)


def _pairs(runs: DataFrame) -> DataFrame:
    """(block, pair, a, b) of complete pairs with both candidates."""
    pair = F.floor(F.col("position") / 2).alias("pair")
    sides = [F.max(F.when(F.col("candidate") == c.upper(), F.col("rate"))).alias(c) for c in ("a", "b")]
    return runs.groupBy("block", pair).agg(*sides).where("a IS NOT NULL AND b IS NOT NULL")


def paired_effect(runs: DataFrame, band: float = 0.1) -> DataFrame:
    """(block, n, theta, ci_lo, ci_hi, drift, branch): the mean of 2(b - a)/(a + b) over pairs, its Student interval, and which side of the band it falls."""
    theta, mean = 2 * (F.col("b") - F.col("a")) / (F.col("a") + F.col("b")), (F.col("a") + F.col("b")) / 2
    sums = _pairs(runs).groupBy("block").agg(F.count("*").alias("n"), F.avg(theta).alias("theta"), F.stddev_samp(theta).alias("sd"), ((F.max(mean) - F.min(mean)) / F.avg(mean)).alias("drift"))
    t = F.get(F.array(*map(F.lit, T_QUANTILES)), (F.col("n") - 3).cast("int"))
    half = t * F.col("sd") / F.sqrt("n")
    found = sums.select("block", "n", "theta", (F.col("theta") - half).alias("ci_lo"), (F.col("theta") + half).alias("ci_hi"), "drift")
    branch = (
        F.when(F.col("ci_lo").isNull(), "inconclusive")
        .when(F.col("ci_lo") > band, "B-wins")
        .when(F.col("ci_hi") < -band, "A-wins")
        .when((F.col("ci_lo") >= -band) & (F.col("ci_hi") <= band), "equivalent")
        .otherwise("inconclusive")
    )
    return found.withColumn("branch", branch)


#: Draws that a task of a large block makes; the most slices of a block's resamples; and bytes read times resamples that a task stands for.
_DRAWS, _SLICES, _TASK_WORK = 1 << 18, 256, 1 << 31


def bootstrap_interval(runs: DataFrame, resamples: int = 10_000, least: int = 2) -> DataFrame:
    """(block, ci_lo, ci_hi): percentile bootstrap of the mean effect. Draws are hashes of (block, resample, draw), so they can be repeated anywhere.

    A block's effects travel as one small array.  No row is made for a draw or a resample: a task makes the draws of a block, by a Java UDF as a call of
    hashlib a draw takes several times longer, and gives its two ends; the resamples of a large block are dealt to several tasks, and their means meet
    again.  Tasks follow the bytes read and the resamples."""
    spark = runs.sparkSession
    resampled_means = java_function(spark, "plotwise.ResampledMeans", ArrayType(DoubleType()))
    theta = 2 * (F.col("b") - F.col("a")) / (F.col("a") + F.col("b"))
    xs = F.transform(F.sort_array(F.collect_list(F.struct("pair", theta.alias("x")))), lambda s: s["x"].cast("double"))
    blocks = _pairs(runs).groupBy("block").agg(xs.alias("xs")).where(F.size("xs") >= max(1, least))
    step = F.greatest(F.lit(-(-resamples // _SLICES)), F.lit(_DRAWS) / F.size("xs")).cast("int")
    name = F.coalesce(F.concat(F.col("block").cast("string"), F.lit(":")), F.lit(""))
    sliced = blocks.select("block", name.alias("name"), "xs", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), step)).alias("first"))
    dealt = sliced.select("block", "name", "xs", "first", F.least("step", resamples - F.col("first")).alias("n_resamples"))
    tasks = max(spark.sparkContext.defaultParallelism, stored_bytes(runs) * resamples // _TASK_WORK)
    ends, whole = (int(0.025 * resamples), int(0.975 * resamples)), F.col("n_resamples") == resamples
    means = dealt.repartition(tasks, "block", "first").select("block", whole.alias("whole"), resampled_means("name", "xs", "first", "n_resamples", F.when(whole, F.lit([*ends]))).alias("ms"))
    ordered = means.groupBy("block").agg(F.first("whole").alias("whole"), F.sort_array(F.flatten(F.collect_list("ms"))).alias("ms"))
    lo, hi = (F.get("ms", F.when(F.col("whole"), k).otherwise(end)).alias(c) for k, (end, c) in enumerate(zip(ends, ("ci_lo", "ci_hi"), strict=True)))
    return ordered.select("block", lo, hi)


def order_effect(runs: DataFrame) -> DataFrame:
    """(block, half_gap, interaction): late minus early mean rate, and how much the candidates' difference changes between the halves."""
    n = runs.groupBy("block").agg(F.count("*").alias("n"))
    early = F.col("position") * 2 < F.col("n")

    def mean(when: Column) -> Column:
        return F.avg(F.when(when, F.col("rate")))

    a, b = F.col("candidate") == "A", F.col("candidate") == "B"
    return runs.join(n, "block").groupBy("block").agg(
        (mean(~early) - mean(early)).alias("half_gap"), ((mean(~early & b) - mean(~early & a)) - (mean(early & b) - mean(early & a))).alias("interaction")
    )


def phase_spread(points: DataFrame, run: str, order: Sequence[str], value: str, within: float = 0.1) -> DataFrame:
    """Each point after its run's first, with its distance from the one before as a share of the lesser of the two."""
    before = F.lag(value).over(Window.partitionBy(run).orderBy(*order))
    spread = F.abs(F.col(value) - F.col("_before")) / F.nullif(F.least(value, "_before"), F.lit(0))
    found = points.withColumn("_before", before).where("_before IS NOT NULL").withColumn("spread", spread).drop("_before")
    return found.withColumn("within", F.coalesce(F.col("spread") <= within, F.lit(False)))


def cadence(batches: DataFrame, stream: str, order: Sequence[str], clock: str, size: str) -> DataFrame:
    """Gaps between a stream's batches and throughput, by nearest rank."""
    gap = F.col(clock) - F.lag(clock).over(Window.partitionBy(stream).orderBy(*order))
    gaps = batches.withColumn("_gap", gap).where("_gap IS NOT NULL").withColumn("_rate", F.col(size) / F.nullif("_gap", F.lit(0)))
    return gaps.groupBy(stream).agg(
        F.count("*").alias("n"), nearest_rank("_gap", 0.5).alias("p50_gap"), nearest_rank("_gap", 0.95).alias("p95_gap"), F.max("_gap").alias("max_gap"), nearest_rank("_rate", 0.5).alias("p50_rate")
    )
