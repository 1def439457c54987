"""Queries on measurement trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators.order_statistics import nearest_ranks, pair_wins
from plotwise.operators.trials import admissible_cells, admission_of_cells, bootstrap_interval, cadence, cell_summary, order_effect, paired_effect, pairwise_wins, phase_spread, ratio_gates, span_share
from plotwise.operators.sequences import consecutive_groups
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import table
from plotwise.storage import stored_bytes

_TRIALS_SQL = """tri AS (SELECT CAST(l_suppkey AS VARCHAR) || '|' || l_returnflag AS cell, l_quantity AS first_batch_ms, l_extendedprice AS total_ms, l_partkey AS read_bytes, l_linestatus AS plan, l_linenumber AS n_rows, l_orderkey AS run_id, l_suppkey, l_returnflag FROM lineitem)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial for each line item; a cell is a supplier and a return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", F.col("l_suppkey").cast("string"), "l_returnflag").alias("cell"),
        F.col("l_quantity").alias("first_batch_ms"),
        F.col("l_extendedprice").alias("total_ms"),
        F.col("l_partkey").alias("read_bytes"),
        F.col("l_linestatus").alias("plan"),
        F.col("l_linenumber").alias("n_rows"),
        F.col("l_orderkey").alias("run_id"),
        "l_suppkey",
        "l_returnflag",
    )


@query(
    "cell_summary",
    f"""WITH {_TRIALS_SQL} SELECT cell, count(*) AS n, min(total_ms) AS min, quantile_disc(total_ms, 0.5) AS p50, quantile_disc(total_ms, 0.95) AS p95, max(total_ms) AS max, list_sort(list(total_ms)) AS samples FROM tri GROUP BY cell""",
)
def cell_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_summary(trials(spark, sf_dir), "cell", "total_ms")


@query(
    "cell_admissibility",
    f"""WITH {_TRIALS_SQL}, c AS (SELECT cell, count(*) AS n, count(*) FILTER (run_id % 97 = 0)::BIGINT AS errors, count(DISTINCT n_rows) AS row_counts, count(DISTINCT plan) AS plans FROM tri GROUP BY cell)
    SELECT cell, n, list_filter([CASE WHEN errors > 0 THEN 'errored-trials' END, CASE WHEN n < 30 THEN 'wrong-n' END, CASE WHEN row_counts > 7 THEN 'row-count-varies' END, CASE WHEN plans > 1 THEN 'plan-varies' END], lambda x: x IS NOT NULL) AS reasons FROM c""",
)
def cell_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 30 trials, none in error, at most seven row counts, one plan."""
    return admissible_cells(trials(spark, sf_dir).withColumn("error", F.col("run_id") % 97 == 0), least=30, row_counts=7)


@query(
    "pairwise_wins",
    f"""WITH {_TRIALS_SQL}, a AS (SELECT l_suppkey AS cell, total_ms AS x FROM tri WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey AS cell, total_ms AS x FROM tri WHERE l_returnflag = 'R'),
    w AS (SELECT a.cell, count(*) AS pairs, count(*) FILTER (a.x < b.x) AS wins FROM a JOIN b ON a.cell = b.cell GROUP BY a.cell),
    m AS (SELECT l_suppkey AS cell, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'R') AS n_b, quantile_disc(total_ms, 0.5) FILTER (l_returnflag = 'A') AS p50_a, quantile_disc(total_ms, 0.5) FILTER (l_returnflag = 'R') AS p50_b FROM tri WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
    SELECT m.cell, n_a, n_b, coalesce(wins, 0) AS wins, CASE WHEN n_a < 7 OR n_b < 7 THEN 'unmeasured' WHEN p50_a < p50_b AND 49 * coalesce(wins, 0) >= 42 * n_a * n_b THEN 'wins' ELSE 'no-win' END AS verdict FROM m LEFT JOIN w ON m.cell = w.cell""",
)
def pairwise_wins_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    a = t.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("cell"), F.col("total_ms").alias("x"))
    b = t.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("cell"), F.col("total_ms").alias("x"))
    return pairwise_wins(a, b)


@query("cell_order_statistics", f"WITH {_TRIALS_SQL} SELECT l_returnflag, count(*) AS n, min(total_ms) AS min, max(total_ms) AS max, quantile_disc(total_ms, 0.5) AS p50, quantile_disc(total_ms, 0.95) AS p95 FROM tri GROUP BY ALL")
def cell_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cells of about a third of all trials each."""
    return nearest_ranks(trials(spark, sf_dir), "l_returnflag", "total_ms", {"p50": 0.5, "p95": 0.95})


@query(
    "pairwise_wins_large",
    f"""WITH {_TRIALS_SQL}, c AS (SELECT plan AS cell, total_ms AS x, count(*) FILTER (n_rows % 2 = 1) AS a, count(*) FILTER (n_rows % 2 = 0) AS b FROM tri GROUP BY ALL),
    w AS (SELECT cell, a, b, b * coalesce(sum(a) OVER (PARTITION BY cell ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM c),
    s AS (SELECT cell, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(won)::BIGINT AS wins FROM w GROUP BY cell),
    m AS (SELECT plan AS cell, quantile_disc(total_ms, 0.5) FILTER (n_rows % 2 = 1) AS p50_a, quantile_disc(total_ms, 0.5) FILTER (n_rows % 2 = 0) AS p50_b FROM tri GROUP BY ALL)
    SELECT s.cell, n_a, n_b, wins, CASE WHEN n_a < 7 OR n_b < 7 THEN 'unmeasured' WHEN p50_a < p50_b AND 49 * wins >= 42 * n_a * n_b THEN 'wins' ELSE 'no-win' END AS verdict FROM s JOIN m ON s.cell = m.cell""",
)
def pairwise_wins_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells with half of all trials each."""
    t = trials(spark, sf_dir)
    a, b = (t.where(F.col("n_rows") % 2 == k).select(F.col("plan").alias("cell"), F.col("total_ms").alias("x")) for k in (1, 0))
    return pair_wins(a, b).withColumn("wins", F.col("wins").cast("long"))


@query(
    "cell_admission",
    """WITH t AS (SELECT l_orderkey AS cell, l_partkey % 97 = 0 AS error, l_suppkey % 2 AS n_rows, l_linenumber // 4 AS digest, l_linestatus AS plan, CASE WHEN l_returnflag = 'N' THEN 'size-only' ELSE 'budgeted' END AS cut_policy FROM lineitem),
    d AS (SELECT o_orderkey AS cell, 1 + o_orderkey % 4 AS want_n, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 2 END AS want_rows, CASE WHEN o_orderkey % 2 = 0 THEN 'size-only' ELSE 'budgeted' END AS want_cut FROM orders),
    f AS (SELECT coalesce(t.cell, d.cell) AS cell, count(t.cell) AS tried, count(*) FILTER (error) AS errors, count(*) FILTER (NOT error) AS n, any_value(want_n) AS want_n, any_value(want_rows) AS want_rows, any_value(want_cut) AS want_cut,
      count(DISTINCT n_rows) FILTER (NOT error) AS row_kinds, count(DISTINCT digest) FILTER (NOT error) AS digests, count(DISTINCT plan) FILTER (NOT error) AS plans, count(DISTINCT cut_policy) FILTER (NOT error) AS cuts,
      count(*) FILTER (NOT error AND n_rows = want_rows) AS predicted, count(*) FILTER (NOT error AND cut_policy = want_cut) AS as_declared FROM t FULL JOIN d ON t.cell = d.cell GROUP BY 1)
    SELECT cell, n, list_filter([CASE WHEN tried = 0 THEN 'no-trial' END, CASE WHEN errors > 0 THEN 'errored-trials' END, CASE WHEN tried > 0 AND n = 0 THEN 'no-successful-trial' END, CASE WHEN n > 0 AND n <> want_n THEN 'wrong-n' END,
      CASE WHEN row_kinds > 1 THEN 'row-count-varies' END, CASE WHEN n > 0 AND want_rows IS NOT NULL AND predicted = 0 THEN 'row-count-unpredicted' END, CASE WHEN digests > 1 THEN 'digest-varies' END, CASE WHEN plans > 1 THEN 'plan-varies' END,
      CASE WHEN cuts > 1 THEN 'cut-policy-varies' END, CASE WHEN n > 0 AND want_cut IS NOT NULL AND as_declared = 0 THEN 'cut-policy-undeclared' END], lambda x: x IS NOT NULL) AS reasons FROM f""",
)
def cell_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items as a cell's trials, against what is declared of the order."""
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell"),
        (F.col("l_partkey") % 97 == 0).alias("error"),
        (F.col("l_suppkey") % 2).alias("n_rows"),
        F.expr("l_linenumber div 4").alias("digest"),
        F.col("l_linestatus").alias("plan"),
        F.when(F.col("l_returnflag") == "N", "size-only").otherwise("budgeted").alias("cut_policy"),
    )
    k = F.col("o_orderkey")
    wanted = table(spark, sf_dir, "orders").select(
        k.alias("cell"), (1 + k % 4).alias("want_n"), F.when(k % 3 > 0, F.col("o_custkey") % 2).alias("want_rows"), F.when(k % 2 == 0, "size-only").otherwise("budgeted").alias("want_cut")
    )
    return admission_of_cells(t, wanted)


@query(
    "read_volume_gates",
    f"""WITH {_TRIALS_SQL}, v AS (SELECT l_suppkey AS view_id, sum(read_bytes) FILTER (l_returnflag = 'N')::BIGINT AS control, sum(read_bytes) FILTER (l_returnflag = 'A')::BIGINT AS candidate FROM tri GROUP BY ALL)
    SELECT view_id, control, candidate, candidate / control AS ratio, CASE WHEN control IS NULL OR candidate IS NULL THEN 'unmeasured' WHEN candidate / control <= CASE WHEN view_id % 2 = 0 THEN 0.70 ELSE 1.005 END THEN 'pass' ELSE 'fail' END AS verdict FROM v""",
)
def read_volume_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes read by a layout as a share of the control's, against a gate for each kind of viewport."""
    t = trials(spark, sf_dir).select(F.col("l_suppkey").alias("view_id"), F.when(F.col("l_returnflag") == "N", "control").when(F.col("l_returnflag") == "A", "candidate").alias("layout"), "read_bytes")
    return ratio_gates(t, F.when(F.col("view_id") % 2 == 0, 0.70).otherwise(1.005))


@query(
    "span_share",
    f"""WITH {_TRIALS_SQL} SELECT cell, quantile_disc(first_batch_ms * 1000 / total_ms, 0.5) AS p50_of_shares, quantile_disc(first_batch_ms * 1000, 0.5) / quantile_disc(total_ms, 0.5) AS share_of_p50s,
    quantile_disc(first_batch_ms * 1000 / total_ms, 0.5) >= 0.4 AS dominant FROM tri GROUP BY cell""",
)
def span_share_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_share(trials(spark, sf_dir).withColumn("part_ms", F.col("first_batch_ms") * 1000), "cell", "part_ms", "total_ms")


_RUNS_SQL = """runs AS (SELECT o_custkey AS block, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_totalprice AS rate FROM orders),
cand AS (SELECT *, CASE WHEN (position + position // 2) % 2 = 0 THEN 'A' ELSE 'B' END AS candidate FROM runs),
th AS (SELECT block, position // 2 AS pair, max(rate) FILTER (candidate = 'A') AS a, max(rate) FILTER (candidate = 'B') AS b FROM cand GROUP BY ALL HAVING count(*) = 2)"""


#: Bytes of orders read that a task of runs stands for.
_RUN_BYTES = 4 << 20


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, position, candidate, rate): a customer's orders as alternating AB BA runs, dealt once by block to tasks that follow the bytes read."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, stored_bytes(orders) // _RUN_BYTES)
    dealt = orders.select(F.col("o_custkey").alias("block"), "o_orderkey", F.col("o_totalprice").alias("rate")).repartition(tasks, "block")
    position = F.row_number().over(Window.partitionBy("block").orderBy("o_orderkey")) - 1
    runs = dealt.select("block", position.alias("position"), "rate")
    return runs.withColumn("candidate", F.when((F.col("position") + F.floor(F.col("position") / 2)) % 2 == 0, "A").otherwise("B"))


_T = "4.303 3.182 2.776 2.571 2.447 2.365 2.306 2.262 2.228 2.201 2.179 2.16 2.145 2.131 2.12 2.11 2.101 2.093 2.086 2.08 2.074 2.069 2.064 2.06".split()


@query(
    "paired_effect",
    f"""WITH {_RUNS_SQL}, s AS (SELECT block, count(*) AS n, avg(2 * (b - a) / (a + b)) AS m, stddev_samp(2 * (b - a) / (a + b)) AS sd, max((a + b) / 2) AS hi, min((a + b) / 2) AS lo, avg((a + b) / 2) AS g FROM th GROUP BY block),
    t(n, t) AS (VALUES {", ".join(f"({k + 3}, {v})" for k, v in enumerate(_T))}), i AS (SELECT block, s.n, m, m - t * sd / sqrt(s.n) AS lo_ci, m + t * sd / sqrt(s.n) AS hi_ci, (hi - lo) / g AS drift FROM s LEFT JOIN t ON s.n = t.n)
    SELECT block, n, round(m, 6) AS theta, round(lo_ci, 6) AS ci_lo, round(hi_ci, 6) AS ci_hi, round(drift, 6) AS drift, CASE WHEN lo_ci IS NULL THEN 'inconclusive' WHEN lo_ci > 0.1 THEN 'B-wins' WHEN hi_ci < -0.1 THEN 'A-wins' WHEN lo_ci >= -0.1 AND hi_ci <= 0.1 THEN 'equivalent' ELSE 'inconclusive' END AS branch FROM i""",
)
def paired_effect_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paired_effect(paired_runs(spark, sf_dir))
    return found.select("block", "n", *(F.round(c, 6).alias(c) for c in ("theta", "ci_lo", "ci_hi", "drift")), "branch")


@query(
    "bootstrap_interval",
    f"""WITH {_RUNS_SQL}, x AS (SELECT block, list(2 * (b - a) / (a + b) ORDER BY pair) AS xs FROM th GROUP BY block HAVING count(*) >= 5),
    d AS (SELECT block, r, avg(xs[1 + (('0x' || substr(sha256(CAST(block AS VARCHAR) || ':' || CAST(r AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8))::BIGINT % len(xs))]) AS m
      FROM (SELECT block, xs, r, unnest(generate_series(1, len(xs))) AS j FROM (SELECT block, xs, unnest(generate_series(0, 199)) AS r FROM x)) GROUP BY block, r),
    o AS (SELECT block, list(m ORDER BY m) AS ms FROM d GROUP BY block) SELECT block, round(ms[6], 6) AS ci_lo, round(ms[196], 6) AS ci_hi FROM o""",
)
def bootstrap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bootstrap_interval(paired_runs(spark, sf_dir), resamples=200, least=5)
    return found.select("block", F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


@query("bootstrap_interval_full")
def bootstrap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own 10 000 resamples."""
    found = bootstrap_interval(paired_runs(spark, sf_dir), least=5)
    return found.select("block", F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


@query(
    "order_effect",
    f"""WITH {_RUNS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY block) AS n FROM cand), h AS (SELECT block, avg(rate) FILTER (position * 2 < n) AS early, avg(rate) FILTER (position * 2 >= n) AS late,
      avg(rate) FILTER (position * 2 < n AND candidate = 'A') AS ea, avg(rate) FILTER (position * 2 < n AND candidate = 'B') AS eb, avg(rate) FILTER (position * 2 >= n AND candidate = 'A') AS la, avg(rate) FILTER (position * 2 >= n AND candidate = 'B') AS lb FROM n GROUP BY block)
    SELECT block, round(late - early, 4) AS half_gap, round((lb - la) - (eb - ea), 4) AS interaction FROM h""",
)
def order_effect_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_effect(paired_runs(spark, sf_dir))
    return found.select("block", F.round("half_gap", 4).alias("half_gap"), F.round("interaction", 4).alias("interaction"))


@query(
    "phase_spread",
    """WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, abs(value - before) / nullif(least(value, before), 0) AS spread, coalesce(abs(value - before) / nullif(least(value, before), 0) <= 0.1, false) AS within FROM l WHERE before IS NOT NULL""",
)
def phase_spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase_spread(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "spread", "within")


@query(
    "batch_cadence",
    """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, value FROM events)
    SELECT user_id, count(*) AS n, quantile_disc(gap::DOUBLE, 0.5) AS p50_gap, quantile_disc(gap::DOUBLE, 0.95) AS p95_gap, max(gap) AS max_gap, quantile_disc(value / nullif(gap, 0), 0.5) AS p50_rate FROM g WHERE gap IS NOT NULL GROUP BY user_id""",
)
def batch_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return cadence(e, "user_id", ["ts", "event_id"], "micros", "value")


@query(
    "consecutive_groups",
    """WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS group_no FROM m) SELECT user_id, group_no::BIGINT AS group_no, event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY ALL""",
)
def consecutive_groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = consecutive_groups(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return grouped.groupBy("user_id", "group_no", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("trial_source", "SELECT CAST(l_suppkey AS VARCHAR) AS cell, count(*) AS n, sum(l_quantity) AS first_batch_ms, sum(l_partkey)::BIGINT AS read_bytes, min(l_linestatus) AS filter_plan FROM lineitem GROUP BY ALL")
def trial_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials written as JSON documents, a cell each, and read as artifacts."""
    from plotwise.storage import shared_folder
    from plotwise.sources.artifacts import read_trials

    trial = F.struct(F.col("l_linenumber").alias("rep"), F.col("l_quantity").alias("first_batch_ms"), F.col("l_partkey").alias("read_bytes"), F.struct(F.col("l_linestatus").alias("name")).alias("filter_plan"))
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("cell")).agg(F.collect_list(trial).alias("trials"))
    folder = shared_folder(spark, "trials")
    cells.write.json(folder)
    rows = read_trials(spark, folder, lines=True)
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("first_batch_ms").alias("first_batch_ms"), F.sum("read_bytes").alias("read_bytes"), F.min("filter_plan").alias("filter_plan"))
