"""What the larger tables ask for: no pairs, no row a draw, no table through the driver, and tasks that follow the input."""

import hashlib
import random

from pyspark.sql import functions as F

from plotwise.functions.wkb import by_feature
from plotwise.operators.audit import match_grants
from plotwise.operators.cutting import Cut, CutPolicy
from plotwise.operators.linting import lint_crossings
from plotwise.operators.trials import bootstrap_interval, paired_effect
from plotwise.plans import catalog, metadata, publishing, trials


def orders(spark, path, ids):
    rows = [(k, k % 50, float(k % 977 + 1), "1-URGENT") for k in ids]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"file://{path}/orders.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def fat(spark, path, mb):
    """Rows with few columns in use, and a file of so many MB."""
    rows = spark.range(mb * 100).select("id", F.concat(*(F.unhex(F.sha2(F.concat_ws("/", F.col("id"), F.lit(k)).cast("binary"), 512)) for k in range(157))).alias("blob"))
    rows.write.parquet(f"file://{path}/fat.parquet")
    return spark.read.parquet(f"file://{path}/fat.parquet")


def test_features_are_not_broadcast(spark, tmp_path):
    d = orders(spark, tmp_path, range(700))
    facts = catalog.queries()["dataset_facts"](spark, d)
    assert "Broadcast" not in plan(facts) and "Broadcast" not in plan(publishing.shaped_features(spark, d))
    assert [(r.category, r.n_features) for r in facts.collect()] == [("1-URGENT", 700)]


def test_wide_ids_of_large_tables(spark, tmp_path):
    d = orders(spark, tmp_path, range(0, 9_000_000, 9_001))
    spark.createDataFrame([(k,) for k in range(1, 60_000, 500)], "s_suppkey long").write.parquet(f"file://{tmp_path}/supplier.parquet")
    shift = next(k for k in range(64) if 59_501 * (4 * 10**15 >> k) + (1 << 61) < 1 << 63)
    assert shift == 6
    ranges = [(k * (4 * 10**15 >> shift) + k % 97, k * (4 * 10**15 >> shift) + (1 << 61)) for k in range(1, 60_000, 500)]  # each is one of the wide
    lo, hi = min(a for a, _ in ranges) + 10**17, max(b for _, b in ranges)
    ids = [k * (3 * 10**13 >> shift) + k * 7919 % 1_000_003 for k in range(0, 9_000_000, 9_001)]
    found = sorted(r.id for r in catalog.queries()["id_range_wide"](spark, d).collect())
    assert found == sorted(i for i in ids if lo <= i <= hi) and 0 < len(found) < len(ids)


def test_grants_meet_attempts_without_pairs(spark):
    rng = random.Random(3)
    places = ["/out", "/out/a", "/out/b"]
    grants = [(k, rng.choice(["p", "q"]), "d", "h", rng.choice(["exact", "child"]), rng.choice(places), rng.choice([None, *range(0, 300, 7)]), rng.choice([None, -3, 0, 5, 60, 5000])) for k in range(400)]
    attempts = [(k, rng.choice(["p", "q", "r"]), rng.choice(["d", "e"]), "h", rng.choice([*places, "/out/a/x", "x"]), rng.choice([None, *range(-5, 1700)])) for k in range(900)]
    a = spark.createDataFrame(attempts, "attempt long, operation string, dataset string, content_hash string, destination string, now_s long")
    few = [g for g in grants if g[0] % 40 == 0]
    for some in (grants, few, [g for g in few if (g[7] or 0) <= 0 and g[6] is not None], grants[:1]):
        g = spark.createDataFrame(some, "grant_id long, operation string, dataset string, content_hash string, scope_kind string, scope string, granted_s long, lifetime_s long")
        expected = {}
        for k, operation, dataset, content, destination, now in attempts:
            met = []
            for i, o, d, h, kind, scope, granted, lifetime in some:
                if (o, d, h) == (operation, dataset, content) and scope == (destination if kind == "exact" else destination.rpartition("/")[0]):
                    met.append((max(0, now - granted if None not in (now, granted) else 0) - min(1200 if lifetime is None else lifetime, 1200), i))
            live = [i for over, i in met if over < 0]
            verdict = "no_grant" if operation not in {g[1] for g in some} else "grant_scope_mismatch" if not met else "granted" if live else "grant_expired"
            expected[k] = (verdict, min(live) if live else min(met)[1] if met else None)
        found = match_grants(a, g)
        assert {r.attempt: (r.verdict, r.grant_id) for r in found.collect()} == expected
        joins = [line for line in plan(found).splitlines() if "Join [" in line and "scope#" in line]
        assert all("_range#" in line for line in joins)


def test_resamples_of_small_and_large_blocks(spark):
    rng = random.Random(5)
    blocks = {None: 3, 1: 4, 2: 61, 3: 700}
    runs, theta = [], {}
    for block, n in blocks.items():
        for pair in range(n):
            a, b = rng.randint(1, 99) / 4, rng.randint(1, 99) / 4
            runs += [(block, 2 * pair, "A", a), (block, 2 * pair + 1, "B", b)]
            theta.setdefault(block, []).append(2 * (b - a) / (a + b))
    found = bootstrap_interval(spark.createDataFrame(runs, "block long, position int, candidate string, rate double"), resamples=1000, least=3)
    rows = {r.block: (r.ci_lo, r.ci_hi) for r in found.collect()}
    for block, xs in theta.items():
        name = "" if block is None else f"{block}:"
        means = sorted(sum(xs[int(hashlib.sha256(f"{name}{r}:{j}".encode()).hexdigest()[:8], 16) % len(xs)] for j in range(1, len(xs) + 1)) / len(xs) for r in range(1000))
        assert all(abs(a - b) < 1e-9 for a, b in zip(rows[block], (means[25], means[975]), strict=True))
    assert len(rows) == 4 and plan(found).count("Generate explode") == 1  # slices only: no row a resample or a draw


def test_runs_are_dealt_once_by_bytes(spark, tmp_path):
    rows = fat(spark, tmp_path, 48)
    rows.selectExpr("id AS o_orderkey", "id % 60 AS o_custkey", "1.0D + id % 89 AS o_totalprice", "blob").write.parquet(f"file://{tmp_path}/orders.parquet")
    runs = trials.paired_runs(spark, str(tmp_path))
    assert runs.rdd.getNumPartitions() >= 11
    assert plan(paired_effect(runs)).count("Exchange hashpartitioning") == 1  # pairs and blocks are made where the runs were dealt to
    found = bootstrap_interval(runs, resamples=40, least=3)
    assert plan(found).count("Exchange hashpartitioning") == 3  # runs, resamples, means
    expected = {}
    for block in range(60):
        rates, xs = [1.0 + k % 89 for k in range(block, 4800, 60)], []
        for k in range(0, len(rates), 2):
            a, b = rates[k : k + 2] if k // 2 % 2 == 0 else rates[k : k + 2][::-1]
            xs.append(2 * (b - a) / (a + b))
        means = sorted(sum(xs[int(hashlib.sha256(f"{block}:{r}:{j}".encode()).hexdigest()[:8], 16) % len(xs)] for j in range(1, len(xs) + 1)) / len(xs) for r in range(40))
        expected[block] = (means[1], means[39])
    rows = {r.block: (r.ci_lo, r.ci_hi) for r in found.collect()}
    assert rows.keys() == expected.keys() and all(abs(a - b) < 1e-9 for k in rows for a, b in zip(rows[k], expected[k], strict=True))


def test_ranges_and_tasks_follow_the_bytes(spark, tmp_path):
    rows = fat(spark, tmp_path, 40)
    sized = rows.select("id", F.lit(5).alias("verts"), F.lit(93).alias("wkb_len"), F.lit(9).alias("attr_bytes"), "blob")
    cut = Cut(sized.drop("blob"), CutPolicy(max_rows=300))
    assert cut.ranges >= 20
    assert [r.n for r in cut.rows().groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [300] * 13 + [100]
    vertices = rows.select("id", F.lit(0).alias("ring"), F.lit(0).alias("pos"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    assert by_feature(vertices).rdd.getNumPartitions() >= 10


def test_documents_of_one_file_are_many_tasks(spark, tmp_path):
    spark.range(64).selectExpr("id AS c_custkey", "'X' AS c_mktsegment").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    for documents in (metadata.geo_documents, publishing.style_documents):
        assert documents(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    styles = catalog.queries()["style_validation"](spark, str(tmp_path))
    assert styles._jdf.queryExecution().optimizedPlan().toString().count("style_version,IntegerType") == 1  # each document is parsed once


def test_segments_of_small_features_are_not_shuffled_again(spark, tmp_path):
    found = catalog.queries()["geometry_crossings"](spark, orders(spark, tmp_path, range(200)))
    assert {(r.id % 20, r.issue) for r in found.collect()} >= {(8, "ring-self-crossing")}
    dealt = [line for line in plan(found).splitlines() if " Exchange hashpartitioning(" in line or "- Exchange hashpartitioning(" in line]
    assert dealt and not any("c#" in line for line in dealt)
    star = [(1, 0, k % 40, 100.0 * (k % 40 * 17 % 40), float(k % 40 * k % 7)) for k in range(41)]
    small = [(2, r, p, x, y) for _, r, p, x, y in star[:20]] + [(2, 0, 20, star[0][3], star[0][4])]
    kinds = "id long, ring int, pos int, x double, y double"
    star = [(i, r, p if k < 40 else 40, x, y) for k, (i, r, p, x, y) in enumerate(star)]
    both = {r.id: 0 for r in lint_crossings(spark.createDataFrame(star + small, kinds)).collect()}
    assert set(both) == {1, 2}
