"""Order statistics of large cells, admission of cells, and edits over unchanged files, against plain loops."""

import hashlib
import math
import os
import pathlib
import random

import pytest
from conftest import DATA

from plotwise.operators.edits import create_edited, open_edited
from plotwise.operators.lake import overlay
from plotwise.operators.order_statistics import nearest_ranks, pair_wins
from plotwise.operators.trials import admission_of_cells
from plotwise.plans import catalog


def draws(shape, n, rng):
    return {"wide": [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(n)], "ties": [float(rng.randint(0, 3)) for _ in range(n)], "heavy": [7.0 if rng.random() < 0.97 else rng.random() for _ in range(n)], "one": [5.0] * n}[shape]


@pytest.mark.parametrize("shape", ["wide", "ties", "heavy", "one"])
def test_ranks_of_large_cells(spark, shape):
    rng = random.Random(shape)
    cells = {"a": draws(shape, 9000, rng), "b": draws(shape, 37, rng), None: draws(shape, 1200, rng), "n": [None] * 3, "c": [*draws(shape, 400, rng), None]}
    rows = spark.createDataFrame([(c, v) for c, vs in cells.items() for v in vs], "cell string, v double").repartition(5)
    shares = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r["cell"]: r for r in nearest_ranks(rows, "cell", "v", shares, most=50).collect()}
    assert set(found) == set(cells)
    for cell, vs in cells.items():
        real, row = sorted(v for v in vs if v is not None), found[cell]
        assert row["n"] == len(vs)
        for name, p in shares.items():
            assert row[name] == (real[max(math.ceil(len(real) * p), 1) - 1] if real else None), (cell, name)


def test_ranks_of_no_rows(spark):
    assert nearest_ranks(spark.createDataFrame([], "cell string, v double"), "cell", "v", {"p50": 0.5}).collect() == []


@pytest.mark.parametrize("most", [20, 100_000])
def test_wins_over_ranges(spark, most):
    rng = random.Random(most)
    sides = {c: ([rng.randint(0, 40 * n) for _ in range(n)], [rng.randint(0, 50 * n) + shift for _ in range(n + 5)]) for c, n, shift in (("x", 300, 0), ("y", 8, 900), ("z", 3, 0), (None, 60, 5000))}
    a, b = (spark.createDataFrame([(c, float(v)) for c, s in sides.items() for v in [*s[k], *s[k][:2]]] + [("x", None)], "cell string, x double") for k in (0, 1))
    found = {r["cell"]: (r["n_a"], r["n_b"], int(r["wins"]), r["verdict"]) for r in pair_wins(a, b, most=most).collect()}
    for cell, (xs, ys) in sides.items():
        xs, ys = [*xs, *xs[:2]], [*ys, *ys[:2]]
        wins = sum(x < y for x in xs for y in ys)
        p50 = [sorted(s)[math.ceil(len(s) / 2) - 1] for s in (xs, ys)]
        verdict = "unmeasured" if min(len(xs), len(ys)) < 7 else "wins" if p50[0] < p50[1] and 49 * wins >= 42 * len(xs) * len(ys) else "no-win"
        assert found[cell] == (len(xs), len(ys), wins, verdict)


def test_admission_names_every_reason(spark):
    good = (False, 10, "d", "p", "size-only")
    cells = {
        "fine": [good] * 3,
        "failed": [(True, None, None, None, None)] * 3,
        "one-error": [good] * 3 + [(True, 9, "e", "q", "budgeted")],
        "short": [good] * 2,
        "rows": [good] * 2 + [(False, 11, "d", "p", "size-only")],
        "unpredicted": [(False, 12, "d", "p", "size-only")] * 3,
        "digest": [good] * 2 + [(False, 10, None, "p", "size-only")],
        "plan": [good] * 2 + [(False, 10, "d", "q", "size-only")],
        "cut": [good] * 2 + [(False, 10, "d", "p", "budgeted")],
        "other-cut": [(False, 10, "d", "p", "budgeted")] * 3,
        "undeclared": [(False, 99, "d", "p", "any")],
    }
    trials = spark.createDataFrame([(c, *t) for c, ts in cells.items() for t in ts], "cell string, error boolean, n_rows long, digest string, plan string, cut_policy string")
    declared = spark.createDataFrame([(c, 3, 10, "size-only") for c in cells if c != "undeclared"] + [("unseen", 3, 10, "size-only")], "cell string, want_n int, want_rows long, want_cut string")
    found = {r["cell"]: (r["n"], r["reasons"]) for r in admission_of_cells(trials, declared).collect()}
    assert found == {
        "fine": (3, []),
        "failed": (0, ["errored-trials", "no-successful-trial"]),
        "one-error": (3, ["errored-trials"]),
        "short": (2, ["wrong-n"]),
        "rows": (3, ["row-count-varies"]),
        "unpredicted": (3, ["row-count-unpredicted"]),
        "digest": (3, ["digest-varies"]),
        "plan": (3, ["plan-varies"]),
        "cut": (3, ["cut-policy-varies"]),
        "other-cut": (3, ["cut-policy-undeclared"]),
        "undeclared": (1, []),
        "unseen": (0, ["no-trial"]),
    }


def seen(table):
    return sorted((r["id"], r["zone"], r["value"]) for r in table.collect())


def test_edits_leave_files_as_they_are(spark, tmp_path):
    rng = random.Random(4)
    base = spark.range(70_000).selectExpr("id", "concat('z', id % 7) AS zone", "id / 2.0D AS value")
    base.repartition(2).write.parquet(f"{tmp_path}/base")
    before = {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(tmp_path, "base").rglob("*.parquet")}
    table, want = create_edited(spark, f"file://{tmp_path}/base", f"file://{tmp_path}/table"), base
    for step in range(5):
        rows = [(rng.choice([rng.randrange(70_000), rng.randrange(40), 70_000 + rng.randrange(30)]), f"e{step}", float(k), rng.choice([k, 1, None]), rng.choice([True, False, None])) for k in range(300)]
        deltas = spark.createDataFrame(rows, "id long, zone string, value double, version long, deleted boolean")
        table, want = table.edit(deltas), overlay(want, deltas)
        want = spark.createDataFrame(want.collect(), base.schema)
    assert seen(table.rows()) == seen(want)
    smaller = table.compact(fan=2)
    assert seen(smaller.rows()) == seen(want) and len(smaller.data) < len(table.data) and len(smaller.gone) == 1
    assert seen(open_edited(spark, f"file://{tmp_path}/table").rows()) == seen(want)
    assert seen(open_edited(spark, f"file://{tmp_path}/table", 0).rows()) == seen(base)
    assert before == {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(tmp_path, "base").rglob("*.parquet")}
    nothing = spark.createDataFrame([], "id long, zone string, value double, version long, deleted boolean")
    assert seen(smaller.edit(nothing).rows()) == seen(want)
    with pytest.raises(FileExistsError):
        smaller.edit(nothing)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_gates_are_fed_by_measured_bytes(spark):
    found = {r["view_id"]: r for r in catalog.queries()["read_volume_measured"](spark, DATA).collect()}
    measured = {(r["layout"], r["view_id"]): r["kept_bytes"] or 0 for r in catalog.queries()["pruned_viewports"](spark, DATA).collect()}
    assert len(found) == 4
    for view, row in found.items():
        assert (row["control"], row["candidate"]) == (measured["source-identity", view], measured["hilbert16", view]) and row["control"] > 0
        assert row["verdict"] == ("pass" if row["candidate"] / row["control"] <= (1.005 if view == "whole" else 0.7) else "fail")
