"""Draws of resamples are made by a Java function, with the same results as hashlib in plain loops."""

import hashlib
import os
import shutil
import subprocess
import zipfile

import pyspark
import pytest

from plotwise.functions.java import JAR
from plotwise.operators.trials import bootstrap_interval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_draws_are_not_calls_of_python(spark):
    blocks = {"ä" * 40: 6, "x" * 55: 12, "y" * 70: 3, "": 11, None: 5}
    runs, theta = [], {}
    for k, (block, n) in enumerate(blocks.items()):
        for pair in range(n):
            a, b = 1.0 + (7 * pair + k) % 13, 1.0 + (5 * pair + k) % 11
            runs += [(block, 2 * pair, "A", a), (block, 2 * pair + 1, "B", b)]
            theta.setdefault(block, []).append(2 * (b - a) / (a + b))
    found = bootstrap_interval(spark.createDataFrame(runs, "block string, position int, candidate string, rate double"), resamples=1100, least=3)
    assert not any(word in plan(found) for word in ("Python", "MapInArrow", "Pandas"))
    rows = {r.block: (r.ci_lo, r.ci_hi) for r in found.collect()}
    assert rows.keys() == blocks.keys()
    for block, xs in theta.items():
        name = "" if block is None else f"{block}:"
        means = sorted(sum(xs[int(hashlib.sha256(f"{name}{r}:{j}".encode()).hexdigest()[:8], 16) % len(xs)] for j in range(1, len(xs) + 1)) / len(xs) for r in range(1100))
        assert all(abs(a - b) < 1e-9 for a, b in zip(rows[block], (means[27], means[1072]), strict=True))


def test_the_jar_is_made_of_its_sources(tmp_path):
    javac = shutil.which("javac")
    if not javac or " 17." not in subprocess.run([javac, "-version"], capture_output=True, text=True).stdout:
        pytest.skip("compiled by another javac, classes differ")
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    subprocess.run([javac, "--release", "17", "-cp", jars, "-d", tmp_path, *JAR.parent.glob("plotwise/*.java")], check=True)
    with zipfile.ZipFile(JAR) as jar:
        held = {name: jar.read(name) for name in jar.namelist() if name.endswith(".class")}
    assert held == {str(path.relative_to(tmp_path)): path.read_bytes() for path in tmp_path.rglob("*.class")} != {}
