"""Line numbers of files that many tasks read, rules with a limit, edits with odd values."""

import random

import pytest

from plotwise.operators.lake import overlay
from plotwise.operators.style import resolve
from plotwise.sources.audit import numbered_lines, read_audit


def test_lines_of_large_files_are_numbered(spark, tmp_path):
    rnd = random.Random(1)
    expected = []
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        lines = [rnd.choice(("", "x" * rnd.randrange(300), "é" * rnd.randrange(50), "carriage\rinside")) for _ in range(rnd.choice((1, 7000, 9000)))] + ["end"]
        ends = [rnd.choice(("\n", "\r\n")) for _ in lines[:-1]] + [rnd.choice(("", "\n"))]
        (tmp_path / name).write_bytes("".join(a + b for a, b in zip(lines, ends, strict=True)).encode())
        expected += [(name, k, line) for k, line in enumerate(lines, 1)]
    (tmp_path / "empty.jsonl").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        found = numbered_lines(spark, f"file://{tmp_path}")
        assert found.rdd.getNumPartitions() > 20 or found.select("value").distinct().count() > 1
        assert sorted((r.file.rpartition("/")[2], r.line_no, r.value) for r in found.collect()) == sorted(expected)
        broken = [r.line_no for r in read_audit(spark, f"file://{tmp_path}/a.jsonl").where("corrupt_reason = 'not-json'").collect()]
        assert sorted(broken) == [k for name, k, line in expected if name == "a.jsonl" and line.strip()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rules_beyond_the_limit_are_refused(spark):
    features = spark.createDataFrame([(1, "a"), (2, None), (3, "k63"), (4, "z")], "id long, zone string")

    def rules(names):
        return spark.createDataFrame([(n, f"#{n}") for n in names], "when string, then string")

    got = resolve(features, "zone", rules(["a"] + [f"k{k}" for k in range(1, 64)]), "null", "other", "fill")
    assert {r.id: r.fill for r in got.collect()} == {1: "#a", 2: "null", 3: "#k63", 4: "other"}
    with pytest.raises(ValueError, match="too-many-cases"):
        resolve(features, "zone", rules([f"k{k}" for k in range(65)]), "null", "other", "fill")
    with pytest.raises(ValueError, match="duplicate-case"):
        resolve(features, "zone", rules(["a", "a"]), "null", "other", "fill")


def test_edits_with_null_and_equal_versions(spark):
    base = spark.createDataFrame([(k, "old") for k in range(8)], "id long, zone string")
    edits = [(1, "new", 1, None), (2, "new", 1, True), (2, "newer", 2, False), (3, "x", 5, False), (3, "x", 5, True), (4, "p", 1, False), (4, "q", 1, False), (5, "y", None, False), (5, "z", 0, False), (9, "added", 1, None)]
    deltas = spark.createDataFrame(edits, "id long, zone string, version long, deleted boolean")
    for frame in (deltas, deltas.orderBy("zone").repartition(3)):
        found = {r.id: r.zone for r in overlay(base, frame).collect()}
        assert found.pop(4) in ("p", "q")
        assert found == {0: "old", 1: "new", 2: "newer", 5: "z", 6: "old", 7: "old", 9: "added"}
    assert overlay(base, deltas).where("id = 4").collect() == overlay(base, deltas.repartition(5)).where("id = 4").collect()


def test_attribute_files(spark, tmp_path):
    from plotwise.sources.attributes import read_attributes

    (tmp_path / "a.csv").write_text('k,name,size\n1,"a ""b"", c",2.5\n2,,\nx,bad key,1\n3,short\n4,long,1,2\n5,bad size,wide\n1,again,0\n')
    rows, broken = read_attributes(spark, f"file://{tmp_path}/a.csv", "k long, name string, size double")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, 'a "b", c', 2.5), (2, None, None), (1, "again", 0.0)], key=str)
    assert sorted(r["_broken"] for r in broken.collect()) == ["3,short", "4,long,1,2", "5,bad size,wide", "x,bad key,1"]
    assert rows.select("k").count() == 3 and broken.groupBy("name").count().count() == 4
    with pytest.raises(Exception, match="(?i)header"):
        read_attributes(spark, f"file://{tmp_path}/a.csv", "k long, size double, name string")[0].collect()
