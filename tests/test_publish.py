"""Publishing: the cut as a prefix scan, what is refused, and the sink's commit."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotwise.operators import cutting
from plotwise.operators.cutting import CutPolicy
from plotwise.operators.publish import PublishRefused, file_hashes, publish, verify_bundle
from plotwise.sources.bundle import BundleWriter, Written


def boxed(df):
    box = F.struct(*(F.coalesce(F.col("id"), F.lit(0)).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    return df.select("id", box.alias("bbox"), F.lit("x").alias("zone"), F.lit(5).alias("verts"), F.lit(93).alias("wkb_len"))


def one_scan(rows, policy):
    """(id, part, why) of the sequential rule, row by row."""
    out, why, part, v, r, a = [], {}, 0, 0, 0, 0
    for k, verts, wkb, attr in rows:
        if r and 20 * v + 12 * r + a + 20 * (wkb // 16) + 12 + attr > policy.target_bytes:
            why[part] = "size-target"
            part, v, r, a = part + 1, 0, 0, 0
        out.append((k, part))
        v, r, a = v + verts, r + 1, a + attr
        size = 20 * v + 12 * r + a
        if size >= policy.target_bytes or r >= policy.max_rows:
            why[part] = "size-target" if size >= policy.target_bytes else "row-ceiling"
            part, v, r, a = part + 1, 0, 0, 0
    return [(k, p, why.get(p, "stream-end")) for k, p in out]


def in_memory_cut(rows, policy, cuts):
    """The tasks of the tree, called one after another."""
    tables, lo = [], 0
    for number, hi in enumerate([*cuts, len(rows)]):
        if hi > lo:
            own = rows[lo:hi]
            columns = {c: pa.array([r[k] for r in own], pa.int64()) for k, c in enumerate(("id", "verts", "wkb_len", "attr_bytes"))}
            tables.append(pa.table({**columns, "_range": pa.array([number] * len(own)), "_place": pa.array(range(len(own)))}))
        lo = hi
    levels = [pa.concat_tables([cutting._told(policy)(t) for t in tables])]
    while levels[-1].num_rows > 1 or levels[-1].column("node")[0].as_py():
        groups = {}
        for k, node in enumerate(levels[-1].column("node").to_pylist()):
            groups.setdefault(node // cutting.FAN, []).append(k)
        assert max(map(len, groups.values())) <= cutting.FAN
        levels.append(pa.concat_tables([cutting._composed(policy)(levels[-1].take(random.Random(1).sample(g, len(g)))) for g in groups.values()]))
        assert max(len(x) for x in levels[-1].column("before").to_pylist()) <= policy.max_rows + 1
    states = {0: {"node": 0, "used": 0, "rows": 0, "part": 0, "last_why": "stream-end"}}
    for maps in reversed(levels[:-1]):
        below, nodes = {}, np.array(maps.column("node").to_pylist())
        for parent, state in states.items():
            mine = maps.filter(pa.array(nodes // cutting.FAN == parent))
            below |= {s["node"]: s for s in cutting._handed_down(policy)(mine, pa.Table.from_pylist([state], cutting._STATE)).to_pylist()}
        states = below
    schema = pa.schema([("id", pa.int64()), ("part", pa.int64()), ("cut_by", pa.string()), ("oversize", pa.bool_())])
    found = []
    for t in tables:
        state = pa.Table.from_pylist([states[t.column("_range")[0].as_py()]], cutting._STATE)
        got = cutting._cut(policy, ["id"], schema)(t, state)
        found += zip(*(got.column(c).to_pylist() for c in ("id", "part", "cut_by")), strict=True)
    return found


@pytest.mark.parametrize("ranges", [1, 2, 17, 300, 2000])
def test_composed_ranges_give_the_sequential_cut(ranges):
    rnd = random.Random(ranges)
    for target, most, n in ((8_000, 100, 5000), (8_000, 7, 3000), (300, 100, 2500), (10**9, 10**4, 3000), (10**9, 1000, 3000)):
        rows = [(k, v := rnd.choice((5, 9, 60)), 9 + 16 * v + (rnd.random() < 0.02) * 30_000, rnd.randrange(40)) for k in range(n)]
        cuts = sorted(rnd.randrange(n + 1) for _ in range(ranges - 1))
        policy = CutPolicy(target_bytes=target, max_rows=most)
        assert in_memory_cut(rows, policy, cuts) == one_scan(rows, policy)


def test_cut_over_many_ranges(spark):
    rnd = random.Random(2)
    rows = [(k * 7, v := rnd.choice((5, 9, 60)), 9 + 16 * v, rnd.randrange(40)) for k in range(900)]
    policy = CutPolicy(target_bytes=9_000, max_rows=50)
    df = spark.createDataFrame(rows, "id long, verts int, wkb_len long, attr_bytes long").repartition(4)
    found = cutting.cut_partitions(df, policy, 120).collect()
    assert sorted((r.id, r.part, r.cut_by) for r in found) == one_scan(rows, policy)


@pytest.mark.parametrize("ids,code", [([1, None, 3], "identity_null"), ([1, -2, 3], "identity_negative"), ([*range(20), 7], "identity_duplicate"), ([None, -1, 3, 3], "identity_null")])
def test_publish_refuses_bad_identities(spark, tmp_path, ids, code):
    with pytest.raises(PublishRefused, match=code):
        publish(boxed(spark.createDataFrame([(i,) for i in ids], "id long")), ["zone"], f"file://{tmp_path}/b", CutPolicy(max_rows=4), partitions=5)
    assert list(tmp_path.iterdir()) == []


def test_publish_refuses_bad_shapes(spark, tmp_path):
    df = boxed(spark.range(30)).withColumn("verts", F.when(F.col("id") == 11, -1).otherwise(5))
    with pytest.raises(PublishRefused, match="geometry_refused"):
        publish(df, ["zone"], f"file://{tmp_path}/b")


def test_a_bundle_without_parts(spark, tmp_path):
    dest = f"file://{tmp_path}/b"
    assert publish(boxed(spark.range(0)), ["zone"], dest, style=None).collect() == []
    assert {r.path: r.state for r in verify_bundle(spark, dest).collect()} == {p: "ok" for p in ("(numbering)", "(rows)", "(envelope)", "(schema)")}


def test_every_row_is_published_once(spark, tmp_path):
    ids = random.Random(3).sample(range(10**12), 500)
    dest = f"file://{tmp_path}/b"
    manifest = publish(boxed(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)), ["zone"], dest, CutPolicy(max_rows=33), partitions=9, keys={"license": "CC-BY"}).collect()
    assert sorted(r.id for r in spark.read.parquet(f"{dest}/data").collect()) == sorted(ids)
    assert [m.n_rows for m in sorted(manifest, key=lambda m: m.part)] == [33] * 15 + [5]
    assert json.loads((tmp_path / "b/build-info.json").read_text())["n_rows"] == 500
    import pyarrow.parquet as pq

    first = next((tmp_path / "b/data").rglob("*.parquet"))
    assert pq.read_metadata(first).metadata[b"license"] == b"CC-BY"
    assert {r.state for r in verify_bundle(spark, dest).collect()} == {"ok"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    fails = F.when(F.col("id") == 400, F.raise_error(F.lit("broken row"))).otherwise("x")
    dest = f"file://{tmp_path}/b"
    with pytest.raises(Exception, match="broken row"):
        publish(boxed(spark.range(500)).withColumn("zone", fails), ["zone"], dest, CutPolicy(max_rows=20))
    assert not (tmp_path / "b").exists()


def test_the_sink_commits_last_and_takes_back(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, zone string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, part long").schema
    box = pa.StructArray.from_arrays([pa.array([1.0, 2.0])] * 4, names=["xmin", "ymin", "xmax", "ymax"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None]), box, pa.array([0, 1])], names=["id", "zone", "bbox", "part"])
    writer = BundleWriter(schema, {"path": f"file://{tmp_path}/b", "rows": "2", "schema": "[]"})
    told = writer.write(iter([batch]))
    again = writer.write(iter([batch]))  # a second attempt writes the same files
    assert told == again == Written("part-00000.json", 2, 2, [1.0, 1.0, 2.0, 2.0])
    assert not (tmp_path / "b/build-info.json").exists()
    writer.commit([told, None])
    assert json.loads((tmp_path / "b/build-info.json").read_text())["parts"] == 2
    other = BundleWriter(schema, {"path": f"file://{tmp_path}/c", "rows": "3", "schema": "[]"})
    told = other.write(iter([batch]))
    with pytest.raises(ValueError, match="rows_changed"):
        other.commit([told])
    assert not (tmp_path / "c").exists()


def test_large_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    body = random.Random(1).randbytes(20 << 20)
    (tmp_path / "x.parquet").write_bytes(body)
    found = {r.path.rpartition("/")[2]: (r.bytes, r.content_hash) for r in file_hashes(spark, f"file://{tmp_path}").collect()}
    assert found == {"x.parquet": (len(body), hashlib.sha256(body).hexdigest())}
