"""Small cases of single operators, and the queries that SQL can't express."""

import hashlib
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwise.dataset import Refused, open_dataset
from plotwise.sources.geoparquet import geo_key, write_files
from plotwise.plans.datasets import CRS
from plotwise.functions.wkb import Polygons, decode, encode
from plotwise.operators.admission import admit_predicate, admit_projection
from plotwise.operators.audit import pair_attempts
from plotwise.operators.publish import CutPolicy, PublishRefused, cut_partitions, publish, unsafe_path, verify_assets, verify_bundle
from plotwise.operators.sequences import global_ordinal, islands
from plotwise.operators.spatial_joins import bbox_join
from plotwise.operators.text_scan import scan_text
from plotwise.plans import catalog
from plotwise.sources.audit import SCHEMA, parse_audit
from plotwise.sources.generate import CATEGORIES, MIX_A, MIX_B, MIX_STEP

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
SCHEMA_OF_PARCELS = T.StructType([T.StructField("id", T.LongType()), T.StructField("zone", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("geometry", T.BinaryType())])


@pytest.mark.parametrize(
    "text",
    ["zone = 'residential'", "id BETWEEN 5 AND 10 AND zone IN ('a','b')", "zone LIKE 'r%'", "zone IS NOT NULL", "zone ILIKE 'R%'", "NOT (id > 3 OR id < 2)", "id > 3 AND 1=1", "value / 2 <= -1 + id", "zone = '--not a comment; really'"],
)
def test_predicates_admitted(spark, text):
    assert admit_predicate(spark, text, SCHEMA_OF_PARCELS) is None


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("1=1; DROP TABLE x", "not_a_single_expression"),
        ("1=1 --", "construct_not_admitted"),
        ("/* */", "construct_not_admitted"),
        ("(SELECT 1)", "construct_not_admitted"),
        ("read_csv('c:/x')", "construct_not_admitted"),
        ("zone IN (SELECT 1)", "construct_not_admitted"),
        ("zone = ?", "construct_not_admitted"),
        ("CAST(zone AS INT) = 1", "construct_not_admitted"),
        ("random() < 0.5", "construct_not_admitted"),
        ("t.zone = 'a'", "construct_not_admitted"),
        ("missing = 1", "unknown_column"),
        ("1 + 1", "not_boolean"),
        ("zone = 'residential') OR (1=1", "unparsable"),
        ("1=1) UNION SELECT 1 --", "construct_not_admitted"),
        ("geometry IS NULL", "column_not_filterable"),
        ("id = 1 AND " * 500 + "id = 1", "too_long"),
        ("NOT " * 40 + "id = 1", "too_deep"),
    ],
)
def test_predicates_refused(spark, text, code):
    assert admit_predicate(spark, text, SCHEMA_OF_PARCELS) == code


def test_projection_ceiling():
    schema = T.StructType([T.StructField(f"c{k}", T.LongType()) for k in range(40)])
    found = admit_projection(schema, [f"c{k}" for k in range(34)])
    assert [r for _, r in found] == [None] * 32 + ["too_many_attributes"] * 2


def ring(*points):
    return struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))


@pytest.mark.parametrize(
    ("wkb", "refusal"),
    [
        (struct.pack("<BII", 1, 3, 1) + SQUARE, None),
        (None, "geometry_null"),
        (b"", "empty"),
        (b"\x02" + b"\x00" * 8, "bad_byte_order"),
        (struct.pack("<BI", 1, 1), "not_polygon"),
        (struct.pack("<BII", 1, 3 | 0x20000000, 1) + SQUARE, "ewkb_flags"),
        (struct.pack("<BII", 1, 3, 0), "no_rings"),
        (struct.pack("<BII", 1, 3, 1) + ring((0, 0), (1, 0), (0, 0)), "ring_too_short"),
        (struct.pack("<BII", 1, 3, 1) + ring((0, 0), (1, 0), (1, 1), (0, 1)), "ring_unclosed"),
        ((struct.pack("<BII", 1, 3, 1) + SQUARE)[:-3], "truncated"),
        (struct.pack("<BII", 1, 3, 1) + SQUARE + b"\x00", "trailing_bytes"),
    ],
)
def test_wkb_classes(wkb, refusal):
    assert decode(wkb)[0] == refusal


def test_wkb_big_endian_keeps_bits():
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">dd", *p) for p in [(2600000.123456789, 1), (2, 3), (4, 5), (2600000.123456789, 1)])
    refusal, rings = decode(big)
    assert refusal is None and rings[0][0, 0] == 2600000.123456789
    assert Polygons(pa.array([big], pa.binary())).digests() == [hashlib.sha256(struct.pack("<Q", 4) + rings[0].tobytes()).hexdigest()]


def test_batches_of_polygons_equal_single_ones():
    rng = np.random.default_rng(3)
    ids, rings, x, y = [], [], [], []
    for k in range(200):
        for r in range(rng.integers(1, 4)):
            xy = rng.random((rng.integers(3, 9), 2))
            xy = np.vstack((xy, xy[:1]))
            ids += [k * 7] * len(xy)
            rings += [r] * len(xy)
            x += xy[:, 0].tolist()
            y += xy[:, 1].tolist()
    made = encode(np.array(ids), np.array(rings, np.int32), np.array(x), np.array(y))
    column = made.column("geometry").to_pylist()
    assert made.column("id").to_pylist() == [7 * k for k in range(200)] and all(decode(g)[0] is None for g in column)
    spoilt = [None, b"", column[0][:-1], column[1], b"\x01\x03\x00\x00\x00\xff\xff\xff\xff", b"\x00" + column[2][1:], column[3] + b"\x00", column[4][:9] + b"\xff" + column[4][10:], *column[5:]]
    for column in (spoilt, spoilt[::-1], [b""], []):
        p = Polygons(pa.array(column, pa.binary()))
        assert p.refusals == [decode(g)[0] for g in column]
        expected = [(k, r.tobytes()) for k, g in enumerate(column) for r in decode(g)[1]]
        assert [(k, p.xy[b : b + n].tobytes()) for k, b, n in zip(p.row, p.begin, p.size, strict=True)] == expected


def test_bbox_join_loses_nothing(spark):
    rng = np.random.default_rng(5)
    boxes = [(int(k), *map(float, (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(zip(*(rng.integers(0, n, 120) for n in (200, 200, 60, 60)), strict=True))]
    boxes += [(900, -5.0, -5.0, 500.0, 500.0), (901, float("nan"), 0.0, 1.0, 1.0), (902, 9.0, 0.0, 1.0, 1.0)]
    views = [(int(k), *map(float, (x, y, x + 30, y + 20))) for k, (x, y) in enumerate(zip(rng.integers(0, 250, 30), rng.integers(0, 250, 30), strict=True))] + [(77, 0.0, 0.0, 1e9, 1e9), (78, 1.0, 1.0, 0.0, 0.0)]
    f = spark.createDataFrame(boxes, "id long, xmin double, ymin double, xmax double, ymax double")
    v = spark.createDataFrame(views, "view_id long, xmin double, ymin double, xmax double, ymax double")
    expected = sorted((w[0], b[0]) for w in views for b in boxes if b[1] <= b[3] and b[2] <= b[4] and w[1] <= w[3] and b[1] <= w[3] and b[3] >= w[1] and b[2] <= w[4] and b[4] >= w[2])
    for extent in ((0.0, 0.0, 260.0, 260.0), (7.0, 7.0, 7.0, 7.0)):
        assert sorted((r.view_id, r.id) for r in bbox_join(f, v, extent).collect()) == expected


def test_islands_and_ordinals_cross_ranges(spark):
    ids = [1, 2, 3, 10, *range(4090, 4100), 8191, 8192, *range(16777210, 16777220), 20000000]
    df = spark.createDataFrame([(i,) for i in ids + ids[:3]], "id long")
    runs, lo = [], None
    for a, b in zip(ids, ids[1:] + [None], strict=True):
        lo = a if lo is None else lo
        if b != a + 1:
            runs.append((lo, a))
            lo = None
    assert sorted(map(tuple, islands(df).collect())) == runs
    sparse = [k * 10**12 for k in range(40)] + [7, 8]
    assert islands(spark.createDataFrame([(k,) for k in sparse], "id long"), partitions=9).count() == 41
    assert sorted((r.id, r.k) for r in global_ordinal(df.distinct(), "id", "k").collect()) == [(i, k) for k, i in enumerate(sorted(ids))]


@pytest.mark.parametrize("step", [1, 10_000_000])
@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_any_ranges_give_the_sequential_cut(spark, step, partitions):
    """Dense and sparse ids, few and many ranges (some smaller than a part), a feature that is taken for more than it is."""
    rows = [(k * step, 5 + k % 9, 93 + 16 * (k % 9) + (30_000 if k % 97 == 5 else 0), 10) for k in range(700)]
    policy = CutPolicy(target_bytes=8_000, max_rows=100)
    expected, why, part, v, r, a = {}, {}, 0, 0, 0, 0
    for k, verts, wkb, attr in rows:
        if r and v * 16 + r * 8 + (r + v) * 4 + a + (wkb // 16) * 16 + 8 + (1 + wkb // 16) * 4 + attr > policy.target_bytes:
            why[part] = "size-target"
            part, v, r, a = part + 1, 0, 0, 0
        expected[k] = part
        v, r, a = v + verts, r + 1, a + attr
        if v * 16 + r * 8 + (r + v) * 4 + a >= policy.target_bytes or r >= 100:
            why[part] = "size-target" if v * 16 + r * 8 + (r + v) * 4 + a >= policy.target_bytes else "row-ceiling"
            part, v, r, a = part + 1, 0, 0, 0
    why.setdefault(part, "stream-end")
    df = spark.createDataFrame(rows, "id long, verts int, wkb_len long, attr_bytes long").repartition(5)
    found = cut_partitions(df, policy, partitions).collect()
    assert {x.id: x.part for x in found} == expected and {x.part: x.cut_by for x in found} == {p: why[p] for p in set(expected.values())}


def test_cut_by_rows_alone(spark):
    df = spark.range(1000).select(F.col("id") * 10_000_000, F.lit(5).alias("verts"), F.lit(93).alias("wkb_len"), F.lit(10).alias("attr_bytes")).toDF("id", "verts", "wkb_len", "attr_bytes")
    found = cut_partitions(df, CutPolicy(max_rows=64), 7).collect()
    assert {r.id: r.part for r in found} == {k * 10_000_000: k // 64 for k in range(1000)}
    assert {r.cut_by for r in found if r.part < 15} == {"row-ceiling"} and {r.cut_by for r in found if r.part == 15} == {"stream-end"}
    assert cut_partitions(df.limit(0)).count() == 0


def test_publish_refuses_what_exists(spark, tmp_path):
    df = spark.range(50).select("id", F.struct(*(F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("bbox"), F.lit("x").alias("zone"), F.lit(5).alias("verts"), F.lit(93).alias("wkb_len"))
    manifest = publish(df, ["zone"], f"file://{tmp_path}/b", CutPolicy(max_rows=20)).collect()
    assert sorted((m.part, m.n_rows) for m in manifest) == [(0, 20), (1, 20), (2, 10)]
    with pytest.raises(PublishRefused, match="destination_exists"):
        publish(df, ["zone"], f"file://{tmp_path}/b", CutPolicy(max_rows=20))
    none = {"source": None, "redistribution": "no"}
    pinned = spark.createDataFrame([("a", "x", 1)], "path string, content_hash string, bytes long")
    for refused, more in (("license_refused", {"license": none}), ("style_refused", {"style": "{}"}), ("source_changed", {"pins": (pinned, pinned.withColumn("bytes", F.lit(2)))})):
        with pytest.raises(PublishRefused, match=refused):
            publish(df, ["zone"], f"file://{tmp_path}/c", CutPolicy(max_rows=20), **more)
    assert [x.name for x in tmp_path.iterdir()] == ["b"]  # nothing is left of what was refused
    assert {r.state for r in verify_bundle(spark, f"file://{tmp_path}/b").collect()} == {"ok"}


def test_verification_of_spoilt_files(spark, tmp_path):
    df = spark.range(50).select("id", F.struct(*(F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("bbox"), F.lit("x").alias("zone"), F.lit(5).alias("verts"), F.lit(93).alias("wkb_len"))
    publish(df, ["zone"], f"file://{tmp_path}/b", CutPolicy(max_rows=20))
    one, two, three = (next((tmp_path / "b/data" / f"part=0000{k}").glob("*.parquet")) for k in range(3))
    for crc in (tmp_path / "b").rglob(".*.crc"):
        crc.unlink()
    one.write_bytes(two.read_bytes())  # another file in its place: its bytes, rows and bounds are not those of the manifest
    three.unlink()
    found = {r.path.split("/")[1] if "/" in r.path else r.path: r.state for r in verify_bundle(spark, f"file://{tmp_path}/b").collect()}
    assert found["part=00000"] in ("bytes-mismatch", "hash-mismatch") and found["part=00001"] == "ok" and found["part=00002"] == "asset-missing"
    assert found["(rows)"] == "row-sum-mismatch" and found["(envelope)"] == "envelope-mismatch" and found["(numbering)"] == "ok"


def test_verification_states(spark):
    kind = "path string, bytes long, content_hash string, n_rows long"
    m = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "x", 1), ("../c", 1, "x", 1), ("d", 1, "x", 1), ("e", 1, "x", 1), ("g", 1, "x", 1)], kind)
    o = spark.createDataFrame([("a", 1, "x", 1), ("../c", 1, "x", 1), ("d", 2, "x", 1), ("e", 1, "y", 1), ("f", 1, "x", 1), ("g", 1, "x", 2)], kind)
    assert dict(map(tuple, verify_assets(m, o).collect())) == {"a": "ok", "b": "asset-missing", "../c": "unsafe-path", "d": "bytes-mismatch", "e": "hash-mismatch", "f": "asset-extra", "g": "rows-mismatch"}
    bad = spark.createDataFrame([(p,) for p in ("", "/a", "a\\b", "a:b", "a/./b", "a//b", "a/b")], "p string")
    assert [r[0] for r in bad.select(unsafe_path(F.col("p"))).collect()] == [True] * 6 + [False]


def test_audit_reader_and_pairs(spark):
    def line(attempt, phase, **more):
        import json

        return json.dumps({"schema": SCHEMA, "attempt": attempt, "phase": phase, "at": "2026-01-01T00:00:00Z", **more})

    lines = [
        line("a", "intent", destination="/x"),
        line("a", "intent", destination="/y"),
        line("a", "outcome", outcome="published", approval="flag"),
        line("a", "outcome", outcome="published"),
        "{",
        "",
        line("b", "intent", destination="/x"),
        line("c", "intent"),
        line("d", "outcome"),
        line("e", "later"),
    ]
    parsed = parse_audit(spark.createDataFrame([(k + 1, v) for k, v in enumerate(lines)], "line_no long, value string"))
    reasons = {r.line_no: r.corrupt_reason for r in parsed.collect()}
    assert reasons == {1: None, 2: None, 3: None, 4: None, 5: "not-json", 7: None, 8: "intent-missing-fields", 9: "outcome-missing-fields", 10: "bad-phase"}
    assert parsed.where("line_no = 3").first().approval_route == "flag"
    assert sorted(map(tuple, pair_attempts(parsed).collect())) == [("a", "orphan-outcome", None, 4), ("a", "pair", 2, 3), ("b", "orphan-intent", 7, None)]


def test_text_scan(spark):
    rows = [("a", "1", "my PassWord is here"), ("a", "2", "secret"), ("a", "3", "é see C:\\work\\maps and https://x.y/z"), ("a", "4", None), ("a", "5", "in /home/ada/maps by Ada Byron"), ("a", "6", "a:/b")]
    found = scan_text(spark.createDataFrame(rows, "source string, key string, text string"), usernames=["ada"], declared=["maps by Ada Byron"]).collect()
    got = sorted((r.key, r["class"], r.byte_offset) for r in found)
    assert got == [("1", "credential", 3), ("3", "local-filesystem-path", 7), ("5", "local-filesystem-path", 3), ("5", "operator-declared", 21), ("5", "username", 9)]


def test_open_dataset(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    spark.range(10).select("id", F.lit("a").alias("zone")).write.parquet(path)
    ds = open_dataset(spark, path, "EPSG:2056", CRS)
    assert ds.describe().first().row_count == 10
    assert ds.viewport(filter="id > 6", columns=["zone"]).count() == 3
    with pytest.raises(Refused, match="unknown_column"):
        ds.viewport(filter="height > 1")
    with pytest.raises(Refused, match="viewport_crs_mismatch"):
        ds.viewport((0, 0, 1, 1), bbox_crs="EPSG:4326")
    with pytest.raises(Refused, match="crs_undeclared"):
        open_dataset(spark, path)
    with pytest.raises(Refused, match="axis_order_unestablished"):
        open_dataset(spark, path, "EPSG:2056")
    with pytest.raises(Refused, match="geo_metadata_absent"):
        ds.rewrite(f"{path}3", "source-identity")
    spark.range(3).union(spark.range(1)).write.parquet(f"{path}2")
    with pytest.raises(Refused, match="identity_duplicate"):
        open_dataset(spark, f"{path}2", "EPSG:2056", CRS)


def test_footers_decide_admission(spark, tmp_path):
    square = struct.pack("<BII", 1, 3, 1) + SQUARE
    rows = [(k, f"z{k % 3}", (float(k), 0.0, k + 1.0, 1.0), square) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, zone string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, geometry binary")
    north = CRS.replace("east", "x").replace("north", "east").replace('"x"', '"north"')
    geo = geo_key(CRS)
    cases = {
        "good": (geo, None),
        "null": (geo_key(None), "crs_undeclared"),
        "north": (geo_key(north), "axis_order_refused"),
        "points": (geo.replace("Polygon", "Point"), "geometry_type_not_admitted"),
        "arrow": (geo.replace("WKB", "polygon"), "encoding_not_admitted"),
        "other": (geo.replace('"geometry"', '"shape"'), "geometry_column_missing"),
        "text": (geo.replace('"geometry"', '"zone"'), "geometry_column_not_binary"),
    }
    for name, (key, refusal) in cases.items():
        path = f"file://{tmp_path}/{name}"
        files = write_files(df.repartition(3), path, {"geo": key, "license": "CC-BY"}, 20)
        assert files.agg(F.sum("n_rows")).first()[0] == 100 and sorted(r.file for r in files.collect()) == sorted(x.name for x in (tmp_path / name).glob("*.parquet"))
        if refusal:
            with pytest.raises(Refused, match=refusal):
                open_dataset(spark, path)
    with pytest.raises(Refused, match="crs_assertion_conflict"):
        open_dataset(spark, f"file://{tmp_path}/good", "EPSG:2056", CRS)
    ds = open_dataset(spark, f"file://{tmp_path}/good")
    assert (ds.crs, ds.crs_source, ds.license) == ("EPSG:2056", "file", "CC-BY")
    again = ds.rewrite(f"file://{tmp_path}/again", "hilbert16", (0.0, 0.0, 100.0, 1.0), 16)
    assert (again.crs, again.license, again.features.count()) == ("EPSG:2056", "CC-BY", 100)
    assert sorted(map(tuple, again.features.select("id", "zone", "geometry").collect())) == sorted((k, z, bytearray(g)) for k, z, _, g in rows)
    assert {r.state for r in verify_bundle(spark, f"file://{tmp_path}/bundle").collect()} == {"ok"} if again.publish(["zone"], f"file://{tmp_path}/bundle", CutPolicy(max_rows=30)).count() == 4 else False
    write_files(df.limit(5), f"file://{tmp_path}/good/more", {"geo": geo}, 20)
    with pytest.raises(ValueError, match="differ"):
        open_dataset(spark, f"file://{tmp_path}/good")


@needs_data
def test_kept_row_groups_hold_all_rows(spark):
    """Statistics never lose a row, the curve reads fewer bytes for a small view, and joins of statistics agree with the plan's count."""
    from plotwise.plans.datasets import stored
    from plotwise.plans.fixtures import grid_cols, viewports
    from plotwise.sources.footers import row_group_bounds

    found = {(r.layout, r.view_id): r for r in catalog.queries()["pruned_viewports"](spark, DATA).collect()}
    ds = stored(spark, DATA, "hilbert16", 1024)
    groups = row_group_bounds(spark, ds.path).collect()
    assert sum(g.n_rows for g in groups) == ds.features.count()
    for name, box in viewports(grid_cols(spark, DATA)).items():
        r = found["hilbert16", name]
        kept = [g for g in groups if box is None or (g.g_xmin <= box[2] and g.g_xmax >= box[0] and g.g_ymin <= box[3] and g.g_ymax >= box[1])]
        assert (r.kept, r.total, r.kept_bytes) == (len(kept), len(groups), sum(g.bytes for g in kept)) and r.kept_bytes <= r.total_bytes
        inside = ds.features.where("true" if box is None else f"bbox.xmin <= {box[2]} AND bbox.xmax >= {box[0]} AND bbox.ymin <= {box[3]} AND bbox.ymax >= {box[1]}")
        assert {r.id for r in inside.select("id").collect()} <= {i for g in kept for i in range(g.id_lo, g.id_hi + 1)}
    assert found["hilbert16", "1-64"].kept_bytes <= found["hilbert16", "whole"].kept_bytes


@needs_data
def test_categories_are_plain_integers(spark):
    mask = (1 << 64) - 1
    for r in catalog.queries()["feature_categories"](spark, DATA).orderBy("id").limit(300).collect():
        z = (0x5EED + r.id * MIX_STEP) & mask
        z = ((z ^ z >> 30) * MIX_A) & mask
        z = ((z ^ z >> 27) * MIX_B) & mask
        z ^= z >> 31
        assert r.category == [*CATEGORIES, None][z % 5]


@needs_data
def test_file_hashes(spark):
    found = {r.table: (r.bytes, r.content_hash) for r in catalog.queries()["file_content_hashes"](spark, DATA).collect()}
    for name, value in found.items():
        content = open(f"{DATA}/{name}.parquet", "rb").read()
        assert value == (len(content), hashlib.sha256(content).hexdigest())


@needs_data
def test_feature_digests_and_xor(spark):
    from plotwise.plans.geometry import parcel_vertices

    rings: dict = {}
    for v in sorted(parcel_vertices(spark, DATA).collect(), key=lambda v: (v.id, v.ring, v.pos)):
        rings.setdefault(v.id, {}).setdefault(v.ring, []).append((v.x, v.y))
    arrays = {k: [np.array(r) for r in v.values()] for k, v in rings.items()}
    assert {r.id: r.digest for r in catalog.queries()["feature_digests"](spark, DATA).collect()} == {k: hashlib.sha256(b"".join(struct.pack("<Q", len(r)) + r.tobytes() for r in v)).hexdigest() for k, v in arrays.items()}
    xor = 0
    for v in arrays.values():
        for r in v:
            for bits in r.view(np.int64).ravel().tolist():
                xor ^= bits
    assert catalog.queries()["coordinate_xor"](spark, DATA).first().coordinate_xor == xor


def test_drive_paths_by_loop(spark):
    import re

    texts = ["see C:\\maps\\a and d:/x/yyyyyyy but not xC:\\a or https://a.b/c", "Z:/short", "é E:\\éé long enough text"]
    rows = spark.createDataFrame([("t", str(k), t) for k, t in enumerate(texts)], "source string, key string, text string")
    expected = []
    for k, t in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/]", t):
            left, right = re.search(r"[ -~]*$", t[: m.start()])[0], re.match(r"[ -~]*", t[m.end() :])[0]
            if len(left) + 3 + len(right) >= 12:
                expected.append((str(k), len(t[: m.start()].encode())))
    assert sorted((r.key, r.byte_offset) for r in scan_text(rows, needles=()).collect()) == sorted(expected)


def test_tickets_beyond_the_limit_are_refused(spark):
    from plotwise.operators.lake import replay_tickets

    rnd = random.Random(6)
    events, at = [], 0
    for k in range(300):
        at += rnd.randrange(3)
        t = rnd.randrange(k + 1)
        events += [(k % 2, 2 * k + k % 2, "mint", at, 3 * k), (t % 2, 2 * t + t % 2, rnd.choice(("redeem", "cancel")), at + 1, 3 * k + 1)]
    events += [(0, 9999, "redeem", 5, 5), (1, 1 * 2 + 1, "mint", at, 10_000), (None, 7, "mint", 1, 1)]
    expected = {}
    for dataset in (0, 1, None):
        pending = {}
        for _, ticket, action, now, _ in sorted((e for e in events if e[0] == dataset), key=lambda e: (e[3], e[4])):
            pending = {t: m for t, m in pending.items() if now < m + 30}
            if action == "mint" and (dataset, ticket) not in expected:
                expected[dataset, ticket] = (now, "expired" if len(pending) < 8 else "refused")
                pending |= {ticket: now} if len(pending) < 8 else {}
            elif action != "mint" and ticket in pending:
                expected[dataset, ticket] = (pending.pop(ticket), "redeemed" if action == "redeem" else "cancelled")
    minted = {(e[0], e[1]) for e in events if e[2] == "mint"}
    expected |= {(e[0], e[1]): (None, "unknown") for e in events if (e[0], e[1]) not in minted}
    found = replay_tickets(spark.createDataFrame(events, "dataset long, ticket long, action string, at_s long, event_id long"), "dataset", ["at_s", "event_id"]).collect()
    assert {(r.dataset, r.ticket): (r.minted_s, r.state) for r in found} == expected and len(found) == len(expected)
    assert {s for _, s in expected.values()} == {"refused", "expired", "redeemed", "cancelled", "unknown"}


def test_bootstrap_with_all_resamples(spark, tmp_path):
    rates = {1: [3.0, 4.0, 5.5, 2.5, 6.0, 6.5, 1.0, 3.0, 2.0, 2.5], 2: [1.0, 9.0] * 4}
    orders = [(10 * block + k, block, r) for block, rs in rates.items() for k, r in enumerate(rs)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    xs = []
    for k in range(0, 10, 2):
        a, b = rates[1][k : k + 2] if k // 2 % 2 == 0 else rates[1][k : k + 2][::-1]
        xs.append(2 * (b - a) / (a + b))
    means = sorted(sum(xs[int(hashlib.sha256(f"1:{r}:{j}".encode()).hexdigest()[:8], 16) % 5] for j in range(1, 6)) / 5 for r in range(10_000))
    found = catalog.queries()["bootstrap_interval_full"](spark, str(tmp_path)).collect()
    assert [r.block for r in found] == [1]
    assert abs(found[0].ci_lo - means[250]) < 1e-6 and abs(found[0].ci_hi - means[9750]) < 1e-6


def test_picks_and_shuffle_cover_every_parcel(spark, tmp_path):
    n = 2500
    spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'1-URGENT' AS o_orderpriority", "1.0D AS o_totalprice").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.range(6000).selectExpr("id AS event_id", "id % 13 AS user_id").write.parquet(f"file://{tmp_path}/events.parquet")
    found = catalog.queries()["pick_indirection_all"](spark, str(tmp_path)).collect()
    assert {r.pick_id: r.id for r in found} == {
        k: id if o < 200 and (id := b * 200 + o) < n else None for k in range(6000) for b, o in [((k * 7919 + k % 13) % ((n - 1) // 200 + 3), k * 31 % 250)]
    }
    assert max(r.id or 0 for r in found) >= 1800
    order = sorted(range(n), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
    found = catalog.queries()["shuffled_order_all"](spark, str(tmp_path)).collect()
    assert {r.id: r.ordinal for r in found} == {k: i for i, k in enumerate(order)}


def test_publish_keeps_the_geometry(spark, tmp_path):
    bbox = F.struct(*(F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    df = spark.range(50).select("id", bbox.alias("bbox"), F.lit("x").alias("zone"), F.lit(5).alias("verts"), F.lit(93).alias("wkb_len"), F.encode(F.col("id").cast("string"), "UTF-8").alias("geometry"))
    first = {m.part: m.content_hash for m in publish(df, ["zone"], f"file://{tmp_path}/a", CutPolicy(max_rows=20)).collect()}
    assert {r.id: bytes(r.geometry) for r in spark.read.parquet(f"file://{tmp_path}/a/data").collect()} == {k: str(k).encode() for k in range(50)}
    other = df.withColumn("geometry", F.when(F.col("id") == 25, F.lit(b"moved")).otherwise(F.col("geometry")))
    second = {m.part: m.content_hash for m in publish(other, ["zone"], f"file://{tmp_path}/b", CutPolicy(max_rows=20)).collect()}
    assert {p for p in first if first[p] != second[p]} == {1}
