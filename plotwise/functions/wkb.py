"""Polygon WKB as Arrow jobs: bytes to a vertex table and facts, and a vertex table to bytes. No arithmetic is done on coordinates."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plotwise.storage import stored_bytes

_HAS_Z, _HAS_M, _HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def decode(wkb: bytes | None) -> tuple[str | None, list[np.ndarray]]:
    """(refusal, rings): the rings as n x 2 doubles, or why the bytes aren't a plain closed polygon."""
    if wkb is None:
        return "geometry_null", []
    if not wkb:
        return "empty", []
    if wkb[0] > 1:
        return "bad_byte_order", []
    end = "<" if wkb[0] == 1 else ">"
    if len(wkb) < 5:
        return "truncated", []
    (kind,) = struct.unpack_from(f"{end}I", wkb, 1)
    if kind & (_HAS_Z | _HAS_M | _HAS_SRID):
        return "ewkb_flags", []
    if kind != 3:
        return "not_polygon", []
    if len(wkb) < 9:
        return "truncated", []
    (count,) = struct.unpack_from(f"{end}I", wkb, 5)
    if not count:
        return "no_rings", []
    at, rings = 9, []
    for _ in range(count):
        if at + 4 > len(wkb):
            return "truncated", []
        (n,) = struct.unpack_from(f"{end}I", wkb, at)
        at += 4
        if n < 4:
            return "ring_too_short", []
        if at + 16 * n > len(wkb):
            return "truncated", []
        raw = np.frombuffer(wkb, f"{end}f8", 2 * n, at).reshape(n, 2)
        if raw[0].tobytes() != raw[-1].tobytes():
            return "ring_unclosed", []
        rings.append(raw.astype("<f8"))
        at += 16 * n
    return ("trailing_bytes", []) if at != len(wkb) else (None, rings)


class Polygons:
    """All polygons of a batch at once. Little-endian, plain and closed ones are read by array steps, a step for each ring number; what is left is decoded alone.

    rings: row, number, first vertex and vertices of each ring, by row; xy: all vertices; refusals: by row, None for good ones."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = np.concatenate((data[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)))
        u4, u8 = (np.ndarray((len(data) - 7,), kind, data, strides=(1,)) for kind in ("<u4", "<u8"))
        start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        good = np.asarray(column.is_valid()) & (end - start >= 9)
        good[good] = (data[start[good]] == 1) & (u4[start[good] + 1] == 3)
        count = np.zeros(n, np.int64)
        count[good] = u4[start[good] + 5]
        good &= count > 0
        at, found = start + 9, []
        for k in range(int(count[good].max(initial=0))):
            mine = np.flatnonzero(good & (count > k))
            if not len(mine):
                break
            fits = at[mine] + 4 <= end[mine]
            size = np.zeros(len(mine), np.int64)
            size[fits] = u4[at[mine[fits]]]
            fits &= (size >= 4) & (at[mine] + 4 + 16 * size <= end[mine])
            first = at[mine] + 4
            last = first + 16 * (size - 1)
            f, z = first[fits], last[fits]
            fits[fits] = (u8[f] == u8[z]) & (u8[f + 8] == u8[z + 8])
            good[mine[~fits]] = False
            mine, size, first = mine[fits], size[fits], first[fits]
            found.append((mine, np.full(len(mine), k), first, size))
            at[mine] = first + 16 * size
        good &= at == end
        row, ring, first, size = (np.concatenate(v) if found else np.zeros(0, np.int64) for v in (zip(*found, strict=True) if found else [[]] * 4))
        keep = good[row]
        row, ring, first, size = row[keep], ring[keep], first[keep], size[keep]
        place = np.repeat(first, size) + 16 * (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        xy = np.stack((u8[place], u8[place + 8]), 1).view("<f8") if len(place) else np.zeros((0, 2))
        self.refusals: list[str | None] = [None] * n
        more = []
        for k in np.flatnonzero(~good):
            self.refusals[k], rings = decode(column[int(k)].as_py())
            more += [(k, j, r) for j, r in enumerate(rings)]
        if more:
            size = np.concatenate((size, [len(r) for *_, r in more]))
            row, ring = np.concatenate((row, [k for k, *_ in more])), np.concatenate((ring, [j for _, j, _ in more]))
            xy = np.concatenate((xy, *(r for *_, r in more)))
        begin = np.cumsum(size) - size
        by = np.lexsort((ring, row))
        take = np.repeat(begin[by], size[by]) + np.arange(size.sum()) - np.repeat(np.cumsum(size[by]) - size[by], size[by])
        self.row, self.ring, self.size, self.xy = row[by], ring[by], size[by], np.ascontiguousarray(xy[take])
        self.begin = np.cumsum(self.size) - self.size

    def digests(self) -> list[str]:
        """For each good row, SHA-256 over each ring's vertex count (64 bits) and coordinates (x, y doubles), all little-endian."""
        out, h, now = [], None, None
        view = memoryview(self.xy.astype("<f8", copy=False)).cast("B") if len(self.xy) else memoryview(b"")
        for row, at, n in zip(self.row.tolist(), self.begin.tolist(), self.size.tolist(), strict=True):
            if row != now:
                out += [h.hexdigest()] if h else []
                h, now = hashlib.sha256(), row
            h.update(struct.pack("<Q", n))
            h.update(view[16 * at : 16 * (at + n)])
        return out + ([h.hexdigest()] if h else [])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = Polygons(batch.column("geometry"))
        rows, first, rings = np.unique(p.row, return_index=True, return_counts=True)
        none = np.full(len(p.refusals), -1)
        none[rows] = np.arange(len(rows))
        at = pa.array(none, mask=none < 0)
        begin = p.begin[first]
        values = [rings.astype(np.int32), np.add.reduceat(p.size, first).astype(np.int32) if len(first) else np.zeros(0, np.int32)]
        for c, least in ((0, np.minimum), (1, np.minimum), (0, np.maximum), (1, np.maximum)):
            values.append(least.reduceat(p.xy[:, c], begin) if len(begin) else np.zeros(0))
        bits = p.xy.view(np.int64)
        values.append(np.bitwise_xor.reduceat(bits[:, 0] ^ bits[:, 1], begin) if len(begin) else np.zeros(0, np.int64))
        columns = [pa.array(v).take(at) for v in values] + [pa.array(p.digests(), pa.string()).take(at)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(p.refusals, pa.string()), *columns], names=["id", "refusal", "rings", "vertices", "xmin", "ymin", "xmax", "ymax", "coordinate_xor", "digest"]
        )


def geometry_facts(features: DataFrame) -> DataFrame:
    """(id, refusal, rings, vertices, xmin..ymax, coordinate_xor, digest) of each geometry; all null but the refusal where it is bad."""
    return features.select("id", "geometry").mapInArrow(
        _facts, "id long, refusal string, rings int, vertices int, xmin double, ymin double, xmax double, ymax double, coordinate_xor long, digest string"
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = Polygons(batch.column("geometry"))
        good = np.array([r is None for r in p.refusals], bool)
        n = np.bincount(p.row, p.size, len(good)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(good, n, -1).astype(np.int32))], names=[*batch.schema.names, "verts"])


def with_vertex_counts(features: DataFrame) -> DataFrame:
    """The features, with the number of their geometry's vertices as verts: -1 where the geometry is refused."""
    return features.mapInArrow(_counted, StructType([*features.schema, StructField("verts", IntegerType())]))


def _vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = Polygons(batch.column("geometry"))
        ids = batch.column("id").take(pa.array(np.repeat(p.row, p.size)))
        pos = np.arange(len(p.xy)) - np.repeat(p.begin, p.size)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.repeat(p.ring, p.size).astype(np.int32)), pa.array(pos.astype(np.int32)), *(pa.array(np.ascontiguousarray(p.xy[:, k])) for k in (0, 1))], names=["id", "ring", "pos", "x", "y"]
        )


def vertex_table(features: DataFrame) -> DataFrame:
    """(id, ring, pos, x, y) of every vertex of the good geometries."""
    return features.select("id", "geometry").mapInArrow(_vertices, "id long, ring int, pos int, x double, y double")


def encode(ids: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """(id, geometry) of vertices that come sorted by id, ring and place: one byte buffer, filled column by column."""
    new_id = np.append(True, ids[1:] != ids[:-1])
    new_ring = new_id | np.append(True, ring[1:] != ring[:-1])
    feature, part = np.cumsum(new_id) - 1, np.cumsum(new_ring) - 1
    first = np.flatnonzero(new_ring)
    vertices = np.diff(np.append(first, len(ids)))
    rings = np.bincount(feature[first])
    size = 9 + 4 * rings + 16 * np.bincount(feature)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    out = np.zeros(offsets[-1], np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
        for k in range(raw.shape[1]):
            out[at + k] = raw[:, k]

    begin = offsets[:-1]
    out[begin] = 1
    put(begin + 1, np.full(len(rings), 3, "<u4"))
    put(begin + 5, rings.astype("<u4"))
    own = feature[first]
    ring_no = np.arange(len(first)) - np.repeat(np.cumsum(rings) - rings, rings)
    head = begin[own] + 9 + 4 * ring_no + 16 * (first - np.flatnonzero(new_id)[own])
    put(head, vertices.astype("<u4"))
    at = head[part] + 4 + 16 * (np.arange(len(ids)) - first[part])
    put(at, x.astype("<f8"))
    put(at + 8, y.astype("<f8"))
    geometry = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rings), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([pa.array(ids[new_id]), geometry.cast(pa.binary())], names=["id", "geometry"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vertices to features; a batch's last feature waits for the next batch, where it may go on."""
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)]
    for batch in batches:
        rest = [np.concatenate((r, batch.column(c).to_numpy())) for r, c in zip(rest, ("id", "ring", "x", "y"), strict=True)]
        cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        if cut:
            yield encode(*(r[:cut] for r in rest))
            rest = [r[cut:] for r in rest]
    if len(rest[0]):
        yield encode(*rest)


#: Stored bytes that a task of vertices stands for: they may be made from a few bytes a feature.
_VERTEX_BYTES = 4 << 20


def by_feature(vertices: DataFrame) -> DataFrame:
    """The vertices, all of a feature in one task; more tasks than the shuffle's partitions where the bytes read ask for them."""
    tasks = -(-stored_bytes(vertices) // _VERTEX_BYTES)
    return vertices.repartition(tasks, "id") if tasks > int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")) else vertices.repartition("id")


def to_wkb(vertices: DataFrame) -> DataFrame:
    """(id, geometry): little-endian WKB polygons from a vertex table. A feature's vertices meet in one task, sorted."""
    dealt = by_feature(vertices.select("id", "ring", "pos", "x", "y")).sortWithinPartitions("id", "ring", "pos")
    return dealt.select(F.col("id").cast("long").alias("id"), F.col("ring").cast("int").alias("ring"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(_encode, "id long, geometry binary")


def header_class(wkb):
    """Refusals that the first nine bytes tell, as a column expression; null if they look like a plain polygon."""
    head = F.hex(F.substring(wkb, 1, 9))
    little = F.substring(head, 1, 2) == "01"
    kind = F.substring(head, 3, 8)
    plain = F.when(little, kind == "03000000").otherwise(kind == "00000003")
    flags = F.conv(F.when(little, F.substring(kind, 7, 2)).otherwise(F.substring(kind, 1, 2)), 16, 10).cast("int")
    return (
        F.when(wkb.isNull(), "geometry_null")
        .when(F.octet_length(wkb) == 0, "empty")
        .when(~F.substring(head, 1, 2).isin("00", "01"), "bad_byte_order")
        .when(F.octet_length(wkb) < 5, "truncated")
        .when(flags >= 0x20, "ewkb_flags")
        .when(~plain, "not_polygon")
        .when(F.octet_length(wkb) < 9, "truncated")
        .when(F.substring(head, 11, 8) == "00000000", "no_rings")
        .otherwise(F.lit(None).cast("string"))
    )
