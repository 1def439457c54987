"""Substring dedup by relative Lempel-Ziv parsing (operator 1).

Every document is a reference for the documents after it.  Documents are dealt to reference blocks; each block indexes all its word windows of
the least factor length, with the earliest document that holds each and its place there (blocks.py tells how the blocks' indexes meet without
a hot task).  A document is then parsed greedily against all blocks at once: where a window is known, a factor begins, and it goes on as long
as the next window comes from the next place of the same source; the next factor begins where it ends.  At each boundary of factors the
windows that lie across it are looked up too, and those known elsewhere become spans of their own, as a passage may go on in another source.
Factors and boundary spans together are the duplicate words.  A factor takes the earliest source of each window, so it is the longest from
that source, not the longest of all sources.

Cases.  Null or empty text: no words, nothing removed.  Fewer words than a window: nothing removed.  Repeated rows with one doc_id: each
gives a row, and they are no earlier source for each other.  A null doc_id counts as earlier than all others.  Ties: of several places in the
earliest document the first counts.  A very long text is in one block with others, and is parsed whole.  No rows: no rows.  doc_id must be of
an integer type (TypeError else).  Windows are compared by a 64-bit hash.  Columns other than doc_id and text are not read, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm import blocks, text as tx
from plotwise.llm.shared import integer_ids

WINDOW = 13
NULL_ID = np.iinfo(np.int64).min


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(int(NULL_ID)).to_numpy().astype(np.int64)


def _windows(table: pa.Table, window: int):
    """Of a block, in the order of doc_id: hashes of all windows inside documents, and for each its first word and document."""
    ids = _ids(table)
    table = table.take(pa.array(np.argsort(ids, kind="stable")))
    ids = np.sort(ids, kind="stable")
    data, offsets = tx.flat(table.column("text"))
    starts, ends, before = tx.words(data, offsets)
    grams = tx.ngrams(tx.word_hashes(data, starts, ends), window)
    doc = tx.owner(before)
    whole = np.flatnonzero(doc[: len(grams)] == doc[window - 1 :]) if len(grams) else np.zeros(0, np.int64)
    return table, ids, data, (starts, ends, before, doc), grams[whole], whole


def _first_holders(grams: np.ndarray, doc: np.ndarray, ids: np.ndarray, place: np.ndarray):
    """The distinct hashes, sorted; the earliest holder of each and its place there; for each window the number of its hash. The windows come by doc_id and place."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(grams), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return ranked[new], ids[doc[first]], place[first], number


def _indexed(table: pa.Table, window: int):
    """A block's documents and its index."""
    docs, ids, data, (starts, ends, before, doc), grams, first = _windows(table, window)
    keys, holders, places, number = _first_holders(grams, doc[first], ids, (first - before[doc[first]]).astype(np.int32))
    return docs, ids, data, (starts, ends, before, doc), first, (keys, holders, places, number)


def _index(window: int, buckets: int):
    def index(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        *_, (keys, holders, places, _) = _indexed(table, window)
        edges = blocks.bucket_edges(keys, buckets)
        spans = [(b, slice(lo, hi)) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        packed = {name: pa.array([blocks.pack(values[at]) for _, at in spans], pa.binary()) for name, values in (("keys", keys), ("holders", holders), ("places", places))}
        return pa.table({"bucket": pa.array([b for b, _ in spans], pa.int32()), "block": pa.array([block] * len(spans), pa.int32()), **packed})

    return index


def _earliest(table: pa.Table) -> pa.Table:
    """One bucket: tells each block which of its keys an earlier document of another block holds, which document, and where."""
    keys = [blocks.unpack(x, np.uint64) for x in table.column("keys").to_pylist()]
    who = np.concatenate([blocks.unpack(x, np.int64) for x in table.column("holders").to_pylist()])
    where = np.concatenate([blocks.unpack(x, np.int32) for x in table.column("places").to_pylist()])
    cuts = np.cumsum([0, *map(len, keys)])
    every = np.concatenate(keys)
    order = np.lexsort((who, every))
    ranked = every[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    least = np.empty(len(every), np.int64)
    least[order] = order[new][np.cumsum(new) - 1]
    known, source, place = [], [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        flag = who[least[lo:hi]] < who[lo:hi]
        best = least[lo:hi][flag]
        known.append(np.packbits(flag).tobytes())
        source.append(blocks.pack(who[best]))
        place.append(blocks.pack(where[best]))
    packed = {name: pa.array(values, pa.binary()) for name, values in (("known", known), ("source", source), ("place", place))}
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), **packed})


def _runs(on: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true places; same[i]: place i goes on from place i-1."""
    begin = on.copy()
    begin[1:] &= ~(on[:-1] & same[1:])
    start = np.flatnonzero(begin)
    stop = on.copy()
    stop[:-1] &= ~(on[1:] & same[1:])
    return start, np.flatnonzero(stop) + 1


def factors(begin: np.ndarray, stop: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and kind (true: across a boundary) of the spans of a greedy parse.

    begin, stop: runs of windows that follow each other in one source, in the order of the text.  A factor ends where its run does; the next
    one begins there at the earliest.  What a run has before that lies across the boundary."""
    first, end, across, cursor = [], [], [], 0
    for b, e in zip(begin.tolist(), stop.tolist(), strict=True):
        start = max(b, cursor)
        if start > b:  # the boundary's windows: those of this run that begin inside the last factor
            first.append(b)
            end.append(min(start, e) - 1 + window)
            across.append(True)
        if start < e:
            cursor = e - 1 + window
            first.append(start)
            end.append(cursor)
            across.append(False)
    return np.array(first, np.int64), np.array(end, np.int64), np.array(across, bool)


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The texts of the kept words, joined by one space."""
    counts = np.concatenate(([0], np.cumsum(keep)))
    s, e = starts[keep], ends[keep].copy()
    last = counts[before[1:]][np.diff(counts[before]) > 0] - 1
    e += 1
    e[last] -= 1
    delta = np.zeros(len(data) + 2, np.int8)
    delta[s] += 1
    np.add.at(delta, e, -1)
    inside = np.cumsum(delta, dtype=np.int8)[: len(data)].view(bool)
    out = np.where(tx.SPACE[data], np.uint8(32), data)[inside]
    length = np.concatenate(([0], np.cumsum(e - s)))
    offsets = length[counts[before]].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(before) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


_SPAN = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("source_id", pa.int64()), ("source_word", pa.int64()), ("boundary", pa.bool_())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", pa.list_(_SPAN))])


def _parse(window: int, buckets: int):
    def parse(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        docs, ids, data, (starts, ends, before, doc), at, (keys, holders, places, number) = _indexed(docs, window)
        edges = blocks.bucket_edges(keys, buckets)
        for b, known, source, place in zip(*(answers.column(c).to_pylist() for c in ("bucket", "known", "source", "place")), strict=True):
            lo, hi = edges[b], edges[b + 1]
            flag = np.unpackbits(np.frombuffer(known, np.uint8), count=hi - lo).astype(bool)
            holders[lo:hi][flag] = blocks.unpack(source, np.int64)
            places[lo:hi][flag] = blocks.unpack(place, np.int32)
        del keys
        source, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        on = np.zeros(len(starts), bool)
        source[at], place[at] = holders[number], places[number]
        on[at] = source[at] < ids[doc[at]]
        goes_on = np.ones(len(starts), bool)
        goes_on[1:] = (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1) & (doc[1:] == doc[:-1])
        begin, stop, across = factors(*_runs(on, goes_on), window)
        cover = np.zeros(len(starts) + 1, np.int32)
        np.add.at(cover, begin, 1)
        np.add.at(cover, stop, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.concatenate(([0], np.cumsum(gone)))[before]
        base = before[doc[begin]] if len(begin) else begin
        spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - begin), pa.array(source[begin]), pa.array(place[begin]), pa.array(across)], fields=list(_SPAN))
        return pa.table(
            [
                docs.column("doc_id"),
                pa.array(np.diff(before), pa.int64()),
                pa.array(np.diff(removed), pa.int64()),
                kept_words(data, starts, ends, before, ~gone).cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, before), pa.int32()), spans),
            ],
            schema=_RESULT,
        )

    return parse


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, text, spans) of each document: the text that is left, and the spans taken out with their sources and places there."""
    count = blocks.block_count(docs, block_bytes)
    dealt = blocks.dealt(docs, count, integer_ids(docs), F.col("text").cast("string").alias("text"))
    index = dealt.groupBy("block").applyInArrow(_index(window, count), "bucket int, block int, keys binary, holders binary, places binary")
    answers = index.repartition(count, "bucket").groupBy("bucket").applyInArrow(_earliest, "block int, bucket int, known binary, source binary, place binary")
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _parse(window, count),
            "doc_id long, n_words long, n_removed long, text string, spans array<struct<first_word:long,n_words:long,source_id:long,source_word:long,boundary:boolean>>",
        )
    )
