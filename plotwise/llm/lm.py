"""Language-model scores: a unigram base and prediction by partial matching (operator 8).

Training counts come from all training texts, and nothing of them is left out.  Each block of documents sends every distinct word and every
distinct byte n-gram of the whole order once, with its count in the block's training texts (blocks.py).  Words are dealt by hash, n-grams by
the hash of the last CONTEXT bytes of their context.  Asked n-grams of a bucket are dealt on by block in `salt` parts, so that a common
context makes no task hot; its counts are added up by part, then over the parts, and given back to each part.

All n-grams that end in the same CONTEXT bytes before their symbol meet in one bucket, so from order CONTEXT on a bucket's trie is whole:
it is built there, and answers each block with the log-probabilities of its n-grams (32-bit floats).  The orders below are broadcast: their
nodes are distinct strings of CONTEXT bytes, which are 2**24 at most, whatever the corpus.  ppm.py has the model.

Cases.  Null or empty text: one token, the end; the PPM model codes its end symbol.  No training text: N = V = 0 and c = 0, so the base is
log10(1) a token; the trie is empty, and each byte costs log10(256).  Repeated rows: each is a document.  A null doc_id is not held out.  A
very long text is in one block with others; it takes some tens of bytes a byte there.  Ties: scores depend on counts alone.  No rows: no
rows.  doc_id must be of an integer type (TypeError else).  Words are compared by a 64-bit hash, n-grams by their bytes.  Columns other than
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm import blocks, ppm, text as tx
from plotwise.llm.shared import integer_ids, pieces

ORDER = 6
CONTEXT = 3
PIECE = 2 << 20
#: Blocks whose keys meet in one part of a bucket.
PART_BLOCKS = 1024
_END = np.uint64(0x454E44)
_WORDS, _GRAMS = 0, 1


def _tokens(table: pa.Table):
    """Hashes of the lower-cased words of a block, and the n+1 offsets of its documents among them."""
    data, offsets = tx.flat(table.column("text"))
    data = tx.lowered(data)
    starts, ends, before = tx.words(data, offsets)
    return tx.word_hashes(data, starts, ends), before


def _words(table: pa.Table):
    """The distinct word hashes of a block, the end's included, the number of each word among them, and the n+1 offsets of the documents."""
    h, before = _tokens(table)
    keys, number = np.unique(np.append(h, _END), return_inverse=True)
    return keys, number, before


def _text_pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return pieces(iter(table.select(["text"]).combine_chunks().to_batches()), "text", PIECE)


def _grams(table: pa.Table, order: int) -> tuple[np.ndarray, list]:
    """The distinct n-grams of a block in the order of their buckets' hash, and for each piece the number of each n-gram and the n+1 offsets of its texts."""
    found = []
    for part in _text_pieces(table):
        key, at = ppm.gram_keys(*tx.flat(part.column("text")), order)
        keys, number = np.unique(key, return_inverse=True)
        found.append((keys, number.astype(np.int32), at))
    every, back = np.unique(np.concatenate([keys for keys, *_ in found]), return_inverse=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    cuts = np.cumsum([0, *(len(keys) for keys, *_ in found)])
    return every, [(back[lo:hi][number], at) for lo, hi, (_, number, at) in zip(cuts[:-1], cuts[1:], found, strict=True)]


def _gram_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys by bucket, ascending within each, and the buckets+1 edges."""
    to = (tx.mix((keys >> np.uint64(8)) & np.uint64((1 << (8 * CONTEXT)) - 1)) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(to, kind="stable")
    return by, np.searchsorted(to[by], np.arange(buckets + 1))


def _index(buckets: int, salts: int, order: int):
    """Rows (kind, bucket, salt, block, keys, counts) of a block; words go to every bucket, as each tells its part of N and V."""

    def rows(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, edges: np.ndarray, every: bool):
        spans = [(b, slice(lo, hi)) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if every or hi > lo]
        n = len(spans)
        return [
            pa.array([kind] * n, pa.int32()),
            pa.array([b for b, _ in spans], pa.int32()),
            pa.array([block % salts] * n, pa.int32()),
            pa.array([block] * n, pa.int32()),
            pa.array([blocks.pack(keys[at]) for _, at in spans], pa.binary()),
            pa.array([blocks.pack(counts[at]) for _, at in spans], pa.binary()),
        ]

    def index(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        train = ~table.column("held_out").to_numpy(zero_copy_only=False)
        keys, number, before = _words(table)
        counts = np.bincount(number[:-1][np.repeat(train, np.diff(before))], minlength=len(keys))
        counts[number[-1]] += train.sum()
        words = rows(_WORDS, block, keys, counts.astype(np.int64), blocks.bucket_edges(keys, buckets), True)
        keys, parts = _grams(table, order)
        counts, row = np.zeros(len(keys), np.int64), 0
        for number, at in parts:
            learned = np.repeat(train[row : row + len(at) - 1], np.diff(at))
            counts += np.bincount(number[learned], minlength=len(keys))
            row += len(at) - 1
        by, edges = _gram_buckets(keys, buckets)
        grams = rows(_GRAMS, block, keys[by], counts[by], edges, False)
        return pa.table([pa.concat_arrays([a, b]) for a, b in zip(words, grams, strict=True)], names=["kind", "bucket", "salt", "block", "keys", "counts"])

    return index


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[by], first)


def _merged(table: pa.Table) -> pa.Table:
    """All trained keys of the rows with their counts, in one row. A few rows are unpacked at a time, so memory follows the distinct keys."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = list(zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True))
    for k in range(0, len(rows), 16):
        more = [(blocks.unpack(a, np.uint64), blocks.unpack(b, np.int64)) for a, b in rows[k : k + 16]]
        more = [(a[b > 0], b[b > 0]) for a, b in more]
        keys, counts = _summed(np.concatenate([keys, *(a for a, _ in more)]), np.concatenate([counts, *(b for _, b in more)]))
    return pa.table(
        {
            "kind": table.column("kind").slice(0, 1),
            "bucket": table.column("bucket").slice(0, 1),
            "known": pa.array([blocks.pack(keys)], pa.binary()),
            "totals": pa.array([blocks.pack(counts)], pa.binary()),
        }
    )


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the strings of CONTEXT bytes of training texts: one row for each in the task."""
    total = np.zeros(1 << (8 * CONTEXT), np.int64)
    for part in pieces(batches, "text", 4 * PIECE):
        key, _ = ppm.gram_keys(*tx.flat(part.column("text")), CONTEXT - 1)
        total += np.bincount(key.astype(np.int64), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["key", "n"])


def low_orders(train: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trie's levels below order CONTEXT, from all texts given (column text): 2**24 nodes a level at most."""
    rows = train.select("text").mapInArrow(_low_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = _summed(rows.column("key").to_numpy().astype(np.uint64), rows.column("n").to_numpy())
    return ppm.shorter(keys, counts, CONTEXT - 1)


_base: dict[str, ppm.Model] = {}


def _base_model(name: str, shared) -> ppm.Model:
    """The model of the broadcast levels; a worker builds it once and keeps the last one only."""
    if name not in _base:
        _base.clear()
        _base[name] = ppm.Model(shared.value)
    return _base[name]


def _answer(order: int, name: str, shared):
    """Answers to the blocks' rows of a bucket's part: the totals of their words, or the log10 probabilities of their n-grams."""

    def answer(asked: pa.Table, learned: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _ANSWERS.empty_table()
        keys, counts = blocks.unpack(learned.column("known")[0].as_py(), np.uint64), blocks.unpack(learned.column("totals")[0].as_py(), np.int64)
        words = asked.column("kind")[0].as_py() == _WORDS
        if not words:
            levels = ppm.shorter(keys, counts, order)[CONTEXT:]
            model = ppm.Model(levels, _base_model(name, shared))
        values = []
        for blob in asked.column("keys").to_pylist():
            mine = blocks.unpack(blob, np.uint64)
            if words:
                at = np.searchsorted(keys, mine)
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == mine[hit]
                found = np.zeros(len(mine), np.int64)
                found[hit] = counts[at[hit]]
                values.append(blocks.pack(found))
            else:
                values.append(blocks.pack(model.score(mine).astype(np.float32)))
        n = asked.num_rows
        distinct, tokens = (len(keys), int(counts.sum())) if words else (0, 0)
        return pa.table([asked.column("block"), asked.column("kind"), asked.column("bucket"), pa.array(values, pa.binary()), pa.array([distinct] * n), pa.array([tokens] * n)], schema=_ANSWERS)

    return answer


_ANSWERS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("distinct", pa.int64()), ("tokens", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(buckets: int, order: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORES.empty_table()
        kinds = answers.column("kind").to_numpy()

        def gathered(kind: int, edges: np.ndarray, dtype: type) -> np.ndarray:
            out = np.zeros(edges[-1], dtype)
            mine = answers.filter(pa.array(kinds == kind))
            for b, found in zip(mine.column("bucket").to_pylist(), mine.column("found").to_pylist(), strict=True):
                out[edges[b] : edges[b + 1]] = blocks.unpack(found, dtype)
            return out

        keys, number, before = _words(docs)
        total = gathered(_WORDS, blocks.bucket_edges(keys, buckets), np.int64)
        n, v = pc.sum(answers.column("tokens")).as_py(), pc.sum(answers.column("distinct")).as_py()
        log = np.log10((total + 1) / (n + v + 1))
        end = number[-1]
        sums = np.concatenate(([0.0], np.cumsum(log[number[:-1]])))[before]
        known = np.concatenate(([0], np.cumsum(total[number[:-1]] > 0)))[before]
        keys, parts = _grams(docs, order)
        by, edges = _gram_buckets(keys, buckets)
        chance = np.zeros(len(keys))
        chance[by] = gathered(_GRAMS, edges, np.float32)
        scores = [np.diff(np.concatenate(([0.0], np.cumsum(chance[number])))[at]) for number, at in parts]
        return pa.table(
            [
                docs.column("doc_id"),
                docs.column("held_out"),
                pa.array(np.diff(before) + 1),
                pa.array(np.diff(known) + int(total[end] > 0)),
                pa.array(np.full(docs.num_rows, n, np.int64)),
                pa.array(np.diff(sums) + log[end]),
                pa.array(np.concatenate(scores)),
            ],
            schema=_SCORES,
        )

    return run


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER, block_bytes: int = blocks.BLOCK_BYTES, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document. held_out: a boolean column, true where the document isn't learned from."""
    if order < CONTEXT:
        raise ValueError(f"the order is {CONTEXT} at least")
    own = docs.select(integer_ids(docs), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(low_orders(own.where(~F.col("held_out"))))
    count = blocks.block_count(docs, block_bytes)
    salts = -(-count // part_blocks)
    dealt = blocks.dealt(own, count, "doc_id", "text", "held_out")
    index = dealt.groupBy("block").applyInArrow(_index(count, salts, order), "kind int, bucket int, salt int, block int, keys binary, counts binary")
    index = index.repartition(2 * count, "kind", "bucket", "salt")
    sums = index.groupBy("kind", "bucket", "salt").applyInArrow(_merged, "kind int, bucket int, known binary, totals binary")
    if salts > 1:
        sums = sums.select("kind", "bucket", F.col("known").alias("keys"), F.col("totals").alias("counts")).groupBy("kind", "bucket").applyInArrow(_merged, "kind int, bucket int, known binary, totals binary")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked, learned = index.groupBy("kind", "bucket", "salt"), sums.groupBy("kind", "bucket", "salt")
    answers = asked.cogroup(learned).applyInArrow(_answer(order, uuid.uuid4().hex, shared), "block int, kind int, bucket int, found binary, distinct long, tokens long")
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_score(count, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
