"""Phrase collocations by prefix-free parsing (operator 13).

Texts are lower-cased (A-Z) and cut to pieces at punctuation and line ends.  A piece is cut again before each pair of words whose hash is a
multiple of TRIGGER, so that equal passages are cut alike wherever they stand.  A chunk is what lies between two cuts and, as an overlap, the words
after it that a phrase beginning in it may reach.  Equal chunks become one row of the dictionary, with the number of times that the parse has it.
Phrases are counted in the distinct chunks alone, each time by that number; one belongs to the chunk in which it begins, so overlaps count once.

Each block of the dictionary sums its own words and pairs, and sends a row (hash, sum) for each to be added up.  Of those found often enough the
blocks are told again.  Three and four words can only be frequent where all pairs in them are, so few of them are sent.  At last one block for each
frequent phrase, the least that has it, writes its words down.  Longer and shorter phrases then meet by plain joins.

Sums are by 64-bit hashes of language and words; a hash is sent once by a block, so the most common word costs a task one row a block.  The
dictionary is a table bucketed by block in the shared folder: later passes read it where it lies.  All arithmetic is of integers, products of
decimals with 38 digits.

Cases.  Null or empty text, or one of punctuation only: no words.  Null language: `und`, together with rows that say `und`.  A very long text, or one
without punctuation: cut by its own pairs; a chunk is the whole piece at the most.  Repeated rows and null ids: each row counts.  Ties: by the order
that the result states.  No documents: no rows.  Only text and lang are read; other columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwise.llm import blocks
from plotwise.llm import text as tx
from plotwise.llm.shared import passing, pieces, saved, shared_folder

LONGEST, LEAST, WITHIN_PERCENT, TOP = 4, 30, 80, 2000
#: A language's phrases are ranked in so many shares first, so that the last ranking reads TOP of each at most.
SHARES = 32
#: A pair of words in so many, by its hash, begins a chunk.
TRIGGER = 32
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN = _PIECE_END.copy()
_BETWEEN[[0x20, 0x09]] = True


def _each(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] ... first[i]+size[i]-1 of all i, one after another."""
    at = np.cumsum(size)
    return np.arange(at[-1] if len(at) else 0) + np.repeat(first - (at - size), size)


def chunks(texts: pa.Array, longest: int = LONGEST) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of all texts (words joined by one space), the number of their own words (without the overlap), and the numbers of their texts."""
    data, offsets = tx.flat(texts)
    data = tx.lowered(data)
    starts, ends, before = tx.words(data, offsets, _BETWEEN)
    n = len(starts)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = tx.owner(before)
    piece_no = np.cumsum(_PIECE_END[data], dtype=np.int64)[starts]
    new_piece = np.ones(n, bool)
    new_piece[1:] = (piece_no[1:] != piece_no[:-1]) | (doc[1:] != doc[:-1])
    cut = new_piece.copy()
    cut[1:] |= tx.ngrams(tx.word_hashes(data, starts, ends), 2) % np.uint64(TRIGGER) == 0
    first, piece_first = np.flatnonzero(cut), np.flatnonzero(new_piece)
    own = np.diff(np.append(first, n))
    piece_end = np.append(piece_first[1:], n)[np.searchsorted(piece_first, first, side="right") - 1]
    size = np.minimum(own + longest - 1, piece_end - first)
    # the bytes of the chunks' words, each with the byte after it, which becomes a space
    word = _each(first, size)
    length = ends[word] - starts[word] + 1
    at = np.cumsum(length)
    out = np.append(data, np.uint8(32))[_each(starts[word], length)]
    out[at - 1] = 32
    chunk_end = at[np.cumsum(size) - 1]
    keep = np.ones(len(out), bool)
    keep[chunk_end - 1] = False
    offset = np.concatenate(([0], chunk_end - np.arange(1, len(first) + 1)))
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offset), pa.py_buffer(out[keep]))
    return text.cast(pa.string()), own, doc[first]


def _parse(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            chunk, own, doc = chunks(part.column("text"), longest)
            table = pa.table({"lang": part.column("lang").take(pa.array(doc)), "chunk": chunk, "own": pa.array(own), "n": pa.array(np.ones(len(own), np.int64))})
            found = table.group_by(["lang", "chunk", "own"]).aggregate([("n", "sum")]).rename_columns(["lang", "chunk", "own", "n"])
            yield from found.combine_chunks().to_batches()

    return run


class Dictionary:
    """The distinct chunks (block, lang, chunk, own, n) of a parse, bucketed by block in the shared folder."""

    def __init__(self, docs: DataFrame, longest: int = LONGEST, block_bytes: int = blocks.BLOCK_BYTES):
        self.spark, self.name, self.longest = docs.sparkSession, f"phrase_chunks_{uuid.uuid4().hex}", longest
        self.blocks = blocks.block_count(docs, block_bytes)
        worded = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
        parsed = worded.mapInArrow(_parse(longest), "lang string, chunk string, own long, n long")
        dealt = parsed.withColumn("block", F.pmod(F.xxhash64("lang", "chunk", "own"), F.lit(self.blocks)).cast("int")).repartition(self.blocks, "block")
        distinct = dealt.groupBy("block", "lang", "chunk", "own").agg(F.sum("n").alias("n"))
        self.folder = shared_folder(self.spark, "phrase-chunks")
        distinct.write.option("compression", "zstd").option("path", self.folder).bucketBy(self.blocks, "block").sortBy("block").saveAsTable(self.name)
        passing(self.spark, self.folder)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table's name; its files go when the driver ends."""
        self.spark.sql(f"DROP TABLE {self.name}")


class _Grams:
    """The phrases of a block: for each length the places where they begin (in the block's words), their hashes and the chunks they are in."""

    def __init__(self, table: pa.Table):
        self.lang, self.n = table.column("lang").combine_chunks(), table.column("n").to_numpy()
        self.data, offsets = tx.flat(table.column("chunk"))
        space = np.zeros(256, bool)
        space[0x20] = True
        self.starts, self.ends, self.before = tx.words(self.data, offsets, space)
        self.words = tx.word_hashes(self.data, self.starts, self.ends)
        self.chunk = tx.owner(self.before)
        self.own_end = (self.before[:-1] + table.column("own").to_numpy())[self.chunk]
        lang, at = tx.flat(self.lang)
        self.lang_hash = tx.word_hashes(lang, at[:-1], at[1:])

    def of(self, length: int, overlaps: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of some length: those that are the chunks' own, or all."""
        h = tx.ngrams(self.words, length)
        at = np.arange(len(h))
        own = (at < self.own_end[: len(h)]) | overlaps
        at = at[(self.chunk[: len(h)] == self.chunk[length - 1 :]) & own]
        return at, tx.combine(self.lang_hash[self.chunk[at]] + np.uint64(length), h[at])


def _among(keys: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(keys), bool)
    return ranked[np.minimum(np.searchsorted(ranked, keys), len(ranked) - 1)] == keys


_SUMS = "key long, block int, n long"


def _summed(block: int, keys: np.ndarray, n: np.ndarray) -> pa.Table:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return pa.table({"key": pa.array(ranked[first].view(np.int64)), "block": pa.array(np.full(len(first), block, np.int32)), "n": pa.array(sums)})


def _short(table: pa.Table) -> pa.Table:
    """A block's sums of single words and pairs; of pairs in overlaps it wants to be told, and adds nothing to their sums."""
    g = _Grams(table)
    one, two = g.of(1), g.of(2, overlaps=True)
    n = g.n[g.chunk[two[0]]] * (two[0] < g.own_end[two[0]])
    return _summed(table.column("block")[0].as_py(), np.concatenate((one[1], two[1])), np.concatenate((g.n[g.chunk[one[0]]], n)))


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent hashes in order, their sums, and which of them are this block's to write down."""
    keys = answers.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], answers.column("total").to_numpy()[order], answers.column("mine").to_numpy(zero_copy_only=False)[order]


def _long(longest: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's sums of longer phrases, all pairs of which are frequent."""
        if not table.num_rows:
            return _summed(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        g = _Grams(table)
        at, h = g.of(2, overlaps=True)
        pair = np.zeros(len(g.words) + 1, np.int64)
        pair[at + 1] = _among(h, _known(answers)[0])
        pair = np.cumsum(pair)
        keys, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in range(3, longest + 1):
            at, h = g.of(k)
            likely = pair[at + k - 1] - pair[at] == k - 1
            keys.append(h[likely])
            n.append(g.n[g.chunk[at[likely]]])
        return _summed(table.column("block")[0].as_py(), np.concatenate(keys), np.concatenate(n))

    return run


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])


def _written(longest: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The words of the frequent phrases that are this block's to write down."""
        if not table.num_rows or not answers.num_rows:
            return _PHRASES.empty_table()
        g, (keys, total, mine) = _Grams(table), _known(answers)
        keys, total = keys[mine], total[mine]
        out = []
        for k in range(1, longest + 1):
            at, h = g.of(k)
            hit = _among(h, keys)
            h, where = np.unique(h[hit], return_index=True)
            at = at[hit][where]
            size = g.ends[at + k - 1] - g.starts[at]
            text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(g.data[_each(g.starts[at], size)]))
            sums = total[np.searchsorted(keys, h)]
            out.append(pa.table([g.lang.take(pa.array(g.chunk[at])), text.cast(pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(sums)], schema=_PHRASES))
        return pa.concat_tables(out)

    return run


def _answers(sums: DataFrame, buckets: int, least: int) -> DataFrame:
    """(block, key, total, mine) for each block and each of its hashes that all blocks together have often enough."""
    by_key = Window.partitionBy("key")  # a key has a row a block at most
    total, writer = F.sum("n").over(by_key), F.min(F.when(F.col("n") > 0, F.col("block"))).over(by_key)
    often = sums.repartition(buckets, "key").select("block", "key", total.alias("total"), writer.alias("writer")).where(F.col("total") >= least)
    return saved(often.select("block", "key", "total", (F.col("block") == F.col("writer")).alias("mine")), "phrase-answers")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block_bytes: int = blocks.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of 1 to `longest` words found `least` times or more in a language, and (lang, n), its words in all."""
    chunk = Dictionary(docs, longest, block_bytes)
    rows = chunk.rows()
    told = _answers(rows.groupBy("block").applyInArrow(_short, _SUMS), chunk.blocks, least)
    more = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_long(longest), _SUMS)
    told = told.unionByName(_answers(more, chunk.blocks, least))
    written = rows.groupBy("block").cogroup(told.where("mine").groupBy("block")).applyInArrow(_written(longest), "lang string, phrase string, words int, a long")
    found = saved(written, "phrases")
    total = saved(rows.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")), "phrase-languages")
    chunk.drop()
    return found, total


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words and more, by their lowest-scoring cut."""
    part = F.split("phrase", " ")
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", "a", part.alias("part"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    joined = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("part", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("part", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    both = joined.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + r)")
    return both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def standing_alone(candidates: DataFrame, within_percent: int = WITHIN_PERCENT) -> DataFrame:
    """The candidates that are not mostly found within one longer candidate."""
    part, n = F.split("phrase", " "), F.col("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice("part", at, size), " "))))
    inside = candidates.where("words > 2").withColumn("part", part).select("lang", "a", F.explode(spans).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    both = candidates.join(longer, ["lang", "phrase"], "left")
    return both.where(F.col("within").isNull() | (100 * F.col("within") < within_percent * F.col("a"))).drop("within")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, within_percent: int = WITHIN_PERCENT, top: int = TOP, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, then count, then their bytes."""
    phrases, languages = phrase_counts(docs, longest, least, block_bytes)
    candidates = standing_alone(scored(phrases), within_percent).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    likely = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
