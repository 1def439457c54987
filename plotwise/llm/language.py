"""Language identification by bit-sliced Bloom filters over byte n-grams (operator 9).

One Bloom filter for each language, stored slot by slot: a slot's bits say which languages' filters have it set, so that one look-up for each
hash function answers for all languages at once.  An n-gram belongs to a language if enough of that language's training texts have it, and
not far fewer than of any other language's (mixed texts would else teach each language the others' n-grams).  A text's hits are counted for
each language; the filter's own false-positive rate is taken off; the language with most hits left wins.

The filters are fitted on at most TRAIN_TEXTS texts of each language, the first by a fixed hash of doc_id.  A language keeps the n-grams that
a share of LEAST_SHARE of these texts have, so no more than the n-grams of an average text divided by that share: this bounds what is
broadcast, whatever the corpus.  Prediction reads every text once and shuffles nothing.

Cases.  Null text or one without a letter: `und`, score 0.  Letters but no n-gram that any language has: the language with most training
texts, score 0.  No training text: `und`.  Ties: the first language by name.  Repeated rows: a row each.  Columns other than doc_id, text and,
in training, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwise.llm import text as tx
from plotwise.llm.shared import pieces

N = 4
TRAIN_TEXTS = 4_000
LEAST_SHARE = 0.01
LEAST_OF_BEST = 0.3
HASHES = 2
SLOT_BITS = 20

#: ASCII letters lower-cased, bytes of other characters as they are, all else a space.
_FOLD = np.array([i if i >= 0x80 or chr(i).islower() and i < 0x80 else i + 32 if 65 <= i <= 90 else 32 for i in range(256)], np.uint8)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text in order, as 32-bit numbers, with two spaces before and one after; and the n+1 offsets. All-space n-grams are left out."""
    data, offsets = tx.flat(texts)
    n = len(offsets) - 1
    pad = N - 1
    padded = np.full(len(data) + n * pad, 32, np.uint8)
    begin = offsets[:-1] + np.arange(n) * pad + 2
    padded[np.arange(len(data)) + np.repeat(begin - offsets[:-1], np.diff(offsets))] = _FOLD[data]
    if len(padded) < N:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    key = np.zeros(len(padded) - N + 1, np.uint32)
    for j in range(N):
        key <<= np.uint32(8)
        key |= padded[j : j + len(key)]
    keep = key != np.uint32(0x20202020)
    at = np.minimum(offsets + np.arange(n + 1) * pad, len(key))
    for j in range(1, N):  # n-grams across two texts
        border = at[1:-1] - j
        keep[border[border >= 0]] = False
    return key[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, texts that have it) of each piece."""
    for part in pieces(batches, "text"):
        key, at = grams(part.column("text"))
        langs = part.column("lang").dictionary_encode()
        code = langs.indices.to_numpy()[tx.owner(at)].astype(np.uint64)
        one = np.unique((tx.owner(at).astype(np.uint64) << np.uint64(32)) | key)  # once a text
        code = langs.indices.to_numpy()[(one >> np.uint64(32)).astype(np.int64)].astype(np.uint64)
        pair, n = np.unique((code << np.uint64(32)) | (one & np.uint64(0xFFFFFFFF)), return_counts=True)
        lang = langs.dictionary.take(pa.array((pair >> np.uint64(32)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([lang, pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def learn(docs: DataFrame, texts: int = TRAIN_TEXTS) -> DataFrame:
    """(lang, texts, gram) of the n-grams kept for each language."""
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = docs.groupBy("lang").agg(F.count("*").alias("all"))  # a row a language, like the filters; broadcast, or all texts would be shuffled by language
    rank = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30))
    likely = docs.join(F.broadcast(size), "lang").withColumn("rank", rank).where(F.col("rank") < 1.5 * texts / F.col("all") * (1 << 30) + 1)  # few more than are wanted
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank", F.xxhash64("text")))
    chosen = likely.withColumn("place", first).where(F.col("place") <= texts).select("text", "lang")
    counted = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    taken = chosen.groupBy("lang").agg(F.count("*").alias("texts"))
    rate = counted.join(F.broadcast(taken), "lang").withColumn("rate", F.col("n") / F.col("texts")).where(F.col("rate") >= LEAST_SHARE)
    best = F.max("rate").over(Window.partitionBy("gram"))
    return rate.withColumn("best", best).where(F.col("rate") >= LEAST_OF_BEST * F.col("best")).select("lang", "texts", "gram")


class Filters:
    """All languages' Bloom filters in one table: slots[word, slot] has a bit for each of 64 languages."""

    def __init__(self, langs: list[str], sets: list[np.ndarray], prior: int):
        self.langs, self.prior = langs, prior
        self.slots = np.zeros((-(-max(1, len(langs)) // 64), 1 << SLOT_BITS), np.uint64)
        for k, members in enumerate(sets):
            for s in self.places(members.astype(np.uint32)):
                np.bitwise_or.at(self.slots[k // 64], s, np.uint64(1 << k % 64))
        filled = [np.count_nonzero(self.slots[k // 64] & np.uint64(1 << k % 64)) / (1 << SLOT_BITS) for k in range(len(langs))]
        self.false = np.array(filled) ** HASHES

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        h = tx.mix(keys.astype(np.uint64) + np.uint64(1))
        return [((h >> np.uint64(j * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for j in range(HASHES)]

    def hits(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """hits[text, language]: n-grams of the text that the language's filter has, less those expected by chance."""
        places = self.places(keys)
        total = np.diff(at).astype(np.float64)
        out = np.zeros((len(at) - 1, len(self.langs)))
        for word in range(len(self.slots)):
            mask = self.slots[word][places[0]]
            for s in places[1:]:
                mask &= self.slots[word][s]
            for k in range(64 * word, min(len(self.langs), 64 * word + 64)):
                has = np.concatenate(([0], np.cumsum((mask >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)))
                out[:, k] = np.diff(has[at])
        return np.maximum(0, (out - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))


def predict(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for each document; score: the share of its n-grams that the language has, corrected."""
    rows = learned.toPandas()  # bounded by LEAST_SHARE
    langs = sorted(rows["lang"].unique())
    sizes = rows.groupby("lang")["texts"].first()
    prior = max(range(len(langs)), key=lambda k: (sizes[langs[k]], -k), default=0)
    shared = docs.sparkSession.sparkContext.broadcast(Filters(langs, [rows.loc[rows["lang"] == x, "gram"].to_numpy() for x in langs], prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        letters = np.array([i >= 0x80 or chr(i).isalpha() for i in range(256)])
        for part in pieces(batches, "text"):
            data, offsets = tx.flat(part.column("text"))
            ascii_letters = np.diff(np.concatenate(([0], np.cumsum(letters[data] & (data < 0x80))))[offsets]) > 0
            has = ascii_letters.copy()
            for i in np.flatnonzero(~ascii_letters & (np.diff(offsets) > 0)):
                has[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py() or ""))
            if not filters.langs:
                pred, score = np.full(len(has), "und", object), np.zeros(len(has))
            else:
                key, at = grams(part.column("text"))
                hits = filters.hits(key, at)
                best = np.argmax(hits, 1)
                top = hits[np.arange(len(best)), best]
                best[top == 0] = filters.prior
                pred = np.where(has, np.array(filters.langs, object)[best], "und")
                score = np.where(has, np.minimum(1, top / np.maximum(1, np.diff(at))), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
