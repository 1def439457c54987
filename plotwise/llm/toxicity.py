"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams (operator 3).

Features of a text are the distinct words, word pairs and pairs with one word between, lower-cased and hashed to 2**BITS coordinates.  The
regression is fitted on labelled rows only, at most TRAIN_ROWS of them (a fixed hash of doc_id chooses, so that the choice is the same in any
run): FTRL-proximal gives each coordinate its own rate, and the L1 term leaves few weights other than 0.  The bound on the rows bounds the one
task that fits; the bound on coordinates (2**BITS) bounds the weights that are broadcast.  Scoring reads every text once and shuffles nothing.

Cases.  Null or empty text: no features, so the intercept's score.  No labelled row: all scores are 0.5's logistic of 0, that is 0.5.  Rows
of labels with null toxic, or without a document, are left out; repeated ones count as often as they come.  Repeated documents: a row each.
A null doc_id is not held out.  Very long texts: work and memory in proportion, in one task as their text is.  Ties in the order of training
rows are settled by label and size.  No documents: no rows.  Only doc_id and text of the documents and doc_id and toxic of the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm import text as tx
from plotwise.llm.shared import pieces

BITS = 18
TRAIN_ROWS = 16_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 7.0
    l2: float = 0.0
    epochs: int = 4


def crc_remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column, parts: int = 4, which: int = 2) -> Column:
    return F.coalesce(crc_remainder(doc_id, parts) == which, F.lit(False))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of each text's features, and the n+1 offsets of the texts among them; a text has a coordinate once."""
    data, offsets = tx.flat(texts)
    data = tx.lowered(data)
    starts, ends, before = tx.words(data, offsets, tx.PUNCTUATION)
    h = tx.word_hashes(data, starts, ends)
    doc = tx.owner(before)
    pair, skip = h[:-1] * np.uint64(3) + h[1:], h[:-2] * np.uint64(5) + h[2:] * np.uint64(7)
    keep2, keep3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    every = np.concatenate((h, tx.mix(pair[keep2]), tx.mix(skip[keep3])))
    whose = np.concatenate((doc, doc[:-1][keep2], doc[:-2][keep3]))
    key = np.unique((whose.astype(np.uint64) << np.uint64(BITS)) | (every >> np.uint64(64 - BITS)))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(key >> np.uint64(BITS), np.arange(len(before)))


def fit(rows: list[np.ndarray], label: np.ndarray, p: Ftrl = Ftrl()) -> np.ndarray:
    """Weights of all coordinates and, last, the intercept: one step a row, in the order given, some epochs. rows: each row's coordinates."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - p.l1, 0) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for row, y in zip(rows, label, strict=True):
            i = np.append(row, 1 << BITS)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange((1 << BITS) + 1))


def _fit_task(p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, ranks = [], [], []
        for part in pieces(batches, "text"):
            i, at = features(part.column("text"))
            i = i.astype(np.int32)
            rows += [i[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            labels.append(part.column("toxic").to_numpy(zero_copy_only=False))
            ranks.append(part.column("rank").to_numpy())
        if not rows:
            return
        label = np.concatenate(labels)
        order = np.lexsort(([len(r) for r in rows], label, np.concatenate(ranks)))
        w = fit([rows[k] for k in order], label[order], p)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(w[used])], names=["coordinate", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, p: Ftrl = Ftrl()) -> DataFrame:
    """(coordinate, weight) of the weights other than 0. Both tables are taken as given: leave held-out rows out before."""
    labels = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("toxic"), F.xxhash64("doc_id").alias("rank"))
    chosen = labels.orderBy("rank", "toxic").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).select("text", "toxic", "rank")
    return sample.repartition(1).mapInArrow(_fit_task(p), "coordinate int, weight double")


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, score) for each document."""
    found = weights.toArrow()  # 2**BITS rows at most
    dense = np.zeros((1 << BITS) + 1)
    dense[found.column("coordinate").to_numpy()] = found.column("weight").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(dense.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in pieces(batches, "text"):
            i, at = features(part.column("text"))
            total = np.concatenate(([0.0], np.cumsum(w[i], dtype=np.float64)))
            logit = total[at[1:]] - total[at[:-1]] + w[-1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
