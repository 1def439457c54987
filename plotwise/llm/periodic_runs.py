"""Periodic runs: passages that repeat themselves at once, four times or more (operator 11).

A run is a stretch of consecutive words with smallest period q, of at least max(6, 4q) words, that no neighbouring word extends.  Every word of
a run is found four times or more within it.  So a word found less often within its segment splits the segment there, and the pieces are looked
at again by themselves, until nothing splits.  All segments of a batch of documents are split in the same array passes.

What survives is scanned by lags.  At lag q the words q apart within a run are equal at three multiples of q in a row at least, so only every
q-th word is compared first, which makes the scan of n words n log n; where three in a row agree the stretch is measured word by word.  Places
that lie in a run already found, with a smaller period, are left out: were the stretch around them periodic in q, it would be that run.

Cases.  Null or empty text: no words and no runs, and the collapsed text is empty.  A very long text is a batch of its own, in one task as its
text is; it takes some hundred bytes a word.  Words are compared by a 64-bit hash.  Ties (runs with the same start): both are listed, the smaller
period first.  Repeated rows and null ids: each row is judged alone, and gives a row.  No documents: no rows.  Nothing is shuffled, so no key can
be hot.  Only doc_id and text are read; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm import text as tx
from plotwise.llm.shared import pieces
from plotwise.llm.substring_dedup import kept_words

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Splitting goes on until it is stable, or until all rounds have read this many times the batch's words.  The scan is exact for any segments.
MOST_ROUNDS_OF_ALL = 64


def segments(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that can hold a run: within each, every word is found MIN_PERIODS times.

    h: the words' hashes; before: for each document the number of words before it."""
    start, end = before[:-1], before[1:]
    done_start, done_end, left = [], [], MOST_ROUNDS_OF_ALL * (len(h) + 1)
    while True:
        long = end - start >= MIN_WORDS
        start, end = start[long], end[long]
        size = end - start
        left -= int(size.sum())
        if not len(start) or left < 0:
            break
        first = np.concatenate(([0], np.cumsum(size)))
        number = np.repeat(np.arange(len(start)), size)
        place = np.arange(first[-1]) - np.repeat(first[:-1] - start, size)
        key = tx.combine(tx.mix(number.astype(np.uint64)), h[place])
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        cut = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
        often = np.empty(len(key), bool)
        often[order] = np.repeat(np.diff(cut) >= MIN_PERIODS, np.diff(cut))
        stable = np.logical_and.reduceat(often, first[:-1])
        done_start.append(start[stable])
        done_end.append(end[stable])
        often &= ~stable[number]
        same = number[1:] == number[:-1]
        begin, stop = often.copy(), often.copy()
        begin[1:] &= ~(often[:-1] & same)
        stop[:-1] &= ~(often[1:] & same)
        start, end = place[begin], place[stop] + 1
    start, end = np.concatenate([*done_start, start]), np.concatenate([*done_end, end])
    order = np.argsort(start)
    return start[order], end[order]


def _stretch(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch around a place in which the words are equal to those a lag later."""
    lo, hi, top = at, at, len(w) - lag
    step = 64
    while hi < top:
        to = min(hi + step, top)
        differ = w[hi:to] != w[hi + lag : to + lag]
        k = int(differ.argmax())
        if differ[k]:
            hi += k
            break
        hi, step = to, min(2 * step, 1 << 16)
    step = 64
    while lo > 0:
        to = max(lo - step, 0)
        differ = (w[to:lo] != w[to + lag : lo + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            lo -= k
            break
        lo, step = to, min(2 * step, 1 << 16)
    return lo, hi


def lag_scan(w: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one word array, in which no run is longer than so many words."""
    found: list[tuple[int, int, int]] = []
    inside = np.zeros(len(w), np.int64)  # for each place the furthest end of a run that holds it
    for q in range(1, longest // MIN_PERIODS + 1):
        anchor = w[::q]
        equal = anchor[1:] == anchor[:-1]
        at = np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2]) * q
        if not len(at):
            continue
        at = at[inside[at] <= at + 3 * q]
        for part in range(1, 8):  # a stretch holds all places between the first and the third multiple
            between = at + 2 * q * part // 8
            at = at[w[between] == w[between + q]]
        done = -1
        for place in at.tolist():
            if place < done:
                continue
            lo, done = _stretch(w, place, q)
            if done <= place + 2 * q:
                continue  # equal words by chance: the stretch doesn't hold all three
            length = done - lo + q
            if length >= max(MIN_WORDS, MIN_PERIODS * q):
                found.append((lo, length, q))
                inside[lo : lo + length] = np.maximum(inside[lo : lo + length], lo + length)
    return found


def runs(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a batch, by start and period; starts count from the batch's first word."""
    start, end = segments(h, before)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    # the segments side by side, each followed by a word like no other
    size = end - start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    w = np.empty(at[-1], np.uint64)
    gap = at[1:] - 1
    w[gap] = tx.mix(np.arange(len(gap), dtype=np.uint64) + np.uint64(1 << 60))
    here = np.ones(len(w), bool)
    here[gap] = False
    w[here] = h[np.arange(int(size.sum())) + np.repeat(start - (at[:-1] - np.arange(len(size))), size)]
    found = np.array(lag_scan(w, int(size.max())), np.int64).reshape(-1, 3)
    found[:, 0] += (start - at[:-1])[np.searchsorted(at, found[:, 0], side="right") - 1]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsible(found: np.ndarray, n: int) -> np.ndarray:
    """Which words come after the first period of a run that holds them."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return np.cumsum(cover)[:-1] > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _measured(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = tx.flat(part.column("text"))
    starts, ends, before = tx.words(data, offsets)
    found = runs(tx.word_hashes(data, starts, ends), before)
    kept = kept_words(data, starts, ends, before, ~collapsible(found, len(starts)))
    at = np.searchsorted(found[:, 0], before)
    local = found[:, 0] - np.repeat(before[:-1], np.diff(at))
    listed = pa.StructArray.from_arrays([pa.array(local), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(_RUN))
    columns = [part.column("doc_id"), pa.array(np.diff(before), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), listed), kept.cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "text"])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text) of each document: its runs (start, length, period) by start and period, and the text in which each run has
    shrunk to its first period, the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield _measured(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
    )
