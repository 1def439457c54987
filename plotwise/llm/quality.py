"""Quality rules from suffix-array repetition (operator 6).

A batch of documents is one word array.  Its suffixes are ordered within documents by prefix doubling, with only the groups that are still
tied sorted again; the longest common prefixes of neighbours come, exactly, from the ranks of each doubling.  The larger of a suffix's two neighbour
prefixes is the longest passage that starts there and is found elsewhere in the document, so the union of those spans is the union of all
maximal repeats.  The verdict limits the share of words in long repeats and the longest repeat itself.

Cases.  Null or empty text: no words, so the base rule on length rejects it.  A very long text is a batch of its own, and takes some hundred
bytes a word.  Words and lines of one document are compared by a 64-bit hash.  Ties (equal repeats) count once, as their union.  Repeated rows: each is judged alone, and gives a row.  Nothing
is shuffled; columns other than doc_id and text are carried by kept_documents and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm import text as tx
from plotwise.llm.shared import pieces


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    #: The method's own limits: repeats of at least so many words may cover so many percent, and none may be longer.
    long_repeat: int = 20
    max_long_percent: int = 10
    longest: int = 100


#: Bytes of text that kept_documents judges at once: its batches carry all columns, and its task's memory is that of the next stage too.
_KEPT_BYTES = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_order(value: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes, ordered within their documents; and the ranks by their first 1, 2, 4, ... words, as long as any are tied.

    value: equal words of a document have equal values; stop: where the suffix's document ends."""
    n = len(value)
    order = np.lexsort((value, doc))
    tie = np.ones(n, bool)
    tie[1:] = (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(tie, np.arange(n), 0))
    length, levels = 1, []
    while True:
        group = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(group[rank] > 1)
        if not len(open_):
            break
        levels.append(rank.astype(np.int32))
        ahead = open_ + length
        second = np.full(len(open_), -1, np.int64)
        inside = ahead < stop[open_]
        second[inside] = rank[ahead[inside]]
        by = np.lexsort((second, rank[open_]))
        first, second, where = rank[open_][by], second[by], open_[by]
        new_group = np.ones(len(by), bool)
        new_group[1:] = first[1:] != first[:-1]
        new = new_group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(by))
        begin = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[where] = first + np.maximum.accumulate(np.where(new, at, 0)) - begin
        length *= 2
    order[rank] = np.arange(n)
    return order, levels


def longest_repeats(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each word the length of the longest passage that starts there and also starts elsewhere in its document."""
    n = len(h)
    if n < 2:
        return np.zeros(n, np.int64)
    doc = tx.owner(before)
    stop = before[1:][doc]
    order, levels = suffix_order(h, doc, stop)
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero((doc[a] == doc[b]) & (h[a] == h[b]))
    a, b = a[pair], b[pair]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):  # a common prefix is a sum of powers of two, each step told by the ranks of its level
        x, y = a + common, b + common
        inside = np.flatnonzero((x < stop[a]) & (y < stop[b]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        common[same] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in repeats of at least so many words."""
    start = np.flatnonzero(longest >= least)
    cover = np.zeros(len(longest) + 1, np.int64)
    cover[start] += 1
    np.add.at(cover, start + longest[start], -1)
    return np.cumsum(cover)[:-1] > 0


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document the number of lines with a word that are equal to an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    doc = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(breaks, offsets)))
    end = np.append(begin[1:], offsets[-1])
    next_same = np.append(doc[1:] == doc[:-1], False)
    end = np.where(next_same, end - 1, end)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    h = tx.word_hashes(data, begin, end)
    order = np.lexsort((h, doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], minlength=len(offsets) - 1)


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    data, offsets = tx.flat(texts)
    starts, ends, before = tx.words(data, offsets)
    n_words = np.diff(before)
    longest = longest_repeats(tx.word_hashes(data, starts, ends), before)

    def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])

    n_repeat = per_doc(covered(longest, limits.window), before)
    n_long = per_doc(covered(longest, limits.long_repeat), before)
    top = np.zeros(len(n_words), np.int64)
    np.maximum.at(top, tx.owner(before), longest)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": per_doc(~tx.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": _duplicate_lines(data, offsets, starts),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (100 * n_long <= limits.max_long_percent * n_words) & (top <= limits.longest),
        "n_long_repeat_words": n_long,
        "longest_repeat": top,
    }


_FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_long_repeat_words long, longest_repeat long"


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id with the measures and the verdict, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            facts = measure(part.column("text"), limits)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, facts.values())], names=["doc_id", *facts])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FACTS}")


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with all their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.concat_arrays([pa.array(measure(part.column(at), limits)["kept"]) for part in pieces(iter([batch]), at, _KEPT_BYTES)]))

    placed = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # mapInArrow takes names for expressions
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
