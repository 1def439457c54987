"""Prediction by partial matching over bytes: a context trie in arrays, escapes by method D, symbol exclusion.

The trie of order K is kept as one sorted array of keys for each order k = 0..K; a key is the k context bytes followed by the symbol.  The byte
0xFF, which UTF-8 never has, stands before a text's first byte and as the end symbol after its last one, so that every text has a probability
of its own.  With n all that followed a context in training, c the count of a symbol and d the symbols, a symbol has probability
(c - 1/2) / n; the escape has the rest, d / 2n.  At the shorter context the symbols that the longer one knew are left out of n and d: they
are in the shorter context's trie too, so what is left out is one number for each context.  After order 0, the symbols not seen share the rest
evenly.  A part of the trie (all that ends in the same context bytes) is a model on top of one of the lower orders.
"""

from __future__ import annotations

import numpy as np

END = 0xFF


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each end of a text the key of the whole order; and the n+1 offsets of the texts among them."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(data) + n * (order + 1), END, np.uint8)
    begin = offsets[:-1] + np.arange(n) * (order + 1) + order
    shift = np.repeat(begin - offsets[:-1], size)
    padded[np.arange(len(data)) + shift] = data
    key = np.zeros(len(padded) - order, np.uint64) if len(padded) > order else np.zeros(0, np.uint64)
    for j in range(order + 1):
        key <<= np.uint64(8)
        key |= padded[j : j + len(key)]
    # a text's keys end at its bytes and its end symbol; what ends in the next text's padding is dropped
    keep = np.ones(len(key), bool)
    first = begin - order
    for j in range(1, order + 1):
        keep[first[1:] - j] = False
    return key[keep], offsets + np.arange(n + 1)


class _Hash:
    """Exact lookup of 64-bit keys: open addressing in two arrays, filled and asked a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        at, rest = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = self.slot[at] < 0
            self.slot[at[free]] = rest[free]
            lost = self.slot[at] != rest
            at, rest = (at[lost] + 1) & self.mask, rest[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self._home(keys)
        found = self.slot[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slot[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


def shorter(keys: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels 0..order of the trie with these nodes of the whole order (ascending)."""
    levels = []
    for k in range(order, -1, -1):
        part = keys & np.uint64((1 << (8 * (k + 1))) - 1)
        by = np.argsort(part, kind="stable")
        part, counts = part[by], counts[by]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        keys, counts = part[first], np.add.reduceat(counts, first) if len(first) else counts[:0]
        levels.append((keys, counts))
    return levels[::-1]


class Model:
    """levels[k]: sorted keys of an order and their counts; the orders begin at 0, or go on where those of the base end."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], base: Model | None = None):
        self.pairs, self.contexts, self.levels = (list(base.pairs), list(base.contexts), list(base.levels)) if base else ([], [], [])
        for k, (keys, counts) in enumerate(levels, len(self.levels)):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            d = np.diff(np.append(first, len(keys)))
            number = np.repeat(np.arange(len(first)), d)
            c = counts.astype(np.float64)
            known = np.zeros(len(first))  # what this context's symbols count at the shorter one
            if k:
                lower_keys, lower_counts = self.levels[k - 1]
                at = np.searchsorted(lower_keys, keys & np.uint64((1 << (8 * k)) - 1))
                known = np.bincount(number, lower_counts[at].astype(np.float64), len(first))
            self.pairs.append((_Hash(keys), c))
            self.contexts.append((_Hash(context[first]), np.bincount(number, c, len(first)), d.astype(np.float64), known))
            self.levels.append((keys, counts))
        self.order = len(self.levels) - 1

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each key (of the whole order) after its context, from the longest context down."""
        log = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        left_n, left_d = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(self.order, -1, -1):
            part = keys[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            find, n, d, known = self.contexts[k]
            at = find.find(part >> np.uint64(8))
            has = at >= 0
            rest_n, rest_d = np.zeros(len(part)), np.zeros(len(part))
            rest_n[has], rest_d[has] = n[at[has]] - left_n[open_[has]], d[at[has]] - left_d[open_[has]]
            pair, counts = self.pairs[k]
            to = pair.find(part)
            seen = to >= 0
            log[open_[seen]] += np.log10((counts[to[seen]] - 0.5) / rest_n[seen])
            gone = ~seen & (rest_n > 0)
            log[open_[gone]] += np.log10(rest_d[gone] / 2 / rest_n[gone])
            left_n[open_[has]], left_d[open_[has]] = known[at[has]], d[at[has]]
            open_ = open_[~seen]
        log[open_] -= np.log10(256 - left_d[open_])
        return log
