"""Word and n-gram arithmetic on whole Arrow string columns, with numpy.

A batch of texts is one byte array plus document offsets, so splitting and hashing cost a few array passes whatever the number of documents.
Words are runs of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte UTF-8 character, so bytes and code points
give the same words.  A null text counts as an empty one.

Hashes have 64 bits and no structure that an input could use: among the n values that a comparison sees, two different ones meet with a
probability of n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: ASCII other than letters and digits.
PUNCTUATION = np.array([i < 0x80 and not chr(i).isalnum() for i in range(256)])

#: Words longer than this are hashed one by one by xxhash; shorter ones eight bytes at a time, all words of a batch together.
LONG_WORD = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two; the order counts, and for either one fixed it is a bijection of the other."""
    return mix(a * _STEP + (b ^ (b >> np.uint64(32))))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n+1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the number of words before it (n+1 values)."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes a round, every round mixed, so that no two strings meet but by chance."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64) + _STEP)
    step = 1 << 16
    for at in range(0, len(starts), step):
        here = slice(at, at + step)
        left, place, where = size[here], starts[here], np.arange(at, min(at + step, len(starts)))
        short = left <= LONG_WORD
        for k in np.flatnonzero(~short):
            out[at + k] = mix(np.array([xxhash.xxh3_64_intdigest(data[place[k] : place[k] + left[k]].tobytes())], np.uint64))[0]
        if not short.all():
            left, place, where = left[short], place[short], where[short]
        while len(left):
            rest = np.minimum(left, 8).astype(np.uint64)
            chunk = eight[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - rest) * np.uint64(8)))
            out[where] = combine(out[where], chunk)
            more = left > 8
            left, place, where = left[more] - 8, place[more] + 8, where[more]
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive values at each place; the array is n-1 shorter.  Places across documents are the caller's to drop.

    Built from runs of 1, 2, 4, ... values, as the binary digits of n say."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(h) - n + 1, np.uint64)
    step = 1 << 16
    for at in range(0, len(out), step):
        run, length, done, have = h[at : at + step + n - 1], 1, 0, None
        while True:
            if n & length:
                part = run[done:]
                have = part if have is None else combine(have[: len(part)], part)
                done += length
            if done == n:
                break
            run = combine(run[:-length], run[length:])
            length *= 2
        to = min(len(out), at + step)
        out[at:to] = have[: to - at]
    return out if n > 1 else mix(out)


def owner(counts_before: np.ndarray) -> np.ndarray:
    """For each item the number of its document, from the n+1 running counts."""
    return np.repeat(np.arange(len(counts_before) - 1, dtype=np.int64), np.diff(counts_before))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return LOWER[data]
