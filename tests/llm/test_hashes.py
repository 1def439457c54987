"""Strings that meet under polynomial hashes (Thue-Morse words) must not meet here, as words, lines or sequences of words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotwise.llm import jaccard_join, lm, quality, substring_dedup
from plotwise.llm import text as tx

KIND = "doc_id long, text string, lang string"
SWAP = str.maketrans("ab", "ba")


def thue_morse(rounds):
    t = "a"
    for _ in range(rounds):
        t += t.translate(SWAP)
    return t, t.translate(SWAP)


def hashed(*texts):
    data, offsets = tx.flat(pa.array(texts))
    starts, ends, _ = tx.words(data, offsets)
    return tx.word_hashes(data, starts, ends)


@pytest.mark.parametrize("rounds", [6, 7, 8, 10, 12])
def test_words_and_sequences_differ(rounds):
    one, two = thue_morse(rounds)
    assert len(set(hashed(one, two, one).tolist())) == 2
    a, b = (tx.ngrams(hashed(" ".join(x)), len(x))[0] for x in (one, two))
    assert a != b and a == tx.ngrams(hashed(" ".join(one)), len(one))[0]


def test_hash_depends_on_bytes_alone():
    """Not on where a word stands, nor on the batch or the step that it comes in."""
    words = [f"{k:0{k % 200 + 1}d}é" for k in range(3000)]
    alone = np.concatenate([hashed(w) for w in words[::37]])
    assert np.array_equal(hashed(" ".join(words), "x", "")[:3000:37], alone) and len(set(hashed(*words).tolist())) == 3000
    h = hashed(" ".join(map(str, range(70_000))))
    for n in (1, 2, 3, 5, 13):
        grams = tx.ngrams(h, n)
        assert len(grams) == len(h) - n + 1 and all(grams[i] == tx.ngrams(h[i : i + n], n)[0] for i in (0, 65_535, 65_536, len(grams) - 1))


def documents(spark):
    one, two = thue_morse(12)
    rest = " ".join(f"w{k}" for k in range(6))
    rows = [(1, f"{rest} {one} {rest}"), (2, f"{rest} {two} {rest}"), (3, f"x\n{one}\n{two}\n{one}"), (4, " ".join(one[:1024])), (5, " ".join(two[:1024]))]
    return spark.createDataFrame([(*r, "en") for r in rows], KIND)


def test_operators_tell_them_apart(spark):
    docs = documents(spark)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert removed[2] == 0
    component = {r.doc_id: r.component_id for r in jaccard_join.join_documents(docs).collect()}
    assert component[1] == 1 and component[2] == 2
    facts = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert facts[3].n_dup_lines == 1 and facts[1].longest_repeat == 6
    known = {r.doc_id: r for r in lm.score_documents(docs, F.col("doc_id") == 2).collect()}
    assert known[2].n_known == known[2].n_tokens - 1 + 1  # the swapped word is in document 3
    alone = {r.doc_id: r for r in lm.score_documents(docs.where("doc_id < 3"), F.col("doc_id") == 2).collect()}
    assert alone[2].n_known == alone[2].n_tokens - 1
