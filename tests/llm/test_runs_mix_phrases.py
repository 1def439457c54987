"""Periodic runs, source mixing and phrases, against brute force and against their SQL."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same_as_sql
from pyspark.sql import functions as F

from plotwise.llm import mixing, periodic_runs, phrases, queries
from plotwise.llm import text as tx

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string"


def words(text):
    return WORD.findall(text or "")


def brute_runs(w):
    """(start, length, period) by trying every lag at every place."""

    def least_period(lo, hi):
        return next(p for p in range(1, hi - lo + 1) if all(w[i] == w[i + p] for i in range(lo, hi - p)))

    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i and least_period(i, j + q) == q:
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rnd, docs = random.Random(1), []
    for _ in range(3000):
        k = rnd.choice((1, 2, 3, 5, 30))
        w = [rnd.randrange(k) for _ in range(rnd.randrange(60))]
        if w and rnd.random() < 0.7:
            period = [rnd.randrange(k + 2) for _ in range(rnd.randrange(1, 12))]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [period[i % len(period)] for i in range(rnd.randrange(1, 70))]
        docs.append(w)
    before = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    found = periodic_runs.runs(tx.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(7)), before)
    assert [tuple(r) for r in found.tolist()] == [(b + s, length, q) for d, b in zip(docs, before.tolist()) for s, length, q in brute_runs(d)]


def test_segments_are_stable_and_hold_all_runs():
    rnd = random.Random(5)
    w = [rnd.choice("abcdefgh") if rnd.random() < 0.6 else f"rare{rnd.randrange(40)}" for _ in range(400)] + list("xyz" * 5) + ["once"] + list("ab" * 4)
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    h = tx.mix(np.array([ids[x] for x in w], np.uint64))
    start, end = periodic_runs.segments(h, np.array([0, len(w)]))
    for a, b in zip(start.tolist(), end.tolist()):
        assert b - a >= 6 and all(w[a:b].count(x) >= 4 for x in w[a:b])
    for s, length, _ in brute_runs(w):
        assert any(a <= s and s + length <= b for a, b in zip(start.tolist(), end.tolist()))


def test_a_very_long_text_of_few_words():
    w = np.random.default_rng(0).integers(0, 2, 60_000).astype(np.uint64)
    w[30_000:42_000] = np.tile(w[:3000], 4)
    found = periodic_runs.runs(tx.mix(w + np.uint64(3)), np.array([0, len(w)]))
    s, length, q = next(r for r in found.tolist() if r[2] == 3000)
    assert length >= 12_000 and (w[s : s + length - q] == w[s + q : s + length]).all()
    assert all((w[a : a + n - p] == w[a + p : a + n]).all() for a, n, p in found.tolist())


def test_run_cases(spark):
    """Null, empty and repeated rows, odd white space, null ids, clashing columns, no rows."""
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a " * 5, "x"), (5, "a\ta\n a a  a a", "x"), (None, "la la la la la la", "x"), (5, "ab cd " * 4, "x"), (5, "ab cd " * 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `runs` string").withColumn("n_words", F.lit(7)).withColumn("a.b", F.lit(1))
    got = sorted((tuple(r) for r in periodic_runs.find_runs(docs).collect()), key=repr)
    expected = sorted(((d, len(words(t)), brute_runs(words(t)), collapsed(words(t), brute_runs(words(t)))) for d, t, _ in rows), key=repr)
    assert [(d, n, [tuple(r) for r in runs], t) for d, n, runs, t in got] == expected
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []


@needs_data
def test_op11_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        w, h = words(text), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 1500:
            continue
        found, r = brute_runs(w), got[doc_id]
        some += bool(found)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert some > 10


def brute_targets(sizes, share, weights, most):
    """Targets by source, in order: the excess is shared again by weight until none is above its bound."""
    budget, w = Fraction(share) * sum(sizes), [weights[k % len(weights)] for k in range(len(sizes))]
    target, free = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free and budget:
        each = budget / sum(w[k] for k in free)
        budget = Fraction(0)
        for k in free:
            target[k] += each * w[k]
        for k in list(free):
            if target[k] >= Fraction(most) * sizes[k]:
                budget += target[k] - Fraction(most) * sizes[k]
                target[k] = Fraction(most) * sizes[k]
                free.discard(k)
    return target


def mixture(spark):
    rnd = random.Random(4)
    rows = [(k, " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 60))), "en", rnd.choice(("a", "a", "a", "B", "é", "", None, "zz"))) for k in range(600)]
    rows += [(None, "x y", "en", "a"), (None, None, None, None), (7, "", "en", "B"), (900, "same words here", "en", "twins"), (900, "same words here", "en", "twins"), (901, " \t", "en", "void"), (902, "long " * 5000, "en", "big")]
    return rows, spark.createDataFrame(rows, KIND).withColumn("hash", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("key", F.lit(2))


@pytest.mark.parametrize("share", [0.4, 1.0, 1.5, 1.99, 3.0])
def test_mix_meets_its_targets(spark, share):
    rows, docs = mixture(spark)
    got = [r.asDict() for r in mixing.mix_sources(docs, share=share).withColumn("n", F.lit(1)).collect()]
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(d), len(words(t))) for d, t, *_ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len(words(t)) for _, t, _, s in rows if s == name) for name in names]
    expected = brute_targets(sizes, share, (3, 1, 2), 2.0)
    taken = {}
    for r in got:
        assert r["taken"] == r["size"] * r["times"] <= 2 * r["size"]
        at = taken.setdefault((r["source_size"], round(r["target"], 6)), [0, 0])
        at[0] += r["taken"]
        at[1] = max(at[1], r["size"])
    wanted = {}
    for n, t, name in zip(sizes, expected, names, strict=True):
        wanted.setdefault((n, round(float(t), 6)), []).append(name)
    assert set(taken) == set(wanted)
    for (_, target), (words_taken, longest) in taken.items():
        assert abs(words_taken - target) <= max(longest, 6) / 2 + 1e-6  # the twins are taken together


def test_mix_is_nested_and_the_same_again(spark):
    _, docs = mixture(spark)
    before = None
    for share in (0.2, 0.5, 0.9, 1.3):
        found = {(r["doc_id"], r["size"]): r["times"] for r in mixing.mix_sources(docs.where("doc_id < 900"), share=share).collect()}
        again = {(r["doc_id"], r["size"]): r["times"] for r in mixing.mix_sources(docs.where("doc_id < 900").repartition(5), share=share).collect()}
        assert found == again
        assert before is None or all(found[k] >= before[k] for k in found)
        before = found


def test_thresholds_below_one_bucket(spark):
    """Hashes that agree in their first 48 bits are told apart by further levels; equal ones are taken together."""
    base = 5 << 48
    rows = [("0a", base + (k << 12) + 7, 10) for k in range(50)] + [("0b", base, 4)] * 3 + [("0c", k << 50, 1) for k in range(100)]
    frame = spark.createDataFrame(rows, "key string, hash long, size long")
    for share in (0.0, 0.1, 0.5, 0.77):
        totals = {"0a": 500, "0b": 12, "0c": 100}
        wanted = spark.createDataFrame([(k, n * share) for k, n in totals.items()], "key string, rest double")
        found = {r["key"]: r["threshold"] for r in mixing.thresholds(frame, mixing._histogram(frame, mixing.LEVEL_BITS), wanted).collect()}
        for key, total in totals.items():
            taken = sum(n for k, h, n in rows if k == key and h < found[key])
            assert abs(taken - total * share) <= (6 if key == "0b" else 5)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], KIND)
    assert mixing.mix_sources(docs).collect() == []
    void = spark.createDataFrame([(1, None, None, None), (2, "", None, "a")], KIND)
    assert sorted(map(tuple, mixing.mix_sources(void).collect())) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


@needs_data
def test_op12_against_sql(spark):
    same_as_sql(spark, queries.op12_source_mixing, queries.oracle_sql()["op12_source_mixing"])


def brute_pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if w]


def brute_phrases(rows, longest, least, within, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for w in brute_pieces(text):
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items() if len(q) > len(p)):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def prose(seed=8, n=150):
    """Odd texts in which phrases come back: across cuts, with white space of all kinds, in several languages and in none."""
    rnd = random.Random(seed)
    fixed = [["new", "York", "city", "hall"], ["a", "priori"], ["in", "spite", "of"], ["é", "Ü", "x"], ["la", "la", "la", "la", "la"], ["nbsp\u00a0word", "next"]]
    rows = [(None, None, None, None), (1, "", "en", None), (2, " ., \n!", "en", None), (3, "new york", None, None), (4, "of.in spite,of in\x0bspite of", "und", None)]
    for k in range(n):
        body = []
        for _ in range(rnd.randrange(1, 25)):
            body += rnd.choice(fixed) if rnd.random() < 0.5 else [rnd.choice(("the", "of", f"w{rnd.randrange(60)}"))]
            body.append(rnd.choice((" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ;")))
        rows.append((k, "".join(x if not x.strip(" \t.,;\n") else x + " " for x in body), rnd.choice(("en", "en", "de", None)), None))
    return rows + [(500, "w1 w2 w3 the of " * 800, "de", None), rows[9], rows[9]]


@pytest.mark.parametrize("longest,least,within,top,block_bytes", [(4, 3, 80, 2000, 400), (4, 3, 50, 7, 1 << 20), (3, 1, 100, 2000, 2000), (2, 5, 80, 2000, 400)])
def test_phrases_against_brute_force(spark, longest, least, within, top, block_bytes):
    rows = prose()
    docs = spark.createDataFrame(rows, KIND).withColumn("chunk", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("n", F.lit(2))
    got = phrases.collocations(docs, longest, least, within, top, block_bytes)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, longest, least, within, top)


def test_chunks_hold_every_phrase_once():
    texts = [t for _, t, *_ in prose()] + [" ".join(f"v{k * k % 97}" for k in range(3000))]
    chunk, own, doc = phrases.chunks(pa.array(texts, pa.string()))
    found, expected = Counter(), Counter()
    for text, n, d in zip(chunk.to_pylist(), own.tolist(), doc.tolist(), strict=True):
        w = text.split(" ")
        assert n <= len(w) <= n + 3
        found.update((d, tuple(w[i : i + k])) for k in range(1, 5) for i in range(n) if i + k <= len(w))
    for d, text in enumerate(texts):
        for w in brute_pieces(text):
            expected.update((d, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert found == expected
    last = [(t, n) for t, n, d in zip(chunk.to_pylist(), own.tolist(), doc.tolist(), strict=True) if d == len(texts) - 1]
    assert len(last) > 20 and len(set(last)) < len(last)  # cut by content: the same passage gives the same chunks


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], KIND)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None), (2, "one two", "en", None)], KIND)).collect() == []


def test_scores_beyond_64_bits(spark):
    a = 4 * 10**18
    rows = [("en", "x", 1, a), ("en", "y", 1, a), ("en", "x y", 2, a - 3)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, a long")).first()
    assert got["score"] == 2_000_000 * (a - 3) // (2 * a)


@needs_data
def test_op13_against_sql(spark):
    same_as_sql(spark, queries.op13_phrase_mining, queries.oracle_sql()["op13_phrase_mining"])
