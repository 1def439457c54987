"""Operators that learn: normalised probabilities, held-out accuracy, edge cases."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from plotwise.llm import language, lm, ppm, toxicity
from plotwise.llm import text as tx

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
KIND = "doc_id long, text string, lang string, score string"


def trained(texts, order, context=None):
    """A whole model; or, of `context` bytes, one that is put together from the lower orders and a part for each context."""
    keys, counts = np.unique(ppm.gram_keys(*tx.flat(pa.array(texts)), order)[0], return_counts=True)
    levels = ppm.shorter(keys, counts, order)
    return ppm.Model(levels) if context is None else ppm.Model(levels[context:], ppm.Model(levels[:context]))


@pytest.mark.parametrize("context", [None, 3])
def test_probabilities_of_all_symbols_sum_to_one(context):
    rnd = random.Random(4)
    model = trained(["".join(rnd.choice(["the ", "cat ", "é", "\n", "thing "]) for _ in range(40)) for _ in range(30)], 4, context)
    keys, _ = ppm.gram_keys(*tx.flat(pa.array(["the cat é then", "zzz", ""])), 4)
    for context in keys >> np.uint64(8):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.score(every)).sum() - 1) < 1e-9


def naive_log10(text, counts, order):
    """PPM with method D and exclusion, symbol by symbol, from plain dictionaries of context to counts."""
    padded, total = b"\xff" * order + text.encode() + b"\xff", 0.0
    for k in range(order, len(padded)):
        symbol, out = padded[k], set()
        for j in range(order, -1, -1):
            seen = counts[j].get(padded[k - j : k])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in out}
            n = sum(left.values())
            if symbol in left:
                total += math.log10((left[symbol] - 0.5) / n)
                break
            if left:
                total += math.log10(len(left) / 2 / n)
            out |= set(seen)
        else:
            total -= math.log10(256 - len(out))
    return total


def naive_counts(texts, order):
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        padded = b"\xff" * order + t.encode() + b"\xff"
        for k in range(order, len(padded)):
            for j in range(order + 1):
                counts[j].setdefault(padded[k - j : k], Counter())[padded[k]] += 1
    return counts


@pytest.mark.parametrize("part_blocks", [1024, 2])
def test_distributed_scores_equal_a_plain_model(spark, part_blocks):
    """The whole query, over many blocks, buckets and parts, against dictionaries."""
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(["The", "the", "cat", "Ähm", "x", "thereof", "\n"]) for _ in range(rnd.randrange(0, 40))), "en", "s") for k in range(80)]
    rows += [(90, None, None, None), (91, "", None, None), (5, "repeated id", None, None), (None, "no id", None, None), (92, "the cat " * 20_000, None, None)]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    counts = naive_counts([t or "" for (_, t, *_), h in zip(rows, held, strict=True) if not h], lm.ORDER)
    expected = sorted(((d, naive_log10(t or "", counts, lm.ORDER)) for d, t, *_ in rows), key=repr)
    found = lm.score_documents(spark.createDataFrame(rows, KIND), toxicity.held_out(F.col("doc_id"), 7), block_bytes=1 << 12, part_blocks=part_blocks).collect()
    got = sorted(((r.doc_id, r.score) for r in found), key=repr)
    assert sorted(map(str, (d for d, _ in got))) == sorted(map(str, (d for d, _ in expected)))
    by = {}
    for d, s in expected:
        by.setdefault(d, []).append(s)
    for d, s in got:
        assert min(abs(s - e) / max(1, abs(e)) for e in by[d]) < 1e-5


def test_scores_equal_a_plain_model():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab cé\n") for _ in range(30)) for _ in range(12)]
    counts = naive_counts(texts, 3)
    model = trained(texts, 3)
    for t in [*texts[:3], "", "abz", "ééé x"]:
        keys, _ = ppm.gram_keys(*tx.flat(pa.array([t])), 3)
        assert abs(model.score(keys).sum() - naive_log10(t, counts, 3)) < 1e-9


def test_lm_cases_by_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["The", "the", "cat", "Ähm", "x"]) for _ in range(rnd.randrange(0, 20))), "en", "s") for k in range(60)] + [(61, None, None, None), (62, "", None, None), (5, "repeated id", None, None), (None, "no id", None, None)]
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = [(r[0], h, len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, tokens, held, strict=True)]
    found = lm.score_documents(spark.createDataFrame(rows, KIND), toxicity.held_out(F.col("doc_id"), 7)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.score < 0 for r in found)
    assert lm.score_documents(spark.createDataFrame([], KIND), F.lit(False)).count() == 0
    alone = lm.score_documents(spark.createDataFrame([(1, "ab", None, None)], KIND), F.lit(True)).first()
    assert (alone.n_known, alone.train_tokens, alone.base_score) == (0, 0, 0.0) and abs(alone.score + 3 * math.log10(256)) < 1e-5  # 32-bit answers


@needs_data
def test_held_out_texts_are_likelier_than_by_words(spark):
    found = lm.score_documents(spark.read.parquet(f"{DATA}/documents.parquet"), toxicity.held_out(F.col("doc_id"), 7)).where("NOT held_out")
    sums = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_language_cases(spark):
    rows = [(k, ("the house and the river are there " if k % 2 else "das haus und der fluss sind dort ") * 3, "en" if k % 2 else "de", "x") for k in range(40)]
    learned = language.learn(spark.createDataFrame(rows, KIND))
    asked = [(1, "the river and the house", "zz", None), (2, "das haus und der fluss", None, None), (3, None, None, None), (4, "", None, None), (5, "123 !? …", None, None), (6, "éé", None, None), (1, "der fluss", None, None), (None, "the house", None, None)]
    found = sorted(((r.doc_id, r.lang_pred) for r in language.predict(spark.createDataFrame(asked, KIND), learned).collect()), key=repr)
    assert found == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (1, "de"), (None, "en")], key=repr)
    nothing = language.learn(spark.createDataFrame([], KIND))
    assert {r.lang_pred for r in language.predict(spark.createDataFrame(asked, KIND), nothing).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], KIND), learned).count() == 0


def test_languages_by_brute_force(spark):
    """Plain sets of n-grams instead of filters, over the whole query: the same languages, and scores that differ by no more than the filters' errors."""
    rnd = random.Random(12)
    pools = {"en": "the and river house there with stone water light over".split(), "de": "das und fluss haus dort mit stein wasser licht über".split(), "es": "el y río casa allí con piedra agua luz sobre".split()}
    rows = [(k, " ".join(rnd.choice(pools[lang]) for _ in range(rnd.randrange(3, 40))), lang, "x") for k in range(150) for lang in [rnd.choice(list(pools))]]
    rows += [(900, "The river " * 20_000, "en", "x"), (5, rows[5][1], rows[5][2], "x"), (901, "", "en", "x"), (902, None, "de", "x")]
    asked = [*rows, (903, "das haus dort casa", None, None), (904, "\u2003…", None, None)]

    def grams(text):
        folded = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text or "").encode()
        padded = b"  " + folded + b" "
        return [g for i in range(len(padded) - 3) if (g := padded[i : i + 4]) != b"    "]

    texts = Counter(lang for _, t, lang, _ in rows if t is not None)
    have = {lang: Counter() for lang in pools}
    for _, t, lang, _ in rows:
        if t is not None:
            have[lang].update(set(grams(t)))
    rate = {lang: {g: n / texts[lang] for g, n in c.items() if n / texts[lang] >= language.LEAST_SHARE} for lang, c in have.items()}
    best = {}
    for c in rate.values():
        for g, r in c.items():
            best[g] = max(best.get(g, 0), r)
    kept = {lang: {g for g, r in c.items() if r >= language.LEAST_OF_BEST * best[g]} for lang, c in rate.items()}
    learned = language.learn(spark.createDataFrame(rows, KIND))
    assert {(r.lang, int(r.gram).to_bytes(4, "big")) for r in learned.collect()} == {(lang, g) for lang, c in kept.items() for g in c}
    found = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(asked, KIND), learned).collect()), key=repr)
    expected = []
    for d, t, *_ in asked:
        g = grams(t)
        hits = {lang: sum(x in kept[lang] for x in g) for lang in sorted(pools)}
        top = max(hits, key=hits.get)
        expected.append((d, top if any(map(str.isalpha, t or "")) else "und", hits[top] / max(1, len(g)) if any(map(str.isalpha, t or "")) else 0.0))
    for (d, lang, score), (e, true, exact) in zip(found, sorted(expected, key=repr), strict=True):
        assert d == e and lang == true and abs(score - exact) < 0.01
    few = language.learn(spark.createDataFrame(rows, KIND), texts=7)
    assert max(r.texts for r in few.select("texts").distinct().collect()) <= 7 < min(texts.values())


def test_toxicity_by_brute_force(spark):
    """FTRL-proximal over dictionaries, with the features of a text written as a loop."""
    rnd = random.Random(3)
    pool = "you foul fine day tree moon vile kind word number".split()
    docs = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 25))), "en", "x") for k in range(160)] + [(500, None, None, None), (501, "You, FOUL! " * 3000, None, None), (7, "a repeated id", None, None)]
    labels = [(k, 1, int("foul" in (t or "").split() or "vile" in (t or "").split())) for k, t, *_ in docs if k is not None and k < 120 and k != 7]
    p = toxicity.Ftrl(l1=0.5)

    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [int(h) for h in tx.word_hashes(*[np.array(x) for x in hashed(lower)])] if lower.strip() else []
        top = lambda h: h >> (64 - toxicity.BITS)
        mixed = lambda h: int(tx.mix(np.array([h % 2**64], np.uint64))[0])
        return sorted({top(h) for h in w} | {top(mixed(a * 3 + b)) for a, b in zip(w, w[1:])} | {top(mixed(a * 5 + b * 7)) for a, b in zip(w, w[2:])})  # noqa: B905

    def hashed(lower):
        spans = [m.span() for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", lower)]
        at = [len(lower[:a].encode()) for a, _ in spans], [len(lower[:b].encode()) for _, b in spans]
        return np.frombuffer(lower.encode(), np.uint8), np.array(at[0], np.int64), np.array(at[1], np.int64)

    order = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", "toxic", F.xxhash64("doc_id").alias("rank")).orderBy("rank").collect()
    text = dict((d, t) for d, t, *_ in docs)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -math.copysign(abs(z[i]) - p.l1, z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for r in order:
            i = [*features(text[r.doc_id]), "bias"]
            g = 1 / (1 + math.exp(-sum(map(weight, i)))) - r.toxic
            for k in i:
                w, was = weight(k), n.get(k, 0.0)
                n[k] = was + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(was)) / p.alpha * w
    weights = toxicity.train(spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), p=p)
    assert 0 < weights.count() < 2**10  # sparse
    found = sorted(((r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame(docs, KIND), weights).collect()))
    expected = sorted((d, 1 / (1 + math.exp(-max(-35, min(35, sum(map(weight, [*features(t), "bias"]))))))) for d, t, *_ in docs)
    assert [d for d, _ in found] == [d for d, _ in expected] and max(abs(a - b) for (_, a), (_, b) in zip(found, expected, strict=True)) < 1e-4


def test_many_languages_share_filters():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 32, 200, dtype=np.uint64).astype(np.uint32) for _ in range(70)]
    filters = language.Filters([f"l{k:02}" for k in range(70)], sets, 0)
    for k in (0, 63, 64, 69):
        hits = filters.hits(sets[k], np.array([0, len(sets[k])]))[0]
        assert np.argmax(hits) == k and hits[k] > 195


@needs_data
def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = toxicity.held_out(F.col("doc_id"))
    found = language.predict(docs.where(out), language.learn(docs.where(~out))).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_toxicity_cases(spark):
    docs = [(k, ("you foul person number " if k % 3 == 0 else "a fine day number ") + f"w{k}", "en", "x") for k in range(120)]
    labels = [(k, 1, 1 if k % 3 == 0 else 0) for k in range(90)] + [(3, 1, 1), (4, 1, None), (9999, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = toxicity.train(spark.createDataFrame(docs, KIND), labels)
    asked = [*docs[90:], (500, None, None, None), (501, "", None, None), (90, "you foul", None, None), (None, "a fine day", None, None)]
    found = toxicity.score(spark.createDataFrame(asked, KIND), weights).collect()
    assert len(found) == len(asked) and all(0 <= r.score <= 1 for r in found)
    right = [(r.score >= 0.3) == (r.doc_id % 3 == 0) for r in found if r.doc_id is not None and r.doc_id < 120]
    assert sum(right) >= len(right) - 1
    none = toxicity.train(spark.createDataFrame([], KIND), labels)
    assert {r.score for r in toxicity.score(spark.createDataFrame(asked, KIND), none).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_toxicity_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.score(docs.where(out), toxicity.train(docs.where(~out), labels.where(~out))).join(labels, "doc_id")
    rows = scored.select("score", "toxic").toPandas()
    said, true = rows["score"] >= toxicity.THRESHOLD, rows["toxic"] == 1
    assert (said & true).sum() / said.sum() > 0.85 and (said & true).sum() / true.sum() > 0.7
