"""The training-data operators as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm import byte_bpe, decontaminate, jaccard_join, language, line_dedup, lm, mixing, periodic_runs, phrases, quality, substring_dedup, toxicity, url_filter

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
keyed AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM keyed) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM dup),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM pos ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _shingles_sql(table: str, key: str, place: str) -> str:
    return f"""(SELECT {key}, i - 1 AS {place}, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT {key}, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM
      (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM {table}) WHERE len(w) > 0))"""


_OP2_SQL = f"""
WITH s AS MATERIALIZED {_shingles_sql("documents", "doc_id", "p")}, i AS MATERIALIZED {_shingles_sql("benchmark", "item_id", "q")},
m AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id), ic AS (SELECT item_id, k, count(*) AS c FROM i GROUP BY ALL),
w AS (SELECT DISTINCT doc_id, n, unnest(generate_series(greatest(p - n + 1, 0), p)) AS start FROM (SELECT DISTINCT doc_id, p, n FROM s JOIN i USING (k) JOIN m USING (item_id))),
wc AS (SELECT w.doc_id, n, start, k, count(*) AS c FROM w JOIN s ON s.doc_id = w.doc_id AND p >= start AND p < start + n GROUP BY ALL),
ws AS (SELECT doc_id, n, start, sum(c) AS size FROM wc GROUP BY ALL),
o AS (SELECT doc_id, wc.n, start, ic.item_id, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic USING (k) JOIN m ON m.item_id = ic.item_id AND m.n = wc.n GROUP BY ALL),
f AS (SELECT doc_id, item_id, start, (common / (size + n - common))::DOUBLE AS similarity FROM o JOIN ws USING (doc_id, n, start))
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start)) AS first_word, count(DISTINCT start) AS n_windows
FROM f WHERE similarity >= {decontaminate.SIMILARITY} GROUP BY ALL
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    weights = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    found = toxicity.score(docs, weights)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(_read(spark, sf_dir, "documents"))


def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of op4_jaccard_join: each two class representatives that link."""
    return jaccard_join.link_documents(_read(spark, sf_dir, "documents"))[1]


_OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM (SELECT doc_id, md5(string_agg(k, chr(10) ORDER BY k)) AS h FROM s GROUP BY doc_id)),
g AS (SELECT x AS class_id, count(*) AS n_links FROM e JOIN k a ON a.doc_id = x AND a.class_id = x JOIN k b ON b.doc_id = y AND b.class_id = y GROUP BY x)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, coalesce(any_value(k.class_id), doc_id)::BIGINT AS class_id,
  coalesce(any_value(g.n_links), 0)::BIGINT AS n_links
FROM r LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN g ON g.class_id = k.class_id GROUP BY doc_id
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _hits_sql(terms: list[str]) -> str:
    """How many of the terms stand in the url between characters other than a-z, 0-9."""
    return f"len(list_intersect(regexp_extract_all(u, '[a-z0-9]+'), [{', '.join(map(repr, terms))}]))"


_OP5_SQL = f"""
WITH c AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_ASCII_LOWER.format("url")} AS u, {_ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM c),
rules(says, rule, dom, pre) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES)}),
fit AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(says, len(rule)) AS says
        FROM p JOIN rules ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule,
  coalesce(says, CASE WHEN {_hits_sql(url_filter.STRICT)} >= 1 OR {_hits_sql(url_filter.SOFT)} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("longest_repeat")


def _repeats_sql(m: int) -> str:
    """Starts of m-word windows found twice or more in their document."""
    return f"""(SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM
      (SELECT doc_id, i, md5(array_to_string(w[i : i + {m - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {m - 1})) AS i FROM d WHERE len(w) >= {m}))) WHERE c > 1)"""


def _covered_sql(m: int) -> str:
    return f"(SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {m - 1})) FROM {_repeats_sql(m)}) GROUP BY doc_id)"


_LIMITS = quality.Limits()
_OP6_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
a AS {_covered_sql(_LIMITS.window)}, b AS {_covered_sql(_LIMITS.long_repeat)},
z AS (SELECT DISTINCT doc_id FROM {_repeats_sql(_LIMITS.longest + 1)}),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
        coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS n_long_repeat_words, z.doc_id IS NOT NULL AS too_long
      FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)),
g AS (SELECT *, n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.max_repeat_percent} * n_words AS base_failed FROM f)
SELECT * EXCLUDE (too_long), NOT base_failed AND 100 * n_long_repeat_words <= {_LIMITS.max_long_percent} * n_words AND NOT too_long AS kept FROM g
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_facts.n_lines", "line_facts.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_OP7_SQL = f"""
WITH l AS (SELECT doc_id, j, line, {_ASCII_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM
  (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS j FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT k FROM l WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
m AS (SELECT l.*, hot.k IS NULL AS stays FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 7))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = toxicity.held_out(F.col("doc_id"))
    found = language.predict(docs, language.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a hash of its id, repeats its words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, n, g = F.col("w"), F.size("w"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    worded = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    again = F.transform(w, lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(w, F.col("a") + (i - F.col("a")) % F.col("p"))))
    placed = worded.select("doc_id", "text", "w", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    return placed.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_made_periodic(_read(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    top = F.reduce("runs", none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.format_string("%d,%d,%d\n", x["start"], x["length"], x["period"])), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * top.length) div top.period")
    return told.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS nameless, len({_WORDS})::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, {mixing.HASH_BITS // 4}))::BIGINT AS hash FROM documents),
g AS (SELECT source, nameless, sum(size)::BIGINT AS n FROM d GROUP BY ALL),
s AS (SELECT *, {list(mixing.WEIGHTS)}[1 + (row_number() OVER (ORDER BY nameless, source) - 1) % {len(mixing.WEIGHTS)}] AS w FROM g),
o AS (SELECT *, {mixing.SHARE} * (sum(n) OVER ())::DOUBLE AS budget, sum(w) OVER (ORDER BY n / w, nameless, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
        coalesce(sum({mixing.MOST} * n) OVER (ORDER BY n / w, nameless, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS taken_before FROM s),
f AS (SELECT *, w * (budget - taken_before) >= {mixing.MOST} * n * weights AS capped FROM o),
l AS (SELECT any_value(budget) - coalesce(sum({mixing.MOST} * n) FILTER (capped), 0)::DOUBLE AS rest, coalesce(sum(w) FILTER (NOT capped), 1) AS weights FROM f),
t AS (SELECT source, nameless, n, CASE WHEN capped THEN {mixing.MOST}::DOUBLE * n ELSE w::DOUBLE * l.rest / l.weights::DOUBLE END AS target FROM f, l),
k AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT doc_id, size, n, target, whole, target - whole * n AS rest, sum(size) OVER (PARTITION BY source, nameless ORDER BY hash) AS through,
        sum(size) OVER (PARTITION BY source, nameless, hash) AS own FROM d JOIN k USING (source, nameless))
SELECT doc_id, size, n AS source_size, target, (size * (whole + (2 * rest >= 2 * through - own)::BIGINT))::BIGINT AS taken FROM c
"""


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


_OP13_SQL = f"""
WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
  (SELECT lang, unnest(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM
  (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES {", ".join(f"({k})" for k in range(1, phrases.LONGEST + 1))}) s(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, j, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS within FROM
  (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE within IS NULL OR 100 * within < {phrases.WITHIN_PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= {phrases.TOP}
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_toxicity, op4_jaccard_join, op4_jaccard_links, op5_url_filters, op6_quality_rules, op7_line_dedup, op8_lm_scoring, op9_language_id, op10_byte_bpe, op11_periodic_runs, op12_source_mixing, op13_phrase_mining)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1_SQL, "op2_decontamination": _OP2_SQL, "op4_jaccard_join": _OP4_SQL, "op5_url_filters": _OP5_SQL, "op6_quality_rules": _OP6_SQL, "op7_line_dedup": _OP7_SQL, "op12_source_mixing": _OP12_SQL, "op13_phrase_mining": _OP13_SQL}
