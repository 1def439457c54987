"""URL filter: rules by host and path first, then a weighted vocabulary (operator 5).

An Aho-Corasick automaton over the vocabulary reads each url once.  A hit counts where it is bounded by characters other than a-z, 0-9.  One
strict term rejects; soft terms reject when their distinct hits weigh 1 together.  The automaton is built once a task from the terms given.

Cases.  Null url, or one without `://`: host and path are empty, no rule fits; the vocabulary still reads the url; null is allowed.  Repeated
rows: a row each.  No rows: no rows.  Very long urls are read whole.  Ties: of equal rules there is one only; a term counts once, however often
it is hit.  Nothing is shuffled; columns other than page_id and url are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): fixed by the contract; the longest that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The terms of the default vocabulary; any other table of terms (a-z, 0-9) and weights can be given instead.
STRICT = """casino casinos poker blackjack roulette slots jackpot bets betting bookmaker sportsbook porn porno xxx hentai escort escorts camgirl camgirls nudes
viagra cialis levitra pills steroids warez keygen torrent torrents malware phishing ransomware""".split()
SOFT = """ads adserver advert banner popup popunder track tracker tracking click clicks clickbait free cheap discount coupon bonus win winner prize giveaway
download cracked serial adult dating singles sexy loan loans payday crypto bitcoin forex miracle detox slim""".split()
#: Weight of each term; 1 or more is strict.
VOCABULARY = dict.fromkeys(STRICT, 1.0) | dict.fromkeys(SOFT, 0.5)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url by plain cutting; both empty without `://`."""
    rest = F.when(url.contains("://"), F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(RULES, key=lambda r: len(r[1])):  # a longer rule is asked later, and so stands outside
        domain, slash, below = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _reader(vocabulary: Mapping[str, float]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            machine.add_word(term, (term, weight))
        machine.make_automaton()
        lower = str.maketrans(_UPPER, _UPPER.lower())
        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            blocked, terms = [], []
            for url in batch.column("url").to_pylist():
                url = (url or "").translate(lower)
                hits = {}
                for end, (term, weight) in machine.iter(url) if vocabulary else ():
                    begin = end - len(term)
                    if (begin < 0 or url[begin] not in inner) and (end + 1 == len(url) or url[end + 1] not in inner):
                        hits[term] = weight
                terms.append(sorted(hits))
                blocked.append(sum(hits.values()) >= 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(blocked, pa.bool_()), pa.array(terms, pa.list_(pa.string()))],
                names=["page_id", "host", "path", "rule", "ruled", "blocked", "terms"],
            )

    return read


def judge_urls(pages: DataFrame, vocabulary: Mapping[str, float] = VOCABULARY) -> DataFrame:
    """(page_id, host, path, rule, verdict, terms) for each page; terms are the distinct vocabulary hits. The vocabulary goes to every task: it is a word list, not a table that grows."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"))
    found = cut.select("*", rule.alias("rule"), ruled.alias("ruled")).mapInArrow(
        _reader(dict(vocabulary)), f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, ruled string, blocked boolean, terms array<string>"
    )
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "terms")
