"""Audit analytics: pairing intents with outcomes, matching grants, roll-ups, labels, destinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.operators.sequences import in_ranges, range_count
from plotwise.storage import bucketed

#: Longest lifetime of a grant, in seconds: a fixed value.
LIFETIME_CEILING_S = 1200
#: Later than any time, and stored bytes that a range of grants and attempts stands for.
_LATEST, _GRANT_BYTES = (1 << 62), 1 << 20


def pair_attempts(records: DataFrame) -> DataFrame:
    """(attempt, state, intent_line, outcome_line): pair, orphan-outcome or orphan-intent.

    An outcome takes the latest intent of its attempt since the outcome before it; an intent that a later one of the same attempt overwrites
    before any outcome is gone. One sort by (attempt, line); attempts are small."""
    good = records.where("corrupt_reason IS NULL")
    w = Window.partitionBy("attempt").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    intent, outcome = F.when(F.col("phase") == "intent", F.col("line_no")), F.when(F.col("phase") == "outcome", F.col("line_no"))
    seen = good.select("attempt", "phase", "line_no", F.last(intent, ignorenulls=True).over(w).alias("intent"), F.last(outcome, ignorenulls=True).over(w).alias("before"))
    fresh = F.col("intent").isNotNull() & (F.col("before").isNull() | (F.col("before") < F.col("intent")))
    outcomes = seen.where("phase = 'outcome'").select(
        "attempt", F.when(fresh, "pair").otherwise("orphan-outcome").alias("state"), F.when(fresh, F.col("intent")).alias("intent_line"), F.col("line_no").alias("outcome_line")
    )
    last = good.groupBy("attempt").agg(F.max(intent).alias("i"), F.max(outcome).alias("o")).where("i IS NOT NULL AND (o IS NULL OR o < i)")
    return outcomes.unionByName(last.select("attempt", F.lit("orphan-intent").alias("state"), F.col("i").alias("intent_line"), F.lit(None).cast(outcomes.schema["outcome_line"].dataType).alias("outcome_line")))


def match_grants(attempts: DataFrame, grants: DataFrame) -> DataFrame:
    """(attempt, verdict, grant_id): granted, or the first reason that stands: no_grant, grant_scope_mismatch, grant_expired.

    attempts: attempt, operation, dataset, content_hash, destination, now_s; grants: grant_id, operation, dataset, content_hash, scope_kind
    (exact or child), scope, granted_s, lifetime_s. The scope is an equi-key: an attempt asks for its destination and for its parent. Of
    several live grants the first by id is taken; of expired ones the one that lapsed last.

    No pairs are made, and no scope is gathered: what a scope's grants begin and end is sorted with its attempts by time, in ranges of any number a
    scope.  A live grant is one that ends later; of those begun before, the one that ends last is closest, of the others the longest.  So each
    attempt needs least values of the rows before it and after it, in its range and in the others of its scope."""
    parent = F.regexp_extract("destination", r"^(.*)/[^/]+$", 1)
    asked = attempts.select("*", F.explode(F.array(F.struct(F.lit("exact").alias("scope_kind"), F.col("destination").alias("scope")), F.struct(F.lit("child").alias("scope_kind"), parent.alias("scope")))).alias("a"))
    asked = asked.select(*attempts.columns, "a.*")
    bounded = grants.withColumn("lifetime_s", F.least("lifetime_s", F.lit(LIFETIME_CEILING_S)))
    key = ["operation", "dataset", "content_hash", "scope_kind", "scope"]
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    ends, begins = F.coalesce(F.try_add("granted_s", "lifetime_s"), F.lit(_LATEST)), F.coalesce("granted_s", F.lit(_LATEST))
    own = F.xxhash64("grant_id").alias("_tie")  # so that many rows of one scope and time don't all fall into one range
    ended = bounded.select(*key, ends.alias("_time"), F.lit(0).alias("_kind"), own, F.when(F.col("lifetime_s") > 0, F.col("grant_id")).alias("live"))
    begun = bounded.select(*key, begins.alias("_time"), F.lit(2).alias("_kind"), own, F.struct((-ends).alias("over"), "grant_id").alias("late"), F.struct((-F.col("lifetime_s")).alias("over"), "grant_id").alias("early"))
    asks = asked.select(*key, F.coalesce("now_s", F.lit(-_LATEST)).alias("_time"), F.lit(1).alias("_kind"), F.xxhash64("attempt").alias("_tie"), "attempt")
    rows = asks.unionByName(ended.unionByName(begun, allowMissingColumns=True), allowMissingColumns=True).where(known)
    ranges = range_count(rows, _GRANT_BYTES)
    rows = bucketed(in_ranges(rows, [*key, "_time", "_kind", "_tie"], ranges), "grant-ranges", ranges, "_range")

    least = {"live": F.desc, "late": F.asc, "early": F.desc}  # of the rows after, before, after
    here, over = Window.partitionBy("_range", *key), Window.partitionBy(*key)
    per = rows.groupBy("_range", *key).agg(*(F.min(c).alias(c) for c in least))
    others = {c: over.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1) for c, way in least.items()}
    # only scopes that lie in several ranges, of which a range has two at most
    carried = per.withColumn("_spans", F.count("*").over(over)).select("_range", *key, "_spans", *(F.min(c).over(w).alias(f"o_{c}") for c, w in others.items())).where("_spans > 1").drop("_spans")
    seen = rows.select("_range", *key, "_kind", "_time", "attempt", *(F.min(c).over(here.orderBy(way("_place")).rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c, way in least.items()))
    told = seen.where("_kind = 1").join(F.broadcast(carried), ["_range", *key], "left").select("attempt", "_time", *(F.least(c, f"o_{c}").alias(c) for c in least))
    late = F.when(F.col("late").isNotNull(), F.struct((F.col("late.over") + F.col("_time")).alias("over"), F.col("late.grant_id").alias("grant_id")))
    best = told.groupBy("attempt").agg(F.min("live").alias("live_id"), F.min(F.least(late, "early")).alias("closest"))
    operations = grants.select("operation").distinct().withColumn("_known", F.lit(True))
    joined = attempts.select("attempt", "operation").join(best, "attempt", "left").join(operations, "operation", "left")
    verdict = F.when(F.col("_known").isNull(), "no_grant").when(F.col("closest").isNull(), "grant_scope_mismatch").when(F.col("live_id").isNull(), "grant_expired").otherwise("granted")
    return joined.select("attempt", verdict.alias("verdict"), F.coalesce("live_id", "closest.grant_id").alias("grant_id"))


def normalize_destination(path: Column, roots: Sequence[tuple[str, str]], usernames: Sequence[str]) -> Column:
    """A path for a log: verbatim prefix off, one kind of separator, the longest profile root as its token, user names as <user>."""
    unc = path.startswith("\\\\?\\UNC\\")
    bare = F.when(unc, F.concat(F.lit("\\\\"), F.substring(path, 9, 1 << 30))).when(path.startswith("\\\\?\\"), F.substring(path, 5, 1 << 30)).otherwise(path)
    slashed = F.replace(bare, F.lit("\\"), F.lit("/"))
    rooted = slashed
    for root, token in sorted(roots, key=lambda r: len(r[0])):  # the longest stands outermost, so it is asked first
        inside = (F.lower(slashed) == root.lower()) | F.lower(slashed).startswith(root.lower() + "/")
        rooted = F.when(inside, F.concat(F.lit(token), F.substring(slashed, len(root) + 1, 1 << 30))).otherwise(rooted)
    if not usernames:
        return rooted
    users = [u.lower() for u in usernames]
    return F.array_join(F.transform(F.split(rooted, "/", -1), lambda c: F.when(F.lower(c).isin(users), F.lit("<user>")).otherwise(c)), "/")


def plain_date(at: Column) -> Column:
    """`2026-08-17T08:44:08Z` as `2026-08-17 08:44`; what doesn't look so stays."""
    return F.when((F.length(at) >= 16) & (F.substring(at, 11, 1) == "T"), F.concat(F.substring(at, 1, 10), F.lit(" "), F.substring(at, 12, 5))).otherwise(at)


def words_of(code: Column) -> Column:
    """A code in CamelCase as lower-case words, whatever codes there are."""
    return F.lower(F.regexp_replace(code, "([a-z0-9])([A-Z])", "$1 $2"))


def labelled(df: DataFrame, column: str, labels: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """The rows with a plain label for a code; an unknown code is shown as itself. The label table is a literal, broadcast."""
    table = F.broadcast(df.sparkSession.createDataFrame(list(labels), f"_code string, {name} string"))
    joined = df.join(table, df[column] == table["_code"], "left")
    return joined.select(*df.columns, F.coalesce(name, column).alias(name))
