"""Benchmark decontamination by SimHash windows and a multi-index (operator 2); DataFrame functions only.

A text is its lower-cased words, and its shingles are the hashes of five consecutive words.  A window of a document is as long as an item has
shingles; every start is tried.  A window can only reach the similarity t to an item of n shingles if t * n of its places hold shingles of
items of that length, so all others are passed over before any fingerprint is made; which item it may be, that does not say.

A fingerprint has 63 bits, each the weighted vote of the window's shingles (a shingle weighs as often as it occurs).  The multi-index cuts
fingerprints to 4 blocks of 16 bits: two within RADIUS = 15 differ by at most 3 bits in some block, so looking up each block among the items'
blocks with up to 3 bits flipped finds every item of the window's length within the radius; a block meets about one item in a hundred by
chance.  The items found for any window of a document are verified on all its windows of that length, by the exact similarity of the weighted
shingles: sum of lesser weights over sum of greater ones, 0.75 or more.  At similarity 0.75 two fingerprints differ by 10.8 +- 3.0 bits, so
one window just at the bound is found with a probability of 0.94, and its neighbours are tried too; a test measures the recall.

Cases.  Null or empty text of a document or an item: no words, never a match.  Fewer than five words: the whole text is one shingle.  An item longer
than what is left of the document: the window ends with the document.  Repeated rows and items: one result for each pair of ids.  A null doc_id
or item_id is an id like another.  Ties: of equally similar windows the first is reported.  Very long texts are hashed whole.  No rows of
either table: no result.  Items have fewer than 2**21 shingles.  Only doc_id, item_id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm.shared import saved

WORDS = 5
SIMILARITY = 0.75
LANES, LANE_BITS = 3, 21
BLOCKS, BLOCK_BITS, FLIPS = 4, 16, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Item shingles up to so many rows are broadcast (16 bytes each and their overhead); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles, in order; none for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.aggregate(  # binds the words once
        F.array(words),
        F.array().cast("array<bigint>"),
        lambda _, w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(WORDS))))
        ),
    )


def fingerprint(window: Column) -> Column:
    """63 bits; bit b is set if more than half of the shingles have it. Three counters of 21 bits share each sum."""
    mask = sum(1 << (LANE_BITS * lane) for lane in range(LANES))
    half = F.size(window)
    bits = F.lit(0).cast("bigint")
    def add(k: int):
        return lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask))

    for k in range(LANE_BITS):
        votes = F.aggregate(window, F.lit(0).cast("bigint"), add(k))
        for lane in range(LANES):
            count = F.shiftrightunsigned(votes, LANE_BITS * lane).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
            bits = bits + F.when(2 * count > half, F.lit(1 << (LANE_BITS * lane + k)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return bits


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("bigint"))


def _flips() -> list[int]:
    """All masks of a block of up to so many bits."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= FLIPS]


def weighted_overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the lesser of the two counts."""
    both = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))

    def count(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == h))

    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h))))


def _row_hash(text: Column) -> Column:
    """With doc_id it tells rows apart whose texts differ."""
    return F.xxhash64(text.cast("string"))


def item_windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, row, n, start, window, fp) of all windows with enough places that hold a shingle of items of n shingles. items: shingles and n of each."""
    known = items.select(F.explode("shingles").alias("h"), "n").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    text = F.col("text")
    places = docs.select("doc_id", _row_hash(text).alias("row"), F.posexplode(shingles(text)).alias("p", "h")).join(known, "h")
    counts = places.groupBy("doc_id", "row", "n").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    counts = counts.withColumn("need", F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int")).where(F.size("ps") >= F.col("need"))
    ranges = F.expr("filter(transform(sequence(0, size(ps) - need), k -> struct(greatest(ps[k + need - 1] - n + 1, 0) AS lo, ps[k] AS hi)), r -> r.lo <= r.hi)")
    starts = counts.select("doc_id", "row", "n", F.explode(ranges).alias("r")).select("doc_id", "row", "n", F.explode(F.sequence("r.lo", "r.hi")).alias("start")).distinct()
    starts = starts.groupBy(F.col("doc_id").alias("id"), "row").agg(F.collect_list(F.struct("n", "start")).alias("at"))
    own = docs.select("doc_id", "text")
    met = own.join(starts, own["doc_id"].eqNullSafe(starts["id"]) & (_row_hash(own["text"]) == starts["row"]))
    cut = met.select("doc_id", "row", shingles(F.col("text")).alias("shingles"), "at").select("doc_id", "row", "shingles", F.explode("at").alias("at"))
    windows = cut.select("doc_id", "row", "at.n", "at.start", F.expr("slice(shingles, at.start + 1, at.n)").alias("window"))
    return saved(windows.withColumn("fp", fingerprint(F.col("window"))), "benchmark-windows")


def near_items(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(n, fp, item_id): for each fingerprint the items of that length within the radius, through the multi-index."""

    def at(fp: Column, b: int):
        return lambda mask: F.struct(F.lit(b).alias("block"), _block(fp, b).bitwiseXOR(mask).alias("value"))

    def blocks(fp: Column, masks: list[int]) -> Column:
        every = F.array(*map(F.lit, masks)).cast("array<bigint>")
        return F.explode(F.flatten(F.array(*(F.transform(every, at(fp, b)) for b in range(BLOCKS)))))

    index = items.select("item_id", "n", F.col("fp").alias("item_fp"), blocks(F.col("fp"), _flips()).alias("at")).select("item_id", "n", "item_fp", "at.*")
    asked = windows.select("n", "fp").distinct().select("n", "fp", blocks(F.col("fp"), [0]).alias("at")).select("n", "fp", "at.*")
    index = index.hint("merge")  # Spark takes it for as small as the items are, and would broadcast it
    return asked.join(index, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("n", "fp", "item_id").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_windows) of each document that holds a benchmark item: the best window, and how many match."""
    items = items.select("item_id", shingles(F.col("text")).alias("shingles")).where(F.size("shingles") > 0)
    items = saved(items.select("item_id", "shingles", F.size("shingles").alias("n"), fingerprint(F.col("shingles")).alias("fp")), "benchmark-items")
    windows = item_windows(docs, items, similarity)
    near = near_items(windows, items)
    candidates = windows.select(F.col("doc_id").alias("id"), F.col("row").alias("r"), "n", "fp").join(near, ["n", "fp"]).select("id", "r", F.col("n").alias("m"), "item_id").distinct()
    tried = windows.join(candidates, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")) & (F.col("n") == F.col("m")))
    whole = items.select(F.col("item_id").alias("item"), "shingles", F.col("n").alias("size"))
    pairs = tried.join(whole, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("n") == F.col("size")))
    pairs = pairs.withColumn("common", weighted_overlap(F.col("window"), F.col("shingles")))
    pairs = pairs.withColumn("similarity", F.col("common") / (F.size("window") + F.size("shingles") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    found = pairs.groupBy("doc_id", "item_id").agg(best, F.count_distinct("start").alias("n_windows"))
    return found.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), "n_windows")


def clean_documents(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    leaks = find_leaks(docs, items, similarity).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leaked_id"]), "left_anti")
