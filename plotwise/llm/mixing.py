"""Mixing sources to target weights by hash-threshold histograms (operator 12).

A document's size is its number of words.  Sources get weights in their order; a source's target is its share of a budget, at most so many times
its size, and what it can't take is shared again.  A source is taken whole as often as its target allows; of the rest of the target, the documents
below a threshold of a 60-bit hash are taken once more.  The threshold comes from a histogram: sizes are summed by source and by the hash's first
12 bits, the running sums tell the bucket in which the rest ends, and only that bucket's documents are summed again by the next 12 bits, until it
holds one document.  That one is taken if this comes nearer to the target.  So no documents are sorted, and thresholds are nested: a larger
target takes all documents that a smaller one takes.

Texts are read once; a row (id, source, size, hash) a document is kept in the shared folder.  Histograms have 4 096 rows a source, and are joined to
the documents by source and bucket, so a hot source is spread over its buckets.  No table goes to the driver: each round of sharing brings it two numbers.

Cases.  Null or empty text: size 0, nothing is taken.  Null source: a source of its own, the last one; an empty one is a source as others.
A very long text counts whole, and is taken whole: targets are met to half the document in which they end.  Ties and repeated rows: the hash is of
id and text, so rows equal in both are taken together; null ids are as good as any.  Sources without words: target 0.  No documents: no rows.
Only doc_id, text and source are read; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.llm.shared import saved
from plotwise.operators.sequences import global_ordinal

SHARE, WEIGHTS, MOST = 1.5, (3, 1, 2), 2.0
#: Bits of a hash (15 hexadecimal digits), and those that a histogram tells apart.
HASH_BITS, LEVEL_BITS = 60, 12


def source_key(source: Column) -> Column:
    """Text that sorts by code points, with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 of id and text, as a long."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, hash) of each document."""
    text = F.col("text").cast("string")
    n = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", source_key(F.col("source")).alias("key"), n.alias("size"), document_hash(F.col("doc_id"), text).alias("hash"))


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (key, source_size, weight), with their targets: what is over `most` times a source's size is shared again, till none is."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, weight, bound = share * total, F.col("weight").cast("double"), F.col("source_size") * most
    rest, weights = budget, sources.agg(F.sum("weight")).first()[0] or 0
    while True:  # a round takes at least one source out, and mostly all that there are to take
        over = weight * rest >= bound * weights
        full, left = sources.agg(F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        if not left or left == weights:
            break
        rest, weights = budget - (full or 0.0), left
    return sources.withColumn("target", F.when(over, bound).otherwise(weight * F.lit(rest) / F.lit(float(weights or 1))))


def _histogram(rows: DataFrame, bits: int) -> DataFrame:
    """(key, bucket, n, size) by the first bits of the hash."""
    return rows.groupBy("key", F.shiftright("hash", HASH_BITS - bits).alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _boundary(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bucket of each source (key, rest) in which the rest ends: (key, bucket, n, size, rest), rest being what is wanted of it."""
    through = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))
    sums = histogram.withColumn("before", through - F.col("size")).join(wanted, "key")
    ends = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))
    return sums.where(ends).select("key", "bucket", "n", "size", (F.col("rest") - F.col("before")).alias("rest"))


def thresholds(rows: DataFrame, histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, threshold): documents with hashes below it add up to about the rest that is wanted (key, rest); a source without rest has no row.

    rows (key, hash, size) and their histogram by the first 12 bits."""
    found, bits = None, LEVEL_BITS
    while True:
        ends = saved(_boundary(histogram, wanted), "mix-boundary")  # a row a source
        last = F.lit(bits == HASH_BITS) | (F.col("n") == 1)
        one_more = (2 * F.col("rest") >= F.col("size")).cast("long")
        done = ends.where(last).select("key", F.shiftleft(F.col("bucket") + one_more, HASH_BITS - bits).alias("threshold"))
        found = done if found is None else found.unionByName(done)
        open_ = ends.where(~last)
        if open_.isEmpty():
            return found
        at = open_.select("key", F.col("bucket").alias("_bucket"))
        inside = rows.withColumn("_bucket", F.shiftright("hash", HASH_BITS - bits)).join(at, ["key", "_bucket"], "left_semi")
        rows = saved(inside.select("key", "hash", "size"), "mix-bucket")
        bits += LEVEL_BITS
        histogram, wanted = _histogram(rows, bits), open_.select("key", "rest")


def mix_sources(docs: DataFrame, share: float = SHARE, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, times, taken) of each document: the words of its source and what the mix should take of them, and how
    often the mix takes the document, and how many words that is."""
    rows = saved(sized(docs), "mix-sizes")
    histogram = saved(_histogram(rows, LEVEL_BITS), "mix-histogram")
    summed = histogram.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = global_ordinal(summed, "key", "ordinal")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights)).cast("int"))
    sources = saved(targets(ranked.select("key", "source_size", weight.alias("weight")), share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.select("key", "source_size", "target", whole.alias("whole"))
    wanted = sources.where("source_size > 0").select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    limits = sources.join(thresholds(rows, histogram, wanted), "key", "left")
    by_bucket = histogram.select("key", "bucket").join(limits, "key")
    bucket = F.shiftright("hash", HASH_BITS - LEVEL_BITS)
    times = F.col("whole") + F.coalesce(F.col("hash") < F.col("threshold"), F.lit(False)).cast("long")
    joined = rows.withColumn("bucket", bucket).join(by_bucket, ["key", "bucket"])
    return joined.select("doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))
