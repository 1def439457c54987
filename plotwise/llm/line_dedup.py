"""Line dedup over levelled sorted runs (operator 7); DataFrame functions only.

The lines of all documents are hashed once, to a table of (document, line number, key).  The corpus then comes in batches.  A batch's keys are
counted (in how many of its documents each occurs) and merge-anti-joined with the runs: a key that a run already found in `min_docs`
documents is settled, and is not counted again.  What is left is added as a run of its own.  A run is bucketed by key and sorted within its
buckets; the runs of a level are one bucketed table, so that joins and sums over them shuffle nothing of it.  When a level holds `fanout`
runs they are compacted to one run of the next level, so n batches leave O(log n) levels and a key is rewritten O(log n) times.

The documents lose the lines with settled keys.  Keys in more than one of HOT lines are found by a broadcast join (there are at most so many
of them), all others by a merge join, so that no common line makes a task hot.

Key of a line: stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; compared by two 64-bit hashes.  Lines whose key is empty always
stay.  Cases.  Null or empty text: one empty line, which stays.  Very long texts and very many lines: work in proportion.  Rows with one doc_id
are one document in the count, and each gives a row.  A null doc_id is an id like another.  A key in exactly min_docs documents goes.  No rows:
no rows.  Extra columns are kept; facts come in a column named as asked, with underscores added where the table has that name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.blocks import shuffle_partitions
from plotwise.llm.shared import discard, passing, quoted, saved, shared_folder

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
HOT = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() folds all letters: right only for all-ASCII keys, and much faster there than translate()
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _row_hash(text: Column) -> Column:
    """With doc_id it tells rows apart whose lines differ."""
    return F.xxhash64(text.cast("string"))


def line_table(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(id, h, pos, a, b, batch) of every line whose key is long enough, in the shared folder by batch."""
    lines = docs.select(F.col("doc_id").alias("id"), _row_hash(F.col("text")).alias("h"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("id", "h", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = keyed.select("id", "h", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    return saved(hashed, "lines", "batch")


class LineRuns:
    """Runs of (a, b, n): a key's two hashes and documents; each level is one bucketed table of up to `fanout` sorted runs."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets, self.name = shuffle_partitions(spark), f"line_runs_{uuid.uuid4().hex}"
        self.runs: list[int] = []
        self.folders: dict[int, str] = {}
        self.compactions = 0

    def level(self, k: int) -> DataFrame:
        return self.spark.table(f"{self.name}_{k}")

    def _merged(self, k: int) -> DataFrame:
        """A level's runs as one."""
        return self.level(k).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def _write(self, counts: DataFrame, k: int) -> None:
        while len(self.runs) <= k:
            self.runs.append(0)
        if not self.runs[k]:
            self.folders[k] = shared_folder(self.spark, f"line-runs-{k}")
        writer = counts.write.option("compression", "zstd").option("path", self.folders[k]).mode("append")
        writer.bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(f"{self.name}_{k}")
        passing(self.spark, self.folders[k])
        self.runs[k] += 1
        if self.runs[k] == self.fanout:
            self._write(self._merged(k), k + 1)
            self._drop(k)
            self.compactions += 1

    def _drop(self, k: int) -> None:
        self.spark.sql(f"DROP TABLE {self.name}_{k}")
        discard(self.spark, self.folders[k])
        self.runs[k] = 0

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The counts whose keys no run has found in enough documents yet."""
        for k, runs in enumerate(self.runs):
            if runs:
                counts = counts.join(self.level(k).where(F.col("n") >= self.min_docs), ["a", "b"], "left_anti")
        return counts

    def add(self, batch: DataFrame) -> None:
        """A batch (id, a, b): its keys, counted by documents, less those that are settled, become a run."""
        self._write(self.unsettled(batch.select("id", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))), 0)

    def frequent(self) -> DataFrame:
        """(a, b, n) of all keys in enough documents; n counts up to the batch that settled a key.  The runs are dropped."""
        levels = [k for k, runs in enumerate(self.runs) if runs]
        rows = self._merged(levels[0])
        for k in levels[1:]:  # both sides are bucketed alike; a union of them is not known to be
            more = self._merged(k).withColumnRenamed("n", "m")
            rows = rows.join(more, ["a", "b"], "full").select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        found = saved(rows.where(F.col("n") >= self.min_docs), "frequent-lines")
        for k in levels:
            self._drop(k)
        return found


def clean_lines(docs: DataFrame, lines: DataFrame, frequent: DataFrame, facts: str | None = "line_facts") -> DataFrame:
    """The documents' own columns with the text cleaned, and facts struct(n_lines, n_dropped) if a name for it is given."""
    most = lines.count() / HOT
    hot, rest = frequent.where(F.col("n") >= most).select("a", "b"), frequent.where(F.col("n") < most).select("a", "b")
    common = F.broadcast(hot)  # HOT keys at most, as their documents are lines, and each line is of one key
    gone = lines.join(common, ["a", "b"], "left_semi").unionByName(lines.join(common, ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_semi"))
    gone = gone.groupBy("id", "h").agg(F.collect_list("pos").alias("gone"))
    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]) & (_row_hash(docs["text"]) == gone["h"]), "left")
    split = lines_of(docs["text"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone["gone"])
    picked = F.aggregate(F.array(split), F.array().cast("array<string>"), lambda _, x: F.transform(stay, lambda k: x[k]))  # binds the lines once
    kept = F.when(gone["gone"].isNull(), split).otherwise(picked)
    own = [F.array_join(kept, "\n").alias("text") if c == "text" else docs[quoted(c)] for c in docs.columns]
    if facts:
        while facts in docs.columns:
            facts += "_"
        dropped = F.when(gone["gone"].isNull(), 0).otherwise(F.size(split) - F.size(stay))
        own.append(F.struct(F.size(split).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")).alias(facts))
    return both.select(*own)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, facts: str | None = "line_facts") -> DataFrame:
    """Batches of documents add their runs one after another; then all documents lose the lines that enough documents share."""
    lines = line_table(docs, min_chars, batches)
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    return clean_lines(docs, lines, runs.frequent(), facts)
