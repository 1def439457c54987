"""From documents to token ids: each stage reads what its predecessor kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of `documents`.  They keep their rows' other columns as they are, but
for n_chars, which follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from plotwise.llm.shared import quoted, saved

#: SQL has no byte-pair merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.kept_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that enough documents share."""
    cleaned = line_dedup.dedup_lines(docs, facts=None)
    return cleaned.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else quoted(c) for c in docs.columns))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id."""
    found = jaccard_join.join_documents(docs)
    later = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("later_id")).distinct()
    return docs.join(later, docs["doc_id"] == later["later_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids as little-endian unsigned 32-bit integers."""
    found = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder, and the next one reads them there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "corpus-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
