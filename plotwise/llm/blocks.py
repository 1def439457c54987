"""Dealing documents to blocks and their keys to buckets.

Three operators must know of every n-gram of every document something about the whole corpus.  One row for each n-gram would move tens of
bytes for each word.  Here documents are dealt to blocks by a hash of their id; a task sorts and pre-aggregates the keys of its block, so
that a block sends a key once however many of its documents hold it, and sends one packed row to each bucket of the key space.  A bucket
answers each block with one packed row.  A passage in a third of all documents costs a bucket one entry a block, so no key makes a task hot.
There are as many buckets as blocks, and as many tasks: both follow the bytes of the files read, so a block, a bucket and a task stay as they
are while the data grow.  (Packed rows are blocks x buckets, like the segments of any shuffle; `block_bytes` sets how many.)  A lost executor
costs only its tasks: blocks and buckets are recomputed from shuffle files or inputs, and depend on nothing but the rows.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that the plan reads, added up over its leaves: joins and filters above them change nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)  # beyond that Spark says that it doesn't know


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """By the bytes read alone, but for small tables, which are spread over the cores there are."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(df) // block_bytes))


def dealt(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """The columns asked for, with the block of each document, a task for each block; repeated or null ids are as good as any."""
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), *columns).repartition(blocks, "block")


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: sorted or narrow values keep few planes with anything in them."""
    wide = np.ascontiguousarray(values)
    planes = wide.view(np.uint8).reshape(len(wide), wide.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


def bucket_edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run of the sorted keys begins and ends: buckets+1 places; bucket b holds the b-th equal share of the key space."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, cuts), [len(sorted_keys)]))
