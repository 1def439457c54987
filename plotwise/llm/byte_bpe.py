"""Byte-level BPE encoding and decoding by overlapping chunks (operator 10).

A long text is cut to chunks that overlap, and the chunks go to different tasks.  Each is pre-tokenised from its raw beginning.  The pattern
matches from left to right and looks at nothing before a match, so two chunks that share one pre-token boundary agree from there on: a chunk
takes over from its left neighbour at the first boundary that both have.  Only boundaries after a character other than white space count,
because `\\s+(?!\\S)` looks ahead; a piece that ends there is pre-tokenised alone as it is within the text.  The ids before the boundary in
the right chunk and after it in the left one are dropped, and the document's ids are the rest, in order.  Where an overlap holds no common
boundary (a run of letters longer than it), the two chunks are encoded again as one.  A text of one chunk needs no stitching.
Decoding concatenates the raw bytes of the ids.

The ranks come from a file of the public rank format (base64 bytes, rank a line); its path is a parameter, and every Python worker reads it
once.  Merges are done by the tiktoken library, a piece at a time.

Cases.  Null or empty text: no ids.  Very long texts: chunks; the ids of one document meet in one row, as its text does.  Repeated rows: a row
each.  Nulls in doc_id stay.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.shared import pieces

CHUNK = 1 << 15
OVERLAP = 1 << 10


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the text's pre-tokens that come after a character other than white space."""
    return [m.end() for m in regex.finditer(pattern, text) if not text[m.end() - 1].isspace()]


_RESULT = ["doc_id", "n_tokens", "ids", "decoded"]


def _encode_short(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        token = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
        for part in pieces(batches, "text"):
            ids = [enc.encode_ordinary(x or "") for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([b"".join([token[i] for i in x]) for x in ids], pa.binary()),
                ],
                names=_RESULT,
            )

    return run


def encode_chunk(enc: tiktoken.Encoding, pattern: str, text: str, body: int, overlap: int) -> dict:
    """A chunk's ids, cut at every safe boundary in the overlaps with its neighbours: cuts (offsets in the chunk) and parts (ids up to the next).

    body: where the right neighbour begins; for a last chunk the text's end.  The longest fixed word of the pattern has 3 characters: nearer
    to the end of the overlap a boundary may be due to the cut."""
    sure = len(text) if body == len(text) else len(text) - 3
    cuts = [0, *(b for b in boundaries(text, pattern) if b < sure and (b <= overlap or b >= body))]
    return {"cuts": cuts, "parts": [enc.encode_ordinary(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]}


def _encode_chunks(path: str, pattern: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for part in pieces(batches, "text"):
            found = [encode_chunk(enc, pattern, t, b, overlap) for t, b in zip(part.column("text").to_pylist(), part.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("row", "doc_id", "chunk", "body", "text")),
                    pa.array([x["cuts"] for x in found], pa.list_(pa.int32())),
                    pa.array([[np.array(p, "<u4").tobytes() for p in x["parts"]] for x in found], pa.list_(pa.binary())),
                ],
                names=["row", "doc_id", "chunk", "body", "text", "cuts", "parts"],
            )

    return run


def stitch(enc: tiktoken.Encoding, pattern: str, chunks: list[dict], overlap: int) -> np.ndarray:
    """The ids of a whole text from its chunks, in order; each has text, body, cuts and parts (ids before the next cut)."""
    ids, at, now = [], 0, chunks[0]  # `at`: the cut in the present chunk from which on it counts
    for following in chunks[1:]:
        body = now["body"]
        common = {cut - body for cut in now["cuts"] if cut >= max(at, body)} & set(following["cuts"]) - {0}
        if common:
            to = min(common)
            ids += [p for cut, p in zip(now["cuts"], now["parts"], strict=True) if at <= cut < body + to]
            now, at = following, to
        else:  # no boundary in the overlap: the two are one longer chunk
            text = now["text"][at:body] + following["text"]
            now, at = {"text": text, "body": body - at + following["body"]}, 0
            now |= encode_chunk(enc, pattern, text, now["body"], overlap)
    ids += [p for cut, p in zip(now["cuts"], now["parts"], strict=True) if cut >= at]
    return np.concatenate([np.asarray(p, np.uint32) for p in ids]) if ids else np.zeros(0, np.uint32)


def _stitch_group(path: str, pattern: str, overlap: int):
    def run(group: pa.Table) -> pa.Table:
        enc = encoding(path, pattern)
        rows = group.to_pylist()
        copies = sum(r["chunk"] == 0 for r in rows)  # of a repeated row
        rows = [r for _, r in sorted({r["chunk"]: r for r in rows}.items())]
        for r in rows:
            r["parts"] = [np.frombuffer(p, "<u4") for p in r["parts"]]
        ids = stitch(enc, pattern, rows, overlap)
        decoded = b"".join(map(enc.decode_single_token_bytes, ids.tolist()))
        values = (rows[0]["doc_id"], len(ids), ids.astype("<u4").tobytes(), decoded)
        kinds = (group.schema.field("doc_id").type, pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([v] * copies, k) for v, k in zip(values, kinds, strict=True)], names=_RESULT)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as the bytes that they stand for."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids binary, decoded binary"
    size = F.char_length("text")
    short = docs.where(size.isNull() | (size <= chunk)).mapInArrow(_encode_short(path, pattern), out)
    row = F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))  # not doc_id alone: ids may repeat
    cut = docs.where(size > chunk).select(F.to_json(row).alias("row"), "doc_id", "text", F.posexplode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias("chunk", "begin"))
    cut = cut.select(
        "row",
        "doc_id",
        "chunk",
        F.least(F.lit(chunk), size - F.col("begin")).alias("body"),
        F.col("text").substr(F.col("begin") + 1, F.lit(chunk + overlap)).alias("text"),
    ).repartition("row", "chunk")
    encoded = cut.mapInArrow(_encode_chunks(path, pattern, overlap), f"row string, doc_id {kind}, chunk int, body int, text string, cuts array<int>, parts array<binary>")
    return short.unionByName(encoded.groupBy("row").applyInArrow(_stitch_group(path, pattern, overlap), out))
