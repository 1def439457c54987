"""Scanning text columns for credentials and local paths."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is looked for, without regard to ASCII case, and its class.
NEEDLES = (
    ("credential", "credential"),
    ("password", "credential"),
    ("passwd", "credential"),
    ("secret", "credential"),
    ("api_key", "credential"),
    ("apikey", "credential"),
    ("authorization:", "credential"),
    ("bearer ", "credential"),
    ("private_key", "credential"),
    ("begin rsa", "credential"),
    ("begin private", "credential"),
    ("file://", "local-filesystem-path"),
    ("\\\\?\\", "local-filesystem-path"),
    ("/home/", "local-filesystem-path"),
    ("/users/", "local-filesystem-path"),
    ("/tmp/", "local-filesystem-path"),
    ("/var/folders/", "local-filesystem-path"),
    ("appdata\\local\\temp", "local-filesystem-path"),
    ("appdata/local/temp", "local-filesystem-path"),
)
#: The shortest printable run that a finding stands in, and the bytes shown on either side.
MIN_RUN, AROUND = 12, 24
_DRIVE = r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/]"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BEFORE, _AFTER = re.compile(r"[ -~]*\Z"), re.compile(r"[ -~]*")


def _findings(text: str, wanted: Sequence[tuple[str, str]], drives: bool, declared: Sequence[str]) -> Iterator[tuple[str, int, str]]:
    """(class, byte offset, excerpt) of a text's findings that stand in a printable run of MIN_RUN or more."""
    low = text.translate(_LOWER)
    places = [(m.start(), m.end() - m.start(), kind) for needle, kind in wanted for m in re.finditer(re.escape(needle), low)]
    if drives:
        places += [(m.start(), m.end() - m.start(), "local-filesystem-path") for m in re.finditer(_DRIVE, text)]
    for at, n, kind in places:
        # a run is told from the few characters around, and read on only if these are all printable
        before = _BEFORE.search(text[max(0, at - MIN_RUN) : at]).group()
        after = _AFTER.match(text, at + n, at + n + MIN_RUN).group()
        if len(before) + n + len(after) < MIN_RUN:
            continue
        if kind in ("username", "machine-identifier") and any(low.find(d, max(at + n - len(d), 0), at + len(d)) >= 0 for d in declared):
            kind = "operator-declared"
        excerpt = text[max(0, at - AROUND) : at + n + AROUND].replace("\n", " ").replace("\r", " ")
        yield kind, len(text[:at].encode()), excerpt


def scan_text(rows: DataFrame, needles=NEEDLES, drives: bool = True, usernames=(), hostnames=(), declared=()) -> DataFrame:
    """rows (source, key, text) to findings (source, key, class, byte_offset, excerpt), by row.

    A row is looked at closely, by a Python task, only if it contains one of the strings without regard to any case: a pass of plain searches.
    A user or host name wholly inside a declared string is `operator-declared`; credentials and paths never are."""
    wanted = [*needles, *((u.lower(), "username") for u in usernames), *((h.lower(), "machine-identifier") for h in hostnames)]
    long_enough = [d.translate(_LOWER) for d in declared if len(d.strip()) >= MIN_RUN]
    folded = F.lower("text")
    near = F.lit(False)
    for n, _ in wanted:
        near = near | folded.contains(n)
    if drives:
        near = near | ((F.col("text").contains(":\\") | F.col("text").contains(":/")) & F.col("text").rlike(_DRIVE))
    hits = rows.where(near).select("source", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *f) for k, text in enumerate(batch.column("text").to_pylist()) for f in _findings(text, wanted, drives, long_enough)]
            row, kind, offset, excerpt = zip(*found, strict=True) if found else ((), (), (), ())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("source").take(at), batch.column("key").take(at), pa.array(kind, pa.string()), pa.array(offset, pa.int32()), pa.array(excerpt, pa.string())],
                names=["source", "key", "class", "byte_offset", "excerpt"],
            )

    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("source", "key")}
    return hits.mapInArrow(run, f"source {kinds['source']}, key {kinds['key']}, class string, byte_offset int, excerpt string")
