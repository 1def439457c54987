"""Spans between trace events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derive_spans(events: DataFrame, spans: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(trace_id, span, nanos) for each trace and span (name, first event, last event): from the first occurrence of either end; null if one is missing or they are reversed.

    events: trace_id, name, offset_nanos. One aggregate by trace: first offsets go to a map, the spans are read off it."""
    first = events.groupBy("trace_id", "name").agg(F.min("offset_nanos").alias("at")).groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "at"))).alias("at"))

    def length(a: str, b: str):
        nanos = F.col("at")[b] - F.col("at")[a]
        return F.when(nanos >= 0, nanos)

    rows = F.array(*(F.struct(F.lit(name).alias("span"), length(a, b).alias("nanos")) for name, a, b in spans))
    return first.select("trace_id", F.explode(rows).alias("s")).select("trace_id", "s.*")
