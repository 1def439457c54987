"""Work across tables: attribute joins, profiles, edits over a base, lineage grades, similar columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plotwise.storage import saved


def attribute_join(features: DataFrame, attributes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined features, one row: features, matched, attributes without a feature, match rate)."""
    joined = features.join(attributes, key, "left")
    present = attributes.select(key).distinct().withColumn("_a", F.lit(1))
    both = features.select(key).distinct().withColumn("_f", F.lit(1)).join(present, key, "full_outer")
    report = both.agg(F.count("_f").alias("features"), F.count_if(F.col("_f").isNotNull() & F.col("_a").isNotNull()).alias("matched"), F.count_if(F.col("_f").isNull()).alias("unmatched_attributes"))
    return joined, report.withColumn("match_rate", F.col("matched") / F.col("features"))


def profile(df: DataFrame, columns: Sequence[str], bins: int = 8) -> DataFrame:
    """(column, bin, n, nulls, min, max): equal-width histograms of numeric columns; the top edge belongs to the last bin. Two passes: ranges, then counts."""
    stats = df.agg(*(f(c).cast(t).alias(f"{n}_{c}") for c in columns for n, f, t in (("min", F.min, "double"), ("max", F.max, "double"), ("nulls", lambda c: F.count_if(F.col(c).isNull()), "long")))).first()
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.lit(stats[f"min_{c}"]).alias("lo"), F.lit(stats[f"max_{c}"]).alias("hi"), F.lit(stats[f"nulls_{c}"]).alias("nulls")) for c in columns))
    values = df.select(F.explode(rows).alias("r")).select("r.*").where("v IS NOT NULL")
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("v") - F.col("lo")) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return values.groupBy("column", at.alias("bin")).agg(F.count("*").alias("n"), F.first("nulls").alias("nulls"), F.first("lo").alias("min"), F.first("hi").alias("max"))


def settled_edits(deltas: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """The latest edit of each key, with `deleted`. deltas: key, columns, version, deleted.

    An edit whose deleted is null deletes nothing; of equal versions a deletion wins, and of two edits the one with the greater hash, so that reruns agree;
    a null version is older than any."""
    settled = deltas.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    by = F.struct(F.col("version").isNotNull(), "version", "deleted", F.xxhash64(*columns))
    return settled.groupBy(key).agg(F.max_by(F.struct(*settled.columns), by).alias("d")).select("d.*")


def overlay(base: DataFrame, deltas: DataFrame, key: str = "id") -> DataFrame:
    """The base with edits over it, settled by `settled_edits`. The base is only joined, never sorted."""
    last = settled_edits(deltas, base.columns, key)
    untouched = base.join(last.select(key), key, "left_anti")
    return untouched.unionByName(last.where("NOT deleted").select(*base.columns))


def lineage_grade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, grade): the worst rank among a node and all it is made from. nodes: node, rank; edges: node, input.

    Only nodes whose grade rose in a round are carried to what is made from them in the next, until none rises; cycles end too, as grades only
    rise.  Each round is written to the shared folder."""
    grades = saved(nodes.select("node", F.col("rank").alias("grade")), "grades")
    risen = grades
    while True:
        offered = edges.join(risen.select(F.col("node").alias("input"), F.col("grade").alias("g")), "input").groupBy("node").agg(F.max("g").alias("g"))
        risen = saved(grades.join(offered, "node").where(F.col("g") > F.col("grade")).select("node", F.col("g").alias("grade")), "grades")
        if risen.isEmpty():
            return grades
        grades = saved(grades.join(risen.select("node", F.col("grade").alias("g")), "node", "left").select("node", F.coalesce("g", "grade").alias("grade")), "grades")


def similar_columns(values: DataFrame, least: float = 0.5) -> DataFrame:
    """(left, right, confidence): pairs of columns by name distance and overlap of distinct values. values: (column, value), distinct.

    Columns meet by value, so pairs are counted without comparing all columns."""
    sizes = values.groupBy("column").agg(F.count("*").alias("n"))
    a, b = values.select(F.col("column").alias("left"), "value"), values.select(F.col("column").alias("right"), "value")
    common = a.join(b, "value").where(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count("*").alias("common"))
    sized = common.join(sizes.select(F.col("column").alias("left"), F.col("n").alias("nl")), "left").join(sizes.select(F.col("column").alias("right"), F.col("n").alias("nr")), "right")
    overlap = F.col("common") / F.least("nl", "nr")
    names = 1 - F.levenshtein("left", "right") / F.greatest(F.length("left"), F.length("right"))
    return sized.select("left", "right", F.round((overlap * 3 + names) / 4, 6).alias("confidence")).where(F.col("confidence") >= least)


def fold_sorted(df: DataFrame, key: str, order: Sequence[str], name: str, start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, bool]]) -> DataFrame:
    """The rows with what a rule decides of each, in order, from all decisions before it of the same key.

    A key's rows come sorted to one task and are read in passing, so however long its history, only the rule's state is kept."""
    kinds = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            said = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(batch.schema.names, row, strict=True))
                if now != [row[key]]:
                    now, state = [row[key]], start()
                state, decision = step(state, row)
                said.append(decision)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_())], names=[*kinds.names, name])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, df.schema.add(name, "boolean"))


def resident_totals(batches: DataFrame, session: str, order: Sequence[str], vertices: str, ceiling: int = 2_000_000) -> DataFrame:
    """Each batch with whether it is admitted: in order, unless the running sum of the admitted would pass the ceiling; a refused one adds nothing."""

    def step(total: int, row: dict) -> tuple[int, bool]:
        fits = total + row[vertices] <= ceiling
        return total + row[vertices] * fits, fits

    rows = batches.select(session, *order, F.col(vertices).cast("long").alias(vertices))
    return fold_sorted(rows, session, [*order, vertices], "admitted", int, step)


def newest_generation(batches: DataFrame, dataset: str, generation: str) -> DataFrame:
    """Only the batches of each dataset's newest stream: the greatest is aggregated, then joined, so a dataset with most of the rows makes no hot task."""
    newest = batches.groupBy(dataset).agg(F.max(generation).alias("_newest"))
    return batches.join(newest, dataset).where(F.col(generation) == F.col("_newest")).drop("_newest")


def duplicate_batches(batches: DataFrame, stream: str, seq: str) -> DataFrame:
    """(stream, seq, n) seen more than once."""
    return batches.groupBy(stream, seq).agg(F.count("*").alias("n")).where("n > 1")


def throttled(requests: DataFrame, key: str, order: Sequence[str], millis: str, gap: int = 120) -> DataFrame:
    """Each request with whether it is accepted: `gap` ms or more after the last accepted one of its key."""

    def step(last: int | None, row: dict) -> tuple[int | None, bool]:
        ok = last is None or row["_m"] - last >= gap
        return (row["_m"] if ok else last), ok

    rows = requests.select(key, *order, F.col(millis).cast("long").alias("_m"))
    return fold_sorted(rows, key, ["_m", *order], "accepted", lambda: None, step).drop("_m")


def replay_tickets(events: DataFrame, dataset: str, order: Sequence[str], ttl_s: int = 30, most: int = 8) -> DataFrame:
    """Each ticket with its end: redeemed, cancelled, expired, or refused when its dataset had `most` pending. events: ticket, action (mint, redeem, cancel), at_s.

    The first mint of a ticket counts. A dataset's events are read in order (at one time mints first), and only its pending tickets, `most` at most, are kept:
    an end within the time to live, or its passing, frees a place; a ticket refused at its mint stays refused."""
    mint = F.col("action") == "mint"
    ties = [F.when(mint, 0).otherwise(1), F.col("action")]
    first = F.row_number().over(Window.partitionBy(dataset, "ticket", mint).orderBy(*order)) == 1
    counted = events.withColumn("_first", first).where(~mint | F.col("_first"))
    schema = events.select(dataset, "ticket", F.col("at_s").alias("minted_s"), F.lit("").alias("state")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, now, out = {}, None, []  # pending: ticket to time of mint, oldest first
        for batch in batches:
            for key, ticket, action, at in zip(*(batch.column(c).to_pylist() for c in (dataset, "ticket", "action", "at_s")), strict=True):
                if [key] != now:
                    out += [(now[0], t, m, "expired") for t, m in pending.items()] if now else []
                    pending, now = {}, [key]
                for t in [t for t, m in pending.items() if at >= m + ttl_s]:
                    out.append((key, t, pending.pop(t), "expired"))
                if action == "mint":
                    if len(pending) < most:
                        pending[ticket] = at
                    else:
                        out.append((key, ticket, at, "refused"))
                elif ticket in pending:
                    out.append((key, ticket, pending.pop(ticket), "redeemed" if action == "redeem" else "cancelled"))
            yield rows(out)
            out = []
        yield rows([(now[0], t, m, "expired") for t, m in pending.items()] if now else [])

    kinds = to_arrow_schema(schema)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kinds.field(k).type) for k in range(4)], names=kinds.names)

    met = counted.select(dataset, "ticket", "action", "at_s", *(c for c in order if c not in (dataset, "ticket", "action", "at_s"))).repartition(dataset)
    ended = met.sortWithinPartitions(dataset, *order, *ties).mapInArrow(run, schema)
    unknown = events.groupBy(dataset, "ticket").agg(F.count_if(mint).alias("n"), F.first("at_s").alias("at")).where("n = 0")
    return ended.unionByName(unknown.select(dataset, "ticket", F.nullif("at", "at").alias("minted_s"), F.lit("unknown").alias("state")))
