"""Queries that run as streams; their SQL is the batch rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.plans.catalog import query
from plotwise.plans.fixtures import PARCELS_SQL, grid_cols, parcels, table, viewports
from plotwise.storage import shared_folder
from plotwise.plans.logs import _AUDIT_SQL, audit_lines
from plotwise.plans.metadata import _LIFECYCLE_SQL, _THROTTLE_SQL, ticket_events
from plotwise.plans.selection import _NEAR
from plotwise.streaming.runs import once, pair_streams, run_append, run_complete, stream_of, tail_audit, viewport_extent
from plotwise.streaming.processors import live_tickets, supersede, throttle
from plotwise.streaming.stateful import stalls


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: a file source needs a folder of files, so they are written to one first, in order."""
    folder = shared_folder(spark, "events")
    table(spark, sf_dir, "events").repartitionByRange(4, "event_id").write.parquet(folder)
    return stream_of(spark, folder)


@query("stream_audit_tail", f"WITH {_AUDIT_SQL} SELECT coalesce(corrupt_reason, phase) AS kind, count(*) AS n FROM al GROUP BY ALL")
def stream_audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "audit-log")
    audit_lines(spark, sf_dir).select("value").write.text(folder)
    parsed = run_append(tail_audit(spark, folder).select("corrupt_reason", "phase"), "audit-tail")
    return parsed.groupBy(F.coalesce("corrupt_reason", "phase").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "stream_audit_pairs",
    """WITH r AS (SELECT CAST(event_id // 2 AS VARCHAR) AS attempt, event_id % 2 AS side, ts FROM events WHERE event_id % 37 <> 0), i AS (SELECT * FROM r WHERE side = 0), o AS (SELECT * FROM r WHERE side = 1)
    SELECT i.attempt, CASE WHEN o.attempt IS NULL THEN 'orphan-intent' ELSE 'pair' END AS state FROM i LEFT JOIN o ON i.attempt = o.attempt AND o.ts >= i.ts AND o.ts <= i.ts + INTERVAL 10 MINUTE""",
)
def stream_audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A last record far ahead lets the watermark pass all others."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").where("event_id % 37 <> 0").select(F.expr("CAST(event_id div 2 AS STRING)").alias("attempt"), F.when(e % 2 == 0, "intent").otherwise("outcome").alias("phase"), F.col("ts").cast("timestamp").alias("at"))
    folder = shared_folder(spark, "audit-records")
    rows.write.parquet(folder)
    ends = [spark.range(1).select(F.lit(f"end-{k}").alias("attempt"), F.explode(F.array(F.lit("intent"), F.lit("outcome"))).alias("phase"), F.lit(f"{2090 + k}-01-01 00:00:00").cast("timestamp").alias("at")) for k in range(2)]
    for end in ends:
        end.coalesce(1).write.mode("append").parquet(folder)
    paired = run_append(pair_streams(stream_of(spark, folder, 1)), "audit-pairs")
    return paired.where("attempt NOT LIKE 'end-%'")


@query("stream_once", "SELECT DISTINCT user_id AS stream, minute(ts)::INT AS seq FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = event_stream(spark, sf_dir).select(F.col("user_id").alias("stream"), F.minute("ts").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    return run_append(once(batches, ["stream", "seq"], "at", "36500 days").select("stream", "seq"), "once")


@query(
    "stream_supersede",
    "WITH g AS (SELECT event_type AS dataset, event_id, (event_id // 50 + user_id % 3) AS generation FROM events) SELECT dataset, event_id, generation FROM g QUALIFY generation = max(generation) OVER (PARTITION BY dataset ORDER BY event_id)",
)
def stream_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = event_stream(spark, sf_dir).select(F.col("event_type").alias("dataset"), "event_id", (F.expr("event_id div 50") + F.col("user_id") % 3).alias("generation"), (F.col("event_id") * 1000).alias("ms"))
    return run_append(supersede(batches), "supersede", rocks=True)


@query("stream_throttle", f"{_THROTTLE_SQL} SELECT user_id, event_id, accepted FROM r")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = event_stream(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") * 37).alias("ms"))
    return run_append(throttle(requests), "throttle", rocks=True)


@query("stream_tickets", f"SELECT * FROM ({_LIFECYCLE_SQL}) WHERE state <> 'unknown'")
def stream_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events come in four files one after another, within which and across which times are mixed; two last events far ahead let the watermark pass all others."""
    folder = shared_folder(spark, "ticket-events")
    events = ticket_events(spark, sf_dir)
    quarter = (events.agg(F.max("ticket")).first()[0] or 0) // 4 + 1
    for k in range(4):
        events.where(F.floor(F.col("ticket") / quarter) == k).coalesce(1).write.mode("append").parquet(folder)
    for k in range(2):
        spark.range(1).selectExpr("-1L AS ticket", "'end' AS action", f"4000000000L + {k} AS at_s", "-1L AS dataset").coalesce(1).write.mode("append").parquet(folder)
    return run_append(live_tickets(stream_of(spark, folder, 1), late="60 seconds"), "tickets", rocks=True)


@query(
    "stream_stalls",
    """WITH o AS (SELECT user_id, event_id, event_id * 400 AS ms, CASE event_type WHEN 'view' THEN 'begin' WHEN 'error' THEN 'end' ELSE 'tick' END AS kind FROM events),
    b AS (SELECT user_id, ms, lead(CASE WHEN kind <> 'tick' THEN ms END IGNORE NULLS) OVER w AS next_armed, kind, lead(ms) OVER w AS n FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
    x AS (SELECT b.user_id, b.ms AS begun_ms, b.next_armed, min(o.ms) AS seen FROM b LEFT JOIN o ON o.user_id = b.user_id AND o.ms > b.ms + 5000 WHERE b.kind = 'begin' GROUP BY ALL)
    SELECT user_id, begun_ms FROM x WHERE seen <= coalesce(next_armed, seen) OR (next_armed IS NULL AND begun_ms + 5000 < (SELECT max(ms) FROM o))""",
)
def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "error", "end").otherwise("tick")
    events = event_stream(spark, sf_dir).select("user_id", "event_id", kind.alias("kind"), (F.col("event_id") * 400).alias("ms"))
    return run_append(stalls(events), "stalls")


@query("stream_viewport_extent", f"WITH {PARCELS_SQL} SELECT count(*) AS n, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM p CROSS JOIN g WHERE zone = '1-URGENT' AND {_NEAR}")
def stream_viewport_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    folder = shared_folder(spark, "features")
    parcels(spark, sf_dir, cols).repartition(4).write.parquet(folder)
    return run_complete(viewport_extent(stream_of(spark, folder, 1), viewports(cols)["near-quarter"], "zone = '1-URGENT'"), "extent")
