"""Queries on audit logs, traces and sensitive text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators.audit import labelled, match_grants, normalize_destination, pair_attempts, plain_date, words_of
from plotwise.operators.spans import derive_spans
from plotwise.operators.text_scan import NEEDLES, scan_text
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import table
from plotwise.sources.audit import SCHEMA, parse_audit, read_audit
from plotwise.storage import shared_folder

_AT = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value): an audit log made from events; some lines broken, some left out, some with a fault each."""
    e = table(spark, sf_dir, "events").where("event_id % 37 <> 0")
    k = F.col("event_id")
    common = [F.lit(SCHEMA).alias("schema"), F.expr("CAST(event_id div 2 AS STRING)").alias("attempt")]
    intent = F.to_json(F.struct(*common, F.lit("intent").alias("phase"), F.expr(_AT).alias("at"), F.lit("publish").alias("operation"), F.concat(F.lit("/out/"), F.col("user_id").cast("string")).alias("destination")))
    outcome = F.to_json(
        F.struct(
            *common,
            F.lit("outcome").alias("phase"),
            F.expr(_AT).alias("at"),
            F.when(F.col("event_type") == "error", "refused").otherwise("published").alias("outcome"),
            F.when(F.col("event_type") == "error", "GrantExpired").alias("error_kind"),
            F.when(k % 4 == 1, "interactive").otherwise("flag").alias("approval_route"),
            (k % 100).alias("rows"),
            (k % 7).alias("partitions"),
        )
    )
    line = (
        F.when(k % 50 == 0, F.lit("{broken"))
        .when(k % 50 == 11, F.lit('{"schema":"other/1","attempt":"1","phase":"intent"}'))
        .when(k % 50 == 12, F.lit(f'{{"schema":"{SCHEMA}","phase":"intent"}}'))
        .when(k % 50 == 13, F.lit(f'{{"schema":"{SCHEMA}","attempt":"1","phase":"done"}}'))
        .when(k % 50 == 14, F.lit(f'{{"schema":"{SCHEMA}","attempt":"1","phase":"intent","at":"x"}}'))
        .when(k % 50 == 15, F.lit(f'{{"schema":"{SCHEMA}","attempt":"1","phase":"outcome","at":"x"}}'))
        .when(k % 2 == 0, intent)
        .otherwise(outcome)
    )
    return e.select(k.alias("line_no"), line.alias("value"))


_AUDIT_SQL = """al AS (SELECT event_id AS line_no, CASE event_id % 50 WHEN 0 THEN 'not-json' WHEN 11 THEN 'wrong-schema' WHEN 12 THEN 'no-attempt' WHEN 13 THEN 'bad-phase' WHEN 14 THEN 'intent-missing-fields' WHEN 15 THEN 'outcome-missing-fields' END AS corrupt_reason,
  CASE WHEN event_id % 2 = 0 THEN 'intent' ELSE 'outcome' END AS phase, CAST(event_id // 2 AS VARCHAR) AS attempt, event_id % 100 AS n, event_id % 7 AS parts, event_type, CASE WHEN event_id % 4 = 1 THEN 'interactive' ELSE 'flag' END AS route, user_id, ts
  FROM events WHERE event_id % 37 <> 0)"""


@query("audit_source", f"WITH {_AUDIT_SQL} SELECT line_no, corrupt_reason, CASE WHEN corrupt_reason IS NULL THEN phase END AS phase, CASE WHEN corrupt_reason IS NULL THEN attempt END AS attempt FROM al")
def audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_audit(audit_lines(spark, sf_dir))
    good = F.col("corrupt_reason").isNull()
    return parsed.select("line_no", "corrupt_reason", F.when(good, F.col("phase")).alias("phase"), F.when(good, F.col("attempt")).alias("attempt"))


@query("audit_files", f"WITH {_AUDIT_SQL} SELECT line_no // 2000 AS log, row_number() OVER (PARTITION BY line_no // 2000 ORDER BY line_no)::INT AS line_no, corrupt_reason, CASE WHEN corrupt_reason IS NULL THEN attempt END AS attempt FROM al")
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files of two thousand ids each, written and read back with the numbers of their lines."""
    folder = shared_folder(spark, "audit-logs")
    lines = audit_lines(spark, sf_dir).groupBy(F.expr("line_no div 2000").alias("log")).agg(F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("lines"))
    lines.select("log", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value")).write.partitionBy("log").text(folder)
    read = read_audit(spark, folder)
    log = F.regexp_extract("file", r"/log=(\d+)/", 1).cast("long")
    return read.select(log.alias("log"), F.col("line_no").cast("int").alias("line_no"), "corrupt_reason", F.when(F.col("corrupt_reason").isNull(), F.col("attempt")).alias("attempt"))


@query(
    "audit_pairs",
    f"""WITH {_AUDIT_SQL}, i AS (SELECT attempt, line_no FROM al WHERE corrupt_reason IS NULL AND phase = 'intent'), o AS (SELECT attempt, line_no FROM al WHERE corrupt_reason IS NULL AND phase = 'outcome')
    SELECT coalesce(i.attempt, o.attempt) AS attempt, CASE WHEN i.attempt IS NULL THEN 'orphan-outcome' WHEN o.attempt IS NULL THEN 'orphan-intent' ELSE 'pair' END AS state, i.line_no AS intent_line, o.line_no AS outcome_line FROM i FULL JOIN o ON i.attempt = o.attempt""",
)
def audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_attempts(parse_audit(audit_lines(spark, sf_dir)))


@query(
    "audit_rollup",
    f"""WITH {_AUDIT_SQL} SELECT CASE WHEN event_type = 'error' THEN 'refused' ELSE 'published' END AS outcome, CASE WHEN event_type = 'error' THEN 'GrantExpired' END AS error_kind, route AS approval_route, count(*) AS attempts, sum(n)::BIGINT AS n_rows, sum(parts)::BIGINT AS n_partitions
    FROM al WHERE corrupt_reason IS NULL AND phase = 'outcome' GROUP BY ALL""",
)
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = parse_audit(audit_lines(spark, sf_dir)).where("corrupt_reason IS NULL AND phase = 'outcome'")
    return good.groupBy("outcome", "error_kind", "approval_route").agg(F.count("*").alias("attempts"), F.sum("rows").alias("n_rows"), F.sum("partitions").alias("n_partitions"))


_WORDS_SQL = "lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))"


@query(
    "audit_labels",
    f"""WITH {_AUDIT_SQL} SELECT line_no, strftime(ts, '%Y-%m-%d %H:%M') AS "when", CASE route WHEN 'flag' THEN 'by command line' ELSE route END AS route, {_WORDS_SQL.format("CASE WHEN event_type = 'error' THEN 'GrantExpired' END")} AS reason
    FROM al WHERE corrupt_reason IS NULL AND phase = 'outcome'""",
)
def audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in plain words: routes by a table of the caller's, kinds of error by their own words."""
    good = parse_audit(audit_lines(spark, sf_dir)).where("corrupt_reason IS NULL AND phase = 'outcome'")
    named = labelled(good, "approval_route", [("flag", "by command line")], "route")
    return named.select("line_no", plain_date(F.col("at")).alias("when"), "route", words_of(F.col("error_kind")).alias("reason"))


_GRANTS_SQL = """gr AS (SELECT c_custkey AS grant_id, 'publish' AS operation, c_mktsegment AS dataset, sha256(c_mktsegment) AS content_hash, CASE WHEN c_custkey % 3 = 0 THEN 'child' ELSE 'exact' END AS scope_kind,
  CASE WHEN c_custkey % 3 = 0 THEN '/out' ELSE '/out/' || CAST(c_custkey % 40 AS VARCHAR) END AS scope, c_custkey * 600 AS granted_s, least(60 * (1 + c_custkey % 30), 1200) AS lifetime_s FROM customer),
att AS (SELECT event_id AS attempt, CASE WHEN event_id % 9 = 0 THEN 'delete' ELSE 'publish' END AS operation, CASE user_id % 6 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' WHEN 4 THEN 'FURNITURE' ELSE 'OTHER' END AS dataset,
  CASE WHEN event_id % 5 = 0 THEN '/out/deep/' ELSE '/out/' END || CAST(event_id % 40 AS VARCHAR) AS destination, (event_id * 97) % 100000 AS now_s FROM events)"""


def grants_and_attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    grants = table(spark, sf_dir, "customer").select(
        k.alias("grant_id"),
        F.lit("publish").alias("operation"),
        F.col("c_mktsegment").alias("dataset"),
        F.sha2(F.col("c_mktsegment").cast("binary"), 256).alias("content_hash"),
        F.when(k % 3 == 0, "child").otherwise("exact").alias("scope_kind"),
        F.when(k % 3 == 0, "/out").otherwise(F.concat(F.lit("/out/"), (k % 40).cast("string"))).alias("scope"),
        (k * 600).alias("granted_s"),
        (60 * (1 + k % 30)).alias("lifetime_s"),
    )
    e = F.col("event_id")
    names = F.array(*map(F.lit, ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE", "OTHER")))
    attempts = table(spark, sf_dir, "events").select(
        e.alias("attempt"),
        F.when(e % 9 == 0, "delete").otherwise("publish").alias("operation"),
        F.get(names, (F.col("user_id") % 6).cast("int")).alias("dataset"),
        F.concat(F.when(e % 5 == 0, "/out/deep/").otherwise("/out/"), (e % 40).cast("string")).alias("destination"),
        (e * 97 % 100000).alias("now_s"),
    )
    return grants, attempts.withColumn("content_hash", F.sha2(F.col("dataset").cast("binary"), 256))


@query(
    "grant_match",
    f"""WITH {_GRANTS_SQL}, m AS (SELECT attempt, grant_id, greatest(0, now_s - granted_s) - lifetime_s AS over FROM att JOIN gr ON att.operation = gr.operation AND att.dataset = gr.dataset
      AND ((scope_kind = 'exact' AND scope = destination) OR (scope_kind = 'child' AND scope = regexp_extract(destination, '^(.*)/[^/]+$', 1)))),
    b AS (SELECT attempt, min(grant_id) FILTER (over < 0) AS live_id, arg_min(grant_id, (over, grant_id)) AS closest FROM m GROUP BY attempt)
    SELECT att.attempt, CASE WHEN operation <> 'publish' THEN 'no_grant' WHEN closest IS NULL THEN 'grant_scope_mismatch' WHEN live_id IS NULL THEN 'grant_expired' ELSE 'granted' END AS verdict, coalesce(live_id, closest) AS grant_id FROM att LEFT JOIN b USING (attempt)""",
)
def grant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants, attempts = grants_and_attempts(spark, sf_dir)
    return match_grants(attempts, grants)


@query(
    "destination_normalization",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '~/maps/' || u WHEN 1 THEN '//host/share/' || u WHEN 2 THEN '/srv/<user>/' || u ELSE '%TEMP%/x/' || u END AS destination FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS u FROM events)""",
)
def destination_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("\\\\?\\C:\\Users\\Ada\\maps\\"), u))
        .when(k % 4 == 1, F.concat(F.lit("\\\\?\\UNC\\host\\share\\"), u))
        .when(k % 4 == 2, F.concat(F.lit("/srv/ADA/"), u))
        .otherwise(F.concat(F.lit("C:/Users/Ada/Temp/x/"), u))
    )
    roots = [("C:/Users/Ada", "~"), ("C:/Users/Ada/Temp", "%TEMP%")]
    return table(spark, sf_dir, "events").select("event_id", normalize_destination(raw, roots, ["ada"]).alias("destination"))


_EVENT_SPANS = (("view_to_click", "view", "click"), ("click_to_purchase", "click", "purchase"), ("view_to_error", "view", "error"), ("error_to_view", "error", "view"))
_FIRST_SQL = """tr AS (SELECT user_id AS trace_id, event_type AS name, min(epoch_us(ts)) * 1000 AS t1 FROM events GROUP BY ALL), base AS (SELECT trace_id, min(t1) AS t0 FROM tr GROUP BY ALL)"""
_SPANS_SQL = " UNION ALL ".join(
    f"SELECT u.trace_id, '{n}' AS span, CASE WHEN b.t1 - a.t1 >= 0 THEN b.t1 - a.t1 END AS nanos FROM base u LEFT JOIN tr a ON a.trace_id = u.trace_id AND a.name = '{x}' LEFT JOIN tr b ON b.trace_id = u.trace_id AND b.name = '{y}'" for n, x, y in _EVENT_SPANS
)


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, name, offset_nanos): a trace for each user."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), (micros * 1000).alias("offset_nanos"))


@query("trace_spans", f"WITH {_FIRST_SQL} {_SPANS_SQL}")
def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_spans(trace_events(spark, sf_dir), _EVENT_SPANS)


#: What is planted, by the key's remainder by 21.
_PLANTS = {1: "the PassWord: hunter2-hunter2", 4: "opened /home/ada/maps/parcels", 7: "Authorization: BEARER abcdef0123456789", 10: "saved as C:\\Users\\Ada\\map.gpkg", 13: "d:/data/maps is full", 16: "short file://", 19: "ÜBER API_KEY=0123456789"}


def _planted(key: Column) -> Column:
    text = F.lit("")
    for k, plant in _PLANTS.items():
        text = F.when(key % 21 == k, F.lit("\n" + plant)).otherwise(text)
    return text


def _planted_sql(key: str) -> str:
    return f"CASE {key} % 21 " + " ".join(f"WHEN {k} THEN chr(10) || '{plant}'" for k, plant in _PLANTS.items()) + " ELSE '' END"


def scanned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three text tables whole; a third of the documents and two in seven conversations get a planted line."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("key"), F.concat("text", _planted(F.col("doc_id"))).alias("text"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").cast("string").alias("key"), F.col("html").alias("text"))
    talk = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.concat_ws("/", "conv_id", "turn").alias("key"), F.concat("text", _planted(F.col("conv_id"))).alias("text"))
    return docs.unionByName(pages).unionByName(talk)


def _needle_sql(needle: str, kind: str) -> str:
    quoted = needle.replace("'", "''")
    return f"""SELECT source, key, '{kind}' AS class, array_to_string(string_split(low, '{quoted}')[1:k], '{quoted}') AS pre, {len(needle)} AS n, t FROM (SELECT *, unnest(generate_series(1, len(string_split(low, '{quoted}')) - 1)) AS k FROM rows_ WHERE contains(low, '{quoted}'))"""


_SCAN_SQL = f"""WITH rows_ AS (SELECT source, key, t, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, text || {_planted_sql("doc_id")} AS t FROM documents
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), text || {_planted_sql("conv_id")} FROM conversations)),
f AS ({" UNION ALL ".join(_needle_sql(n, k) for n, k in NEEDLES)}),
m AS (SELECT source, key, class, strlen(pre)::INT AS byte_offset, length(regexp_extract(pre, '[ -~]*$')) + n + length(regexp_extract(substr(t, length(pre) + n + 1), '^[ -~]*')) AS run FROM f)
SELECT source, key, class, byte_offset FROM m WHERE run >= 12"""


@query("sensitive_text", _SCAN_SQL)
def sensitive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials and local paths in three text tables."""
    return scan_text(scanned_rows(spark, sf_dir), drives=False).drop("excerpt")


@query("drive_paths")
def drive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive-letter paths; tests hold them against a plain loop."""
    return scan_text(scanned_rows(spark, sf_dir), needles=()).drop("excerpt")


@query("trace_source", "SELECT event_type AS name, count(*) AS n, max(epoch_us(ts) * 1000)::BIGINT AS last FROM events WHERE event_id % 50 <> 0 GROUP BY ALL UNION ALL SELECT '(broken)', count(*), NULL FROM events WHERE event_id % 50 = 0")
def trace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as trace lines, some broken, and read back by kind."""
    from plotwise.sources.artifacts import read_traces

    micros = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    line = F.to_json(F.struct(F.lit("event").alias("kind"), F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("name"), micros.alias("offset_nanos")))
    folder = shared_folder(spark, "traces")
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(line).alias("value")).write.text(folder)
    read = read_traces(spark, folder)
    good = read["event"].groupBy("name").agg(F.count("*").alias("n"), F.max("offset_nanos").alias("last"))
    return good.unionByName(read["broken"].agg(F.count("*").alias("n")).select(F.lit("(broken)").alias("name"), "n", F.lit(None).cast("long").alias("last")))
