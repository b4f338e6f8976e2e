"""Queries on log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.functions import vocabulary as V
from boardlens.operators import diagnosis as D
from boardlens.operators import logs as L
from boardlens.operators import stores as S
from boardlens.sources import fixtures as X


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.log_lines(spark, sf_dir)


def _parsed(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    return L.parsed(_lines(spark, sf_dir).withColumnRenamed("ts", "event_ts"), compat)


def text_lines(spark, sf_dir):
    # Every full stop begins a line of one tab and a line with an indent.
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\t\n\t"))
    files = X.table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", F.concat("doc_id", F.lit(".txt"))).alias("file"), text.alias("content"))
    return L.lines_of_files(files).select("file", "device", "line_number", F.md5("raw").alias("line_md5"))


def log_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "ts", "level", "message")


def log_level_compat(spark, sf_dir):
    return _parsed(spark, sf_dir, compat=True).groupBy("level").agg(F.count("*").alias("n"))


def log_level_counts(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("device", "level").agg(F.count("*").alias("n"))


def metrics_last(spark, sf_dir):
    return L.last_readings(_parsed(spark, sf_dir))


def metrics_wire(spark, sf_dir):
    m = metrics_last(spark, sf_dir)
    return m.where(L.valid_readings(m)).select("file", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("voltage_mv", "current_ma", "temp_c")))


def error_classes(spark, sf_dir):
    return _lines(spark, sf_dir).select(L.error_class(F.col("raw")).alias("error_type")).where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n"))


def first_error(spark, sf_dir):
    return L.first_errors(_lines(spark, sf_dir))


def error_context(spark, sf_dir):
    return L.error_context(_lines(spark, sf_dir)).select("file", "device", "line_number", "error_type", "first_line", "stack_trace", "register_dump", F.array_join("surrounding", "\n").alias("surrounding"))


def alerts(spark, sf_dir):
    return L.alerts(D.diagnosed(first_error(spark, sf_dir)), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def recent_logs(spark, sf_dir):
    rows = _parsed(spark, sf_dir)
    newest = S.recent_logs(rows, ["event_ts", "event_id"])
    return L.stored_logs(newest)


def recent_alerts(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("error_type", L.error_class(F.col("raw"))).where("error_type is not null")
    return S.recent_alerts(rows, ["ts", "event_id"]).select("event_id", "device", L.alert_level(F.col("error_type")).alias("level"))


def stream_rate(spark, sf_dir):
    sizes = _lines(spark, sf_dir).groupBy("file").agg(F.sum(F.octet_length("raw") + 1).alias("bytes"))
    return sizes.select("file", "bytes", L.rate(F.col("bytes")).alias("lines_per_sec"))


def message_union(spark, sf_dir):
    sizes = _lines(spark, sf_dir).groupBy("device").agg(F.sum(F.octet_length("raw") + 1).alias("bytes"))
    found = first_error(spark, sf_dir).select("device", L.alert_level(F.col("error_type")).alias("level"))
    rows = L.message_union(sizes, metrics_last(spark, sf_dir).drop("file"), found)
    return rows.groupBy("type", "device", "payload").agg(F.count("*").alias("n"))


def metrics_rolling60(spark, sf_dir):
    r = L.readings(_parsed(spark, sf_dir)).where("voltage_mv is not null")
    return S.rolling(r, "device", ["event_ts", "event_id"], "voltage_mv").select("event_id", F.round("mean", 6).alias("mean"), "least", "most")


def metrics_latest(spark, sf_dir):
    r = L.readings(_parsed(spark, sf_dir)).where("voltage_mv is not null").withColumn("seq", F.struct("event_ts", "event_id"))
    return S.latest(r, "device", "seq", ["voltage_mv"])


def windowed_errors(spark, sf_dir):
    """An extension: errors by device in windows of an hour."""
    e = _lines(spark, sf_dir).withColumn("error_type", L.error_class(F.col("raw"))).where("error_type is not null")
    return e.groupBy("device", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n")).select("device", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


def session_errors(spark, sf_dir):
    """An extension: bursts of errors of a device with gaps of under six hours."""
    e = _lines(spark, sf_dir).withColumn("error_type", L.error_class(F.col("raw"))).where("error_type is not null")
    return e.groupBy("device", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n")).select("device", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {f.__name__: f for f in (text_lines, log_parse, log_level_compat, log_level_counts, metrics_last, metrics_wire, error_classes, first_error, error_context, alerts, recent_logs, recent_alerts, stream_rate, message_union, metrics_rolling60, metrics_latest, windowed_errors, session_errors)}

_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(raw, '{p}') THEN '{n}'" for n, p in V.ERROR_CLASSES) + " END"
_P = rf"""{X.LOG_LINES},
o AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS own FROM log_line), oo AS (SELECT *, regexp_extract(own, '{V.TIMESTAMP}', 1) AS stamp FROM o),
p AS (SELECT event_id, ts AS event_ts, file, device, line_number, raw, try_cast(nullif(stamp, '') AS TIMESTAMP) AS ts, regexp_replace(substr(own, length(stamp) + 1), '^\s+|\s+$', '', 'g') AS rest FROM oo),
q AS (SELECT *, regexp_replace(rest, '{V.LEVEL_PREFIX}', '') AS message,
CASE WHEN regexp_matches(upper(rest), 'CRITICAL|FATAL|EMERGENCY') THEN 'CRITICAL' WHEN regexp_matches(upper(rest), 'ERROR|PANIC|OOPS|(?:^|[^A-Z])BUG|FAULT') THEN 'ERROR'
WHEN regexp_matches(upper(rest), 'FAIL|TIMEOUT|RETRY|WARNING|OVERFLOW|UNDERFLOW|CORRUPT|INVALID|UNRECOVERABLE') THEN 'WARNING' WHEN regexp_matches(upper(rest), 'DEBUG|TRACE|VERBOSE') THEN 'DEBUG' ELSE 'INFO' END AS level FROM p),
r AS (SELECT *, try_cast(nullif(regexp_extract(message, '{V.VOLTAGE}', 1), '') AS DOUBLE) AS voltage_mv,
try_cast(nullif(regexp_extract(message, '{V.CURRENT}', 1), '') AS DOUBLE) AS current_ma,
try_cast(nullif(regexp_extract(message, '{V.TEMPERATURE}', 1), '') AS DOUBLE) AS temp_c FROM q),
m AS (SELECT file, device, arg_max(voltage_mv, line_number) FILTER (WHERE voltage_mv IS NOT NULL) AS voltage_mv, arg_max(current_ma, line_number) FILTER (WHERE current_ma IS NOT NULL) AS current_ma,
arg_max(temp_c, line_number) FILTER (WHERE temp_c IS NOT NULL) AS temp_c FROM r WHERE coalesce(voltage_mv, current_ma, temp_c) IS NOT NULL GROUP BY file, device),
c AS (SELECT *, {_CLASS} AS error_type FROM log_line),
f AS (SELECT file, arg_min(device, line_number) AS device, min(line_number) AS line_number, arg_min(error_type, line_number) AS error_type, arg_min(raw, line_number) AS first_line FROM c WHERE error_type IS NOT NULL GROUP BY file)"""
_WORD_AT = {w: f"nullif(instr(lower(first_line), '{w}'), 0)" for w in D.CAUSES}
_RULE = f"CASE least({', '.join(_WORD_AT.values())}) " + " ".join(f"WHEN {a} THEN '{D.CAUSES[w]}'" for w, a in _WORD_AT.items()) + f" ELSE '{D.NO_CAUSE}' END"
_LEVEL = "CASE WHEN error_type IN ('Kernel Panic', 'Segfault') THEN 'CRITICAL' WHEN error_type IN ('Kernel Oops', 'Timeout') THEN 'WARNING' ELSE 'INFO' END"
ORACLE = {
    "text_lines": r"""SELECT file, split_part(regexp_replace(file, '\.[^.]*$', ''), '_', 1) AS device, CAST(n AS BIGINT) AS line_number, md5(l[n]) AS line_md5 FROM (
SELECT source || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS file, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT source, doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(9) || chr(10) || chr(9)), chr(10)) AS l FROM documents)) WHERE regexp_replace(l[n], '^\s+|\s+$', '', 'g') <> ''""",
    "log_parse": f"WITH {_P} SELECT event_id, ts, level, message FROM q",
    "log_level_compat": f"""WITH {_P} SELECT level, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(upper(rest), 'CRITICAL|FATAL|EMERGENCY') THEN 'CRITICAL'
WHEN regexp_matches(upper(rest), 'ERROR|PANIC|OOPS|BUG|FAULT') THEN 'ERROR' WHEN regexp_matches(upper(rest), 'DEBUG|TRACE|VERBOSE') THEN 'DEBUG' ELSE 'INFO' END AS level FROM p) GROUP BY level""",
    "log_level_counts": f"WITH {_P} SELECT device, level, count(*) AS n FROM q GROUP BY ALL",
    "metrics_last": f"WITH {_P} SELECT * FROM m",
    "metrics_wire": f"WITH {_P} SELECT file, coalesce(voltage_mv, 0.0) AS voltage_mv, coalesce(current_ma, 0.0) AS current_ma, coalesce(temp_c, 0.0) AS temp_c FROM m WHERE coalesce(voltage_mv >= 0, true) AND coalesce(current_ma >= 0, true)",
    "error_classes": f"WITH {_P} SELECT error_type, count(*) AS n FROM c WHERE error_type IS NOT NULL GROUP BY error_type",
    "first_error": f"WITH {_P} SELECT * FROM f",
    "error_context": rf"""WITH {_P}, n AS (SELECT f.file, f.device, f.line_number, f.error_type, f.first_line, l.line_number AS k, l.raw, regexp_replace(l.raw, '^\s+|\s+$', '', 'g') AS own, regexp_matches(l.raw, '{V.REGISTER_LINE}') AS register,
regexp_matches(l.raw, '{V.STACK_LINE}') OR regexp_matches(l.raw, '{V.BRACKET_FRAME}') AS stack FROM f JOIN log_line l ON l.file = f.file AND l.line_number BETWEEN f.line_number - 5 AND f.line_number + 5)
SELECT file, device, line_number, error_type, first_line, coalesce(string_agg(own, chr(10) ORDER BY k) FILTER (WHERE stack AND NOT register), '') AS stack_trace, coalesce(string_agg(own, chr(10) ORDER BY k) FILTER (WHERE register), '') AS register_dump, string_agg(raw, chr(10) ORDER BY k) AS surrounding
FROM n GROUP BY file, device, line_number, error_type, first_line""",
    "alerts": f"WITH {_P} SELECT device || '-2024-01-01T00:00:00' AS id, device, {_LEVEL} AS level, {_RULE} AS summary, '2024-01-01T00:00:00' AS timestamp FROM f",
    "recent_logs": f"WITH {_P} SELECT device || '-' || CAST(line_number AS VARCHAR) AS id, coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '') AS timestamp, device, raw AS message FROM (SELECT * FROM q ORDER BY event_ts DESC, event_id DESC LIMIT 100)",
    "recent_alerts": f"WITH {_P} SELECT event_id, device, {_LEVEL} AS level FROM (SELECT * FROM c WHERE error_type IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 100)",
    "stream_rate": f"WITH {_P} SELECT file, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes, round(sum(strlen(raw) + 1) / 100.0, 2) AS lines_per_sec FROM log_line GROUP BY file",
    "message_union": f"""WITH {_P}, x AS (SELECT file, coalesce(voltage_mv, 0.0) AS v, coalesce(current_ma, 0.0) AS c, coalesce(temp_c, 0.0) AS t, device FROM m), y AS (SELECT 'stream' AS type, device, '{{"bytes":' || CAST(sum(strlen(raw) + 1) AS VARCHAR) || '}}' AS payload FROM log_line GROUP BY device
UNION ALL SELECT 'metrics', device, '{{"voltage_mv":' || CAST(v AS VARCHAR) || ',"current_ma":' || CAST(c AS VARCHAR) || ',"temp_c":' || CAST(t AS VARCHAR) || '}}' FROM x UNION ALL SELECT 'alert', device, '{{"level":"' || {_LEVEL} || '"}}' FROM f)
SELECT type, device, payload, count(*) AS n FROM y GROUP BY ALL""",
    "metrics_rolling60": f"""WITH {_P} SELECT event_id, round(avg(voltage_mv) OVER w, 6) AS mean, min(voltage_mv) OVER w AS least, max(voltage_mv) OVER w AS most FROM r WHERE voltage_mv IS NOT NULL
WINDOW w AS (PARTITION BY device ORDER BY event_ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "metrics_latest": f"WITH {_P} SELECT device, voltage_mv FROM (SELECT device, voltage_mv, row_number() OVER (PARTITION BY device ORDER BY event_ts DESC, event_id DESC) AS k FROM r WHERE voltage_mv IS NOT NULL) WHERE k = 1",
    "windowed_errors": f"WITH {_P} SELECT device, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM c WHERE error_type IS NOT NULL GROUP BY ALL",
    "session_errors": f"""WITH {_P}, g AS (SELECT device, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM c WHERE error_type IS NOT NULL),
s AS (SELECT device, ts, sum(new) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT device, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY device, k""",
}
