"""Log lines: parsing, readings, fatal errors with context, alerts and messages.

A table of lines has `file`, `device`, `line_number` and `raw`; every window is within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.functions import vocabulary as V


def device_of(file_name: Column) -> Column:
    """What stands before the first underscore of a file name, else the name without its extension."""
    return F.substring_index(F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", ""), "_", 1)


def is_log_file(file_name: Column, size: Column) -> Column:
    return F.lower(file_name).rlike("(" + "|".join(e.replace(".", r"\.") for e in V.LOG_EXTENSIONS) + ")$") & (size >= V.LEAST_FILE_BYTES)


def lines_of_files(files: DataFrame) -> DataFrame:
    """files (file, content) -> (file, device, line_number, raw): lines that are not blank, numbered from 1 among all."""
    out = files.select("file", device_of(F.col("file")).alias("device"), F.posexplode(X.lines(F.col("content"))).alias("at", "raw"))
    return out.where(X.strip(F.col("raw")) != "").select("file", "device", (F.col("at") + 1).cast("long").alias("line_number"), "raw")


def level_of(text: Column, compat: bool = False) -> Column:
    upper, out = F.upper(text), F.lit("INFO")
    for level, pattern in reversed(V.LEVELS_COMPAT if compat else V.LEVELS):
        out = F.when(upper.rlike(pattern), level).otherwise(out)
    return out


def parsed(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ts, level and message. With compat, levels match parts of words and a bracket before a timestamp hides it."""
    stripped = X.strip(F.col("raw")) if compat else F.regexp_replace(X.strip(F.col("raw")), r"^\[(?=\d{4}[-/])", "")
    stamp = F.regexp_extract("stripped", V.TIMESTAMP, 1)
    rest = X.strip(F.expr("substring(stripped, length(stamp) + 1)"))
    out = lines.withColumn("stripped", stripped).withColumn("stamp", stamp).withColumn("rest", rest if compat else F.regexp_replace(rest, r"^\]\s*", ""))
    ts = F.expr("try_cast(replace(replace(stamp, '/', '-'), 'T', ' ') as timestamp_ntz)")
    return out.select(*lines.columns, ts.alias("ts"), level_of(F.col("rest"), compat).alias("level"), F.regexp_replace("rest", V.LEVEL_PREFIX, "").alias("message"))


def readings(lines: DataFrame, column: str = "message") -> DataFrame:
    """Adds voltage_mv, current_ma and temp_c, the first of each in a line."""
    value = {name: F.expr(f"try_cast(nullif({name}_, '') as double)") for name in ("voltage_mv", "current_ma", "temp_c")}
    found = {f"{n}_": F.regexp_extract(column, p, 1) for n, p in zip(value, (V.VOLTAGE, V.CURRENT, V.TEMPERATURE), strict=True)}
    return lines.withColumns(found).withColumns(value).drop(*found)


def last_readings(lines: DataFrame) -> DataFrame:
    """The last reading of each kind by file and device, where there is any."""
    kinds = ("voltage_mv", "current_ma", "temp_c")
    out = readings(lines).where(F.coalesce(*kinds).isNotNull()).groupBy("file", "device")
    return out.agg(*(F.expr(f"max_by({k}, line_number) filter (where {k} is not null)").alias(k) for k in kinds))


def valid_readings(metrics: DataFrame) -> Column:
    """Voltage and current are not negative; rows that break this are for a quarantine."""
    return F.coalesce(F.col("voltage_mv") >= 0, F.lit(True)) & F.coalesce(F.col("current_ma") >= 0, F.lit(True))


def error_class(text: Column, compat: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(V.ERROR_CLASSES_COMPAT if compat else V.ERROR_CLASSES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def first_errors(lines: DataFrame) -> DataFrame:
    """The first fatal line of each file: (file, device, line_number, error_type, first_line)."""
    hits = lines.select("file", "device", "line_number", "raw", error_class(F.col("raw")).alias("error_type")).where("error_type is not null")
    return hits.groupBy("file").agg(F.min_by(F.struct("device", "line_number", "error_type", F.col("raw").alias("first_line")), "line_number").alias("e")).select("file", "e.*")


def error_context(lines: DataFrame, around: int = V.CONTEXT_LINES, compat: bool = False) -> DataFrame:
    """First errors with the lines around them, and of those the stack and register lines, in order.

    Neighbours are counted among the lines that are not blank. The window is over files that have an error only. With compat,
    stack lines are those of the strict pattern; else frames like [<hex>] name count too, and register lines don't.
    """
    first = first_errors(lines)
    w = W.partitionBy("file").orderBy("line_number")
    near = lines.join(first.select("file", F.col("line_number").alias("hit")), "file").withColumn("rn", F.row_number().over(w))
    at = near.where("line_number = hit").select("file", F.col("rn").alias("hit_rn"))
    near = near.join(at, "file").where(F.abs(F.col("rn") - F.col("hit_rn")) <= around)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "raw"))), lambda s: s["raw"])
    around_ = near.groupBy("file").agg(ordered.alias("surrounding"))

    def joined(some) -> Column:
        return F.array_join(F.transform(F.filter("surrounding", some), X.strip), "\n")

    stack = joined(lambda x: x.rlike(V.STACK_LINE)) if compat else joined(lambda x: (x.rlike(V.STACK_LINE) | x.rlike(V.BRACKET_FRAME)) & ~x.rlike(V.REGISTER_LINE))
    return first.join(around_, "file").select("*", stack.alias("stack_trace"), joined(lambda x: x.rlike(V.REGISTER_LINE)).alias("register_dump"))


def context_text(errors: DataFrame) -> Column:
    """The context as one text of sections; an empty section says (none)."""

    def section(title: str, body: Column) -> Column:
        return F.concat(F.lit(f"[{title}]\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("(none)")))

    return F.concat_ws("\n", section("device", F.col("device")), section("error", F.col("error_type")), section("line", F.col("first_line")), section("stack", F.col("stack_trace")), section("registers", F.col("register_dump")), section("context", F.array_join("surrounding", "\n")))


def alert_level(error_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.ALERT_LEVELS.items() for x in pair])
    return F.coalesce(F.element_at(table, error_type), F.lit("INFO"))


def alerts(diagnosed: DataFrame, at: Column) -> DataFrame:
    """(id, device, level, summary, timestamp) for errors with a diagnosed root_cause; at: the time that goes into the id."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return diagnosed.select(F.concat_ws("-", "device", stamp).alias("id"), "device", alert_level(F.col("error_type")).alias("level"), F.substring("root_cause", 1, V.SUMMARY_CHARS).alias("summary"), stamp.alias("timestamp"))


def stored_logs(lines: DataFrame) -> DataFrame:
    """(id, timestamp, device, message) of parsed lines, for the store of recent logs."""
    return lines.select(F.concat_ws("-", "device", "line_number").alias("id"), F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("timestamp"), "device", F.col("raw").alias("message"))


def rate(lines_bytes: Column) -> Column:
    """Lines a second that a file of so many bytes counts as."""
    return F.round(lines_bytes / 100.0, 2)


def message_union(streams: DataFrame, metrics: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """(type, device, payload): one tagged JSON stream of throughput, readings (missing ones 0) and alerts."""
    filled = metrics.select("device", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("voltage_mv", "current_ma", "temp_c")))

    def tagged(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("type"), "device", F.to_json(F.struct(*[c for c in df.columns if c != "device"])).alias("payload"))

    return tagged("stream", streams).unionByName(tagged("metrics", filled)).unionByName(tagged("alert", alert_rows))


def line_style(text: Column) -> Column:
    """Class of a displayed line by its tag."""
    alert = F.regexp_extract(text, r"^\[ALERT:(\w+)\]", 1)
    return F.when(alert != "", F.concat(F.lit("alert-"), F.lower(alert))).when(text.startswith("[STREAM]"), "stream").otherwise("plain")
