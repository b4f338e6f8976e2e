"""Log sets: severity, error type, device, addresses, summary and retrieval query of a set of lines; prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.functions import vocabulary as V

_TYPE = r"(?i)\b(" + "|".join(V.ERROR_WORDS) + r")\b"
_DEVICE = "(" + "|".join(V.DEVICE_WORDS) + ")"


def _found(line: Column) -> Column:
    """struct<pattern, at, text, label> of the addresses in a line, by pattern and place."""

    def of(k: int, name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), 1), lambda a, i: F.struct(F.lit(k).alias("pattern"), i.alias("at"), F.lower(a).alias("hex"), F.concat(F.lit(f"{name}=0x"), F.upper(a)).alias("label")))

    parts = [of(k, name, pattern) for k, (name, pattern) in enumerate(V.SET_ADDRESSES)]
    return reduce(lambda a, b: F.concat(a, b), parts)


def parse_sets(lines: DataFrame) -> DataFrame:
    """lines (set_id, n, line) -> one row for each set. Lines are grouped with partial sums; only addresses are collected."""
    own = lines.select("set_id", "n", X.strip(F.col("line")).alias("line")).where("line <> ''")
    critical, warning = X.contains_any(F.col("line"), V.CRITICAL_WORDS), X.contains_any(F.col("line"), V.WARNING_WORDS)
    own = own.withColumns({"critical": critical, "warning": warning, "type": F.lower(F.regexp_extract("line", _TYPE, 1)), "device_": F.regexp_extract("line", _DEVICE, 1)})
    out = own.groupBy("set_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if("critical").alias("critical"),
        F.count_if("warning").alias("warning_count"),
        F.expr("min_by(type, n) filter (where type <> '')").alias("type"),
        F.expr("min_by(device_, n) filter (where device_ <> '')").alias("device"),
        F.expr("min_by(line, n) filter (where critical)").alias("first_critical"),
        F.expr("min_by(line, n) filter (where length(line) > 10)").alias("first_long"),
        F.flatten(F.collect_list(F.transform(_found(F.col("line")), lambda s: F.struct(s["pattern"].alias("pattern"), F.col("n").alias("n"), s["at"].alias("at"), s["hex"].alias("hex"), s["label"].alias("label"))))).alias("found"),
    )
    severity = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("warning_count") > 0, "WARNING").otherwise("INFO")
    out = out.withColumns({"severity": severity, "error_type": F.coalesce("type", F.lit("unknown")), "device": F.coalesce("device", F.lit("unknown")), "found": F.array_sort("found")})
    summary = F.coalesce("first_critical", "first_long", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("error_type"), F.lit(" ("), F.col("n_lines").cast("string"), F.lit(" lines)")))
    cut = F.when(F.length("summary") > 120, F.concat(F.substring("summary", 1, 120), F.lit("..."))).otherwise(F.col("summary"))
    out = out.withColumn("summary", summary).withColumn("summary", cut)
    return out.select("set_id", "n_lines", (F.col("critical") + F.col("warning_count")).alias("error_count"), "warning_count", "severity", "error_type", "device", "summary", F.transform("found", lambda s: X.hex_to_decimal(s["hex"])).alias("crash_addresses"), F.transform("found", lambda s: s["label"]).alias("crash_locations"))


def retrieval_query(sets: DataFrame) -> Column:
    """Type, device, three addresses, five locations and the head of the summary, as search text."""
    addresses = F.transform(F.slice("crash_addresses", 1, 3), lambda a: X.hex8(a))
    parts = F.concat(F.array("error_type", "device"), addresses, F.slice("crash_locations", 1, 5), F.array(F.substring("summary", 1, 200)))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def fallback_context(sets: DataFrame) -> Column:
    return F.concat(F.lit("/* No code index */\n/* device "), F.col("device"), F.lit(", type "), F.col("error_type"), F.lit(", at "), F.array_join(F.transform(F.slice("crash_addresses", 1, 3), lambda a: X.hex8(a)), ", "), F.lit(" */"))


def first_lines(lines: DataFrame, most: int) -> DataFrame:
    """(set_id, lines): the first `most` lines of each set that aren't blank, stripped. A task keeps no more of a set before the shuffle."""
    own = lines.select("set_id", "n", X.strip(F.col("line")).alias("line")).where("line <> ''")
    place = F.row_number().over(W.partitionBy("set_id").orderBy("n"))
    few = own.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]).alias("lines"))


def batch_counts(sets: DataFrame, ok: Column) -> DataFrame:
    return sets.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))
