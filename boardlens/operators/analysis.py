"""Analysis of log sets from lines to diagnoses: parse, query, rank code, prompt, call, result; a table for each stage.

A set that fails stays one row with its error, beside those that succeed. A job whose folder is given can be taken up again: stages that are whole
are read, so replies that were paid for are not asked for twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.operators import diagnosis, index, logset, prompts
from boardlens.sources.stages import Stages

CONTEXT_CHARS, PREVIEW_CHARS, LEAST_BUDGET, MOST_BUDGET = 2000, 200, 512, 32768
#: What a set without an answer says. A failed call's root cause begins with the first.
UNAVAILABLE = "[LLM unavailable] "
ADVICE = "No model answered. Check the key and the address of its service, and that the code index is built."


def analyze_sets(
    lines: DataFrame,
    code: index.Index | None,
    model: Callable[[str], str] = diagnosis.by_rule,
    stages: Stages | None = None,
    top_k: int = 10,
    budget: int = 8192,
    language: str = "auto",
) -> DataFrame:
    """lines (set_id, n, line) -> one row for each set with a line that isn't blank.

    (set_id, severity, error_type, device, summary, error_count, warning_count, n_chunks, chunks, context, language, root_cause, suggestion,
    patch, success, call_ok, error): chunks are the code that was found, best first, with previews; context and prompt are cut to
    CONTEXT_CHARS. success is whether the suggestion says more than the root cause; a call that fails gives both from fixed texts, and its error.
    """
    if not LEAST_BUDGET <= budget <= MOST_BUDGET or not 1 <= top_k <= 50:
        raise ValueError("budget is 512 to 32768 tokens, top_k 1 to 50")
    stages = stages or Stages(lines.sparkSession)
    sets = stages.table("sets", lambda: _queried(lines))
    asked = sets.select(F.col("set_id").alias("query_id"), "query")
    if code is None:
        found, texts = None, sets.select(F.col("set_id").alias("query_id"), logset.fallback_context(sets).alias("context"), F.lit(0).cast("long").alias("n_chunks"))
    else:
        found = stages.table("found", lambda: index.search(code, asked, top_k, budget))
        texts = index.context(found, asked)
    texts = texts.withColumnRenamed("query_id", "set_id")
    asking = stages.table("prompts", lambda: _prompted(sets, texts, language))
    replies = stages.table("replies", lambda: diagnosis.diagnose(asking.select(F.col("set_id").alias("id"), F.concat_ws("\n\n", "p.system", "p.user").alias("prompt")), model, attempts=1, fallback=None))
    return stages.table("results", lambda: _results(asking, found, replies))


def _queried(lines: DataFrame) -> DataFrame:
    parsed = logset.parse_sets(lines)
    # Prompts show the first lines of a set; no more of it is brought together.
    return parsed.withColumn("query", logset.retrieval_query(parsed)).join(logset.first_lines(lines, prompts.MOST_LINES), "set_id", "left")


def _prompted(sets: DataFrame, texts: DataFrame, language: str) -> DataFrame:
    p = prompts.set_prompt(*(F.col(c) for c in ("severity", "error_type", "device", "summary", "crash_addresses")), F.coalesce("lines", F.array().cast("array<string>")), F.col("context"), language)
    return sets.join(texts, "set_id").withColumn("p", p).drop("lines").withColumn("context", F.substring("context", 1, CONTEXT_CHARS))


def _results(asking: DataFrame, found: DataFrame | None, replies: DataFrame) -> DataFrame:
    got = replies.select(F.col("id").alias("set_id"), diagnosis.parse_reply(F.col("reply")).alias("r"), F.col("ok").alias("call_ok"), "error")
    out = asking.join(got, "set_id")
    kinds = "array<struct<file_path: string, line_start: long, line_end: long, function_name: string, score: double, label: string, preview: string>>"
    if found is None:
        out = out.withColumn("chunks", F.array().cast(kinds))
    else:
        row = F.struct("rank", F.struct("file_path", "line_start", "line_end", "function_name", "score", "label", F.substring("content", 1, PREVIEW_CHARS).alias("preview")).alias("c"))
        chunks = found.groupBy(F.col("query_id").alias("set_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["c"]).alias("chunks"))
        out = out.join(chunks, "set_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(kinds)))
    cause = F.when(F.col("call_ok"), F.col("r.root_cause")).otherwise(F.concat(F.lit(UNAVAILABLE), F.coalesce("error", F.lit(""))))
    advice = F.when(F.col("call_ok"), F.col("r.suggestion")).otherwise(ADVICE)
    return out.select(
        "set_id", "severity", "error_type", "device", "summary", "error_count", "warning_count", "n_chunks", "chunks", "context", F.col("p.language").alias("language"),
        cause.alias("root_cause"), advice.alias("suggestion"), F.when(F.col("call_ok"), F.col("r.patch")).alias("patch"), (~F.coalesce(advice.eqNullSafe(cause), F.lit(True))).alias("success"), "call_ok", "error",
    )


def batch_report(results: DataFrame) -> DataFrame:
    """One row: sets, those whose analysis succeeded, those whose call failed, and those of each severity."""
    by = {s.lower(): F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "WARNING", "INFO")}
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("success") & F.col("call_ok")).alias("succeeded"), F.count_if(~(F.col("success") & F.col("call_ok"))).alias("failed"), *by.values())
