"""Model replies: parsing, patches, and diagnosis with a callable that is given."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.operators import prompts

_FENCE = r"(?is)```(?:diff|c)\s*\n(.*?)```"
# The headings of replies.
ANALYSIS, DIFF = "## ANALYSIS", "## DIFF"


def diff_blocks(text: Column) -> Column:
    """The fenced diff or C blocks that aren't blank, stripped; without any fence, all from the first line that begins (after an indent) with --- or +++."""
    fenced = F.regexp_extract_all(text, F.lit(_FENCE), 1)
    lines = X.lines(text)
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*(?:---|\+\+\+)"), i))
    first = F.array_min(marked)
    loose = F.when(first.isNotNull(), F.array(F.array_join(F.slice(lines, F.coalesce(first, F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1))), "\n"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(fenced) > 0, F.filter(F.transform(fenced, X.strip), lambda b: b != "")).otherwise(loose)


def reply(response: Column) -> Column:
    """struct<content, tokens> of a chat reply in JSON."""
    return F.struct(F.get_json_object(response, "$.choices[0].message.content").alias("content"), F.get_json_object(response, "$.usage.total_tokens").cast("int").alias("tokens"))


def parse_reply(text: Column) -> Column:
    """struct<root_cause, suggestion, patch>. JSON replies give their fields; others an analysis before a DIFF heading.

    The root cause is the analysis up to its first full stop. The patch is the first block after the heading, else the first of the whole reply.
    """
    parts = F.split(text, DIFF, 2)
    headed = F.size(parts) == 2
    analysis = F.when(headed, X.strip(F.replace(parts[0], F.lit(ANALYSIS), F.lit("")))).otherwise(X.strip(text))
    after = F.when(headed, F.try_element_at(diff_blocks(F.get(parts, F.lit(1))), F.lit(1)))
    patch = F.coalesce(after, F.try_element_at(diff_blocks(text), F.lit(1)))
    is_json = text.rlike(r"(?s)^\s*\{.*\}\s*$")

    def field(name: str, other: Column) -> Column:
        return F.when(is_json, F.get_json_object(text, f"$.{name}")).otherwise(other)

    return F.struct(field("root_cause", X.strip(F.substring_index(analysis, ".", 1))).alias("root_cause"), field("suggestion", analysis).alias("suggestion"), field("patch", patch).alias("patch"))


def patch_name(device: Column, stamp: Column) -> Column:
    return F.concat(X.file_name_part(device), F.lit("_"), stamp, F.lit(".patch"))


def unified_diff(old: Column, new: Column, name: Column, stamp: Column | None = None) -> Column:
    """A diff that takes all old lines out and puts all new ones in; the head counts line ends and one more. stamp stands behind the names."""
    a, b = X.lines(old), X.lines(new)
    behind = F.concat(F.lit("\t"), stamp) if stamp is not None else F.lit("")

    def count(text: Column) -> Column:
        return (F.regexp_count(text, F.lit("\n")) + 1).cast("string")

    head = F.concat(F.lit("--- a/"), name, behind, F.lit("\n+++ b/"), name, behind, F.lit("\n@@ -1,"), count(old), F.lit(" +1,"), count(new), F.lit(" @@"))
    return F.array_join(F.concat(F.array(head), F.transform(a, lambda x: F.concat(F.lit("-"), x)), F.transform(b, lambda x: F.concat(F.lit("+"), x))), "\n")


def has_patch(patch: Column) -> Column:
    """Whether there is a patch to save: NONE is none."""
    return F.coalesce(F.upper(X.strip(patch)) != "NONE", F.lit(False)) & F.coalesce(X.strip(patch) != "", F.lit(False))


#: What the model by rule says for words of a prompt; the word that comes first counts.
CAUSES = {
    "panic": "The kernel stopped on a fatal condition",
    "segfault": "A process read or wrote memory that it does not own",
    "segmentation": "A process read or wrote memory that it does not own",
    "bug": "A kernel consistency check failed",
    "oops": "A kernel consistency check failed",
    "timeout": "A task did not answer in time",
    "watchdog": "A task did not answer in time",
}
NO_CAUSE = "No known failure in these lines"
#: What a suggestion by rule adds to the cause.
LOOK = "See the lines around the first error."


def by_rule(prompt: str) -> str:
    """A diagnosis without a model, by the first word of the prompt that names a failure; the code below a prompt's log says nothing about it."""
    low = prompt.lower().split("\n## code\n", 1)[0]
    at = {word: low.find(word) for word in CAUSES}
    first = min((n, word) for word, n in at.items() if n >= 0)[1] if max(at.values()) >= 0 else None
    return f"{ANALYSIS}\n{CAUSES[first] if first else NO_CAUSE}. {LOOK}\n{DIFF}\nNONE"


def diagnose(prompts: DataFrame, model: Callable[[str], str] = by_rule, attempts: int = 3, pause: float = 1.0, fallback: Callable[[str], str] | None = by_rule) -> DataFrame:
    """prompts (id, prompt) -> (id, reply, attempts, ok, error). A failing call is tried again after 1, 2, ... pauses.

    Then ok is false, error tells what the last call raised, and reply is the fallback's (null without one). A row's failure is its own.
    """
    kind = dict(prompts.dtypes)["id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for prompt in batch.column(1).to_pylist():
                text, error, n = None, None, 0
                while text is None and n < attempts:
                    n += 1
                    try:
                        text = model(prompt or "")
                        error = None if text is not None else "no reply"
                    except Exception as x:  # noqa: BLE001  any failure of the given callable counts as one attempt
                        error = f"{type(x).__name__}: {x}"
                    if text is None and n < attempts:
                        time.sleep(pause * 2 ** (n - 1))
                good = text is not None
                out.append((text if good or fallback is None else fallback(prompt or ""), n, good, error))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "reply", "attempts", "ok", "error"])

    return prompts.select("id", "prompt").mapInArrow(rows, f"id {kind}, reply string, attempts int, ok boolean, error string")


def diagnosed(errors: DataFrame, model: Callable[[str], str] = by_rule, prompt: Column | None = None) -> DataFrame:
    """errors (file, ...) with root_cause, suggestion, patch and success.

    The prompt is that of a kernel error where the lines around it are known, else the error's first line, unless one is given. A
    failed call is answered by rule and has success false; each file has one error.
    """
    if prompt is None:
        names = ("device", "error_type", "first_line", "stack_trace", "register_dump", "surrounding")
        own = prompts.kernel_prompt(*(F.col(c) for c in names)) if {*names} <= {*errors.columns} else F.col("first_line")
        prompt = F.concat(own, F.lit("\n\n"), F.lit(prompts.KERNEL_SYSTEM)) if {*names} <= {*errors.columns} else own
    asked = errors.select(F.col("file").alias("id"), prompt.alias("prompt"))
    got = diagnose(asked, model).select(F.col("id").alias("file"), parse_reply(F.col("reply")).alias("r"), F.col("ok").alias("success"))
    return errors.join(got.select("file", "r.*", "success"), "file")
