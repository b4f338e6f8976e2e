"""Prompts for models: of one kernel error with its context, and of a log set with the code that was found for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardlens.functions import text as X

#: What a model is told first, for one error of a kernel log. The headings are those that replies are parsed by.
KERNEL_SYSTEM = (
    "You read logs of embedded Linux boards. From the lines below, say in two or three sentences what went wrong, then give a change to the C "
    "sources as a unified diff.\nAnswer in this form:\n## ANALYSIS\n<what went wrong>\n## DIFF\n<the diff, or NONE>"
)
#: The same for log sets, in both languages.
SET_SYSTEM = {
    "en": "You explain failures of embedded systems from their logs. Name the root cause, why it happened and how to fix it, with registers, addresses and places in the code where they are known.\nAnswer with one JSON object: root_cause, suggestion, patch (may be empty), confidence (0 to 1).",
    "zh": "你根据日志解释嵌入式系统的故障。请指出根本原因、发生的过程和修复方法，尽量引用寄存器、地址和代码位置。\n只回答一个 JSON 对象：root_cause、suggestion、patch（可为空）、confidence（0 到 1）。",
}
CHINESE_SHARE, MOST_LINES, MOST_ADDRESSES = 0.15, 30, 5


def kernel_prompt(device: Column, error: Column, line: Column, stack: Column, registers: Column, surrounding: Column) -> Column:
    """The user's part for an error: its class and line first, then stack, registers and the lines around it."""
    context = F.array_join(F.transform(surrounding, lambda x: F.concat(F.lit("  "), x)), "\n")
    return F.concat(F.lit("Board "), device, F.lit(": "), error, F.lit("\n"), line, F.lit("\n\nStack:\n"), stack, F.lit("\n\nRegisters:\n"), registers, F.lit("\n\nLines around it:\n"), context)


def set_prompt(severity: Column, error_type: Column, device: Column, summary: Column, addresses: Column, lines: Column, context: Column, language: str = "auto") -> Column:
    """struct<language, system, user> for a log set.

    language: en, zh, or auto: Chinese where over 15 % of the characters of the lines are. At most 30 numbered lines and 5 addresses go in;
    without code the prompt says so.
    """
    if language not in ("auto", "en", "zh"):
        raise ValueError(f"no such language: {language}")
    own = F.when(X.cjk_share(F.array_join(lines, "\n")) > CHINESE_SHARE, "zh").otherwise("en") if language == "auto" else F.lit(language)
    numbered = F.array_join(F.transform(F.slice(lines, 1, MOST_LINES), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(": "), x)), "\n")
    shown = F.array_join(F.transform(F.slice(addresses, 1, MOST_ADDRESSES), lambda a: X.hex8(a)), ", ")
    crashed = F.when(shown != "", F.concat(F.lit("\n\n## Addresses\n"), shown)).otherwise("")
    code = F.when((context != "") & ~context.contains("/* No "), F.concat(F.lit("\n\n## Code\n"), context)).otherwise("\n\n## Code\n(none was found; go by the log alone)")
    user = F.concat(F.lit("## Device\n"), device, F.lit(" | "), error_type, F.lit(" | "), severity, F.lit("\n\n## Summary\n"), summary, F.lit("\n\n## Log\n"), numbered, crashed, code)
    asks = F.when(own == "zh", F.lit("\n\n请用中文回答。")).otherwise("")
    return F.struct(own.alias("language"), F.when(own == "zh", SET_SYSTEM["zh"]).otherwise(SET_SYSTEM["en"]).alias("system"), F.concat(user, asks).alias("user"))
