"""Column expressions on text, shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardlens.functions import vocabulary as V


def lines(text: Column) -> Column:
    """The lines of a text, without line ends and without an empty last one."""
    parts = F.split(text, V.LINE_END)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without ASCII white space at both ends: tabs and line ends as well as blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def kept_lines(text: Column) -> Column:
    """The lines of a text with their line ends; those of files are read as \\n."""
    own = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    parts = F.split(own, V.BEHIND_LINE_END)
    return F.filter(parts, lambda x: x != "")


def any_of(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def contains_any(text: Column, words) -> Column:
    """Whether the lower-cased text has one of the words as a part."""
    return F.lower(text).rlike(any_of(words))


def estimate_by_characters(text: Column) -> Column:
    """Tokens as a quarter of the characters, where all but ASCII letters, digits, blanks, tabs and _.,;:-+= count twice."""
    plain = F.regexp_count(text, F.lit(r"[a-zA-Z0-9_ \t.,;:\-+=]"))
    return F.floor((2 * F.char_length(text) - plain) / 4).cast("long")


def estimate_by_runs(text: Column) -> Column:
    """Tokens as a quarter of: one for each run of ASCII letters, digits, blanks, tabs and _.,;: and two for each Chinese character; all
    characters but these, less the number (not the length) of runs, count twice. That is twice all characters less the runs.
    """
    return F.floor((2 * F.char_length(text) - F.regexp_count(text, F.lit(r"[a-zA-Z0-9_ \t.,;:]+"))) / 4).cast("long")


def cjk_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]")) / F.greatest(F.char_length(text), F.lit(1))


def words(text: Column) -> Column:
    """Identifiers of 3 characters or more, lower-cased, that no other word character touches."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z_][a-z0-9_]{2,}$"))


def query_words(text: Column) -> Column:
    """Identifiers, and all words in double or single quotes."""
    quoted = [F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(p), 1), lambda q: F.filter(F.split(q, r"\s+"), lambda w: w != ""))) for p in ('"([^"]+)"', "'([^']+)'")]
    return reduce(F.array_union, quoted, F.array_distinct(words(text)))


def count_words(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_count(text, F.lit(r"\S+"))


def hex_to_decimal(digits: Column) -> Column:
    """Unsigned value of hex digits, null beyond 64 bits."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) <= 16, F.conv(short, 16, 10).cast("decimal(20,0)"))


def address_literal(text: Column) -> Column:
    """0x hex, 0o octal, 0b binary or decimal; null if it is none."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("decimal(20,0)"))
        .when(t.rlike("^0o[0-7]{1,21}$"), F.conv(F.substring(t, 3, 21), 8, 10).cast("decimal(20,0)"))
        .when(t.rlike("^0b[01]{1,64}$"), F.conv(F.substring(t, 3, 64), 2, 10).cast("decimal(20,0)"))
        .when(t.rlike(r"^\d{1,19}$"), t.cast("decimal(20,0)"))
    )


def hex8(value: Column, upper: bool = True) -> Column:
    digits = F.hex(value.cast("long"))
    return F.concat(F.lit("0x"), F.lpad(digits if upper else F.lower(digits), F.greatest(F.length(digits), F.lit(8)).cast("int"), F.lit("0")))


def chunk_id(path: Column, line: Column, suffix: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", path, line.cast("string"), suffix)), 1, 16)


def language_of(path: Column) -> Column:
    """By extension; an unknown extension is its own language, and a name without one is text."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    table = F.create_map(*[F.lit(x) for pair in V.LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension), extension, F.lit("text"))


def snippet(content: Column, most: int = 200) -> Column:
    """The first three lines, cut at `most` characters."""
    head = F.array_join(F.slice(lines(content), 1, 3), "\n")
    return F.when(F.length(head) > most, F.concat(F.substring(head, 1, most), F.lit("..."))).otherwise(head)


def file_name_part(text: Column) -> Column:
    """What is neither letter nor digit becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")
