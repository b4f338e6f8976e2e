r"""Conversations as training text: turns marked by a template, control strings inside texts escaped, assistant texts under a loss mask.

A template gives each role a head and a foot, other roles a head that holds their name. Its marks (control strings such as
[INST] or </s>) never occur inside an escaped text: an occurrence gets a backslash behind its first character, and one that has
backslashes there already gets one more, so taking one away again gives the text back.

Rows of a conversation are brought together by a shuffle on its id, sorted by turn. A task then works on whole Arrow batches: the
pieces of all rows (begin mark, head, text, foot) have a length each; their running sums are offsets in the output, and one scatter
of numpy indices copies heads and texts into one preallocated buffer, of which the formatted column is a view. Rows stream through;
a task holds a batch and the conversation that is open. Conversations of more than `long_turns` rows are dealt over all tasks by
ranges of turns instead, formatted there, and only their formatted parts meet.

Output: (id, formatted, n_turns, loss_starts, loss_ends); the loss mask is spans of code points of `formatted`, one for each
assistant turn, around its escaped text without head and foot.

Cases: a null text is empty; an empty text keeps its marks and an empty span; a null role is an empty name; roles are taken as they are
written; turns that tie are ordered by role, then by a hash of role and text, null turns come first; repeated rows are turns of their own; rows
with a null id are one conversation; very long texts are taken whole (a formatted conversation must fit into 2 GB); an empty table gives
no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boardlens.llm.hashing import buffers
from boardlens.llm.store import mapped

LONG_TURNS = 100_000
_BLANK = " \n\t"


@dataclass(frozen=True)
class Template:
    """begin stands before a conversation; turns has (head, foot) by role; other has what stands before a role's name, after it, and the foot.

    A mark is a head's, foot's or begin's text without the blanks around it, of which a head or foot may have none (" ").
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE] ", "[/END]")
    learned: str = "assistant"

    def __post_init__(self) -> None:
        marks = self.marks
        for a in marks:
            if len(a) < 2 or any(c in _BLANK for c in a):
                raise ValueError(f"a mark has two characters or more and no blanks: {a!r}")
            if any(a != b and a in b for b in marks) or any(a[-n:] == b[:n] for b in marks for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"a mark overlaps another: {a!r}")
        heads = [h.strip(_BLANK) for h, _ in self.turns.values()] + [self.other[0]]
        if len(set(heads)) < len(heads) or not all(f.strip(_BLANK) for _, f in self.turns.values()) or self.other[0] != self.other[0].strip(_BLANK):
            raise ValueError("heads differ, and each foot has a mark")

    @property
    def marks(self) -> list[str]:
        every = [self.begin, *(x for pair in self.turns.values() for x in pair), *self.other]
        return sorted({m.strip(_BLANK) for m in every} - {""})

    def _patterns(self, least: str) -> list[str]:
        """A pattern for each first character of a mark: it, backslashes, the rest of a mark."""
        by = {}
        for m in self.marks:
            by.setdefault(m[0], []).append(m[1:])
        return [f"({re.escape(c)})(\\\\{least})({'|'.join(map(re.escape, rest))})" for c, rest in by.items()]

    def escape(self, texts: pa.Array) -> pa.Array:
        for p in self._patterns("*"):
            texts = pc.replace_substring_regex(texts, p, r"\1\\\2\3")
        return texts

    def unescape(self, text: str) -> str:
        for p in self._patterns("+"):
            text = re.sub(p, lambda m: m[1] + m[2][1:] + m[3], text)
        return text

    def turn_pattern(self) -> re.Pattern[str]:
        """Matches one turn; its last group is the role's number (turns in order, others last)."""
        own = [f"{re.escape(h)}(?P<t{k}>.*?){re.escape(f)}" for k, (h, f) in enumerate(self.turns.values())]
        # A head without a mark is tried last.
        own = [p for _, p in sorted(zip([not h.strip(_BLANK) for h, _ in self.turns.values()], own, strict=True), key=lambda x: x[0])]
        a, b, c = map(re.escape, self.other)
        return re.compile("|".join([f"{a}(?P<name>.*?){b}(?P<said>.*?){c}", *own]), re.DOTALL)


def _starts(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of rows in them, spans [n, 2] of texts in them, whether a row is learned). first: rows that get the begin mark."""
    names = [*t.turns]
    roles = roles.fill_null("")
    kind = pc.fill_null(pc.index_in(roles, pa.array(names, pa.string())), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    texts, said = buffers(t.escape(texts.fill_null("")))
    named, name_at = buffers(t.escape(pc.if_else(pa.array(kind == len(names)), roles, "")))
    # Literals, then the two columns, as one source of bytes.
    literals = [b"", t.begin.encode(), *(x.encode() for pair in t.turns.values() for x in pair), *(x.encode() for x in t.other)]
    at = np.cumsum([0, *map(len, literals)])
    source = np.concatenate([np.frombuffer(b"".join(literals), np.uint8), named, texts])
    other = 2 + 2 * len(names)
    head, foot = np.where(kind < len(names), 2 + 2 * kind, other), np.where(kind < len(names), 3 + 2 * kind, other + 2)
    after = np.where(kind < len(names), 0, other + 1)
    # Six pieces a row: begin, head, name, what follows the name, text, foot.
    lit = np.stack([np.where(first, 1, 0), head, head, after, head, foot], 1)
    starts, sizes = at[lit], np.diff(at)[lit]
    starts[:, 2], sizes[:, 2] = at[-1] + name_at[:-1], np.diff(name_at)
    starts[:, 4], sizes[:, 4] = at[-1] + len(named) + said[:-1], np.diff(said)
    to = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(to[-1], np.uint8)
    # The source of each byte of the output, as its place plus what its piece is shifted by.
    index = np.arange(to[-1]) + np.repeat(starts.ravel() - to[:-1], sizes.ravel())
    np.take(source, index, out=out)
    return out, to[::6], np.stack([to[4::6], to[5::6]], 1), kind == (names.index(t.learned) if t.learned in names else -1)


@dataclass
class _Open:
    """The parts so far of the conversation whose rows are coming in."""

    id: object
    parts: list[bytes]
    turns: int
    chars: int
    spans: list[np.ndarray]


def _formatted_rows(t: Template, kind: pa.DataType, begin: bool):
    """Rows (id, role, text), of which those of a conversation follow each other -> a row for each conversation."""
    names = ["id", "part", "formatted", "n_turns", "loss_starts", "loss_ends"]

    def built(done: list[_Open]) -> pa.RecordBatch:
        spans = [np.concatenate([np.zeros((0, 2), np.int64), *o.spans]) for o in done]
        at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32))
        flat = np.concatenate([np.zeros((0, 2), np.int64), *spans])
        lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(flat[:, k]))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([o.id for o in done], kind), pa.array([TaskContext.get().partitionId()] * len(done), pa.int32()), pa.array([b"".join(o.parts) for o in done], pa.binary()).cast(pa.string()), pa.array([o.turns for o in done], pa.int64()), *lists], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Open | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0)
            codes = pc.fill_null(pc.dictionary_encode(ids).indices, -1).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], codes[1:] != codes[:-1]])
            goes_on = held is not None and held.id == ids[0].as_py()
            first = new.copy() if begin else np.zeros(n, bool)
            if goes_on:
                first[0] = False
            raw, at, spans, learned = assemble(batch.column(1), batch.column(2), first, t)
            chars, bounds, done = _starts(raw), [*np.flatnonzero(new).tolist(), n], []
            for k in range(len(bounds) - 1):
                i, j = bounds[k], bounds[k + 1]
                if not (k == 0 and goes_on):
                    if held is not None:
                        done.append(held)
                    held = _Open(ids[i].as_py(), [], 0, 0, [])
                own = spans[i:j][learned[i:j]]
                held.spans.append(chars[own] - chars[at[i]] + held.chars)
                held.parts.append(raw[at[i] : at[j]].tobytes())
                held.turns += j - i
                held.chars += int(chars[at[j]] - chars[at[i]])
            if done:
                yield built(done)
        if held is not None:
            yield built([held])

    return rows


def format_conversations(turns: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_turns: int = LONG_TURNS) -> DataFrame:
    """(id_col, formatted, n_turns, loss_starts, loss_ends), one row for each conversation."""
    t = template or Template()
    own = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind, order = own.schema["id"].dataType, ["id", "turn", "role", F.xxhash64("role", "text").alias("h")]
    arrow = to_arrow_type(kind)
    schema = f"id {kind.simpleString()}, part int, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"

    def formatted(rows: DataFrame, begin: bool) -> DataFrame:
        return mapped(rows.sortWithinPartitions(*order).select("id", "role", "text"), _formatted_rows(t, arrow, begin), schema)

    long = [r.id for r in own.groupBy("id").count().where(F.col("count") > long_turns).select("id").limit(1).collect()]
    if not long:
        return formatted(own.repartition("id"), True).drop("part").withColumnRenamed("id", id_col)
    # Ids of long conversations are few: each has more than long_turns rows.
    hot = own.groupBy("id").count().where(F.col("count") > long_turns).select(F.col("id").alias("hot"))
    same = F.col("id").eqNullSafe(F.col("hot"))
    whole = formatted(own.join(hot, same, "left_anti").repartition("id"), True).drop("part")
    parts = formatted(own.join(hot, same, "left_semi").repartitionByRange(*order), False)
    return whole.unionByName(_joined(parts, t.begin)).withColumnRenamed("id", id_col)


def _joined(parts: DataFrame, begin: str) -> DataFrame:
    """Formatted parts of conversations, in the order of the ranges that made them, as one text; spans move by what stands before."""
    every = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "formatted", "n_turns", "loss_starts", "loss_ends"))).alias("p"))
    before = F.expr(f"aggregate(p, array(cast({len(begin)} as bigint)), (a, x) -> array_append(a, element_at(a, -1) + char_length(x.formatted)))")
    every = every.withColumn("before", before)

    def moved(c: str) -> F.Column:
        return F.flatten(F.transform("p", lambda x, i: F.transform(x[c], lambda s: s + F.get("before", i)))).alias(c)

    text = F.concat(F.lit(begin), F.array_join(F.transform("p", lambda x: x["formatted"]), ""))
    return every.select("id", text.alias("formatted"), F.expr("aggregate(p, 0L, (a, x) -> a + x.n_turns)").alias("n_turns"), moved("loss_starts"), moved("loss_ends"))


def parse(text: str, t: Template, pattern: re.Pattern[str]) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    names, out, at = [*t.turns], [], len(t.begin)
    if not text.startswith(t.begin):
        raise ValueError("a formatted conversation begins with its mark")
    while at < len(text):
        m = pattern.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["name"] is not None:
            out.append((t.unescape(m["name"]), t.unescape(m["said"])))
        else:
            k = int(m.lastgroup[1:])
            out.append((names[k], t.unescape(m[m.lastgroup])))
        at = m.end()
    return out


def read_back(formatted: DataFrame, template: Template | None = None, id_col: str = "conv_id") -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the formatted text and its mask."""
    t = template or Template()
    pattern = t.turn_pattern()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                turns, every, loss, n = parse(text, t, pattern), sha256(), sha256(), 0
                for role, said in turns:
                    every.update(f"{role}\n{said}\n".encode())
                for a, z in zip(starts, ends, strict=True):
                    said = t.unescape(text[a:z])
                    n += len(said)
                    loss.update(said.encode())
                for column, v in zip(out, (len(turns), every.hexdigest(), n, loss.hexdigest(), len(text)), strict=True):
                    column.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, types, strict=True))], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema[id_col].dataType.simpleString()
    got = mapped(formatted.select(id_col, "formatted", "loss_starts", "loss_ends"), rows, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return got.withColumnRenamed("id", id_col)


_OWN = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", _OWN), (-1, 1, "assistant", _OWN)], turns.schema)
    return read_back(format_conversations(turns.unionByName(own)))


QUERIES = {"op13_chat_format": op13_chat_format}
ORACLE = {
    "op13_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, (['user', 'assistant'])[k + 1], '{_OWN}' FROM range(2) t(k)),
e AS (SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*)(s>|/s>|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'), '(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|/END\])', '\1\\\2\3', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(3 + sum(length(esc) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 19 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""
}
