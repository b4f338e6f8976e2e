"""Chat formatting: an exact round trip, the loss mask, and conversations over several batches and tasks."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from boardlens.llm import chat_format as C

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/END]", "<", "[", "\\", "\\\\", "/s>", "INST]", "s>", " ", "\n", "é", "漢", "a", ">", "]"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_escaping_is_reversible_and_hides_marks(text):
    t = C.Template()
    escaped = t.escape(pa.array([text]))[0].as_py()
    assert t.unescape(escaped) == text
    assert not any(m in escaped for m in t.marks)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]"]), TEXT), min_size=1, max_size=6))
def test_turns_come_back(turns):
    import numpy as np

    t = C.Template()
    first = np.zeros(len(turns), bool)
    first[0] = True
    raw, at, spans, learned = C.assemble(pa.array([r for r, _ in turns]), pa.array([x for _, x in turns]), first, t)
    text = raw.tobytes().decode()
    assert C.parse(text, t, t.turn_pattern()) == turns and at[-1] == len(raw)
    said = [t.unescape(raw[a:z].tobytes().decode()) for a, z in spans[learned].tolist()]
    assert said == [x for r, x in turns if r == "assistant"]


def expected(rows):
    out = {}
    for c, _, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out.setdefault(c, []).append((r or "", x or ""))
    return {c: (len(t), sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), sum(len(x) for r, x in t if r == "assistant"), sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest()) for c, t in out.items()}


@pytest.mark.parametrize("long_turns", [10**6, 5])
def test_conversations_over_batches_and_tasks(spark, long_turns):
    rng = random.Random(4)
    rows = [(c, k, ["user", "assistant", "system", None, "tool"][rng.choice([0, 1, 1, 2, 3, 4])], "".join(rng.choices(PIECES, k=rng.randrange(8)))) for c in range(40) for k in range(rng.randrange(1, 9))]
    rows += [(99, k, ["user", "assistant"][k % 2], f"turn {k} </s> é" * (k % 4)) for k in range(6000)]
    rows += [(None, 0, "user", None), (None, 1, "assistant", "x" * 300_000), (-5, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, part int").repartition(5)
    made = C.format_conversations(df, long_turns=long_turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(made).collect()}
    assert got == expected(rows)
    for r in made.where("conv_id < 40 or conv_id = -5").collect():
        assert r.n_turns == len(C.parse(r.formatted, C.Template(), C.Template().turn_pattern())) and len(r.loss_starts) == len(r.loss_ends)


def test_ties_repeated_rows_and_empty_table(spark):
    schema = "conv_id string, turn long, role string, text string"
    rows = [("a", 1, "user", "x"), ("a", 1, "user", "x"), ("a", 1, "assistant", "y"), ("a", None, "user", "first")]
    got = C.format_conversations(spark.createDataFrame(rows, schema)).first()
    assert got.formatted == "<s>[INST] first [/INST] y</s>[INST] x [/INST][INST] x [/INST]" and got.n_turns == 4
    assert got.formatted[got.loss_starts[0] : got.loss_ends[0]] == "y"
    assert C.read_back(C.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_own_templates_are_checked(spark):
    own = C.Template("<|b|>", {"user": ("<|u|>\n", "<|e|>\n"), "assistant": ("<|a|>\n", "<|e|>\n")}, ("<|r|>", "<|n|>", "<|e|>\n"))
    df = spark.createDataFrame([(1, 0, "user", "<|a|>"), (1, 1, "assistant", "ok<|e|>"), (1, 2, "other", "z")], "conv_id long, turn long, role string, text string")
    r = C.read_back(C.format_conversations(df, own), own).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, 7, sha256(b"ok<|e|>").hexdigest())
    with pytest.raises(ValueError, match="overlaps"):
        C.Template("<|", {"user": ("<|u", "|>")})
    with pytest.raises(ValueError, match="foot"):
        C.Template(turns={"user": ("[U] ", " ")})
