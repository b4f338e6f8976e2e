"""Whole analyses of log sets: stages, failures kept by set, prompts, replies and patches."""

import pytest
from pyspark.sql import functions as F

from boardlens.operators import analysis as A
from boardlens.operators import diagnosis as D
from boardlens.operators import index as I
from boardlens.operators import prompts as P
from boardlens.sources import patches
from boardlens.sources.stages import Stages

LINES = [
    ("good", 1, "kernel panic PC=0x08001234"),
    ("good", 2, "\tretry later"),
    ("code", 1, "segfault in reset_board"),
    ("bad", 1, "FAIL HERE timeout"),
    ("calm", 1, "all is fine now"),
    ("blank", 1, " \t "),
]


def table(spark, rows=LINES):
    return spark.createDataFrame(rows, "set_id string, n int, line string")


def index(spark):
    text = "static int reset_board(int id)\n{\n    return id; /* segfault */\n}\n\nint other(void)\n{\n    return reset_board(2);\n}\n"
    return I.build(I.chunks(spark.createDataFrame([("src/b.c", text), ("src/blank.c", " \n\t\n")], "file_path string, content string")))


@pytest.fixture
def stubborn():
    def model(prompt: str) -> str:
        if "FAIL HERE" in prompt:
            raise OSError("service is down")
        return D.by_rule(prompt)

    return model


def test_a_failing_set_stays_beside_the_others(spark, stubborn):
    got = {r.set_id: r for r in A.analyze_sets(table(spark), index(spark), stubborn).collect()}
    assert set(got) == {"good", "code", "bad", "calm"}
    assert got["good"].success and got["good"].root_cause == "The kernel stopped on a fatal condition" and got["good"].error is None
    assert not got["bad"].call_ok and got["bad"].error == "OSError: service is down"
    assert got["bad"].root_cause == "[LLM unavailable] OSError: service is down" and got["bad"].suggestion == A.ADVICE and got["bad"].patch is None
    assert got["bad"].severity == "WARNING" and got["bad"].success
    assert got["code"].n_chunks == 1 and got["code"].chunks[0].function_name == "reset_board" and "reset_board" in got["code"].context
    assert got["calm"].n_chunks == 0 and got["calm"].context.startswith("/* No relevant code") and got["calm"].root_cause == D.NO_CAUSE
    report = A.batch_report(A.analyze_sets(table(spark), None, stubborn)).first()
    assert (report.total, report.succeeded, report.failed, report.critical, report.warning, report.info) == (4, 3, 1, 2, 1, 1)


def test_success_is_a_suggestion_that_says_more(spark):
    same = A.analyze_sets(table(spark), None, lambda p: "no stop here").first()
    assert same.root_cause == same.suggestion == "no stop here" and not same.success and same.call_ok
    silent = A.analyze_sets(table(spark), None, lambda p: None).first()
    assert not silent.call_ok and silent.error == "no reply"


def test_a_job_is_taken_up_where_it_ended(spark, tmp_path):
    folder = f"file://{tmp_path}/job"
    first = {r.set_id: r.root_cause for r in A.analyze_sets(table(spark), None, D.by_rule, Stages(spark, folder)).collect()}

    def never(prompt: str) -> str:
        raise AssertionError("asked again")

    again = {r.set_id: r.root_cause for r in A.analyze_sets(table(spark), None, never, Stages(spark, folder)).collect()}
    assert first == again and (tmp_path / "job" / "replies" / "_SUCCESS").exists()


def test_bounds_of_requests(spark):
    for bad in ({"budget": 100}, {"budget": 40000}, {"top_k": 0}, {"top_k": 51}):
        with pytest.raises(ValueError, match="budget"):
            A.analyze_sets(table(spark), None, **bad)


def test_prompts_choose_their_language(spark):
    df = spark.createDataFrame([(["内核 崩溃 错误", "x"], "ctx"), (["a panic"] * 40, "/* No code index */"), ([], "")], "lines array<string>, context string")
    s = {c: F.lit(c) for c in ("CRITICAL", "panic", "dev", "what")}
    addresses = F.array(*(F.lit(x).cast("decimal(20,0)") for x in range(7)))
    p = P.set_prompt(s["CRITICAL"], s["panic"], s["dev"], s["what"], addresses, F.col("lines"), F.col("context"))
    zh, en, none = (r.p for r in df.select(p.alias("p")).collect())
    assert zh.language == "zh" and zh.system == P.SET_SYSTEM["zh"] and zh.user.endswith("请用中文回答。") and "## Code\nctx" in zh.user
    assert en.language == "en" and "  30: a panic" in en.user and "  31: " not in en.user and "none was found" in en.user
    assert en.user.count("0x0000000") == 5 and none.language == "en"
    forced = P.set_prompt(s["CRITICAL"], s["panic"], s["dev"], s["what"], addresses, F.col("lines"), F.col("context"), "zh")
    assert {r.p.language for r in df.select(forced.alias("p")).collect()} == {"zh"}
    with pytest.raises(ValueError, match="language"):
        P.set_prompt(*s.values(), addresses, F.col("lines"), F.col("context"), "fr")


REPLIES = [
    ("## ANALYSIS\n```c\nint early;\n```\nBad pointer. Check.\n## DIFF\n```diff\n\n```\n```diff\n--- a/x\n+++ b/x\n```\n", ("```c\nint early;\n```\nBad pointer", "--- a/x\n+++ b/x")),
    ("Only text before.\n## DIFF\nNONE", ("Only text before", None)),
    ("```c\nfix();\n```\n## DIFF\n", ("```c\nfix();\n```", "fix();")),
    ("why\n\t --- a/y\n\t +++ b/y\n+1", ("why\n\t --- a/y\n\t +++ b/y\n+1", "\t --- a/y\n\t +++ b/y\n+1")),
    ("```diff\n \n```", ("```diff\n \n```", None)),
    ('{"root_cause": "a", "suggestion": "b", "patch": "c"}', ("a", "c")),
]


def test_replies_take_the_block_behind_the_heading(spark):
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(REPLIES)], "k int, t string").select("k", D.parse_reply(F.col("t")).alias("r")).collect()
    assert {r.k: (r.r.root_cause, r.r.patch) for r in got} == {k: want for k, (_, want) in enumerate(REPLIES)}


def test_unified_diffs_count_line_ends(spark):
    df = spark.createDataFrame([("a\nb\n", "c")], "old string, new string")
    plain, stamped = df.select(D.unified_diff(F.col("old"), F.col("new"), F.lit("x.c")).alias("d"), D.unified_diff(F.col("old"), F.col("new"), F.lit("x.c"), F.lit("now")).alias("e")).first()
    assert plain == "--- a/x.c\n+++ b/x.c\n@@ -1,3 +1,1 @@\n-a\n-b\n+c"
    assert stamped.startswith("--- a/x.c\tnow\n+++ b/x.c\tnow\n@@")


PATCHES = [("board 1", "s", "+a"), ("board 1", "s", "+b"), ("b/2", "s", "+c"), ("b3", "s", " none "), ("b4", "s", None), ("b5", "s", " ")]


def test_patches_are_files(spark, tmp_path):
    df = spark.createDataFrame(PATCHES, "device string, stamp string, patch string").repartition(4)
    for files in ({"board_1_s.patch", "board_1_s_2.patch", "b_2_s.patch"}, {"board_1_s.patch", "board_1_s_2.patch", "board_1_s_3.patch", "board_1_s_4.patch", "b_2_s.patch", "b_2_s_2.patch"}):
        patches.write_patches(spark, df, str(tmp_path / "out"))
        assert {p.name for p in (tmp_path / "out").iterdir()} == files
    patches.write_patches(spark, df, f"file://{tmp_path}/out", "overwrite")
    assert {p.read_text() for p in (tmp_path / "out").iterdir()} == {"+a", "+b", "+c"}


def test_a_task_that_is_tried_again_leaves_its_files_once(tmp_path):
    from pyspark.sql.types import Row

    writer = patches.PatchWriter(str(tmp_path), overwrite=False)
    rows = [Row(name="a.patch", patch="1"), Row(name="b.patch", patch="2")]

    def breaks():
        yield rows[0]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(breaks())
    lost, again = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.files != again.files
    writer.commit([again])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.patch", "b.patch"]
    other = patches.PatchWriter(str(tmp_path), overwrite=False)
    other.abort([other.write(iter(rows))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.patch", "b.patch"]
