import json

import pytest
from pyspark.sql import functions as F

from boardlens.operators import diagnosis as D
from boardlens.operators import index as I
from boardlens.sources import files
from boardlens.streaming import jobs


FILES = (
    ("src/a.py", "import os\n\ndef first(x):\n    return x + 1\n\n\ndef second(y):\n    return first(y) * 2\n"),
    ("src/b.c", "#include <stdio.h>\r\n\r\nstatic int reset_board(int id)\r\n{\r\n    return id;\r\n}\r\n\r\nvoid main_loop(void)\r\n{\r\n    reset_board(1);\r\n}\r\n"),
    ("src/c.go", "package main\n\nfunc Add(a int, b int) int {\n    return a + b\n}\n\nfunc (s *T) Sub(a int) int {\n    return s.x - a\n}\n"),
    ("src/run.sh", "#!/bin/sh\nset -e\n\nfunction build {\n  make all -j4 target\n}\n\nfunction clean {\n  rm -rf out\n}\n"),
    ("notes/plain.txt", "one line\nanother line\nthird line\nfourth line\nfifth line\n"),
    ("notes/blank.txt", " \n\t\n\n \n \n"),
)


def test_function_chunks(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string")
    got = I.chunks(files).orderBy("file_path", "line_start").collect()
    # One start pattern counts for a file: that of C-like functions also fits the first Go function, and not the method.
    assert [(r.file_path, r.function_name, r.line_start, r.line_end) for r in got if r.function_name] == [
        ("src/a.py", "first", 3, 6),
        ("src/a.py", "second", 7, 8),
        ("src/b.c", "reset_board", 3, 7),
        ("src/b.c", "main_loop", 8, 11),
        ("src/c.go", "Add", 3, 9),
        ("src/run.sh", "build", 4, 7),
        ("src/run.sh", "clean", 8, 10),
    ]
    by = {(r.file_path, r.line_start): r.content for r in got}
    assert by["src/b.c", 8] == "void main_loop(void)\n{\n    reset_board(1);\n}\n" and by["notes/plain.txt", 5] == "fifth line\n"
    assert not any(r.file_path == "notes/blank.txt" for r in got)
    s = I.statistics(files, I.chunks(files)).first()
    size = sum(len(t) for p, t in FILES if p != "notes/blank.txt")
    assert (s.total_files, s.total_bytes, s.languages) == (6, size, {"python": 1, "c": 1, "go": 1, "shell": 1, "txt": 1})


def test_an_indented_first_line_does_not_choose_the_pattern(spark):
    text = "  class A:\ndef one(x):\n    return x + x\n\n\n"
    got = I.function_chunks(spark.createDataFrame([("a.py", text)], "file_path string, content string")).collect()
    assert [r.function_name for r in got] == ["one"]


def test_line_windows(spark):
    df = spark.createDataFrame([("t.txt", "\n".join(map(str, range(60))))], "file_path string, content string")
    got = I.line_chunks(df).orderBy("line_start").collect()
    assert len(got) == 60 and (got[0].line_start, got[0].line_end) == (1, 51) and got[-1].content == "59"


def ranked(spark, budget):
    texts = {"a.c": "error handler crash\n" * 3, "b.c": "error only here", "c.c": "nothing", "d.c": "error crash " * 400}
    chunks = spark.createDataFrame([(p, p, 1, 1, t, None, "c") for p, t in texts.items()], "chunk_id string, file_path string, line_start long, line_end long, content string, function_name string, language string")
    index = I.build(chunks)
    q = spark.createDataFrame([(1, "crash error")], "query_id int, query string")
    return I.retrieve(index.chunks, I.scores(index, q), budget=budget).orderBy("rank").collect()


def test_budget_passes_over_what_does_not_fit(spark):
    free = [r.file_path for r in ranked(spark, 10**6)]
    tight = ranked(spark, 60)
    assert set(free) == {"a.c", "b.c", "d.c"} and "d.c" not in [r.file_path for r in tight]
    assert sum(r.tokens for r in tight) <= 60 and {r.file_path for r in tight} == {"a.c", "b.c"}


def test_names_match_without_words(spark):
    chunks = spark.createDataFrame([("k", "f.c", 1, 1, "xx yy", "reset_board", "c")], "chunk_id string, file_path string, line_start long, line_end long, content string, function_name string, language string")
    q = spark.createDataFrame([(1, "reset now")], "query_id int, query string")
    got = I.scores(I.build(chunks), q).first()
    assert I.scores(I.build(chunks), q, language="go").count() == 0
    assert got.score == pytest.approx(5.0) and got.matched == ["reset"]
    wanted = spark.createDataFrame([("a/b.py",), ("node_modules/x.js",), ("a/x.min.js",), ("a/readme",)], "p string").select(I.wanted(F.col("p")).alias("w")).collect()
    assert [r.w for r in wanted] == [True, False, False, False]


def test_replies_in_json(spark):
    body = json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"total_tokens": 7}})
    r = spark.createDataFrame([(body,)], "b string").select(D.reply(F.col("b")).alias("r")).first().r
    assert (r.content, r.tokens) == ("hi", 7)


def test_contexts_of_queries(spark):
    asked = spark.createDataFrame([(1, "q" * 200), (2, "none")], "query_id int, query string")
    found = spark.createDataFrame([(1, 2, "b.c", 5, 6, None, 1.5, "peripheral", ["x"], "two"), (1, 1, "a.c", 1, 2, "fn", 30.25, "core", ["x", "y"], "one")], "query_id int, rank int, file_path string, line_start long, line_end long, function_name string, score double, label string, matched array<string>, content string")
    got = {r.query_id: (r.context, r.n_chunks) for r in I.context(found, asked).collect()}
    assert got[2] == ("/* No relevant code found for query */", 0)
    assert got[1] == ("/* Code for: " + "q" * 100 + " (2 chunks) */\n\n/* [core] a.c:1-2 fn=fn score=30.25 keywords=x, y */\none\n\n/* [peripheral] b.c:5-6 fn=? score=1.5 keywords=x */\ntwo", 2)


def test_diagnosis_retries_and_falls_back(spark):
    def fails(prompt: str) -> str:
        raise OSError(prompt)

    rows = spark.createDataFrame([(1, "kernel panic")], "id int, prompt string")
    r = D.diagnose(rows, fails, attempts=2, pause=0.0).first()
    assert (r.attempts, r.ok, r.error) == (2, False, "OSError: kernel panic") and "fatal" in r.reply
    assert D.diagnose(rows, fails, attempts=1, fallback=None).first().reply is None
    assert D.diagnose(rows).first().ok


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"b{k}_x.log").write_text(f"INFO voltage={k} mv\nkernel panic at 0x{k}\n")
    (tmp_path / "in" / "skip.bin").write_text("kernel panic")
    q = jobs.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    batch = jobs.tables_of(files.log_files(spark, str(tmp_path / "in")), F.current_timestamp())
    for table in ("log_entry", "metrics", "error_context"):
        got = spark.read.parquet(str(tmp_path / "out" / table)).drop("batch")
        assert got.count() == batch[table].count() == (6 if table == "log_entry" else 3)
        assert got.select("file", "device").exceptAll(batch[table].select("file", "device")).count() == 0
