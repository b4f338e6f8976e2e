from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.operators import diagnosis as D
from boardlens.operators import logs as L
from boardlens.operators import stores

LOG = """[2026-04-15 10:00:00] INFO voltage=3300 mv
DEBUG Loading module

2026/04/15 10:00:01.5 WARNING: retry current: -5 ma
2026-13-45 99:00:00 odd stamp temp=41.5 c
<ERR> kernel panic at boot
   [<0800abcd>] fault_handler in core
   r0: 0x12345678
Oops #1 later
"""


def lines(spark, text=LOG, name="board01_x.log"):
    return L.lines_of_files(spark.createDataFrame([(name, text)], "file string, content string"))


def test_lines_keep_their_numbers(spark):
    got = lines(spark).orderBy("line_number").collect()
    assert [r.line_number for r in got] == [1, 2, 4, 5, 6, 7, 8, 9]
    assert {r.device for r in got} == {"board01"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x85 ", max_size=12), min_size=1, max_size=20))
def test_lines_are_those_of_splitlines(spark, texts):
    got = spark.createDataFrame([*enumerate(texts)], "k int, t string").select("k", X.lines(F.col("t")).alias("l")).collect()
    assert {r.k: r.l for r in got} == {k: t.splitlines() for k, t in enumerate(texts)}


def test_parse_levels_and_messages(spark):
    got = {r.line_number: r for r in L.parsed(lines(spark)).collect()}
    assert got[1].ts == datetime(2026, 4, 15, 10) and got[1].level == "INFO" and got[1].message == "INFO voltage=3300 mv"
    assert got[2].level == "DEBUG" and got[4].level == "WARNING" and got[4].message == "retry current: -5 ma"
    assert got[5].ts is None and got[5].message == "odd stamp temp=41.5 c"
    compat = {r.line_number: r.level for r in L.parsed(lines(spark), compat=True).collect()}
    assert compat[2] == "ERROR" and compat[4] == "INFO"


def test_readings_and_quarantine(spark):
    m = L.last_readings(L.parsed(lines(spark)))
    r = m.first()
    assert (r.voltage_mv, r.current_ma, r.temp_c) == (3300.0, -5.0, 41.5)
    assert m.where(L.valid_readings(m)).count() == 0


def test_error_context(spark):
    r = L.error_context(lines(spark)).first()
    assert r.error_type == "Kernel Panic" and r.line_number == 6
    assert len(r.surrounding) == 8 and r.register_dump == "r0: 0x12345678" and "fault_handler" in r.stack_trace
    a = L.alerts(D.diagnosed(L.first_errors(lines(spark))), F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert a.level == "CRITICAL" and a.summary == "The kernel stopped on a fatal condition" and a.id == "board01-2024-01-01T00:00:00"
    text = L.error_context(lines(spark)).select(L.context_text(F.col("file")).alias("t")).first().t
    assert text.startswith("[device]\nboard01")


def test_no_error_no_row(spark):
    assert L.error_context(lines(spark, "INFO fine\n")).count() == 0
    assert lines(spark, "").count() == 0


def test_stores_and_pages(spark):
    rows = spark.range(2000).withColumnRenamed("id", "seq")
    assert [r.seq for r in stores.recent_logs(rows, ["seq"], limit=3).collect()] == [1997, 1998, 1999]
    assert stores.recent_logs(rows, ["seq"], limit=0).count() == 0
    assert stores.recent_alerts(rows, ["seq"]).count() == 100
    page = stores.page(rows, ["seq"], 10, 5).collect()
    assert [r.seq for r in page] == [*range(10, 15)] and page[0].total == 2000


def test_text_estimates(spark):
    df = spark.createDataFrame([("abcd efgh",), ("漢字漢字",)], "t string")
    got = df.select(X.estimate_by_characters(F.col("t")).alias("a"), X.estimate_by_runs(F.col("t")).alias("b"), X.cjk_share(F.col("t")).alias("c")).collect()
    assert got[0].a == 2 and got[0].b == 4 and got[1].a == 2 and got[1].b == 2 and got[1].c == 1.0
    words = df.select(X.query_words(F.lit("say \"the pc\" now 'lr x'")).alias("w")).first().w
    assert set(words) == {"say", "the", "now", "pc", "lr", "x"}


def test_device_names_and_styles(spark):
    df = spark.createDataFrame([("a/board7_1.log", "[ALERT:CRITICAL] x"), ("core.dmp", "[STREAM] y")], "f string, s string")
    got = df.select(L.device_of(F.col("f")).alias("d"), L.line_style(F.col("s")).alias("s"), L.is_log_file(F.col("f"), F.lit(4)).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("board7", "alert-critical", True), ("core", "stream", True)]
