"""Near-dedup of the pipeline on ids with several texts, words made to collide, and components contracted inside tasks."""

import pytest
from pyspark.sql import functions as F

from boardlens.llm import graph, minhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_a_text_that_shares_its_id_with_a_duplicate_stays(spark, pipeline):
    rows = [(1, A), (3, A), (3, B), (4, A + " more"), (4, A), (5, B), (5, B), (None, A), (None, A), (6, None), (6, None), (7, " "), (3, "")]
    got = pipeline.near_dedup_stage(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, A), (3, B), (0, A), (0, A), (6, ""), (6, ""), (7, " "), (3, "")])


def test_words_that_collide_in_one_hash_stay_apart(spark):
    x, y = 'tf]35#&"abcdefgh', "v4@5~/rp!(:gh((2"
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, width=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("in_task", [1 << 20, 40])
def test_components_contracted_in_tasks(spark, in_task):
    links = [(k, k + 1) for k in range(0, 200) if k % 50] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.id: r.component for r in graph.components(df, in_task=in_task).collect()}
    want = {k: max(1, 50 * ((k - 1) // 50) + 1) for k in range(1, 201)} | dict.fromkeys(range(500, 560), 500)
    assert got == want
    names = graph.components(df.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b")), in_task=in_task).collect()
    assert {r.id for r in names if r.component == "n500"} == {f"n{k}" for k in range(500, 560)}
