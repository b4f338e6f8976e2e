"""Training counts every token of the training texts, whatever their number and partitions, and beats frequencies held out."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boardlens.llm import hashing, lm_score


@pytest.mark.parametrize("n_words", [100, 9000])
def test_every_pair_of_neighbours_is_counted(n_words):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, n_words // 10)) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    words = [*hashing.words(batch.column(0), lower=True)]
    keys, counts = np.unique(np.concatenate([w.hashes for w in words]), return_counts=True)
    vocabulary = lm_score.Vocabulary(keys.view(np.int64), counts, 100, lm_score.ENDINGS, np.ones((lm_score.ENDINGS, 2)), 10)
    n, want = vocabulary.n, Counter()
    for w in words:
        cls = vocabulary.classes(vocabulary.lookup(w.hashes, -1), lm_score.endings(w))
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            c = [n, n, *cls[a:b].tolist(), 0]
            for k in range(2, len(c)):
                want[0, c[k - 1] * n + c[k]] += 1
                want[1, c[k - 2] * n + c[k]] += 1
    [*got] = lm_score._pair_rows(SimpleNamespace(value=vocabulary))([batch, batch.slice(0, 0)])
    assert {(p, c): k for b in got for p, c, k in zip(*(x.to_pylist() for x in b.columns), strict=True)} == dict(want)


def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark):
    rng = np.random.default_rng(8)
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(a if k % 2 else b, 40))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: (r.score, r.base_score, r.n_tokens) for r in lm_score.score_texts(docs.repartition(n), F.col("doc_id") < 200).collect()} for n in (1, 5)]
    assert all(abs(got[0][k][0] - got[1][k][0]) <= 1e-6 * abs(got[0][k][0]) for k in got[0])
    held = [got[0][k] for k in range(200, 300)]
    assert sum(s - base for s, base, _ in held) / sum(n for *_, n in held) > 0.15
