"""Estimates of similarity from stored sketches, and copies with more text at the threshold."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boardlens.llm import hashing, minhash_dedup

K = minhash_dedup.ESTIMATE_K


def extended_copies(n, seed=1):
    """Texts of 130 to 224 pairs of words, each with a copy that has more text, at similarities of 0.80 to 0.82."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        short = int(rng.integers(130, 225))
        long = int(rng.integers(-(-100 * short // 82), 5 * short // 4 + 1))
        words = [f"v{k}x{j}" for j in range(long + 1)]
        out.append((" ".join(words[: short + 1]), " ".join(words)))
    return out


def test_estimates_keep_the_order_of_values(spark):
    pairs = extended_copies(40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([t for p in pairs for t in p])], names=["id", "text"])
    common = SimpleNamespace(value=SimpleNamespace(admits=lambda v: np.zeros(len(v), bool)))
    low = [x for b in minhash_dedup._sketch_rows(2, minhash_dedup.K, common, None)([batch]) for x in b.column(4).to_pylist()]
    sets = []
    for w in hashing.words(batch.column(1), lower=True):
        values, bounds = minhash_dedup.shingle_sets(w, 2)
        sets += [values[a:b][:K] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    want = [len(np.intersect1d(np.intersect1d(x, y), np.union1d(x, y)[:K])) / K for x, y in zip(sets[::2], sets[1::2], strict=True)]
    rows = spark.createDataFrame([(k, low[2 * k], low[2 * k + 1]) for k in range(40)], "k int, x array<int>, y array<int>")
    got = [r.e for r in rows.select("k", minhash_dedup._estimate("x", "y", K).alias("e")).orderBy("k").collect()]
    assert np.allclose(got, want)


def test_extended_copies_are_linked(spark):
    pairs = extended_copies(1500, seed=2)
    for a, b in pairs:
        x, y = ({*zip(t.split(), t.split()[1:], strict=False)} for t in (a, b))
        assert 100 * len(x & y) >= 80 * len(x | y)
    rows = spark.createDataFrame([(2 * k + m, t) for k, p in enumerate(pairs) for m, t in enumerate(p)], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(rows, width=2).select("doc_id", "component_id")
    assert got.where(F.col("component_id") != F.col("doc_id") - F.col("doc_id") % 2).count() == 0 and got.count() == 3000


def test_estimates_in_tasks_equal_those_in_joins():
    rng = np.random.default_rng(5)
    x, y = (np.full((50, K), minhash_dedup._NONE) for _ in range(2))
    want = []
    for k in range(50):
        a, b = (np.unique(rng.integers(-200, 200, rng.integers(1, 400)))[:K] for _ in range(2))
        x[k, : len(a)], y[k, : len(b)] = a, b
        union = np.union1d(a, b)
        want.append(len(np.intersect1d(np.intersect1d(a, b), union[:K])) / min(K, len(union)))
    assert np.allclose(minhash_dedup.estimates(x, y, K), want)


def test_recall_on_planted_links(spark):
    """Links of planted near copies at similarities of 0.80 to 0.95, beside passages that many texts share: all are found."""
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(300):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 200)))] + (passage if k % 3 == 0 else [])
        rows.append(base)
        for _ in range(int(rng.integers(0, 4))):
            rows.append(base + [f"n{x}" for x in rng.integers(0, 10**9, max(1, len(base) // int(rng.integers(5, 20))))])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    fast, sure = ({r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, width=2, exact=e).collect()} for e in (False, True))
    sets = [{*zip(w, w[1:], strict=False)} for w in rows]
    links = [(x, y) for x in range(len(sets)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    assert len(links) > 200 and all(sure[x] == sure[y] for x, y in links)
    assert sum(fast[x] == fast[y] for x, y in links) >= 0.99 * len(links)
    assert len({*sure.values()}) <= len({*fast.values()})


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    """Near copies of one text, whose lists hold all of them, with small blocks."""
    monkeypatch.setattr(minhash_dedup, "LIST_BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "TOGETHER", 16)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(60, int(rng.integers(1, 9)), replace=False):
            own[at] = f"x{k}y{at}"
        rows.append(own)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    sets = [{*zip(w, w[1:], strict=False)} for w in rows]
    label = list(range(60))
    for x in range(60):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((label[x], label[y]))
                label = [a if v == b else v for v in label]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, width=2).collect()}
    assert [got[k] for k in range(60)] == label
