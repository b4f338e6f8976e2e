"""Importance resampling next to a plain computation."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from boardlens.llm import importance as I


def features(text, most):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets, most, least, percent, seed):
    own = [features(t, most) for _, t in docs]
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, fs in own for f in fs), Counter(at(f) for x in target for f in features(x, most)[1])
    n_s, n_t, rows = sum(s.values()), sum(t.values()), []
    for k, ((i, _), (w, fs)) in enumerate(zip(docs, own, strict=True)):
        weight = sum(math.floor(1000 * math.log(float(t[at(f)] + 1) * (n_s + buckets) / (float(s[at(f)] + 1) * (n_t + buckets)))) for f in fs)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least, k])
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    ranks = {r[5]: place + 1 for place, r in enumerate(may[: percent * len(may) // 100])}
    return sorted(((r[0] is None, r[0] or 0, *r[1:4], ranks.get(r[5]) or 0) for r in rows))


DOCS = [(k, f"Word{k % 7} the {'Éa' * (k % 3)} x{k % 5}, " * (k % 9)) for k in range(90)]
ODD = [(None, "a b c"), (None, None), (1, None), (2, ""), (3, " \n.,"), (4, "same text here"), (4, "same text here"), (5, "long " * 30_000), (6, "a\x00b \x7f c"), (7, "漢字 かな")]


@pytest.mark.parametrize(("docs", "most", "least", "percent"), [(DOCS, 1, 8, 30), (DOCS, 3, 4, 55), (ODD, 1, 2, 100), (ODD, 2, 0, 50)])
def test_equals_plain_computation(spark, docs, most, least, percent):
    target = ["word1 the x1", "the a, B c", None, ""]
    df = spark.createDataFrame([(i, t, "own", "r", 1) for i, t in docs], "doc_id long, text string, id string, row string, bucket int").repartition(3)
    got = I.importance_sample(df, spark.createDataFrame([(t,) for t in target], "text string"), 97, most, least, percent, 11)
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got.collect())
    assert [r[:5] for r in rows] == [r[:5] for r in brute(docs, target, 97, most, least, percent, 11)]
    # Equal rows share their places in either order.
    assert sorted(r[5] for r in rows) == sorted(r[5] for r in brute(docs, target, 97, most, least, percent, 11))


def test_carried_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, "one two three", f"s{k}") for k in range(10)], "doc_id long, text string, score string")
    got = I.importance_sample(df.withColumnRenamed("score", "source"), df.select("text"), least_words=1, percent=30, carry=("text", "source")).where("rank is not null").collect()
    assert len(got) == 3 and all(r.text == "one two three" and r.source == f"s{r.doc_id}" for r in got) and sorted(r["rank"] for r in got) == [1, 2, 3]
    assert I.importance_sample(df.limit(0), df).count() == 0
    assert I.importance_sample(df, df.limit(0), least_words=1).where("rank is not null").count() == 1


def test_places_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = I.ranked(rows.repartition(13), [F.desc("x")]).collect()
    assert all(r.place == 1000 - r.x for r in got)
