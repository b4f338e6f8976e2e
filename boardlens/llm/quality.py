"""Document quality by hierarchical empirical Bayes.

Two linear classifiers (low quality, toxic) over hashed words and shape features are fitted on the driver on the whole texts of
at most `most_labels` labelled documents (the lowest hashes of the id), whose features are made in tasks. Every document gets
their log-odds as evidence.

Evidence is pooled by site over all documents: the expected number of bad documents of a host, and of each path of it,
is summed in grouped aggregates. Beta priors are fitted by moments at two levels: the spread of hosts' rates around the global
rate gives the strength of the prior of hosts, the spread of paths' rates around their hosts' that of paths. A host's
posterior mean shrinks towards the global rate, a path's towards its host's, so sparse sites stay near their parent. For each
document its own share is taken out of its path's and host's sums first, so that no evidence counts twice. A document's
log-odds are its evidence plus the log-odds of its path over the global ones, of which at most `most_shift` counts.

A document is rejected if its probability of being toxic or of low quality exceeds `threshold`; one that equals it is kept.

Cases: null or empty text has no word evidence, only its shape (empty) and site; very long texts are judged whole; null host or
path are sites of their own; a site of one document leaves its parent's rate; with no labels, or labels of one kind only, that
classifier abstains (log-odds of its smoothed base rate); rows with one id are judged each for itself; documents that several
label rows name take part once for each in the fit; an empty table gives no rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import hashing
from boardlens.llm.store import mapped, saved

MOST_LABELS = 8000
BITS = 18
LEAST_DOCS, LEAST_Z = 4, 3.0
THRESHOLD = 0.3
MOST_SHIFT = 1.0
KINDS = ("low_quality", "toxic")
#: Beyond the hashed words: shares of letters, capitals, digits, spaces and marks among bytes, mean word length, share of
#: words with three marks in a row or a single mark, number of distinct words over words, log of the number of words.
SHAPES = 10

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = ~(hashing.ALNUM | _UPPER | ~hashing.NOT_SPACE)
_MARK[0x80:] = False


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text of each distinct word, its bucket, shapes by text) for parts of a batch."""
    for w in hashing.words(texts, hashing.ALNUM, lower=True):
        n_texts = w.n_texts
        text = np.repeat(np.arange(n_texts), np.diff(w.bounds))
        bucket = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        pair = np.unique(text << BITS | bucket)
        own, bucket = pair >> BITS, pair & (1 << BITS) - 1
        size = np.maximum(np.diff(w.text_at), 1)

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask[w.raw])])  # noqa: B023
            return (total[w.text_at[1:]] - total[w.text_at[:-1]]) / size  # noqa: B023

        mark = _MARK[w.raw]
        blank = ~hashing.NOT_SPACE[w.raw]
        n_words = np.diff(w.bounds)
        lone = np.zeros(len(mark), bool)
        pairs = np.zeros(len(mark), bool)
        if len(mark) > 2:
            lone[1:-1] = mark[1:-1] & blank[:-2] & blank[2:]
            pairs[1:] = mark[1:] & mark[:-1]

        def counted(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[w.text_at[1:]] - total[w.text_at[:-1]]) / np.maximum(n_words, 1)  # noqa: B023

        length = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
        shapes = np.stack(
            [
                share(hashing.ALNUM & ~_DIGIT),
                share(_UPPER),
                share(_DIGIT),
                share(~hashing.NOT_SPACE),
                share(_MARK),
                np.minimum(1, (length[w.bounds[1:]] - length[w.bounds[:-1]]) / np.maximum(n_words, 1) / 20),
                np.minimum(1, counted(lone)),
                np.minimum(1, counted(pairs)),
                np.bincount(own, minlength=n_texts) / np.maximum(n_words, 1),
                np.log1p(n_words) / 10,
            ],
            1,
        )
        yield w.first, own, bucket, shapes


class Linear:
    """Log-odds: a bias, weights of distinct words that tell the classes apart, and weights of shapes in steps."""

    STEPS = 12

    def __init__(self):
        self.words, self.shapes, self.bias = np.zeros(1 << BITS), np.zeros(SHAPES * self.STEPS), 0.0

    @classmethod
    def steps(cls, shapes: np.ndarray) -> np.ndarray:
        """Columns of the steps that the shapes are in; steps are finer for small shares."""
        level = np.minimum((np.sqrt(np.clip(shapes, 0, 1)) * cls.STEPS).astype(np.int64), cls.STEPS - 1)
        return level + np.arange(SHAPES) * cls.STEPS

    def score(self, own: np.ndarray, bucket: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(own, self.words[bucket], len(shapes)) + self.shapes[self.steps(shapes)].sum(1)

    def fit(self, own: np.ndarray, bucket: np.ndarray, shapes: np.ndarray, y: np.ndarray, rounds: int = 400) -> None:
        """Logistic regression with ridge penalty by AdaGrad. Words take part if LEAST_DOCS rows have them and their log-odds
        ratio differs from 0 by LEAST_Z standard errors; without that, rare words would learn single documents by heart.
        """
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(rate / (1 - rate)))
        if not 0 < y.sum() < len(y):
            return
        bad, good = y.sum(), len(y) - y.sum()
        x, n = np.bincount(bucket, y[own], len(self.words)), np.bincount(bucket, minlength=len(self.words))
        ratio = np.log((x + 0.5) / (bad - x + 0.5)) - np.log((n - x + 0.5) / (good - n + x + 0.5))
        telling = (n >= LEAST_DOCS) & (np.abs(ratio) >= LEAST_Z * np.sqrt(1 / (x + 0.5) + 1 / (n - x + 0.5)))
        own, bucket = own[telling[bucket]], bucket[telling[bucket]]
        step_at = self.steps(shapes)
        sq_w, sq_s = np.zeros_like(self.words), np.zeros_like(self.shapes)
        for _ in range(rounds):
            g = 1 / (1 + np.exp(-np.clip(self.score(own, bucket, shapes), -30, 30))) - y
            gw = np.bincount(bucket, g[own], len(self.words)) + 0.05 * self.words
            gs = np.bincount(step_at.ravel(), np.repeat(g, SHAPES), len(self.shapes)) + 0.05 * self.shapes
            sq_w += gw * gw
            sq_s += gs * gs
            self.words -= 0.2 * gw / np.sqrt(sq_w + 1e-2)
            self.shapes -= 0.2 * gs / np.sqrt(sq_s + 1e-2)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels, buckets of distinct words and shapes of labelled texts."""
    for batch in batches:
        for first, own, bucket, shapes in features(batch.column(1)):
            buckets = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(shapes) + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(shapes) + 1, dtype=np.int32) * SHAPES), pa.array(shapes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(shapes)), buckets, values], names=["row", "buckets", "shapes"])


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, id_col: str = "doc_id", text_col: str = "text") -> list[Linear]:
    """One classifier for each of KINDS; labels has id_col, quality (1 good, 0 low) and toxic (1 toxic)."""
    known = labels.select(F.col(id_col).alias("id"), (1 - F.col("quality")).cast("double").alias("low_quality"), F.col("toxic").cast("double").alias("toxic")).where("id is not null")
    known = known.orderBy(F.xxhash64("id"), "id", "low_quality", "toxic").limit(most_labels)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    own = own.select(F.struct(F.xxhash64("id", "text").alias("at"), *KINDS).alias("row"), "text")
    got = mapped(own, _feature_rows, f"row {own.schema['row'].dataType.simpleString()}, buckets array<int>, shapes array<double>")
    got = got.select("row.*", "buckets", "shapes").orderBy("at", *KINDS).limit(2 * most_labels).toArrow().combine_chunks()
    buckets = got.column("buckets").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    own_at = np.repeat(np.arange(len(buckets)), buckets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    bucket = buckets.flatten().to_numpy().astype(np.int64)
    shapes = got.column("shapes").combine_chunks().flatten().to_numpy().reshape(-1, SHAPES) if got.num_rows else np.zeros((0, SHAPES))
    out = []
    for kind in KINDS:
        model = Linear()
        y = got.column(kind).to_numpy()
        use = ~np.isnan(y)
        number, keep = np.cumsum(use) - 1, use[own_at]
        model.fit(number[own_at[keep]], bucket[keep], shapes[use], y[use])
        out.append(model)
    return out


def _evidence_rows(models):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros((len(KINDS), batch.num_rows))
            for first, own, bucket, shapes in features(batch.column(1)):
                for k, m in enumerate(models.value):
                    score[k, first : first + len(shapes)] = m.score(own, bucket, shapes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, score)], names=["row", *KINDS])

    return rows


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(m: float, between: float, noise: float) -> float:
    """Documents that a beta prior counts as: what rates vary beyond sampling noise gives it, held between 1 and 10,000."""
    return min(1e4, max(1.0, m * (1 - m) / max(between - noise, 1e-9) - 1))


def posteriors(evidence: DataFrame, most_shift: float = MOST_SHIFT) -> DataFrame:
    """evidence (host, path, log-odds of each of KINDS, ...) with p_<kind>: evidence and site of each row, its own share left out."""
    p = {k: 1 / (1 + F.exp(-F.col(k))) for k in KINDS}
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n_path"), *(F.sum(p[k]).alias(f"{k}_path") for k in KINDS))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.count("*").alias("k_path"), *(F.sum(f"{k}_path").alias(f"{k}_host") for k in KINDS), *(F.sum(F.col(f"{k}_path") * F.col(f"{k}_path") / F.col("n_path")).alias(f"{k}_square") for k in KINDS))
    of_hosts = [F.sum(f"{k}_host").alias(f"{k}_bad") for k in KINDS] + [F.sum(F.col(f"{k}_host") * F.col(f"{k}_host") / F.col("n_host")).alias(f"{k}_hosts") for k in KINDS] + [F.sum(f"{k}_square").alias(f"{k}_paths") for k in KINDS]
    total = hosts.agg(F.sum("n_host").alias("n"), F.count("*").alias("hosts"), F.sum("k_path").alias("paths"), *of_hosts).first()
    n = float(total.n or 0)
    # As many rows as there are sites, which may be many: the join is left to the planner.
    renamed = {c: f"site_{c}" for c in ("host", "path")}
    sites = paths.join(hosts.drop(*(f"{k}_square" for k in KINDS)).withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of", "k_path").withColumnsRenamed(renamed)
    out = evidence.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left")
    for k in KINDS:
        bad, by_host, by_path = (float(total[f"{k}_{x}"] or 0) for x in ("bad", "hosts", "paths"))
        m = (bad + 0.5) / (n + 1)
        noise = m * (1 - m) / n if n else 0.0
        of_host = _strength(m, by_host / n - m * m, noise * total.hosts) if n else 1.0
        of_path = _strength(m, (by_path - by_host) / n, noise * (total.paths - total.hosts)) if n else 1.0
        host_rate = (F.col(f"{k}_host") - p[k] + of_host * m) / (F.col("n_host") - 1 + of_host)
        path_rate = (F.col(f"{k}_path") - p[k] + of_path * host_rate) / (F.col("n_path") - 1 + of_path)
        # Sums of floating-point numbers less one of them may fall below 0 by rounding.
        rate = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), path_rate))
        shift = F.greatest(F.lit(-most_shift), F.least(F.lit(most_shift), _odds(rate) - float(np.log(m / (1 - m)))))
        out = out.withColumn(f"p_{k}", 1 / (1 + F.exp(-(F.col(k) + shift))))
    return out.select(*evidence.columns, *(f"p_{k}" for k in KINDS))


def judge(docs: DataFrame, models: list[Linear], host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most_shift: float = MOST_SHIFT) -> DataFrame:
    """For each row of docs: id_col, host, path, p_low_quality, p_toxic, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    own = docs.select(F.struct(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path")).alias("row"), F.col(text_col).alias("text"))
    kind = own.schema["row"].dataType.simpleString()
    evidence = mapped(own, _evidence_rows(sent), f"row {kind}, low_quality double, toxic double").select("row.*", *KINDS)
    out = posteriors(saved(evidence, "evidence"), most_shift)
    rejected = (F.col("p_low_quality") > threshold) | (F.col("p_toxic") > threshold)
    return out.select(F.col("id").alias(id_col), "host", "path", "p_low_quality", "p_toxic", rejected.alias("rejected"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources; a path is a source's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), F.col("source"), F.col("lang"))


QUERIES = {"op8_quality": op8_quality}
