"""Language-model scores of whole texts from a log-bilinear model trained by noise-contrastive estimation.

Tokens are words [^\x20\x09-\x0D]+ of text lower-cased A-Z, then one end. Word counts of the training documents are a
table that grows with the corpus. The most frequent words are classes of their own; all other words fall into
classes by their ending, and within such a class a word has its share of counts, (c + 1) / (N + V + 1), of which one
share is for words never seen. The log-bilinear model gives each class its probability after the two classes before it:
each of the two has a vector that is multiplied with the class's vector, and the log of the class's frequency joins.

Training: how often each class follows each other class at distance 1 and at distance 2 is counted over all tokens of all
training documents, in grouped sums of at most (classes + 1)**2 cells. On the driver numpy takes noise-contrastive steps over
whole tables: a step is three matrix products, and the noise words stand in it by their frequency instead of being
drawn. Counts are sums of integers, so the model does not depend on how documents are dealt out to tasks. The normaliser
of every two classes of context is one row of a batched matrix product; so scores are proper log-probabilities.

Counts of the most frequent HEAD words go to the tasks; the other words of each document meet the table of counts in a join.

Cases: null or empty text is one end token; very long texts and words are tokens like others; a null id is trained on and isn't
held out; rows with one id are counted and scored each for itself; of words with equal counts at the border of HEAD or
OWN_CLASS those with lower hashes come first; without training documents all words are unknown; an empty table gives no
rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import hashing
from boardlens.llm.store import mapped, saved

#: Words whose counts tasks hold, words with a class of their own, classes by ending, width of the vectors of a context place.
HEAD, OWN_CLASS, ENDINGS, WIDTH = 1 << 18, 1000, 64, 24
#: Noise words for a data word, steps, their size, and the ridge penalty in counts.
NOISE, STEPS, RATE, RIDGE = 10.0, 150, 0.05, 5.0
#: Words that a task counts together.
COUNTED = 1 << 21
#: Weights of the two places of context in the score.
PLACES = (0.9, 0.7)


class LogBilinear:
    """Classes 0 .. n - 1; n stands for the begin of a text in contexts."""

    def __init__(self, unigram: np.ndarray, width: int = WIDTH):
        n = len(unigram)
        self.n, self.width = n, width
        self.bias = np.log(unigram).astype(np.float32)
        self.first = np.zeros((n + 1, 2 * width), np.float32)
        self.second = np.zeros((n + 1, 2 * width), np.float32)
        self.out = np.zeros((n, 2 * width), np.float32)

    def train(self, counts: list[np.ndarray], steps: int = STEPS, seed: int = 3) -> None:
        """counts: for each place of context, how often class c (column) comes with context class (row)."""
        for place, table in enumerate(counts):
            at = slice(place * self.width, (place + 1) * self.width)
            u, v = self._factors(table.astype(np.float32), steps, np.random.default_rng(seed + place))
            (self.first, self.second)[place][:, at] = PLACES[place] * u
            self.out[:, at] = v

    def _factors(self, table: np.ndarray, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of contexts and classes by noise-contrastive Adam steps over the whole table.

        A data word has the log-odds u.v - log NOISE against noise of the classes' frequencies. Beside the products of
        vectors a context has a constant, so that it need not be normalised while it is trained.
        """
        total = max(1.0, float(table.sum()))
        u = rng.normal(0, 0.1, (self.n + 1, self.width)).astype(np.float32)
        v = rng.normal(0, 0.1, (self.n, self.width)).astype(np.float32)
        v[:, 0] = 1.0
        noise = table.sum(1, keepdims=True) * (NOISE * np.exp(self.bias))[None]
        moments = [np.zeros_like(x) for x in (u, u, v, v)]
        for t in range(1, steps + 1):
            odds = u @ v.T
            odds -= np.float32(np.log(NOISE))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            g = (table + noise) * p - table
            for x, grad, m, s in ((u, (g @ v + RIDGE * u) / total, *moments[:2]), (v, (g.T @ u + RIDGE * v) / total, *moments[2:])):
                if x is v:
                    grad[:, 0] = 0
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        return u, v

    def log_normalisers(self, w1: int) -> np.ndarray:
        """For each class before it, the log of the sum over all classes of exp(score) after w1."""
        score = (self.first[w1] + self.second) @ self.out.T + self.bias
        most = score.max(1, keepdims=True)
        return (most[:, 0] + np.log(np.exp(score - most).sum(1))).astype(np.float32)

    def log_probability(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """Natural log of the probabilities of classes w."""
        score = np.einsum("ij,ij->i", self.first[w1] + self.second[w2], self.out[w]) + self.bias[w]
        return score - normalisers[w1, w2]


class Vocabulary:
    """Counts of frequent words, and the classes of all words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, own: int, endings: int, by_ending: np.ndarray, ends: int):
        order = np.lexsort((keys, -counts))
        keys, counts = keys[order].view(np.uint64), counts[order]
        self.lookup, self.counts = hashing.Lookup(keys, np.arange(len(keys))), counts
        self.own, self.endings, self.ends = min(own, len(keys)), endings, ends
        self.n = 1 + self.own + endings
        #: by_ending: (tokens, words) of each ending, of words that have no class of their own.
        self.share = -np.log10(by_ending.sum(1) + 1)
        unigram = np.concatenate([[ends], counts[: self.own], by_ending[:, 0]]).astype(np.float64) + 1
        self.unigram = unigram / unigram.sum()

    def classes(self, number: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """number: of words in the lookup, -1 for others."""
        return np.where((number >= 0) & (number < self.own), number + 1, 1 + self.own + ending)


def endings(w: hashing.Words, n: int = ENDINGS) -> np.ndarray:
    """The class of each word by its last two bytes."""
    last = w.low[w.ends - 1].astype(np.uint32)
    before = np.where(w.ends - w.starts > 1, w.low[np.maximum(w.ends - 2, 0)], 0).astype(np.uint32)
    return ((((last << np.uint32(8)) | before) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % n


def sequences(vocabulary: Vocabulary, w: hashing.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class before that, class, text) of all tokens of the texts, ends included, and the numbers of the words."""
    number = vocabulary.lookup(w.hashes, -1)
    n, texts = len(number), w.n_texts
    text = np.repeat(np.arange(texts), np.diff(w.bounds))
    c = np.zeros(n + texts, np.int64)
    c[np.arange(n) + text] = vocabulary.classes(number, endings(w, vocabulary.endings))
    own = np.repeat(np.arange(texts), np.diff(w.bounds) + 1)
    start = w.bounds[:-1] + np.arange(texts)
    w1, w2 = np.full(n + texts, vocabulary.n), np.full(n + texts, vocabulary.n)
    w1[1:], w2[2:] = c[:-1], c[:-2]
    w1[start], w2[start] = vocabulary.n, vocabulary.n
    w2[start[start + 1 < n + texts] + 1] = vocabulary.n
    w2[start] = vocabulary.n
    return w1, w2, c, own, number


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (hashes) with their counts and endings, for up to COUNTED different words of pieces of text at a time."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    ends: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        h, first, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate([np.zeros(0), *counts]), len(h)).astype(np.int64)
        e = np.concatenate([np.zeros(0, np.int64), *ends])[first].astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(e)], names=["h", "c", "ending"])

    for batch in batches:
        for w in hashing.words(batch.column(0), lower=True):
            h, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            keys.append(h)
            counts.append(n)
            ends.append(endings(w)[first])
        if sum(map(len, keys)) >= COUNTED:
            yield counted()
            keys, counts, ends = [], [], []
    yield counted()


def _pair_rows(vocabulary):
    """Cells of the tables of neighbours, with their counts over the texts of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = vocabulary.value.n
        tables = None
        for batch in batches:
            if tables is None:
                tables = np.zeros((2, (n + 1) * n), np.int64)
            for w in hashing.words(batch.column(0), lower=True):
                w1, w2, c = sequences(vocabulary.value, w)[:3]
                for table, before in zip(tables, (w1, w2), strict=True):
                    cell, count = np.unique(before * n + c, return_counts=True)
                    table[cell] += count
        if tables is not None:
            for place, table in enumerate(tables):
                cell = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), place, np.int8)), pa.array(cell.astype(np.int32)), pa.array(table[cell])], names=["place", "cell", "count"])

    return rows


def train(texts: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """The model of all tokens of texts; at most 2 * (n + 1) * n cells come to the driver."""
    model = LogBilinear(vocabulary.unigram)
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)
    cells = mapped(texts, _pair_rows(sent), "place byte, cell int, count long").groupBy("place", "cell").agg(F.sum("count").alias("count")).toArrow()
    place, cell, count = (cells.column(k).to_numpy() for k in ("place", "cell", "count"))
    tables = np.zeros((2, (model.n + 1) * model.n))
    tables[place, cell] = count
    model.train([t.reshape(model.n + 1, model.n) for t in tables])
    return model


def _normaliser_rows(sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.log_normalisers(k).tobytes() for k in contexts], pa.binary())], names=["id", "z"])

    return rows


def normalisers(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    """log of the normaliser for each two classes of context; classes are bounded, and so is this table."""
    sent = spark.sparkContext.broadcast(model)
    got = mapped(spark.range(model.n + 1).repartition(24, "id"), _normaliser_rows(sent), "id long, z binary").collect()
    out = np.zeros((model.n + 1, model.n + 1), np.float32)
    for r in got:
        out[r.id] = np.frombuffer(bytes(r.z), np.float32)
    return out


def _score_rows(vocabulary, sent):
    """id, a key of the row that is drawn anew (the table is written once), counts and sums over its tokens, unknown words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        model, z = sent.value
        log_count = np.log10(v.counts + 1.0)
        end = np.log10(v.ends + 1.0)
        for batch in batches:
            for w in hashing.words(batch.column(1), lower=True):
                w1, w2, c, own, number = sequences(v, w)
                n_words, texts = np.diff(w.bounds), w.n_texts
                text = np.repeat(np.arange(texts), n_words)
                known = number >= 0
                counted = np.where(known, log_count[np.maximum(number, 0)] if len(log_count) else 0.0, 0.0)
                base = np.bincount(text, counted, texts) + end
                score = np.bincount(own, model.log_probability(w1, w2, c, z) / np.log(10), texts)
                ending = c[np.arange(len(number)) + text] - 1 - v.own
                shared = ending >= 0
                score += np.bincount(text[shared], (v.share[ending[shared]] + counted[shared]), texts)
                rest = ~known
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rest], minlength=texts))]).astype(np.int32)), pa.array(w.hashes[rest].view(np.int64)))
                n_known = np.bincount(text[known], minlength=texts) + (v.ends > 0)
                key = np.frombuffer(os.urandom(8 * texts), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, texts), pa.array(key), pa.array(n_words + 1), pa.array(n_known), pa.array(base), pa.array(score), tail], names=["id", "key", "n_tokens", "n_known", "base", "score", "tail"])

    return rows


def _head(counts: DataFrame, most: int) -> pa.Table:
    """The words of a count that at most `most` words reach."""
    steps = counts.groupBy(F.floor(8 * F.log2("c")).alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, float("inf")
    for row in steps:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return counts.where(F.floor(8 * F.log2("c")) >= F.lit(least)).select("h", "c", "ending").toArrow()


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; the model learns from rows of `training`."""
    sc = docs.sparkSession.sparkContext
    texts = docs.where(training).select(F.col(text_col).alias("text"))
    counts = mapped(texts.where("text is not null"), _count_rows, "h long, c long, ending byte").groupBy("h").agg(F.sum("c").alias("c"), F.first("ending").alias("ending"))
    counts = saved(counts, "counts")
    by_ending = np.zeros((ENDINGS, 2))
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        by_ending[r.ending] = r.c, r.n
    ends = texts.count()
    n, v = int(by_ending[:, 0].sum()) + ends, int(by_ending[:, 1].sum()) + (ends > 0)
    head = _head(counts, HEAD)
    keys, c, e = (head.column(k).to_numpy() for k in ("h", "c", "ending"))
    top = np.lexsort((keys.view(np.uint64), -c))[:OWN_CLASS]
    by_ending -= np.stack([np.bincount(e[top], c[top], ENDINGS), np.bincount(e[top], minlength=ENDINGS)], 1)
    vocabulary = Vocabulary(keys, c, OWN_CLASS, ENDINGS, by_ending, ends)
    model = train(texts, vocabulary)
    z = normalisers(docs.sparkSession, model)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = mapped(own, _score_rows(sc.broadcast(vocabulary), sc.broadcast((model, z))), f"id {dict(own.dtypes)['id']}, key long, n_tokens long, n_known long, base double, score double, tail array<long>")
    scored = saved(scored, "scored")
    tail = scored.select("key", F.explode("tail").alias("h")).groupBy("key", "h").agg(F.count("*").alias("tf"))
    tail = tail.join(counts.select("h", "c"), "h").groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("known"))
    out = scored.drop("tail").join(tail, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    return got.withColumn("held_out", held_out)


QUERIES = {"op1_lm_score": op1_lm_score}
