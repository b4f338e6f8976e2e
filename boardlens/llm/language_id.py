"""Language ID by a linear-chain conditional random field over words, for code-switched text.

A word's emission scores are sums of learned weights: of its byte n-grams of 2 to 4, of which those that touch the word's
edges are its affixes, and of its own entry in a lexicon of frequent words. Learned transitions join neighbouring words.
Forward-backward gives every word a distribution over languages; a document gets the language with the highest mean.

The field is trained on the driver from the whole texts of at most `per_language` labelled documents of each language (the
lowest hashes of the id): segments of documents are strung together, so that transitions see switches.
All documents are then labelled whole, in batches whose documents advance in step.

Cases: `und` with score 0 if the text is null or has no letter, or if nothing was labelled; a null id is labelled like others
and counts as not held out; rows with one id are labelled each for itself; very long texts are labelled whole; of languages with
equal means the first in order is taken; an empty table gives no rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import hashing
from boardlens.llm.store import mapped

PER_LANGUAGE = 250
MOST_LANGUAGES = 64
LEXICON_PER_LANGUAGE = 300
SEGMENT_WORDS = (6, 50)
BITS = {2: 16, 3: 17, 4: 18}
#: Characters of texts whose words advance in step, and of texts whose n-grams are looked up at a time.
TOGETHER, LOOKED_UP = 1 << 22, 1 << 19
#: The characters of hashing.ALNUM: digits, a to z and all beyond ASCII, of lower-cased text.
WORD = regex.compile(r"[0-9a-z\x80-\U0010FFFF]+")
_LETTER = regex.compile(r"\p{L}")


class Encoded:
    """Words of texts: for each, the range of n-gram codes and the lexicon key. Texts are lower-cased and kept apart by line ends."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer(("\n" + "\n".join(texts) + "\n\0\0\0").lower().encode(), np.uint8)
        inside = hashing.ALNUM[raw]
        edge = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        low = np.where(inside, raw, 0).astype(np.uint32)
        n = len(raw) - 3
        self.codes = {2: low[:n] | low[1 : n + 1] << 8}
        third = self.codes[2] | low[2 : n + 2] << 16
        self.codes[3] = (third * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS[3])
        self.codes[4] = ((third | low[3:] << 24) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS[4])
        # Lexicon keys: the word hash of boardlens.llm.hashing.
        self.keys = hashing.word_hashes(raw, self.starts, self.ends)
        line = np.cumsum([0, *(len(t.lower().encode()) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, line + 1)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums over the n-grams that begin at the byte before a word or in it."""
        if not len(self.starts):
            return np.zeros((0, per_byte.shape[1]), per_byte.dtype)
        cut = np.stack([self.starts - 1, self.ends], 1).ravel()
        return np.add.reduceat(per_byte, cut, axis=0)[::2]


class Field:
    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages = languages
        self.grams = {k: np.zeros((1 << b, n), np.float32) for k, b in BITS.items()}
        self.lexicon = hashing.Lookup(lexicon, np.arange(1, len(lexicon) + 1))
        self.words = np.zeros((len(lexicon) + 1, n), np.float32)
        self.bias = np.zeros(n, np.float32)
        self.move = np.zeros((n, n), np.float32)

    def emissions(self, x: Encoded) -> np.ndarray:
        per_byte = self.grams[2][x.codes[2]]
        for k in (3, 4):
            per_byte += self.grams[k][x.codes[k]]
        return x.sums(per_byte) + self.words[self.lexicon(x.keys)] + self.bias

    def posteriors(self, emit: np.ndarray, bounds: np.ndarray, with_moves: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Distribution of each word; with_moves: also the sum over neighbours of the joint distributions."""
        n = len(self.languages)
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # texts with more than t words
        p = np.exp(emit - emit.max(1, keepdims=True)) if len(emit) else emit
        t_ = np.exp(self.move)
        fore, back = np.empty_like(p), np.empty_like(p)
        for t, m in enumerate(alive.tolist()):
            at = start[:m] + t
            a = p[at] if t == 0 else p[at] * (fore[at - 1] @ t_)
            fore[at] = a / a.sum(1, keepdims=True)
        moves = np.zeros((n, n))
        for t in range(len(alive) - 1, -1, -1):
            m, on = int(alive[t]), int(alive[t + 1]) if t + 1 < len(alive) else 0
            at = start[:m] + t
            b = np.ones((m, n), p.dtype)
            if on:
                ahead = p[at[:on] + 1] * back[at[:on] + 1]
                b[:on] = ahead @ t_.T
                if with_moves:
                    joint = fore[at[:on]][:, :, None] * t_[None] * ahead[:, None, :]
                    moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back[at] = b / b.sum(1, keepdims=True)
        both = fore * back
        return (both / both.sum(1, keepdims=True) if len(both) else both), moves


def train(texts: list[str], labels: list[str], rounds: int = 6, batches: int = 8, seed: int = 7) -> Field | None:
    """Maximum likelihood with AdaGrad on strings of segments of the labelled texts."""
    rng = np.random.default_rng(seed)
    languages = sorted({*labels})
    if not languages:
        return None
    words = [(WORD.findall(t.lower()), languages.index(k)) for t, k in zip(texts, labels, strict=True)]
    counts: list[dict[bytes, int]] = [{} for _ in languages]
    for ws, k in words:
        for w in ws:
            key = w.encode()
            counts[k][key] = counts[k].get(key, 0) + 1
    lexicon = sorted({w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_PER_LANGUAGE]})
    field = Field(languages, np.unique(hashing.hash_strings(lexicon)))
    segments: list[list[tuple[list[str], int]]] = [[] for _ in languages]
    for ws, k in words:
        i = 0
        while i < len(ws):
            j = i + int(rng.integers(*SEGMENT_WORDS))
            segments[k].append((ws[i:j], k))
            i = j
    segments = [s for s in segments if s]
    if not segments:
        return field
    # Each string holds segments of one language, and in one of five cases goes on in another.
    pool = [s for own in segments for s in own]
    rng.shuffle(pool)
    strings = []
    for s in pool:
        other = segments[rng.integers(len(segments))]
        strings.append([s, other[rng.integers(len(other))]] if rng.random() < 0.2 else [s])
    rate, squares = 0.4, {}

    def step(name: str, x: np.ndarray, g: np.ndarray) -> None:
        squares[name] = squares.get(name, 0) + g * g
        x -= rate * g / np.sqrt(squares[name] + 1e-6)

    for _ in range(rounds):
        rng.shuffle(strings)
        for k in range(batches):
            own = strings[k::batches]
            if not own:
                continue
            x = Encoded([" ".join(w for ws, _ in s for w in ws) for s in own])
            gold = np.array([label for s in own for ws, label in s for _ in ws])
            post, moves = field.posteriors(field.emissions(x), x.bounds, with_moves=True)
            scale = 1 / len(own)
            g = post.astype(np.float64)
            g[np.arange(len(gold)), gold] -= 1
            inner = np.ones(len(gold), bool)
            inner[x.bounds[1:][x.bounds[1:] < len(gold)]] = False
            inner[0] = False
            np.subtract.at(moves, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            step("move", field.move, moves * scale)
            step("bias", field.bias, g.sum(0) * scale)
            at = field.lexicon(x.keys)
            byte_word = np.repeat(np.arange(len(gold)), x.ends - x.starts + 1)
            byte_at = np.concatenate([[0], np.cumsum(x.ends - x.starts + 1)[:-1]])
            byte_at = np.arange(len(byte_word)) - byte_at[byte_word] + x.starts[byte_word] - 1
            for name, table, index, grad in [("words", field.words, at, g), *((k_, field.grams[k_], x.codes[k_][byte_at], g[byte_word]) for k_ in BITS)]:
                full = np.stack([np.bincount(index, grad[:, c], len(table)) for c in range(len(languages))], 1)
                step(str(name), table, full * scale + 1e-6 * table)
    field.words[0] = 0
    return field


def _label_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field | None = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            able = [i for i, t in enumerate(texts) if field and t and _LETTER.search(t)]
            while able:
                size, n = 0, 0
                while n < len(able) and (not n or size + len(texts[able[n]]) <= TOGETHER):
                    size += len(texts[able[n]])
                    n += 1
                own, able = able[:n], able[n:]
                emit, counts = [], []
                for i, j in hashing.chunks(np.cumsum([0, *(len(texts[k]) for k in own)]), LOOKED_UP):
                    x = Encoded([texts[k] for k in own[i:j]])
                    emit.append(field.emissions(x))
                    counts.append(np.diff(x.bounds))
                words = np.concatenate(counts)
                bounds = np.concatenate([[0], np.cumsum(words)])
                post, _ = field.posteriors(np.concatenate(emit), bounds)
                total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0, np.float64)])
                mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(words, 1)[:, None]
                best = mean.argmax(1)
                for i, k, s, m in zip(own, best.tolist(), mean.max(1).tolist(), words.tolist(), strict=True):
                    if m:
                        names[i], scores[i] = field.languages[k], min(1.0, max(0.0, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return rows


def held_out(id_col: str, parts: int, part: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> list:
    """Rows (label, text) of the per_label rows of each label with the lowest hashes of the id."""
    labelled = docs.where(f"`{label_col}` is not null and `{text_col}` is not null and `{id_col}` is not null")
    # Ranked on ids alone: each task sends at most per_label rows of a label on, and no text.
    ranked = labelled.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).withColumn("rank", F.expr("row_number() over (partition by label order by xxhash64(id), id)")).where(F.col("rank") <= per_label)
    chosen = ranked.orderBy("rank", "label").limit(per_label * MOST_LANGUAGES).select("id").distinct()
    own = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(chosen), "id").orderBy("id", "label", "text").limit(per_label * MOST_LANGUAGES).collect()


def identify(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row of docs."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(own, _label_rows(sent), f"id {dict(own.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Field | None:
    rows = training_sample(docs, id_col, text_col, label_col, per_language)
    return train([r.text for r in rows], [r.label for r in rows])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    got = identify(docs, model)
    return got.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
