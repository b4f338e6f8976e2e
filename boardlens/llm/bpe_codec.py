"""Byte-level BPE encoding and decoding of whole texts with a lexicon of frequent words.

Texts are cut into special strings and the usual byte-level pre-tokens. A first pass counts pre-tokens over all
documents; those above a count that at most `lexicon_size` of them reach are encoded once and compiled into a minimal
acyclic transducer with their ids as output. Tasks memory-map it and look the distinct pre-tokens of a batch up
in step; the others are merged exactly, by the ranks of the file's merges. Ids and text come out the same with any lexicon.

Cases: null or empty text has no ids and decodes to the empty string; a special string inside a text is its one id; very
long pre-tokens are merged like others, and very long texts are taken alone; rows with one id are encoded each for itself; of words
with equal counts all or none are in the lexicon; an empty table gives no rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm.automaton import Transducer
from boardlens.llm.merging import RankMerger
from boardlens.llm.store import mapped, saved

LEXICON_SIZE = 100_000
#: Longer pre-tokens are not put into the lexicon.
LONGEST = 64
MOST_CACHED = 400_000
TOGETHER = 1 << 22
#: The pattern of byte-level pre-tokens. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OPEN_SPACE = re.compile(r" (?:\s|\Z)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def pieces(text: str, find) -> list[str]:
    """text cut before its spaces. A space that no white space follows always begins a pre-token, so pieces can be cut into
    pre-tokens one by one; a text with other spaces is cut into pre-tokens at once.
    """
    if not text:
        return []
    if _OPEN_SPACE.search(text) or "\0" in text:
        return find(text)
    return text.replace(" ", "\0 ").split("\0")


class ByteBPE:
    """Ids of texts and texts of ids for a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.array([vocab[c] for c in byte_letters()])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]).T
        self.merger = RankMerger(left, right, merged, np.arange(len(merges)))

    def parts(self, text: str, find) -> list[str]:
        """Special strings, and runs of pre-tokens that end before a space, in order."""
        if not self.special or not any(s in text for s in self.special):
            return pieces(text, find)
        cut = regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        return [x for p in cut for x in ([p] if p in self.special else pieces(p, find))]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers, by merging."""
        data = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        ids, at = self.merger(self.of_byte[data], bounds)
        data = memoryview(ids.astype("<u4")).cast("B")
        return [bytes(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _word_counts(codec):
    """Pre-tokens with their counts, for up to MOST_CACHED distinct pieces of a task's texts at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PATTERN).findall
        count: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words: Counter = Counter()
            for piece, n in count.items():
                if piece not in codec.value.special:
                    for w in find(piece):
                        words[w] += n
            kept = [(w, n) for w, n in words.items() if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(codec.value.parts(text or "", find))
            if len(count) >= MOST_CACHED // 2:
                yield counted()
                count.clear()
        yield counted()

    return rows


def frequent_words(texts: DataFrame, codec, most: int) -> list[str]:
    """Words of a count that at most `most` words reach; counted over all texts. Only they come to the driver."""
    counts = mapped(texts, _word_counts(codec), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts.where("n > 1"), "words")
    # The number of words of each power-of-two step of counts, highest first; the lowest step that fits.
    steps = counts.groupBy(F.floor(4 * F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in steps:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return []
    return [r.word for r in counts.where(F.floor(4 * F.log2("n")) >= least).select("word").collect()]


def _code_rows(codec, lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: ByteBPE = codec.value
        automaton = Transducer.mapped(*lexicon.value)
        find = regex.compile(PATTERN).findall
        special = {s: np.array([i], "<u4").tobytes() for s, i in bpe.special.items()}
        known: dict[str, bytes] = dict(special)
        table = [bpe.token.get(i, b"") for i in range(max(bpe.token) + 1)]
        data, size_of = np.frombuffer(b"".join(table), np.uint8), np.array([*map(len, table)])
        at_of = np.concatenate([[0], np.cumsum(size_of)[:-1]])
        for batch in batches:
            column = batch.column(1)
            ids: list[bytes] = []
            decoded: list[str] = []
            while len(ids) < len(column):
                size, parts = 0, []
                for i in range(len(ids), len(column)):
                    text = column[i].as_py() or ""
                    if parts and size + len(text) > TOGETHER:
                        break
                    size += len(text)
                    parts.append(bpe.parts(text, find))
                if len(known) > MOST_CACHED:
                    known = dict(special)
                new = [*set().union(*parts).difference(known)]
                cut = [find(p) for p in new]
                words = [*set().union(*cut)]
                raw = [w.encode() for w in words]
                number = automaton.numbers(raw)
                seen, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0).tolist()
                code = dict(zip([words[i] for i in seen.tolist()], automaton.outputs(number[seen]), strict=True))
                code.update(zip([words[i] for i in unseen], bpe.merge([raw[i] for i in unseen]), strict=True))
                known.update((p, code[c[0]] if len(c) == 1 else b"".join(map(code.__getitem__, c))) for p, c in zip(new, cut, strict=True))
                for p in parts:
                    got = b"".join(map(known.__getitem__, p))
                    ids.append(got)
                    # The bytes of all ids, gathered from the table of tokens at once.
                    number = np.frombuffer(got, "<u4")
                    n = size_of[number]
                    end = np.cumsum(n)
                    decoded.append(data[np.arange(end[-1] if len(end) else 0) + np.repeat(at_of[number] - end + n, n)].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return rows


def encode(docs: DataFrame, path: str, lexicon_size: int = LEXICON_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for each row of docs. ids: binary, little-endian unsigned 32-bit. path: read on the driver."""
    sc = docs.sparkSession.sparkContext
    bpe = ByteBPE(path)
    codec = sc.broadcast(bpe)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = [w.encode() for w in frequent_words(own.select("text"), codec, lexicon_size)]
    lexicon = sc.broadcast(Transducer.build(words, bpe.merge(words)).to_bytes())
    return mapped(own, _code_rows(codec, lexicon), f"id {dict(own.dtypes)['id']}, ids binary, decoded string").withColumnRenamed("id", id_col)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path("byte_bpe_50k.json"))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op7_bpe_codec": op7_bpe_codec}
