"""Token counts of whole texts for a SentencePiece BPE model, by rank-synchronous array merging.

The vocabulary and its scores come from the model file; the counting is done here. A text gets a space in front, and
spaces become the model's space mark. No piece has a space mark after another character, and characters outside the
vocabulary never merge, so a text falls into pre-tokens (spaces and what follows them) that are merged independently.
The distinct pre-tokens of a batch are merged together as ragged arrays; a character outside the vocabulary counts
one token for each of its UTF-8 bytes. Each task keeps counts that it has met, up to a number, and then starts anew.

Cases: null or empty text has 0 bytes and 0 tokens; very long texts are taken alone and very long pre-tokens only take more rounds;
of equal scores the leftmost pair merges first; rows with one id are counted each for itself; a text of exactly the limit is
not over it; an empty table gives no rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm.merging import RankMerger
from boardlens.llm.store import mapped

LIMIT = 4096
MOST_CACHED = 1_000_000
#: Texts are taken together up to so many characters.
TOGETHER = 1 << 22
SPACE = "▁"
_PRE = re.compile(r" *[^ \n]+| +|\n")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts of tokens for pre-tokens. Scores are ranks turned round: the highest merges first."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a space inside are not supported")
        self.numbers = {p: i for i, p in enumerate(pieces)}
        pairs = [(self.numbers[p[:i]], self.numbers[p[i:]], self.numbers[p]) for p in pieces for i in range(1, len(p)) if p[:i] in self.numbers and p[i:] in self.numbers]
        # Equal scores share a rank, and of those the leftmost merges first.
        score = np.array([*pieces.values()])
        rank = np.unique(-score, return_inverse=True)[1]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.merger = RankMerger(left, right, merged, rank[merged])
        self.unknown = len(pieces)
        chars = {ord(p): i for p, i in self.numbers.items() if len(p) == 1}
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        self.of_char[list(chars)] = list(chars.values())
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"of_char": {int(k): int(self.of_char[k]) for k in np.flatnonzero(self.of_char != self.unknown)}, "numbers": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        self.of_char[list(state["of_char"])] = list(state["of_char"].values())

    def counts(self, pre_tokens: list[str]) -> list[int]:
        code = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens)))])
        symbols = self.of_char[code]
        lost = symbols == self.unknown
        # Bytes of characters that are outside the vocabulary, less the one symbol that each of them is.
        extra = np.where(lost, (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000), 0)
        extra = np.concatenate([[0], np.cumsum(extra)])
        _, merged = self.merger(symbols, bounds)
        return (np.diff(merged) + extra[bounds[1:]] - extra[bounds[:-1]]).tolist()


def _count_rows(counter):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens: list[int] = []
            while len(n_tokens) < len(texts):
                size, parts = 0, []
                for t in texts[len(n_tokens) :]:
                    if parts and size + len(t) > TOGETHER:
                        break
                    size += len(t)
                    parts.append(_PRE.findall(" " + t.replace(SPACE, " ")) if t else [])
                if len(known) > MOST_CACHED:
                    known.clear()
                new = [*set().union(*parts).difference(known)]
                known.update(zip(new, counter.value.counts(new), strict=True))
                n_tokens += [sum(map(known.__getitem__, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64())], names=["id", "n_tokens"])

    return rows


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of docs. path: a SentencePiece BPE model, read on the driver."""
    counter = docs.sparkSession.sparkContext.broadcast(PieceCounter(path))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # The number of bytes rides on the id, so that texts need not come back from Python.
    both = own.select(F.struct("id", n_bytes.alias("n_bytes")).alias("id"), "text")
    got = mapped(both, _count_rows(counter), f"id struct<id: {dict(own.dtypes)['id']}, n_bytes: long>, n_tokens long")
    return got.select(F.col("id.id").alias(id_col), "id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path("piece_bpe_32k.model"))


QUERIES = {"op6_token_counts": op6_token_counts}
