"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Text is lower-cased A-Z and cut into words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. A pattern is each run of `width` item words,
or all words of a shorter item. Words that occur in no pattern get the symbol 0, which no pattern holds.

Patterns of one length m are searched together. A table over blocks of two symbols (one if m is 1) tells how far the
search may jump from a position: past all positions at which no pattern can end. Where the jump is 0 the hash of the
last symbols selects a bucket of patterns and the symbols are compared one by one. All documents of a batch
are searched in step, each from its own position.

Words are told apart by two hashes of different keys, 128 bits together, so equal symbols are equal words.

The patterns are sent to the tasks in blocks of at most MOST_PATTERNS; every block is searched in every document. All
blocks together are in the driver's and each task's memory, which therefore grows with the benchmark table.

Cases: null or empty text has no words and isn't contaminated; very long texts are searched whole, in pieces; an item without words
has no pattern; an item with a null id hits words but isn't named; items with equal words all count; rows with one doc_id are
judged each for itself; a share of exactly 1 / SHARE counts as contaminated; an empty benchmark hits nothing, an empty table
gives no rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import hashing
from boardlens.llm.store import mapped

WIDTH = 13
MOST_PATTERNS = 200_000
#: Share of a document's words, as 1 / SHARE, from which it counts as contaminated.
SHARE = 20
#: Texts are searched in pieces of so many words, so that one long text does not make a batch take its number of steps.
PIECE = 1024


class Patterns:
    """Word patterns as symbols, with shift tables and suffix buckets for each length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        vocabulary = sorted({w for p in patterns for w in p})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.number = hashing.Lookup(hashing.hash_strings(vocabulary), np.arange(1, len(vocabulary) + 1))
        self.second = hashing.hash_strings(vocabulary, hashing.KEYS[1])
        self.groups = []
        by_length = defaultdict(list)
        for p, items in sorted(patterns.items()):
            by_length[len(p)].append((np.array([number[w] for w in p]), sorted(items)))
        for m, group in sorted(by_length.items()):
            block = min(2, m)
            shifts: dict[int, int] = {}
            for p, _ in group:
                for end in range(block, m + 1):
                    key = self.block(p, block, end)
                    shifts[key] = min(shifts.get(key, m), m - end)
            keys = np.array(sorted(shifts), np.uint64)
            rows = np.array([p for p, _ in group])
            suffix = np.array([self.block(p, block, m) for p, _ in group], np.uint64)
            order = np.argsort(suffix, kind="stable")
            heads, first, count = np.unique(suffix[order], return_index=True, return_counts=True)
            self.groups.append(
                {
                    "m": m,
                    "block": block,
                    "shift": hashing.Lookup(keys, np.array([shifts[k] for k in keys.tolist()], np.int64)),
                    "bucket": hashing.Lookup(heads, np.arange(len(heads))),
                    "first": first,
                    "count": count,
                    "rows": rows[order],
                    "items": [group[k][1] for k in order],
                }
            )

    @staticmethod
    def block(p: np.ndarray, block: int, end: int) -> int:
        return int(p[end - 1]) if block == 1 else int(p[end - 2]) << 32 | int(p[end - 1])

    def symbols(self, w: hashing.Words) -> np.ndarray:
        """The symbol of each word, 0 for words that occur in no pattern."""
        out = self.number(w.hashes)
        known = np.flatnonzero(out)
        other = hashing.word_hashes(w.low, w.starts[known], w.ends[known], hashing.KEYS[1]) != self.second[out[known] - 1]
        out[known[other]] = 0
        return out

    def search(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[list[str]]]]:
        """Occurrences in the pieces symbols[low:high]: (positions of the first word, m, numbers of patterns, items of the patterns)."""
        for g in self.groups:
            m, block = g["m"], g["block"]
            # Jumps and bucket numbers of all blocks are looked up at the visited positions only.
            at = low + m - 1
            ends = high
            alive = at < ends
            at, ends = at[alive], ends[alive]
            while len(at):
                key = symbols[at].astype(np.uint64)
                if block == 2:
                    key |= symbols[at - 1].astype(np.uint64) << np.uint64(32)
                jump = g["shift"](key, m - block + 1)
                stop = np.flatnonzero(jump == 0)
                if len(stop):
                    bucket = g["bucket"](key[stop])
                    n = g["count"][bucket]
                    pos = np.repeat(at[stop], n)
                    row = np.repeat(g["first"][bucket] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    for back in range(m):
                        same = symbols[pos - back] == g["rows"][row, m - 1 - back]
                        pos, row = pos[same], row[same]
                        if not len(pos):
                            break
                    if len(pos):
                        yield pos - m + 1, m, row, g["items"]
                at = at + np.maximum(jump, 1)
                alive = at < ends
                if not alive.all():
                    at, ends = at[alive], ends[alive]


def pieces(bounds: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words that cover each text, with so many words shared by neighbours that no pattern is lost or met twice."""
    n = np.diff(bounds)
    parts = np.maximum(1, -(-np.maximum(0, n - overlap) // PIECE))
    text = np.repeat(np.arange(len(n)), parts)
    k = np.arange(parts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]) if len(parts) else [], parts).astype(np.int64)
    low = bounds[:-1][text] + k * PIECE
    return low, np.minimum(low + PIECE + overlap, bounds[1:][text])


def _search_rows(tables: list, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for w in hashing.words(batch.column(1), hashing.ALNUM, lower=True):
                hit = np.zeros(len(w.hashes) + 1, np.int64)
                found: dict[int, set[str]] = defaultdict(set)
                for table in tables:
                    patterns: Patterns = table.value
                    symbols = patterns.symbols(w)
                    for at, m, row, names in patterns.search(symbols, *pieces(w.bounds, width - 1)):
                        np.add.at(hit, at, 1)
                        np.add.at(hit, at + m, -1)
                        own = np.searchsorted(w.bounds, at, "right") - 1
                        for k, r in {*zip(own.tolist(), row.tolist(), strict=True)}:
                            found[k].update(names[r])
                is_hit = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
                n_words += np.diff(w.bounds).tolist()
                n_hit += (is_hit[w.bounds[1:]] - is_hit[w.bounds[:-1]]).tolist()
                items += [sorted(found.get(k, ())) for k in range(w.n_texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))],
                names=["id", "n_words", "n_hit", "items"],
            )

    return rows


def pattern_blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str, most: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The patterns with the ids of their items, in blocks of about `most` patterns; one partition at a time comes to the driver."""
    block: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    lower = bytes(hashing.LOWER)
    spaced = bytes(b if hashing.ALNUM[b] else 0x20 for b in range(256))
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).where(f"`{text_col}` is not null").toLocalIterator():
        words = text.encode().translate(lower).translate(spaced).split()
        for i in range(max(1, len(words) - width + 1) if words else 0):
            named = block[tuple(words[i : i + width])]
            if item is not None:
                named.add(item)
        if len(block) >= most:
            yield dict(block)
            block.clear()
    if block:
        yield dict(block)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """(id_col, n_words, n_hit, items, contaminated) for each row of docs; items: ids of occurring items, sorted as strings."""
    sc = docs.sparkSession.sparkContext
    tables = [sc.broadcast(Patterns(b)) for b in pattern_blocks(benchmark, width, item_col, item_text_col, most_patterns)]
    out = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _search_rows(tables, width), f"id {dict(docs.dtypes)[id_col]}, n_words long, n_hit long, items array<string>")
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words")).withColumnRenamed("id", id_col)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op2_decontamination": rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + 12], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT s.doc_id, s.i, p.m, p.item_id FROM s, (SELECT DISTINCT m FROM p) q, p
      WHERE s.i + q.m - 1 <= len(s.w) AND p.m = q.m AND p.g = array_to_string(s.w[s.i:s.i + q.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
QUERIES = {"op2_decontamination": op2_decontamination}
