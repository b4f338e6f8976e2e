"""Substring dedup by difference-cover anchors.

Words are [^\x20\x09-\x0D]+, unchanged. A window is `width` consecutive words of one document. A word is removed if it
lies in a window whose word sequence also starts in a document with a smaller id.

Anchors are shorter windows (width - period + 1 words) at positions whose remainder modulo the period is in a
difference cover. Two equal windows, whatever their positions, share an anchor at the same offset, so windows
around anchors that two documents share are all that can repeat. Those windows are hashed whole (96 bits of two hashes
with different keys, words included) and written once; the smallest id of each group of equal ones decides. Nothing is
paired: groups are minima, which combine before a shuffle.

A row is named by its id and a hash of its text, so rows with one id and different texts keep their own windows.

The filter of shared anchors is a bitmap of at most 32 MB: with about 10**8 shared anchors it admits a third of the
others and beyond that nearly all, whose windows then are hashed for nothing; results are the same.

Cases: null or empty text has no words; a text under `width` words keeps all; very long texts are cut into words in one piece;
a null id neither removes nor loses words; rows with one id keep what they share, since neither id is smaller, and each
loses what it shares with smaller ids; equal windows within one document remove nothing; an empty table gives no rows; ids
are of any type that Spark orders; other columns are not read unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import hashing
from boardlens.llm.filters import admitted, docs_filter, key_filter, may_be_in
from boardlens.llm.store import discard, mapped, saved

WIDTH = 50
#: Perfect difference sets: each remainder modulo the period is a difference of two members. Fixed values.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}


def period_for(width: int) -> int:
    """The largest period that leaves anchors of two fifths of a window."""
    return max(p for p in COVERS if p == 1 or width - p + 1 >= 0.4 * width)


def _anchors(w: hashing.Words, width: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in w.hashes, texts, hashes) of the anchors of texts that hold a window."""
    size = width - period + 1
    starts, text = hashing.starts_inside(w.bounds, size)
    keep = np.isin(np.arange(period), COVERS[period])[(starts - w.bounds[:-1][text]) % period] & (np.diff(w.bounds) >= width)[text]
    starts, text = starts[keep], text[keep]
    return starts, text, hashing.window_hashes(w.hashes, size)[starts]


def _anchor_rows(width: int, period: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in hashing.words(batch.column(1)):
                _, text, h = _anchors(w, width, period)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(w.first + text))], names=["h", "id"])

    return rows


def _window_rows(width: int, period: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in hashing.words(batch.column(1)):
                at, text, h = _anchors(w, width, period)
                hit = shared.value.admits(h)
                at, text = at[hit], text[hit]
                if not len(at):
                    continue
                # The windows that hold the anchor at one of the offsets 0 .. period - 1 and stay in the text.
                first = np.maximum(at - period + 1, w.bounds[:-1][text])
                last = np.minimum(at, w.bounds[1:][text] - width)
                some = first <= last
                edge = np.zeros(len(w.hashes) + 2, np.int32)
                np.add.at(edge, first[some], 1)
                np.add.at(edge, last[some] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: len(w.hashes)])
                if not len(starts):
                    continue
                own = np.searchsorted(w.bounds, starts, "right") - 1
                row = pa.array(w.first + own)
                second = hashing.window_hashes(w.second(), width, hashing.KEYS[1])[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashing.window_hashes(w.hashes, width)[starts].view(np.int64)),
                        pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        batch.column(0).take(row),
                        batch.column(2).take(row),
                        pa.array((starts - w.bounds[own]).astype(np.int32)),
                    ],
                    names=["h", "g", "id", "text_hash", "start"],
                )

    return rows


def covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window that starts at one of starts."""
    edge = np.zeros(n_words + width + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n_words] > 0


def _cut(width: int, leave=None):
    """id, row, number of words, of removed ones, and the words that stay. leave: rows whose hash it admits are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if leave:
                batch = batch.filter(pa.array(~admitted(leave, batch.column(4))))
            n_words, n_removed, kept = [], [], []
            hits = batch.column(2)
            for k, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if hits[k].is_valid:
                    gone = covered(len(words), hits[k].values.to_numpy(), width)
                    words = [w for w, x in zip(words, gone, strict=True) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "row", "n_words", "n_removed", "kept"],
            )

    return rows


def repeated_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, starts): the word positions in a row at which a window starts that also starts under a smaller id."""
    sc, period = docs.sparkSession.sparkContext, period_for(width)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = own.schema["id"].dataType.simpleString()
    anchors = mapped(own, _anchor_rows(width, period), f"h long, id {kind}")
    shared = saved(anchors.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h"), "anchors")
    admit = sc.broadcast(key_filter(shared, "h"))
    # Written once: both the minima and the join read the table.
    windows = mapped(own.withColumn("text_hash", F.xxhash64("text")), _window_rows(width, period, admit), f"h long, g int, id {kind}, text_hash long, start int")
    windows = saved(windows, "windows")
    # Minima are written too, so that the join can split hot windows and the shuffle of all windows is gone by then.
    least = saved(windows.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"), "least")
    hits = windows.join(least, ["h", "g"]).where("id > least")
    out = saved(hits.groupBy("id", "text_hash").agg(F.collect_set("start").alias("starts")), "repeats")
    discard(shared, windows, least)
    return out


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_words, n_removed, kept, and the columns of docs named in carry), one row for each row of docs.

    kept has the words that stay, joined by one space.
    """
    hits = repeated_windows(docs, width, id_col, text_col)
    # A struct of the carried columns goes through the tasks as it is; without any it holds a constant.
    row = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(1).cast("byte").alias("none"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row")).withColumn("text_hash", F.xxhash64("text"))
    out = f"id {own.schema['id'].dataType.simpleString()}, row {own.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    key = ["id", "text_hash"]
    touched = own.where(may_be_in(hits, *key)).join(hits, key, "left").select("id", "text", "starts", "row")
    untouched = own.select("id", "text", F.lit(None).cast("array<int>").alias("starts"), "row", F.xxhash64(*key).alias("h"))
    both = mapped(touched, _cut(width), out).unionByName(mapped(untouched, _cut(width, docs_filter(hits, *key)), out))
    return both.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *(F.col(f"row.{c}").alias(c) for c in carry))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM s),
m AS (SELECT g, min(doc_id) AS least FROM h GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT h.doc_id, h.i FROM h JOIN m USING (g) WHERE h.doc_id > m.least), (SELECT unnest(range(0, 50)) AS k)),
l AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(x.w[x.p], ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN r USING (doc_id, p) WHERE r.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.ps), 0) AS BIGINT) AS n_removed,
sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
}
QUERIES = {"op9_substring_dedup": op9_substring_dedup}
