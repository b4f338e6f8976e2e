"""Connected components of a table of links: contracted inside tasks first, then by large-star and small-star rounds with joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.llm.store import discard, mapped, saved

#: Links of a node beyond which its rows are dealt out by SALTS remainders of their other end.
HUB, SALTS = 1000, 64
#: Links that a task contracts at a time.
CONTRACTED = 1 << 20


def _with_smallest(both: DataFrame) -> DataFrame:
    """both (u, v) with m, the smallest of u and all v of its rows. No key holds more than a share of a node's rows."""
    dealt = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    shares = dealt.groupBy("u", "s").agg(F.min("v").alias("least"))
    smallest = shares.groupBy("u").agg(F.least(F.min("least"), F.first("u")).alias("m"))
    return dealt.join(shares.select("u", "s").join(smallest, "u"), ["u", "s"]).drop("s")


def _round(edges: DataFrame, hubs: bool) -> DataFrame:
    """edges (u, v), v < u, with nodes hung on the smallest neighbours that they see. Without hubs a node's rows go to one task."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Large star: the larger neighbours of u hang on the smallest of u and its neighbours.
    seen = _with_smallest(both) if hubs else both.withColumn("m", F.least(F.min("v").over(W.partitionBy("u")), "u"))
    large = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    # Small star: u and its smaller neighbours hang on the smallest of them.
    if hubs:
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        low = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
        small = low.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
    return small.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[bool, bool]:
    """Whether edges are stars already (nodes hang on one center each, and centers on none), and whether a node has more than HUB links."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("up"), F.count("*").alias("n"))
    loose, most = nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and n > 1)")), F.max("n")).first()
    return loose == 0, (most or 0) > HUB


def smallest_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) -> the links of the same components that hang each node on the smallest one, for CONTRACTED links at a time."""

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        m = t.num_rows
        ids = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(ids.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[ids.indices.to_numpy()]
        label = smallest_labels(ends[:m], ends[m:], len(order))
        hangs = np.flatnonzero(label != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(order[x])) for x in (hangs, label[hangs])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CONTRACTED:
            yield contracted(held)
            held = []
    if held:
        yield contracted(held)


def _contracted(links: DataFrame, in_task: int) -> tuple[DataFrame, bool]:
    """Links contracted by tasks of about in_task links each, and whether one task had them all, so that they are stars."""
    edges = saved(links, "links")
    tasks = -(-edges.count() // in_task)
    kind = edges.schema["u"].dataType.simpleString()
    out = saved(mapped(edges.coalesce(max(1, tasks)), _stars, f"u {kind}, v {kind}"), "stars")
    discard(edges)
    return out, tasks <= 1 and in_task <= CONTRACTED


def components(links: DataFrame, most_rounds: int = 60, in_task: int = CONTRACTED) -> DataFrame:
    """links (a, b): links of comparable ids. Returns (id, component) for each id in a link; component is the smallest id reachable.

    Tasks contract about in_task links each: what hangs together inside a task hangs on its smallest id from then on, so paths are short
    and repeated links gone before anything is shuffled, and a table of at most in_task links takes no round. Else each round hangs nodes on the
    smallest neighbour that they see, until all hang on centers. The number of rounds grows with the logarithm of the size of a component.
    Minima combine before the shuffle, and where a node has more than HUB links, rows are dealt out by their other end, so that no task gathers
    a hub. A null end links nothing; an empty table gives no rows.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, stars = _contracted(ends, in_task)
    stars, hubs = (True, False) if stars else _state(edges)
    for _ in range(most_rounds):
        if stars:
            break
        old, edges = edges, saved(_round(edges, hubs), "stars")
        discard(old)
        stars, hubs = _state(edges)
    if not stars:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def more_links(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components of links (a, b) beside those known (id, component): known ones come in as stars, which take no rounds of their own."""
    return components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))
