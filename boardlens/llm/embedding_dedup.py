"""Exact near-duplicate vectors by cosine, with cover trees and dual traversal.

Unit vectors at cosine c are at distance sqrt(2 - 2c), a metric. Equal unit vectors form one class. Classes are dealt to parts
by the nearest of a few pivots; the pivots come from a bounded sample, and any pivots give the same links. Parts are as large as the
memory of a task allows once there are enough of them for all cores, since vectors without structure visit all later parts: what is
shuffled grows with the square of the table over the size of a part. Each part is at home in one task or, by blocks, in several. Two linked vectors of parts p < q lie on both sides of the plane between the
pivots, so the first is no farther from it than the link distance: only vectors that near visit part q.

A task builds cover trees: each level of a node's points has centers that are more than the level's radius apart and cover
all points within it, a node's own center stays one on the levels below, radii halve, and each node has the exact radius that
covers its points. The dual traversal drops pairs of nodes whose centers are farther apart than their radii and the
link distance, and ends in pairs of points. All counts are sums of the classes' sizes, so copies are never paired.

Vectors without structure (all far apart) leave a cover tree nothing to prune: where the balls of a batch hold hardly more
than their centers, or few of what is left, the points left stay single ones without a test of their separation, all pairs of
them are multiplied, and vectors near many planes visit many parts. Links don't depend on that.

Cases: null vectors, vectors with null or non-finite components, zero vectors and vectors of another length than
the most common one (of equally common ones the shortest) link with nothing; a cosine of exactly `least` links; a null id counts
as larger than all others; rows with one id count as separate vectors; an empty table gives no rows; ids are of any type
that Spark orders; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm.graph import components, smallest_labels
from boardlens.llm.store import discard, mapped, release, saved

LEAST_COSINE = 0.9
SAMPLE = 4096
#: Classes that a part holds at least, if there are so many, and at most (two blocks of that size take about 200 MB in a task), and the number of parts at most.
LEAST_PART, PART, MOST_PARTS = 4096, 32768, 512
#: Points of a node that isn't split further, and centers that are tried, and rows and columns of a product, at a time.
LEAF, TRIED, ROWS, COLUMNS = 64, 64, 512, 2048
#: Pairs whose cosine is taken in double precision at a time.
PAIRS = 1 << 15
#: Slack of squared distances for rounding in single precision; the double-precision cosine decides each pair left.
SLACK = 1e-4


def unit(vectors: list, size: int) -> np.ndarray:
    return np.array([np.frombuffer(v, "<f8") for v in vectors]).reshape(len(vectors), size)


def _units(vectors: pa.BinaryArray, size: int) -> np.ndarray:
    """The same of a column without nulls, whose bytes lie one after the other."""
    low, high = np.frombuffer(vectors.buffers()[1], np.int32)[[vectors.offset, vectors.offset + len(vectors)]].tolist()
    return np.frombuffer(vectors.buffers()[2], "<f8", (high - low) // 8, low).reshape(len(vectors), size)


class CoverTree:
    """Nodes with a center, a covering radius and what is below: numbers of nodes, or ~point for single points."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float32)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.below: list[np.ndarray] = []
        self.points: list[np.ndarray] = []
        if len(x):
            points = np.arange(len(x))
            self._add(points, 0, self._squares(points, points[:1])[:, 0])
            stack = [(0, points)]
            while stack:
                me, points = stack.pop()
                if len(points) <= LEAF or self.radius[me] <= 4e-3:
                    self.below[me] = ~points
                    continue
                # Below the radius without its slack, so that some point is outside the first ball.
                level = 2.0
                while level * level >= self.radius[me] ** 2 - 2e-6:
                    level /= 2
                balls, singles = self._cover(points, self.center[me], level)
                nodes = [self._add(own, head, squares) for own, head, squares in balls]
                stack += zip(nodes, [own for own, _, _ in balls], strict=True)
                self.below[me] = np.concatenate([np.array(nodes, np.int64), ~singles])

    def _squares(self, points: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.maximum(0, 2 - 2 * (self.x[points] @ self.x[others].T))

    def _add(self, points: np.ndarray, center: int, squares: np.ndarray) -> int:
        self.center.append(int(center))
        # Rounding of single precision only makes a radius larger.
        self.radius.append(float(np.sqrt(squares.max() + 1e-6)) if len(points) > 1 else 0.0)
        self.below.append(np.zeros(0, np.int64))
        self.points.append(points)
        return len(self.center) - 1

    def _cover(self, points: np.ndarray, head: int, level: float) -> tuple[list[tuple[np.ndarray, int, np.ndarray]], np.ndarray]:
        """Greedy balls of radius `level` as (points, center, squared distances), head's first, and points that are alone in theirs.

        Where the balls of a batch hold few points beside their centers, or few of the rest, nothing is left to gather: the rest stay single points.
        """
        rest = np.concatenate([[head], points[points != head]])
        balls, singles = [], []
        while len(rest):
            tried = rest[:TRIED]
            squares = self._squares(rest, tried)
            near = squares <= level * level
            near[np.arange(len(tried)), np.arange(len(tried))] = True
            free = np.ones(len(rest), bool)
            n = len(balls)
            for k in np.flatnonzero(np.count_nonzero(near, axis=0) > 1).tolist():
                if free[k]:
                    own = near[:, k] & free
                    free &= ~own
                    if np.count_nonzero(own) > 1:
                        balls.append((rest[own], int(tried[k]), squares[own, k]))
                    else:
                        singles.append(rest[own])
            singles.append(tried[free[: len(tried)]])
            free[: len(tried)] = False
            rest = rest[free]
            if sum(len(own) for own, _, _ in balls[n:]) < max(len(tried) // 2, len(free) // TRIED):
                singles.append(rest)
                break
        return balls, np.concatenate(singles)

    def size(self, node: int) -> tuple[int, float]:
        """Number of points and radius."""
        return (len(self.points[node]), self.radius[node]) if node >= 0 else (1, 0.0)

    def parts(self, node: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, centers, radii) of what is below a node, or of all its points; of a point, itself."""
        below = np.array([node]) if node < 0 else ~self.points[node] if whole else self.below[node]
        single = below < 0
        if single.all():
            return below, ~below, np.zeros(len(below), np.float32)
        nodes = below.tolist()
        return below, np.array([self.center[k] if k >= 0 else ~k for k in nodes]), np.array([self.radius[k] if k >= 0 else 0.0 for k in nodes], np.float32)


def _close(x: np.ndarray, r: np.ndarray, y: np.ndarray, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of centers x and y whose balls of radii r and q come within reach. Pairs of single points need no matrix of bounds."""
    found = []
    for i in (np.flatnonzero(r == 0), np.flatnonzero(r)):
        for j in (np.flatnonzero(q == 0), np.flatnonzero(q)):
            if len(i) and len(j):
                most = np.float32(reach) if not r[i[0]] and not q[j[0]] else r[i, None] + q[None, j] + np.float32(reach)
                # Where all are of one kind, nothing is copied.
                product = (x if len(i) == len(x) else x[i]) @ (y if len(j) == len(y) else y[j]).T
                near = product >= 1 - (most * most + np.float32(SLACK)) / 2
                if near.any():
                    k = np.flatnonzero(near)
                    found.append((i[k // len(j)], j[k % len(j)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _against(a: CoverTree, points: np.ndarray, b: CoverTree, node: int, reach: float, products: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for points of a and a node of b."""
    stack = [(points[k : k + ROWS], node) for k in range(0, len(points), ROWS)]
    while stack:
        own, k = stack.pop()
        n, r = b.size(k)
        below, at, radius = b.parts(k, len(own) * n <= ROWS * ROWS or r <= reach)
        x = a.x[own]
        for left in range(0, len(at), COLUMNS):
            if products is not None:
                products.append(len(own) * len(at[left : left + COLUMNS]))
            u, v = _close(x, np.zeros(len(own), np.float32), b.x[at[left : left + COLUMNS]], radius[left : left + COLUMNS], reach)
            v = below[left + v]
            if (v < 0).any():
                yield own[u[v < 0]], ~v[v < 0]
            stack += [(own[u[v == w]], w) for w in np.unique(v[v >= 0]).tolist()]


def dual(a: CoverTree, b: CoverTree, reach: float, products: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points of a and of b that may be within reach of each other, pair by pair. For b is a, each two points once.

    products: the numbers of multiplied pairs are added to it.
    """
    if not a.center or not b.center:
        return
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        same = a is b and i == j
        (n, r), (m, q) = a.size(i), b.size(j)
        # Few pairs, or nodes so small that the levels below could hardly be told apart: their points are multiplied.
        whole = n * m <= ROWS * ROWS or r + q <= reach
        own, at, r = a.parts(i, whole)
        others, other_at, q = (own, at, r) if same else b.parts(j, whole)
        x, y = a.x[at], b.x[other_at]
        # Of a node with itself, each two parts once, and each part that is a node with itself. Products are of a size that caches hold.
        for low, first in ((low, k) for low in range(0, len(own), ROWS) for k in range(low if same else 0, len(others), COLUMNS)):
            if products is not None:
                products.append(len(x[low : low + ROWS]) * len(y[first : first + COLUMNS]))
            u, v = _close(x[low : low + ROWS], r[low : low + ROWS], y[first : first + COLUMNS], q[first : first + COLUMNS], reach)
            u, v = low + u, first + v
            if same:
                u, v = u[u <= v], v[u <= v]
                loop = (u == v) & (own[u] < 0)
                u, v = u[~loop], v[~loop]
            u, v = own[u], others[v]
            ends = (u < 0) & (v < 0)
            if ends.any():
                yield ~u[ends], ~v[ends]
            both = (u >= 0) & (v >= 0)
            stack += zip(u[both].tolist(), v[both].tolist(), strict=True)
            # Single points that meet the same node go down together.
            for node in np.unique(v[(u < 0) & (v >= 0)]).tolist():
                yield from _against(a, ~u[(u < 0) & (v == node)], b, node, reach, products)
            for node in np.unique(u[(v < 0) & (u >= 0)]).tolist():
                for points, others_ in _against(b, ~v[(v < 0) & (u == node)], a, node, reach, products):
                    yield others_, points


def _links_of(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(linked weight of each x, of each y, two ends of pairs that join the same components as all links; y counts on from x). y None: x with itself."""
    tree = CoverTree(x)
    other = tree if y is None else CoverTree(y)
    n_x, n_y = np.zeros(len(x), np.int64), np.zeros(0 if y is None else len(y), np.int64)
    label = np.arange(len(x) + (0 if y is None else len(y)))
    z, weight_z = (x, weight_x) if y is None else (y, weight_y)
    close = dual(tree, other, np.sqrt(2 - 2 * least))
    for i, j in ((i[k : k + PAIRS], j[k : k + PAIRS]) for i, j in close for k in range(0, len(i), PAIRS)):
        # Components one after the other in double precision decide, whatever order the product took them in.
        sure = np.einsum("ij,ij->i", x[i], z[j]) >= least
        i, j = i[sure], j[sure]
        if not len(i):
            continue
        n_x += np.bincount(i, weight_z[j], len(x)).astype(np.int64)
        if y is None:
            n_x += np.bincount(j, weight_x[i], len(x)).astype(np.int64)
        else:
            n_y += np.bincount(j, weight_x[i], len(y)).astype(np.int64)
            j = j + len(x)
        # What hangs together here hangs on the smallest of it.
        apart = label[i] != label[j]
        if apart.any():
            label = smallest_labels(label[i[apart]], label[j[apart]], len(label))[label]
    hangs = np.flatnonzero(label != np.arange(len(label)))
    return n_x, n_y, hangs, label[hangs]


def _compare(size: int, least: float):
    def links(group: pa.Table) -> pa.Table:
        c, side, weight = (group.column(k).to_numpy() for k in ("c", "side", "weight"))
        order = np.argsort(c, kind="stable")
        x = np.concatenate([_units(v, size) for v in group.column("v").chunks if len(v)])[order]
        c, side, weight = c[order], side[order], weight[order]
        if (side == 2).all():
            n, _, u, v = _links_of(x, None, weight, weight, least)
        else:
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            n_p, n_q, u, v = _links_of(x[p], x[q], weight[p], weight[q], least)
            n, c = np.concatenate([n_p, n_q]), np.concatenate([c[p], c[q]])
        some = np.flatnonzero(n)
        a, b = np.concatenate([c[some], c[u]]), np.concatenate([c[some], c[v]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(np.concatenate([n[some], np.zeros(len(u), np.int64)]), pa.int64())})

    def run(group: pa.Table) -> pa.Table:
        try:
            return links(group)
        finally:
            release()

    return run


def _unit_rows(size: int):
    """Bytes of the unit vector of each row, or null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None] * batch.num_rows
            for k, v in enumerate(batch.column(1)):
                if not v.is_valid or len(v) != size or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                most = np.abs(x).max(initial=0.0)
                if not np.isfinite(x).all() or most == 0:
                    continue
                x = x / most
                out[k] = (x / np.sqrt((x * x).sum()) + 0.0).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    return rows


def _part_rows(pivots, size: int, reach: float):
    """The nearest pivot of each class, and the later parts that it visits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1).to_pylist(), size)
            near = x @ p.T
            part = near.argmax(1)
            # The distance from the plane between two pivots; equal pivots have no plane, and all visit.
            margin = (near[np.arange(len(x)), part][:, None] - near) <= (reach + 1e-7) * apart[part] + 1e-9
            margin &= np.arange(len(p)) > part[:, None]
            row, to = np.nonzero(margin)
            visits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)), pa.array(to.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), visits], names=["c", "v", "weight", "part", "visits"])

    return rows


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of vectors."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sizes = own.where("v is not null").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = int(sizes[0]["size"]) if sizes else 0
    units = mapped(own, _unit_rows(size), f"id {own.schema['id'].dataType.simpleString()}, v binary")
    rows = saved(units.withColumn("f", F.unhex(F.md5("v"))), "units")
    good = rows.where("v is not null")
    # The table is written once, so the numbers of classes stay.
    classes = saved(good.groupBy("v").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("f").alias("f")).withColumn("c", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if n:
        found = _found(spark, classes, n, size, least)
        counts = found.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
        comp = components(found.where("a <> b").select("a", "b"))
        named = classes.select("c", "f", "weight", "least").join(counts, "c", "left").join(comp.withColumnsRenamed({"id": "c", "component": "comp"}), "c", "left")
        named = named.select("f", F.coalesce("comp", "c").alias("comp"), "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        firsts = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        linked = good.select("id", "f").join(named.join(firsts, "comp").select("f", "n_links", "component_id"), "f").select("id", "n_links", "component_id")
        alone = alone.unionByName(linked)
    return alone.withColumn("kept", F.expr("id <=> component_id")).withColumnRenamed("id", id_col)


def _part(n: int, cores: int) -> int:
    """Classes of a part: of n classes without structure, parts pair up into about two tasks for each core, or more if parts would be over PART."""
    return min(PART, max(LEAST_PART, -(-n // max(1, round(2 * cores**0.5)))))


def _found(spark: SparkSession, classes: DataFrame, n: int, size: int, least: float) -> DataFrame:
    """(a, b, n): for a = b the weight of the classes linked with a, from one task; else a link."""
    sample = unit([r.v for r in classes.orderBy(F.xxhash64("f"), "f").limit(SAMPLE).select("v").collect()], size)
    # Farthest-first pivots of the sample spread over it.
    k = min(len(sample), MOST_PARTS, -(-n // _part(n, spark.sparkContext.defaultParallelism)))
    chosen, far = [0], np.sqrt(np.maximum(0, 2 - 2 * (sample @ sample[0])))
    while len(chosen) < k:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * (sample @ sample[chosen[-1]]))))
    sent = spark.sparkContext.broadcast(sample[chosen])
    dealt = saved(mapped(classes.select("c", "v", "weight"), _part_rows(sent, size, float(np.sqrt(2 - 2 * least))), "c long, v binary, weight long, part int, visits array<int>"), "parts")
    # Blocks of those at home in a part and of its visitors, at most MOST_PARTS rows.
    most = _part(n, spark.sparkContext.defaultParallelism)
    home = dealt.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("home"))
    guests = dealt.select(F.explode("visits").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("guests"))
    blocks = F.broadcast(home.join(guests, "part", "left").fillna(0, ["guests"]))
    hashed = F.xxhash64("c")
    own = dealt.select("c", "v", "weight", "part").join(blocks, "part").withColumn("block", F.pmod(hashed, "home").cast("int"))
    # At home: each two blocks once, and each block with each block of visitors. Vectors go along with the groups they are in.
    at_home = own.withColumn("to", F.explode(F.expr("sequence(0, home - 1)"))).select(F.xxhash64("part", F.lit("h"), F.least("block", "to"), F.greatest("block", "to")).alias("g"), "c", "v", "weight", F.expr("case when block = to then 2 when block < to then 0 else 1 end").alias("side"))
    hosts = own.where("guests > 0").withColumn("to", F.explode(F.expr("sequence(0, guests - 1)"))).select(F.xxhash64("part", F.lit("v"), "block", "to").alias("g"), "c", "v", "weight", F.lit(1).alias("side"))
    visitors = dealt.select("c", "v", "weight", F.explode("visits").alias("part")).join(blocks, "part").withColumn("to", F.pmod(hashed, "guests").cast("int"))
    visitors = visitors.withColumn("block", F.explode(F.expr("sequence(0, home - 1)"))).select(F.xxhash64("part", F.lit("v"), "block", "to").alias("g"), "c", "v", "weight", F.lit(0).alias("side"))
    groups = at_home.unionByName(hosts).unionByName(visitors)
    out = saved(groups.groupBy("g").applyInArrow(_compare(size, least), "a long, b long, n long"), "found")
    discard(dealt)
    return out


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
