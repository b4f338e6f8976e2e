"""Exact k-means of integer vectors by balls.

Components x become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of `seed:id`; each of `rounds` rounds
assigns every vector to its nearest centroid (squared distance, ties: the smaller number) and replaces every centroid that has
vectors by the componentwise floor of their mean. Then vectors are assigned once more.

A task takes blocks of vectors. In a block, the members that a cluster had in the round before form a ball around its (new)
centroid, whose radius is the distance of the farthest member. A centroid can win a member at distance d only if it lies within 2 d
of the ball's own centroid, so only centroids within two radii are neighbours of the ball. Neighbours, in the order of their distance, cut
the ball into a stable core, which keeps its centroid without any comparison, and annuli: members of an annulus are compared with the neighbours
within twice their own distance, and no others. All of it is in integers, so ties and boundaries are exact, and whatever clusters a
round starts with, the result is that of comparing everything.

A round is one pass: vectors with their new clusters are written to the shared folder, and with them one row for each task and cluster with
count and sums, so k rows a task are all that is added up; centroids (k x dimensions numbers) are what the driver holds and sends. Rounds end
early when centroids stay as they are.

Kept are vectors with exactly `dims` components, none null or non-finite, and none of 2**27 / scale or more, beyond which a squared distance does not
fit into 64 bits. Cases: null vectors aren't kept; repeated rows and repeated ids count each for itself (equal hashes of ids go by components); a
null id is hashed as an empty text; with fewer than k kept vectors each is a centroid; of equal centroids the smaller number takes all;
an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boardlens.llm.store import discard, mapped, saved

#: Components of kept vectors lie below this, so 64 squared differences fit into 62 bits.
MOST = 1 << 27
_MOST_DIMS = 64


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<int>) of the kept vectors."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.size("x") == dims)
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST))
    return own.where(fits).select("id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of v from c, in integers."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of v, whose clusters before were `own`, and how many distances were computed."""
    own = own.copy()
    best = np.empty(len(v), np.int64)
    computed = len(v)
    for i in np.unique(own).tolist():
        members = np.flatnonzero(own == i)
        d = distances(v[members], centroids[i])
        between = distances(centroids, centroids[i])
        # A centroid at squared distance g may win a member at d only if g <= 4 d, that is (g - 1) // 4 < d or g = 0.
        needs = np.where(between > 0, (between - 1) // 4 + 1, 0)
        radius, winner, least = d.max(), np.full(len(members), i), d.copy()
        near = [j for j in np.argsort(between, kind="stable").tolist() if j != i and needs[j] <= radius]
        # Members by distance: those from `needs` of a neighbour on lie in its annuli; the core before the first is left alone.
        by = np.argsort(d, kind="stable")
        edges = np.searchsorted(d[by], needs[near]) if near else []
        for j, edge in zip(near, edges, strict=True):
            ring = by[edge:]
            other = distances(v[members[ring]], centroids[j])
            computed += len(ring)
            wins = (other < least[ring]) | ((other == least[ring]) & (j < winner[ring]))
            least[ring[wins]], winner[ring[wins]] = other[wins], j
        best[members], own[members] = least, winner
    return own, best, computed


def _block_rows(centroids: np.ndarray, kind: pa.DataType):
    """(id, v, cluster) -> the same with new clusters and distances, and at the end of a task a row for each cluster with its sums."""
    k, dims = centroids.shape
    names = ["id", "v", "cluster", "distance", "n", "sums"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(m, dims).astype(np.int64)
            cluster, distance, _ = assign(v, batch.column(2).to_numpy().astype(np.int64), centroids)
            order = np.argsort(cluster, kind="stable")
            some, at = np.unique(cluster[order], return_index=True)
            n += np.bincount(cluster, minlength=k)
            sums[some] += np.add.reduceat(v[order], at, axis=0)
            none = pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance), *none], names=names)
        some = np.flatnonzero(n)
        if len(some):
            total = pa.array(sums[some].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), pa.nulls(len(some), pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), pa.array(n[some]), total], names=names)

    return rows


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of sums over counts; k x dimensions numbers come to the driver."""
    parts = table.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("dim", "x"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.dim] = r.x // r.n
    return out


def ball_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id_col, v, cluster, distance) for each kept vector, final centroids [k, dims])."""
    if dims > _MOST_DIMS:
        raise ValueError(f"squared distances of more than {_MOST_DIMS} components need not fit into 64 bits")
    own = integer_vectors(vectors, dims, scale, id_col, vector_col)
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, v array<int>, cluster int, distance long, n long, sums array<long>"
    arrow = to_arrow_type(own.schema["id"].dataType)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    table = saved(own.withColumn("cluster", F.lit(0)), "vectors")
    first = table.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return table.select(F.col("id").alias(id_col), "v", "cluster", F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    centroids = np.array([r.v for r in first], np.int64)

    def step(t: DataFrame) -> DataFrame:
        return mapped(t.select("id", "v", "cluster"), _block_rows(centroids, arrow), schema)

    for _ in range(rounds):
        before, table = table, saved(step(table.where("n is null") if "n" in table.columns else table), "assigned")
        discard(before)
        moved = _means(table, centroids)
        same, centroids = (moved == centroids).all(), moved
        if same:
            break
    last = saved(step(table.where("n is null") if "n" in table.columns else table).where("n is null").select(F.col("id").alias(id_col), "v", "cluster", "distance"), "clusters")
    discard(table)
    return last, centroids


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, centroids = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(k, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # k rows, whatever the input.
    sums = got.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).withColumn("inertia", F.sum("cluster_inertia").over(W.partitionBy()))
    return got.join(F.broadcast(sums.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Rounds one after the other; floors of means by remainders, so that they are exact."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v AS c FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (SELECT r, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{t})) WHERE place = 1)")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t} JOIN v USING (r)) GROUP BY k, i),
c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(f.c, c.c) AS c FROM c{t} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{t} GROUP BY k) f USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.k"""


QUERIES = {"op11_ball_kmeans": op11_ball_kmeans}
ORACLE = {"op11_ball_kmeans": _oracle()}
