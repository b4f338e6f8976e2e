"""Near-duplicate documents by bottom-k sketches.

Words are [^\x20\x09-\x0D]+ of text lower-cased A-Z. A document's set holds its distinct shingles of `width` words; with
fewer words, the whole sequence as one; without words the set is empty and linked with nothing. Two documents are
linked if their sets' Jaccard similarity is `percent` / 100 or more.

1. Shingles have two hashes of different keys. Documents with equal sets (a 64-bit fingerprint from each) form one class; the rest works on classes.
2. One hash function orders all shingles; a sketch retains the k lowest of a set. An inverted list holds the classes in
   whose sketches two given values are neighbours. Where two sets have similarity 0.8, a value of their union is in both
   with probability 0.8, and the union's k lowest hold two shared neighbours except with probability 0.512**k, 1e-14
   for k = 48; in sets of at most k shingles they always do. Neighbours rather than single values keep lists short.
3. Shingles of more than one in a thousand documents (common phrases, shared passages) are kept out of the lists of
   documents that have enough others: documents of which 30 % or more are other shingles have a sketch of RARE_K of those,
   documents of which less than 65 % are have one of all. Two sets of similarity 0.8 are both in one of the two kinds, and
   in the first the others' similarity is 0.69 or more, which misses two shared neighbours with probability 4e-13.
4. Each list pairs its members with its smallest and its largest member. The ESTIMATE_K lowest values of two sketches' union
   estimate the similarity; pairs far below the threshold go. Pairs that stay, linked or not, form families.
5. Lists with members of several families: linked full sketches share several lists, LEAST_RARE or LEAST_ALL, so each may
   leave one less of its longest lists and still shares another (prefix filtering): that takes the lists of shared passages
   out. In each list left, block by block, the members outside its largest family are compared with all of other families, inside
   the task: parities of the retained values in ODD_BITS slots count differences, never too many, and the estimate decides.
   A task returns one pair for two families, which then are one; pairs of a list never become rows.
6. Full sets, in which shingles are equal if both hashes are, of pairs with heads of lists decide on links. In a family that then has several components, members outside the
   largest are compared with all of the other components, block by block: a task multiplies the incidence matrices of two
   blocks of full sets and reports one link for two components. So every pair that 2 to 5 leave is decided exactly.

With `exact`, lists are those of single values, of which each sketch retains so many that linked sets always share one
(more than a share of 1 - percent / 100 of its set), and estimates drop nothing: no pair is missed at any probability, at higher cost.

Cases: null or empty text has no words; very long texts have large sets and sketches like all others; a null id counts as
larger than all others and is never kept beside one that has an id; repeated rows are copies; rows with one id and different
texts are judged each for itself; a similarity of exactly percent / 100 links; ids are of any type that Spark orders; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.llm import hashing
from boardlens.llm.filters import admitted, docs_filter, key_filter
from boardlens.llm.graph import components, more_links
from boardlens.llm.store import discard, mapped, saved

K = 48
RARE_K = 64
#: Values of the sketches that estimate similarities, and the estimate under which a pair is dropped: a pair at the
#: threshold falls under it with probability 1e-9 (Chernoff).
ESTIMATE_K, ESTIMATE_LESS = 128, 0.25
#: Slots in which a signature has the parities of the ESTIMATE_K lowest values.
ODD_BITS = 512
#: Sets that a task compares with as many others; members of a list that it compares with as many others.
BLOCK, LIST_BLOCK = 128, 512
#: Rows of lists that a task takes together.
TOGETHER = 8192
#: Neighbours that two linked sketches share at least if one is full: of rare shingles, of all (missed at 1e-8 and 4e-9).
LEAST_RARE, LEAST_ALL = 5, 6
#: Shingles of more than one document in so many are common.
COMMON_ONE_IN = 1000
#: Slots by the upper bits of shingles in which shingles are counted first, and shingles that are counted together.
SLOT_BITS, COUNTED = 20, 1 << 22


def _shingles(hashes: np.ndarray, w: hashing.Words, width: int, keys: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, text of each): runs of width words, and whole texts of fewer by the other key."""
    n = np.diff(w.bounds)
    starts, text = hashing.starts_inside(w.bounds, width)
    values = hashing.window_hashes(hashes, width, keys[0])[starts] if len(starts) else np.zeros(0, np.uint64)
    for m in range(1, width):
        own = np.flatnonzero(n == m)
        if len(own):
            values, text = np.concatenate([values, hashing.window_hashes(hashes, m, keys[1])[w.bounds[own]]]), np.concatenate([text, own])
    return values, text


def shingle_sets(w: hashing.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, bounds by text)."""
    values, text = _shingles(w.hashes, w, width, hashing.KEYS)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(w.n_texts + 1))


def whole_sets(w: hashing.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes by other keys, bounds by text): shingles are one only if both agree, 128 bits of two keyed hashes."""
    values, text = _shingles(w.hashes, w, width, hashing.KEYS)
    others, _ = _shingles(w.second(), w, width, hashing.KEYS[::-1])
    order = np.lexsort((values, text))
    same = (values[order][1:] == values[order][:-1]) & (text[order][1:] == text[order][:-1])
    if (same & (others[order][1:] != others[order][:-1])).any():
        order = np.lexsort((others, values, text))
    values, others, text = values[order], others[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1]) | (others[1:] != others[:-1])
    return values[new], others[new], np.searchsorted(text[new], np.arange(w.n_texts + 1))


def numbered(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """One number for each pair of hashes: the first hash where it tells all apart, which is always but for made-up words."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], others[order]
    if not ((v[1:] == v[:-1]) & (o[1:] != o[:-1])).any():
        return values
    order = np.lexsort((others, values))
    v, o = values[order], others[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]))
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fingerprints(values: np.ndarray, others: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a fingerprint of each set, from hashes by different keys."""
    n = np.diff(bounds).astype(np.uint64)
    f = hashing.mix(_sums(hashing.mix(values), bounds) + n)
    g = hashing.mix(_sums(hashing.mix(others * np.uint64(0x9FB21C651E98DF25)), bounds) ^ n)
    return f.view(np.int64), g.view(np.int64)


def ragged(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _lowest(values: np.ndarray, bounds: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k lowest values of each (sorted) set, and their bounds."""
    keep = np.minimum(np.diff(bounds), k)
    at = np.concatenate([[0], np.cumsum(keep)])
    return values[np.arange(at[-1]) - np.repeat(at[:-1] - bounds[:-1], keep)], at


def _neighbours(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each two neighbouring values of a sketch, and the bounds of the keys."""
    inside = np.ones(max(0, len(low) - 1), bool)
    inside[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(low))] - 1] = False
    keys = hashing.mix(low[:-1] * np.uint64(0xA24BAED4963EE407) ^ low[1:])[inside]
    return keys, np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(at) - 1))])


def frequent(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur `least` times or more in all parts together, and how often. Values of slots with fewer are never sorted."""
    slots, shift = np.zeros(1 << SLOT_BITS, np.int64), np.uint64(64 - SLOT_BITS)
    for v in parts:
        slots += np.bincount((v >> shift).astype(np.int64), minlength=len(slots))
    values = np.concatenate([np.zeros(0, np.uint64), *(v[slots[(v >> shift).astype(np.int64)] >= least] for v in parts)])
    values, counts = np.unique(values, return_counts=True)
    return values[counts >= least], counts[counts >= least]


def _common_rows(width: int):
    """Shingles that many of a task's documents have, with their number, for COUNTED shingles at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        n_docs = n = 0

        def counted() -> pa.RecordBatch:
            values, counts = frequent(parts, max(2, n_docs // (2 * COMMON_ONE_IN)))
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["h", "n"])

        for batch in batches:
            for w in hashing.words(batch.column(0), lower=True):
                parts.append(shingle_sets(w, width)[0])
                n_docs, n = n_docs + w.n_texts, n + len(parts[-1])
                if n >= COUNTED:
                    yield counted()
                    parts, n_docs, n = [], 0, 0
        yield counted()

    return rows


def upper_halves(low: np.ndarray) -> np.ndarray:
    """The upper halves of 64-bit values, with the top bit flipped: as int32 they have the order of the unsigned values."""
    return ((low >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)


def _prefix(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest values of each set, so many that of two linked sets one is shared, and their bounds."""
    n = np.diff(bounds)
    return _lowest(values, bounds, np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0))


def _sketch_rows(width: int, k: int, common, exact: int | None):
    """id, n, fingerprint, the lowest values (upper halves), the keys of inverted lists and which kinds are full, for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in hashing.words(batch.column(1), lower=True):
                values, others, bounds = whole_sets(w, width)
                n = np.diff(bounds)
                f, g = fingerprints(values, others, bounds)
                low, at = _lowest(values, bounds, np.full(len(n), ESTIMATE_K))
                low = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(upper_halves(low)))
                if exact:
                    keys, keys_at = _prefix(values, bounds, exact)
                    full = np.zeros(len(n))
                else:
                    rare = ~common.value.admits(values)
                    rare_bounds = np.concatenate([[0], np.cumsum(rare)])[bounds]
                    n_rare = np.diff(rare_bounds)
                    few, many = 100 * n_rare < 65 * n, 100 * n_rare >= 30 * n
                    all_keys, all_at = _neighbours(*_lowest(values, bounds, np.where(few, k, 0)))
                    rare_keys, rare_at = _neighbours(*_lowest(values[rare], rare_bounds, np.where(many, RARE_K, 0)))
                    text = np.concatenate([np.repeat(np.arange(len(n)), np.diff(x)) for x in (all_at, rare_at)])
                    # The lowest bit tells the two kinds of lists apart.
                    keys, keys_at = np.concatenate([all_keys & ~np.uint64(1), rare_keys | np.uint64(1)])[np.argsort(text, kind="stable")], all_at + rare_at
                    full = (np.diff(all_at) == k - 1) + 2 * (np.diff(rare_at) == RARE_K - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n_texts), pa.array(n, pa.int64()), pa.array(f), pa.array(g), low, ragged(keys, keys_at), pa.array(full.astype(np.int8))],
                    names=["id", "n", "f", "g", "low", "keys", "full"],
                )

    return rows


def _set_rows(width: int, admit):
    """Fingerprint and full set of each row whose id (hashed, in the first column) the filter admits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(admitted(admit, batch.column(0))))
            for w in hashing.words(texts, lower=True):
                values, others, bounds = whole_sets(w, width)
                f, g = fingerprints(values, others, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(g), ragged(values, bounds), ragged(others, bounds)], names=["f", "g_", "full", "second"])

    return rows


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, as products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, rows = np.concatenate(left), np.repeat(np.arange(len(left)), [*map(len, left)])
    others, other_rows = np.concatenate(right), np.repeat(np.arange(len(right)), [*map(len, right)])
    shared = np.intersect1d(values, others)
    at, other_at = np.searchsorted(shared, values), np.searchsorted(shared, others)
    keep, other_keep = np.append(shared, 0)[at] == values, np.append(shared, 0)[other_at] == others
    keep &= at < len(shared)
    other_keep &= other_at < len(shared)
    at, rows, other_at, other_rows = at[keep], rows[keep], other_at[other_keep], other_rows[other_keep]
    for low in range(0, len(shared), columns):
        x, y = (at >= low) & (at < low + columns), (other_at >= low) & (other_at < low + columns)
        a, b = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        a[rows[x], at[x] - low] = 1
        b[other_rows[y], other_at[y] - low] = 1
        out += a @ b.T
    return out


def _compare(percent: int):
    """Links between the two sides of a group of sets; side 2 is on both. One link for two components is enough."""

    def links(group: pa.Table) -> pa.Table:
        c, side, comp = (group.column(k).to_numpy() for k in ("c", "side", "comp"))
        full, second = (group.column(k).combine_chunks() for k in ("full", "second"))
        sets = np.split(numbered(full.flatten().to_numpy(), second.flatten().to_numpy()), np.cumsum(full.value_lengths().to_numpy())[:-1])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            both = intersections([sets[i] for i in left], [sets[i] for i in right])
            n = np.array([*map(len, sets)], np.float64)
            near = 100 * both >= percent * (n[left][:, None] + n[right][None] - both)
            i, j = np.nonzero(near & (comp[left][:, None] != comp[right][None]))
            a, b = left[i], right[j]
            pair = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], 1)
            _, first = np.unique(pair, axis=0, return_index=True) if len(pair) else (None, np.zeros(0, np.int64))
            a, b = c[a[first]], c[b[first]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _estimate(x: str, y: str, k: int) -> F.Column:
    """Share of the k lowest values of the union that both sketches retain."""
    return F.expr(f"size(array_intersect(slice(array_sort(array_union({x}, {y})), 1, {k}), array_intersect({x}, {y}))) / least({k}, size(array_union({x}, {y})))")


_NONE = 1 << 40


def estimates(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The same for rows of padded sketches (_NONE where there is no value)."""
    both = np.sort(np.concatenate([x, y], 1), 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _NONE)
    rank = np.cumsum(~again & (both < _NONE), 1)
    return (again & (rank <= k)).sum(1) / np.maximum(np.minimum(k, rank[:, -1]), 1)


def parities(low: np.ndarray) -> np.ndarray:
    """For each padded sketch ODD_BITS bits: whether an odd number of its values falls into a slot. Two signatures differ in at
    most as many bits as the sketches have values that only one of them retains.
    """
    row, at = np.nonzero(low < _NONE)
    slot = low[row, at] & (ODD_BITS - 1)
    odd = np.bincount(row * ODD_BITS + slot, minlength=len(low) * ODD_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(low), ODD_BITS), axis=1).view(np.uint64)


def _near_in_lists(percent: int, least: float):
    """Rows sorted by group g -> one pair of classes for each two families of which some members are near.

    Side 1 rows only meet those of side 0 or 2, side 0 rows only those of side 1 or 2.
    """

    def near(g, c, n, family, side, low) -> list[tuple[int, int]]:
        order = np.lexsort((n, g))
        g, c, n, side, low = g[order], c[order], n[order], side[order], low[order]
        label = np.unique(family[order], return_inverse=True)[1]
        odd, out, d = parities(low), [], 0
        i = np.arange(len(g))
        while len(i):
            d += 1
            i = i[i + d < len(g)]
            j = i + d
            # In a group rows are sorted by size: what is too large now stays so.
            i = i[(g[i] == g[j]) & (percent * n[j] <= 100 * n[i])]
            j = i + d
            some = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 2))
            p, q = i[some], j[some]
            small = np.maximum(n[p], n[q]) <= ESTIMATE_K
            most = np.where(small, (n[p] + n[q]) * (100 - percent) / (100 + percent), np.minimum(n[p], ESTIMATE_K) + np.minimum(n[q], ESTIMATE_K) - 2 * ESTIMATE_K * least)
            close = np.bitwise_count(odd[p] ^ odd[q]).sum(1) <= most
            p, q = p[close], q[close]
            for k in range(0, len(p), 2048):
                x, y = p[k : k + 2048], q[k : k + 2048]
                sure = estimates(low[x], low[y], ESTIMATE_K) >= least
                for u, v in zip(x[sure].tolist(), y[sure].tolist(), strict=True):
                    if label[u] != label[v]:
                        out.append((int(c[u]), int(c[v])))
                        label[label == label[v]] = label[u]
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            lists = t.column("low").combine_chunks()
            low = np.full((t.num_rows, ESTIMATE_K), _NONE, np.int64)
            size = lists.value_lengths().to_numpy()
            low[np.arange(ESTIMATE_K) < size[:, None]] = lists.flatten().to_numpy()
            got = near(*(t.column(k).to_numpy() for k in ("g", "c", "n", "family", "side")), low)
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in got], pa.int64()), pa.array([max(p) for p in got], pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            # The last group may go on in the next batch; blocks bound its size.
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            held = t.slice(cut).to_batches()
            if cut:
                yield pairs(t.slice(0, cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return rows


class _Verifier:
    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, exact: bool):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.least = 0.0 if exact else percent / 100 - ESTIMATE_LESS

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose estimate isn't far below the threshold."""
        low = self.classes.select("c", "low")
        near = pairs.join(low.withColumnsRenamed({"c": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"c": "b", "low": "y"}), "b")
        return saved(near.where(_estimate("x", "y", ESTIMATE_K) >= self.least).select("a", "b"), "candidates")

    def links(self, groups: DataFrame) -> DataFrame:
        """Links that full sets confirm. groups (g, c, side, comp): in each group the classes of side 0 or 2 meet those of side 1 or 2."""
        groups = saved(groups, "groups")
        # Only documents that are the first of their class and in a group are cut into shingles again.
        needed = saved(groups.select("c").distinct().join(self.classes.select("c", "id", "f", "g"), "c").withColumnRenamed("g", "g_"), "needed")
        # They are told apart in the same Python worker that cuts them; a second one in each task would need its own memory.
        sets = mapped(self.docs.select(F.xxhash64("id").alias("h"), "text"), _set_rows(self.width, docs_filter(needed, "id")), "f long, g_ long, full array<long>, second array<long>")
        # Rows that repeat a first document, or have its id, bring sets again or others.
        sets = sets.join(needed.select("c", "f", "g_"), ["f", "g_"]).groupBy("c").agg(F.first(F.struct("full", "second")).alias("s"))
        full = groups.join(sets, "c").select("g", "c", "side", "comp", "s.full", "s.second")
        out = saved(full.groupBy("g").applyInArrow(_compare(self.percent), "a long, b long"), "confirmed")
        discard(groups, needed)
        return out


def _spread(side: str, blocks: int = BLOCK) -> F.Column:
    """The block of a row among about size / BLOCK blocks, by hash."""
    return F.pmod(F.xxhash64("c"), F.ceil(F.col(side) / blocks)).cast("int")


def _star_groups(pairs: DataFrame) -> DataFrame:
    """Groups of a head and at most about BLOCK of its partners."""
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("size")), "a").withColumn("c", F.col("b"))
    sized = sized.withColumn("g", F.xxhash64("a", _spread("size")))
    heads = sized.select("g", F.col("a").alias("c")).distinct().select("g", "c", F.lit(0).alias("side"))
    return heads.unionByName(sized.select("g", "c", F.lit(1).alias("side"))).withColumn("comp", F.col("c"))


def _family_groups(members: DataFrame) -> DataFrame:
    """members (c, family, comp). Groups in which those outside a family's largest component meet all other components."""
    parts = members.groupBy("family", "comp").agg(F.count("*").alias("part"))
    parts = parts.groupBy("family").agg(F.max(F.struct("part", "comp")).alias("most"), F.sum("part").alias("size")).select("family", F.col("most.comp").alias("main"), F.col("most.part").alias("n_main"), (F.col("size") - F.col("most.part")).alias("n_other")).where("n_other > 0")
    own = members.join(parts, "family").withColumn("other", F.col("comp") != F.col("main"))
    own = own.withColumn("block", F.when(F.col("other"), _spread("n_other")).otherwise(_spread("n_main")))
    n_other, n_main = F.ceil(F.col("n_other") / BLOCK).cast("int"), F.ceil(F.col("n_main") / BLOCK).cast("int")
    others, main = own.where("other"), own.where("not other")
    # Each two blocks of others once, and each block of others with each block of the largest component.
    with_other = others.withColumn("to", F.explode(F.sequence(F.lit(0), n_other - 1))).select(
        F.xxhash64("family", F.lit("o"), F.least("block", "to"), F.greatest("block", "to")).alias("g"), "c", F.expr("case when block = to then 2 when block < to then 0 else 1 end").alias("side"), "comp"
    )
    with_main = others.withColumn("to", F.explode(F.sequence(F.lit(0), n_main - 1))).select(F.xxhash64("family", F.lit("m"), "block", "to").alias("g"), "c", F.lit(0).alias("side"), "comp")
    of_main = main.withColumn("to", F.explode(F.sequence(F.lit(0), n_other - 1))).select(F.xxhash64("family", F.lit("m"), "to", "block").alias("g"), "c", F.lit(1).alias("side"), "comp")
    return with_other.unionByName(with_main).unionByName(of_main)


def _list_groups(lists: DataFrame, families: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, c, n, family, side, low): lists with members of several families, in groups of at most about two blocks.

    Members outside a list's largest family meet all others of the list; those of the largest one don't meet each other.
    """
    named = lists.join(families.withColumnsRenamed({"id": "c", "component": "family"}), "c", "left").withColumn("family", F.coalesce("family", "c"))
    parts = named.groupBy("key", "family").agg(F.count("*").alias("part"))
    parts = parts.groupBy("key").agg(F.count("*").alias("k"), F.sum("part").alias("size"), F.max(F.struct("part", "family")).alias("most")).where("k > 1")
    blocks = parts.select("key", F.col("most.family").alias("largest"), F.ceil((F.col("size") - F.col("most.part")) / LIST_BLOCK).cast("int").alias("bo"), F.ceil(F.col("most.part") / LIST_BLOCK).cast("int").alias("bm"))
    own = named.join(blocks, "key").withColumn("main", F.col("family") == F.col("largest"))
    # Targets 0 .. bo - 1 are blocks of others, bo .. bo + bm - 1 those of the largest family. A small list is one group.
    own = own.withColumn("block", F.when(F.col("main"), F.col("bo") + F.pmod(F.xxhash64("c"), F.col("bm"))).otherwise(F.pmod(F.xxhash64("c"), F.col("bo"))).cast("int"))
    own = own.withColumn("to", F.explode(F.expr("case when bo + bm = 2 then array(0) when main then sequence(0, bo - 1) else sequence(0, bo + bm - 1) end")))
    side = F.expr("case when bo + bm = 2 then if(main, 1, 2) when block = to then 2 when block < to then 0 else 1 end")
    g = F.xxhash64("key", F.expr("if(bo + bm = 2, 0, least(block, to))"), F.expr("if(bo + bm = 2, 0, greatest(block, to))"))
    return own.select(g.alias("g"), "c", "n", "family", side.cast("byte").alias("side")).join(classes.select("c", "low"), "c")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each row of docs. component_id is the smallest id reachable by links."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    sent = None
    if not exact:
        common = mapped(own.select("text"), _common_rows(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        n_docs = own.count()
        common = saved(common.where(F.col("n") * COMMON_ONE_IN > n_docs).select("h"), "common")
        sent = docs.sparkSession.sparkContext.broadcast(key_filter(common, "h"))
    sketches = saved(mapped(own, _sketch_rows(width, k, sent, percent if exact else None), f"id {kind}, n long, f long, g long, low array<int>, keys array<long>, full byte"), "sketches")
    rows = saved(sketches.select("id", "n", "f", "g"), "rows")
    first = sketches.where("n > 0").groupBy("f", "g").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("keys").alias("keys"), F.first("full").alias("full"))
    # The table is written once, so the numbers stay.
    classes = saved(first.withColumn("c", F.monotonically_increasing_id()), "classes")
    discard(sketches)
    comp = _class_components(own, classes, width, percent, exact)
    # The smallest id of a component over all its classes.
    of = classes.select("f", "g", "c", "id").join(comp.withColumnsRenamed({"id": "c", "component": "comp"}), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    of = of.join(of.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("f", "g", "component_id")
    linked = rows.where("n > 0").join(of, ["f", "g"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("id <=> component_id")).withColumnRenamed("id", id_col)


def _class_components(docs: DataFrame, classes: DataFrame, width: int, percent: int, exact: bool) -> DataFrame:
    verify = _Verifier(docs, classes, width, percent, exact)
    lists = classes.select(F.explode("keys").alias("key"), "c", "n", "full")
    shared = lists.groupBy("key").agg(F.min("c").alias("head"), F.max("c").alias("last"), F.count("*").alias("members")).where("head <> last")
    lists = saved(lists.join(shared, "key"), "lists")
    ends = lists.where("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b"), "n")
    ends = ends.unionByName(lists.where("c <> last").select(F.col("last").alias("a"), F.col("c").alias("b"), "n")).distinct()
    sizes = classes.select(F.col("c").alias("a"), F.col("n").alias("m"))
    stars = ends.join(sizes, "a").where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = verify.candidates(stars)
    longest = F.row_number().over(W.partitionBy("c", F.col("key") % 2).orderBy(F.desc("members"), F.desc("key")))
    leave = F.expr(f"case when key & 1 = 1 and full & 2 = 2 then {LEAST_RARE - 1} when key & 1 = 0 and full & 1 = 1 then {LEAST_ALL - 1} else 0 end")
    shorter = lists.select("key", "c", "n", (longest > leave).alias("stays")).where("stays").drop("stays")
    heads = components(near)
    groups = _list_groups(shorter, heads, classes).repartition("g").sortWithinPartitions("g")
    across = saved(mapped(groups, _near_in_lists(percent, verify.least), "a long, b long"), "across")
    discard(lists)
    families = more_links(heads, across)
    links = verify.links(_star_groups(near))
    parts = components(links)
    members = families.select(F.col("id").alias("c"), F.col("component").alias("family")).join(parts.withColumnsRenamed({"id": "c", "component": "comp"}), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    return more_links(parts, verify.links(_family_groups(members)))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
