import numpy as np
import pytest

from boardlens.llm.embedding_dedup import CoverTree, dual, near_vectors
from boardlens.llm.graph import components


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_dual_traversal_finds_all_pairs():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 8))
    x = centers[rng.integers(0, 60, 900)] + rng.normal(size=(900, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, reach = CoverTree(x), 0.2
    pairs = [p for u, v in dual(tree, tree, reach) for p in zip(u.tolist(), v.tolist(), strict=True)]
    found = {(min(p), max(p)) for p in pairs}
    assert len(found) == len(pairs)
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    assert {(i, j) for i, j in zip(*np.nonzero(d <= reach), strict=True) if i < j} <= found
    assert all(d[i, j] <= reach + 1e-3 for i, j in found)
    left, right = CoverTree(x[:300]), CoverTree(x[300:])
    across = {(int(i), int(j) + 300) for u, v in dual(left, right, reach) for i, j in zip(u, v, strict=True)}
    assert {(i, j) for i, j in found if i < 300 <= j} == across


def test_levels_are_separated_covered_and_nested():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = CoverTree(x)

    def points(k):
        return [~k] if k < 0 else [p for b in tree.below[k].tolist() for p in points(b)]

    assert sorted(points(0)) == list(range(700))
    for k in range(len(tree.center)):
        own = points(k)
        far = np.linalg.norm(x[own] - x[tree.center[k]], axis=1)
        assert tree.center[k] in own and far.max() <= tree.radius[k] + 1e-6
        below = [b for b in tree.below[k].tolist()]
        if any(b >= 0 for b in below):
            heads = [tree.center[b] if b >= 0 else ~b for b in below]
            level = 2.0
            while level**2 >= tree.radius[k] ** 2 - 2e-6:
                level /= 2
            d = np.linalg.norm(x[heads][:, None] - x[heads][None], axis=2) + 9 * np.eye(len(heads))
            assert heads[0] == tree.center[k] and d.min() > level - 1e-4
            assert all(tree.radius[b] <= level + 1e-3 for b in below if b >= 0)


def test_tight_clusters_are_pruned():
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(200, 64))
    x = centers[rng.integers(0, 200, 8192)] + rng.normal(size=(8192, 64)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, products = CoverTree(x), []
    found = sum(len(u) for u, _ in dual(tree, tree, np.sqrt(0.2), products))
    assert found == (np.triu(x @ x.T >= 0.9, 1)).sum()
    assert sum(products) < 8192 * 8191 / 2 / 5


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 6)) * 0.2, base[:5], base[:5] * 3])
    rows = [(k, [float(v) for v in r], "a", 1) for k, r in enumerate(x)]
    rows += [(200, None, "a", 1), (201, [0.0] * 6, "a", 1), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], "a", 1), (203, [float("nan")] * 6, "a", 1), (204, [1.0], "a", 1), (205, [float("inf")] + [0.0] * 5, "a", 1)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in zip(*np.nonzero(linked), strict=True):
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, c int")).collect()}
    assert len(got) == len(rows)
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id) == (linked[k].sum(), find(k))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(200, 206))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).first().kept
    same = near_vectors(spark.createDataFrame([(4, [1.0, 0.0]), (4, [2.0, 0.0]), (9, [1.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in same) == [(4, 2, 4), (4, 2, 4), (9, 2, 4)]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_odd_rows(spark, tmp_path, stage):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    long_ = " ".join(f"w{k % 97} v{k}" for k in range(600))
    rows = [(1, long_, "en", "s", 1), (2, long_, "en", "s", 1), (3, None, "en", "s", None), (4, "", None, None, 0), (5, "bench words here", "en", "s", 1), (6, "a fine text of its own", "en", "s", 9), (6, "a fine text of its own", "en", "s", 9), (None, long_, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "bench words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.STAGES[stage][1](spark, docs, str(tmp_path)).collect()
    ids = sorted(str(r.doc_id) for r in got)
    if stage < 4:
        assert tuple(got[0].asDict()) == pipeline.COLUMNS
    assert ids == {0: sorted(["1", "2", "3", "4", "5", "6", "6", "None"]), 1: sorted(["1", "3", "4", "5", "6", "None"]), 2: sorted(["1", "2", "3", "4", "5", "6", "6", "None"]), 3: sorted(["1", "2", "3", "4", "6", "6", "None"]), 4: sorted(["1", "2", "3", "4", "5", "6", "6", "None"])}[stage]
    if stage == 2:
        assert {str(r.doc_id): r.text for r in got}["2"] == "" and {str(r.doc_id): r.text for r in got}["None"] == long_


def test_single_points_beside_one_cluster():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 64)), rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.02])
    x[5] = x[4] + rng.normal(size=64) * 0.05
    x = x[rng.permutation(1200)] / 1.0
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, reach = CoverTree(x), np.sqrt(0.2)
    assert sorted(p for k in range(len(tree.center)) for p in (~b for b in tree.below[k].tolist() if b < 0)) == list(range(1200))
    want = np.triu(x @ x.T >= 0.9, 1).sum()
    assert want > 300 * 299 / 2 and sum((np.einsum("ij,ij->i", x[u], x[v]) >= 0.9).sum() for u, v in dual(tree, tree, reach)) == want


def test_more_links_join_known_components(spark):
    from boardlens.llm.graph import components, more_links

    known = components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (None, 1)], "a long, b long"))
    got = more_links(known, spark.createDataFrame([(3, 11), (30, 31), (2, 2)], "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 30, 31: 30}
    same = more_links(known, spark.createDataFrame([], "a long, b long"))
    assert {r.id: r.component for r in same.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}
