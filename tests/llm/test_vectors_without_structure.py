"""Vectors that nothing can be pruned of: few nodes, few copies, products and pairs of bounded size, the same links."""

import numpy as np

from boardlens.llm import embedding_dedup as E


def drawn(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[: n // 20] = x[0] + 0.1 * rng.standard_normal((n // 20, dims))
    x = rng.permutation(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_large_block_makes_no_tiny_balls():
    x = np.random.default_rng(5).standard_normal((20_000, 64))
    assert len(E.CoverTree(x / np.linalg.norm(x, axis=1, keepdims=True)).center) < 100


def test_copies_of_vectors_grow_with_the_table_over_large_parts():
    n = 615_384
    parts = -(-n // E._part(n, 6))
    assert parts < 25 and E._part(n, 6) <= E.PART and E._part(5000, 6) == E.LEAST_PART and -(-51_282 // E._part(51_282, 6)) * (1 + 51_282 // E._part(51_282, 6)) / 2 >= 6


def test_dense_groups_come_in_pairs_of_bounded_number(monkeypatch):
    x = np.random.default_rng(7).standard_normal(64) + 0.01 * np.random.default_rng(8).standard_normal((6000, 64))
    tree = E.CoverTree(x / np.linalg.norm(x, axis=1, keepdims=True))
    sizes = [len(u) for u, _ in E.dual(tree, tree, 0.4)]
    assert sum(sizes) == 6000 * 5999 / 2 and max(sizes) <= 512 * 2048


def test_parts_and_blocks_of_any_size_give_the_links_of_brute_force(spark, monkeypatch):
    x = drawn(900, 16)
    near = x @ x.T >= 0.9
    want = {k: int(near[k].sum()) - 1 for k in range(len(x))}
    label = np.arange(len(x))
    while True:
        least = np.where(near, label[None, :], len(x)).min(1)
        if (least == label).all():
            break
        label = least
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for least, most, pairs in ((4096, 32768, 1 << 15), (64, 90, 7)):
        for name, value in (("LEAST_PART", least), ("PART", most), ("PAIRS", pairs)):
            monkeypatch.setattr(E, name, value)
        got = E.near_vectors(table).collect()
        assert {r.vec_id: r.n_links for r in got} == want and sum(want.values()) > 1000
        assert {r.vec_id: r.component_id for r in got} == dict(enumerate(label.tolist()))
