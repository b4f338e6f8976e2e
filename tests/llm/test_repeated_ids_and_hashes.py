"""Rows with one id and different texts, ids that are no numbers, and words made to collide under polynomial hashes."""

import numpy as np
import pyarrow as pa

from boardlens.llm import decontamination, hashing, minhash_dedup, substring_dedup


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


LEFT, RIGHT = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
SHORT_LEFT, SHORT_RIGHT = LEFT[:64], RIGHT[:64]


def test_thue_morse_words_differ():
    for x, y in ((LEFT, RIGHT), (SHORT_LEFT, SHORT_RIGHT)):
        for key in hashing.KEYS:
            h = [hashing.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]), key)[0] for t in (x, y)]
            assert h[0] != h[1]
    words = np.array([1, 2], np.uint64)
    runs = [np.array([words[int(c == "b")] for c in t]) for t in (LEFT, RIGHT)]
    assert hashing.window_hashes(runs[0], 1024)[0] != hashing.window_hashes(runs[1], 1024)[0]


def test_colliding_words_stay_apart(spark):
    words = [f"u{k}" for k in range(49)]
    for x, y in ((LEFT, RIGHT), (SHORT_LEFT, SHORT_RIGHT)):
        docs = spark.createDataFrame([(1, " ".join([*words, x])), (2, " ".join([*words, y]))], "doc_id long, text string")
        assert [r.n_removed for r in substring_dedup.substring_dedup(docs).collect()] == [0, 0]
        hit = decontamination.decontaminate(docs, spark.createDataFrame([(7, x)], "item_id long, text string"))
        assert sorted((r.doc_id, r.n_hit) for r in hit.collect()) == [(1, 1), (2, 0)]
        alone = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
        assert all(r.kept for r in minhash_dedup.near_duplicates(alone).collect())


def test_substring_rows_of_one_id_keep_their_own_windows(spark):
    words = [f"v{k}" for k in range(50)]
    longer = [f"q{k}" for k in range(60)] + words
    other = [f"z{k}" for k in range(120)]
    rows = [(1, " ".join(words)), (5, " ".join(longer)), (5, "only three words"), (5, " ".join(other)), (5, None), (6, " ".join(other[20:90]))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 50, 0), (5, 0, 0), (5, 3, 0), (5, 110, 50), (5, 120, 0), (6, 70, 70)]


def test_ids_of_any_type(spark):
    words = " ".join(f"v{k}" for k in range(50))
    rows = [("b", words), ("a", words + " more"), (None, words), ("c", "short one"), ("c", "")]
    docs = spark.createDataFrame(rows, "name string, body string")
    cut = substring_dedup.substring_dedup(docs, id_col="name", text_col="body").collect()
    assert sorted((str(r.name), r.n_removed) for r in cut) == [("None", 0), ("a", 0), ("b", 50), ("c", 0), ("c", 0)]
    near = minhash_dedup.near_duplicates(docs, id_col="name", text_col="body").collect()
    assert sorted((str(r.name), str(r.component_id), r.kept) for r in near) == [("None", "a", False), ("a", "a", True), ("b", "a", False), ("c", "c", True), ("c", "c", True)]


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rows = [(3, "a b c d e f"), (3, "g h i j k l"), (4, "g h i j k l"), (2, "a b c d e f"), (2, "a b c d e f")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (2, 2, True), (3, 2, False), (3, 3, True), (4, 3, False)]


def test_words_over_pieces():
    texts = ["x" * 200_000 + " " + "y" * 9, " ".join("z" * k for k in range(1, 80))]
    for w in hashing.words(pa.array(texts), most=1000):
        assert len(w.hashes) == len({*w.hashes.tolist()}) and len(w.second()) == len(w.hashes)
