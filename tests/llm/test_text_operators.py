"""Operators on texts against brute force, with nulls, empty and very long texts, repeated rows, empty tables and other columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boardlens.llm import bpe_codec, decontamination, hashing, language_id, lm_score, minhash_dedup, quality, substring_dedup, token_counts, url_filter
from boardlens.llm.automaton import Transducer
from boardlens.llm.merging import RankMerger

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, id string, h long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(n=60, seed=1):
    """Texts with shared passages, copies, near copies, repeated rows, null and empty texts and a null id."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "of", "É", "x" * 70]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary, 70))
    for k in range(0, n, 5):
        texts[k] = texts[k] + "\n" + passage + " end"
    texts[7], texts[8] = texts[3], texts[3] + " more"
    texts += ["", None, "one", "one", "ONE two", "one  two", " ".join(vocabulary * 30), passage, passage]
    rows = [(k, t, "en", "other", 1) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[0], (None, texts[3], None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_word_hashes():
    texts = ["a Bc  d", None, "", "x\ty\né", "b" * 3000]
    got = [w.hashes[w.bounds[k] : w.bounds[k + 1]] for w in hashing.words(pa.array(texts), lower=True, most=16) for k in range(w.n_texts)]
    for t, h in zip(texts, got, strict=True):
        assert (hashing.hash_strings([x.encode() for x in WORD.findall(lower(t))]) == h).all()


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    found = hashing.Lookup(keys, np.arange(len(keys)))
    assert (found(keys, -1) == np.arange(len(keys))).all() and (found(keys + np.uint64(1), -1)[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (hashing.Lookup(keys[:0], np.zeros(0))(keys, 9) == 9).all()


@pytest.mark.parametrize("width", [50, 20, 3])
def test_substring_dedup(spark, width):
    rows = corpus()
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {k + m for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for m in range(width)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = substring_dedup.substring_dedup(frame(spark), width=width)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == want


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = corpus()
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if sets[x][1] and 100 * both >= 80 * len(sets[x][1] | sets[y][1]):
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))
    got = minhash_dedup.near_duplicates(frame(spark), width=width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontamination(spark, most):
    rows = [*corpus(), (900, "Alpha beta! gamma", "en", "x", 1), (901, "pre " + " ".join(f"t{k}" for k in range(14)) + " post", "en", "x", 1)]
    items = [(1, "alpha, BETA"), (10, " ".join(f"T{k}" for k in range(14))), (2, None), (3, "..."), (4, "w1 w2 w3"), (5, "of"), (5, "of"), (None, "the")]
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = [(i if i is None else str(i), tuple(w[k : k + 13])) for i, t in items for w in [cut.findall(lower(t))] for k in range(max(1, len(w) - 12)) if w]
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = cut.findall(lower(t)), set(), set()
        for item, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= {item} - {None}
        want[i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    got = decontamination.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), most_patterns=most)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()) == want


def test_merging_is_one_pair_at_a_time():
    rng = np.random.default_rng(4)
    pairs = {}
    for k in range(40):
        pairs.setdefault((int(rng.integers(0, 4 + k)), int(rng.integers(0, 4 + k))), (4 + k, int(rng.integers(0, 25))))
    left, right = np.array([*pairs]).T
    merged, rank = np.array([*pairs.values()]).T
    for k in range(len(merged)):  # one rank for a symbol, as scores of pieces are
        rank[k] = rank[list(merged).index(merged[k])]
    table = {(a, b): (m, r) for a, b, m, r in zip(left.tolist(), right.tolist(), merged.tolist(), rank.tolist(), strict=True)}
    texts = [rng.integers(0, 4, rng.integers(0, 30)).tolist() for _ in range(300)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    symbols, at = RankMerger(left, right, merged, rank)(np.concatenate(texts).astype(np.int64), bounds)
    for k, t in enumerate(texts):
        while found := [(table[p][1], i) for i, p in enumerate(zip(t, t[1:], strict=False)) if p in table]:
            _, i = min(found)
            t = [*t[:i], table[t[i], t[i + 1]][0], *t[i + 2 :]]
        assert symbols[at[k] : at[k + 1]].tolist() == t


def test_transducer():
    words = sorted({b"the", b"there", b"then", b"ten", b"t", b"zen", b"\xc3\xa9"})
    ids = [np.arange(k, dtype="<u4").tobytes() for k in range(len(words))]
    t = Transducer.mapped(*Transducer.build(words[::-1], ids[::-1]).to_bytes())
    assert t.numbers([*words, b"th", b"", b"zz"]).tolist() == [*range(len(words)), -1, -1, -1]
    assert t.outputs(np.arange(len(words))) == ids and len(t.final) < sum(map(len, words)) + 1
    assert Transducer.mapped(*Transducer.build([], []).to_bytes()).numbers([b"a"]).tolist() == [-1]


ODD = ["", None, "  two  spaces \n\n tabs\t", "<|endoftext|>x <|endoftext|>", "é漢字😀\u200b\x00", "a" * 20000, "don't 12345 ²½", "Ａ ﬁ\x85\xa0end ", "<s> </s> <unk> ▁▁x"]


def test_token_counts_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    rows = [*corpus(), *((500 + k, t, "x", "y", 2) for k, t in enumerate(ODD))]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, *_ in rows)
    got = token_counts.token_counts(frame(spark, rows), path, limit=100)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


@pytest.mark.parametrize("lexicon", [50, 0])
def test_codec_equals_the_library(spark, lexicon):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [*corpus(), *((500 + k, t, "x", "y", 2) for k, t in enumerate(ODD))]
    lib = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    got = bpe_codec.encode(frame(spark, rows), path, lexicon_size=lexicon)
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded) for r in got.collect()) == want


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 50)
    rows = corpus()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = [(i, [*WORD.findall(lower(t)), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    got = lm_score.score_texts(frame(spark), training).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_is_normalised_and_learns():
    model = lm_score.LogBilinear(np.full(6, 1 / 6), width=8)
    tables = np.zeros((2, 7, 6))
    for k in range(4):
        tables[0, k, (k + 1) % 4] = tables[1, k, (k + 2) % 4] = 3000
    model.train([*tables])
    z = np.stack([model.log_normalisers(k) for k in range(7)])
    every = np.array([[a, b, w] for a in range(7) for b in range(7) for w in range(6)])
    p = np.exp(model.log_probability(every[:, 0], every[:, 1], every[:, 2], z)).reshape(7, 7, 6)
    assert np.allclose(p.sum(2), 1, atol=1e-4) and p[0, 3, 1] > 0.8


def test_urls(spark):
    pages = [(1, "http://a.b.COM/x?porn=1"), (2, "https://www.example.com/en/a"), (3, "https://m.example.com/en/a"), (4, "http://x.net/es/"), (5, "http://x.org/free-porn-now"), (6, "http://x.org/popcorn"), (7, "http://x.org/casino/poker"), (8, "http://x.org/casino/casino"), (9, None), (10, "no scheme"), (11, ""), (12, "http://xcom/en"), (12, "http://h#f://z/q")]
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")).collect()}
    assert len(got) == len(pages)
    want = [("a.b.com", "/x", "com/", "allow"), ("www.example.com", "/en/a", "www.example.com/en/", "allow"), ("m.example.com", "/en/a", "example.com/en/", "block"), ("x.net", "/es/", "net/es/", "block"), ("x.org", "/free-porn-now", None, "block"), ("x.org", "/popcorn", None, "allow"), ("x.org", "/casino/poker", None, "block"), ("x.org", "/casino/casino", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("xcom", "/en", None, "allow"), ("h", "", None, "allow")]
    assert [got[p] for p in pages] == want


def test_languages(spark):
    en, fr = "the cat and the dog are in the house with that thing".split(), "le chat et le chien sont dans la maison avec cette chose".split()
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(fr if k % 2 else en, 30)), "fr" if k % 2 else "en", "", 0) for k in range(80)]
    model = language_id.fit(frame(spark, rows))
    odd = [(100, None), (101, ""), (102, "123 !!"), (None, "the dog and the cat"), (103, "x" * 50000), (104, "Le CHIEN\nde la maison")]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, [*rows, *((i, t, None, None, None) for i, t in odd)]), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in rows) >= 78
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102)) and got[None].lang_pred == "en" and got[104].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(frame(spark, rows[:1]), None).first().lang_pred == "und"


def test_forward_backward_is_exact():
    field = language_id.Field(["a", "b", "c"], np.zeros(0, np.uint64))
    rng = np.random.default_rng(1)
    field.move = rng.normal(size=(3, 3)).astype(np.float32)
    emit, bounds = rng.normal(size=(9, 3)).astype(np.float32), np.array([0, 4, 4, 9])
    post, _ = field.posteriors(emit, bounds)
    for a, b in ((0, 4), (4, 9)):
        total = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            w = math.exp(sum(emit[a + t, s] for t, s in enumerate(path)) + sum(field.move[x, y] for x, y in zip(path, path[1:], strict=False)))
            for t, s in enumerate(path):
                total[t, s] += w
        assert np.allclose(post[a:b], total / total.sum(1, keepdims=True), atol=1e-4)


def test_quality(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(200):
        ws = [f"w{x}" for x in rng.integers(0, 50, 40)]
        bad, toxic = k % 5 == 0, k % 5 == 1
        text = " ".join(w.upper() + "!!" for w in ws) if bad else " ".join([*ws, "vile", "nasty"] if toxic else ws)
        rows.append((k, text, "en", "h", 0))
        if k < 120:
            labels.append((k, int(not bad), int(toxic)))
    rows += [(300, None, None, None, None), (301, "", "en", "h", 0), rows[0]]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.fit(docs, known), F.col("id"), F.col("lang")).collect()
    assert len(got) == len(rows)
    assert all(r.rejected == (r.doc_id % 5 in (0, 1)) for r in got if r.doc_id < 200)
    again = quality.judge(docs.repartition(3), quality.fit(docs.repartition(3), known.repartition(2)), F.col("id"), F.col("lang")).collect()
    assert sorted((str(r.doc_id), round(r.p_toxic, 9)) for r in again) == sorted((str(r.doc_id), round(r.p_toxic, 9)) for r in got)
    none = quality.judge(docs, quality.fit(docs, known.limit(0)), F.col("id"), F.col("lang"))
    assert none.count() == len(rows)


def test_site_posteriors(spark):
    """Two levels of priors and each row's own share left out, against numpy, with many sparse sites, null sites and ties."""
    rng = np.random.default_rng(12)
    rows = []
    for h in range(12):
        rate = rng.beta(0.4, 0.8)
        for path in range(int(rng.integers(1, 6))):
            share = float(np.clip(rate + rng.normal(0, 0.4), 0, 1))
            for _ in range(int(rng.choice([1, 2, 3, 40]))):
                bad = rng.random() < share
                rows.append((f"h{h}" if h else None, f"p{path}" if path else None, float(rng.normal(2 if bad else -2, 1)), float(rng.normal(-3, 1))))
    rows += [rows[0]] * 3
    got = quality.posteriors(spark.createDataFrame(rows, "host string, path string, low_quality double, toxic double"))
    got = Counter((r.host, r.path, round(r.low_quality, 9), round(r.p_low_quality, 8), round(r.p_toxic, 8)) for r in got.collect())
    want, n = [[None] * 2 for _ in rows], len(rows)
    for kind in range(2):
        odds = np.array([r[2 + kind] for r in rows])
        p = 1 / (1 + np.exp(-odds))
        hosts, paths = {}, {}
        for r, x in zip(rows, p, strict=True):
            hosts.setdefault(r[0], []).append(x)
            paths.setdefault(r[:2], []).append(x)
        m = (p.sum() + 0.5) / (n + 1)
        by_host, by_path = (sum(sum(v) ** 2 / len(v) for v in x.values()) for x in (hosts, paths))
        s_host = quality._strength(m, by_host / n - m * m, m * (1 - m) * len(hosts) / n)
        s_path = quality._strength(m, (by_path - by_host) / n, m * (1 - m) * (len(paths) - len(hosts)) / n)
        assert kind or min(s_path, s_host) < 1e4 and s_host != s_path
        for k, r in enumerate(rows):
            host = (sum(hosts[r[0]]) - p[k] + s_host * m) / (len(hosts[r[0]]) - 1 + s_host)
            path = (sum(paths[r[:2]]) - p[k] + s_path * host) / (len(paths[r[:2]]) - 1 + s_path)
            shift = np.clip(np.log(path / (1 - path)) - np.log(m / (1 - m)), -quality.MOST_SHIFT, quality.MOST_SHIFT)
            want[k][kind] = 1 / (1 + np.exp(-(odds[k] + shift)))
    assert got == Counter((r[0], r[1], round(r[2], 9), round(float(a), 8), round(float(b), 8)) for r, (a, b) in zip(rows, want, strict=True))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.substring_dedup(none).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert decontamination.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert lm_score.score_texts(none, F.lit(True)).count() == 0
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert quality.judge(none, quality.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")), F.col("id"), F.col("lang")).count() == 0
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    for model, run in (("piece_bpe_32k.model", token_counts.token_counts), ("byte_bpe_50k.json", bpe_codec.encode)):
        assert run(none, pytest.importorskip("public_tokenizers").path(model)).count() == 0
