"""Windows over one long order, as-of joins over far addresses, call closures, and functions found in bytes, next to plain computations."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from boardlens.operators import addresses as A
from boardlens.operators import cfg as C
from boardlens.operators import images as M
from boardlens.operators import ordered
from boardlens.operators import signatures as G
from boardlens.operators import stores
from boardlens.plans import retrieval as R
from boardlens.sources import elf
from boardlens.sources import fixtures as X


@pytest.mark.parametrize("slice_rows", [7, 64])
def test_rolling_windows_cross_slices(spark, slice_rows):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), k, float(rng.randrange(100))) for k in range(300)]
    got = stores.rolling(spark.createDataFrame(rows, "d string, t int, v double").repartition(5), "d", ["t"], "v", samples=6, slice_rows=slice_rows).collect()
    assert len(got) == 300
    for r in got:
        own = [v for d, t, v in rows if d == r.d and t <= r.t][-6:]
        assert (r.mean, r.least, r.most) == (pytest.approx(sum(own) / len(own)), min(own), max(own))


def test_places_and_halos(spark):
    placed = ordered.numbered(spark.range(500).select((F.col("id") * 37 % 500).alias("x")).repartition(7), ["x"])
    assert all(r.x == r.place for r in placed.collect())
    seen = {}
    for r in ordered.sliced(placed, 3, 2, slice_rows=10).collect():
        seen.setdefault(r.slice_, []).append((r.x, r.own_))
    for k in range(50):
        assert sorted(x for x, _ in seen[k]) == [x for x in range(10 * k - 3, 10 * k + 12) if 0 <= x < 500]
        assert sorted(x for x, own in seen[k] if own) == [*range(10 * k, 10 * k + 10)]
    with pytest.raises(ValueError, match="slice"):
        ordered.sliced(placed, 11, slice_rows=10)


def test_as_of_carries_over_the_whole_address_space(spark):
    rng = random.Random(8)
    starts = sorted({rng.randrange(2 ** rng.choice([12, 20, 36, 50, 64])) for _ in range(150)})
    asked = [rng.randrange(2 ** rng.choice([12, 20, 36, 50, 64])) for _ in range(200)] + starts[::7] + [2**64 - 1, 0]
    left = spark.createDataFrame([("i", str(a), k) for k, a in enumerate(asked)] + [("j", "5", -1), (None, "5", -2), ("i", None, -3)], "image string, a string, k int").withColumn("a", F.col("a").cast("decimal(20,0)"))
    right = spark.createDataFrame([("i", str(s), k) for k, s in enumerate(starts)], "image string, s string, q long").withColumn("s", F.col("s").cast("decimal(20,0)"))
    got = {r.k: (int(r.hit.s) if r.hit is not None and r.hit.s is not None else None) for r in A.as_of(left, right, "a", "s", "q", "hit").collect()}
    assert got == {k: max((s for s in starts if s <= a), default=None) for k, a in enumerate(asked)} | {-1: None, -2: None, -3: None}


def test_neighbours_over_the_whole_address_space(spark):
    rng = random.Random(9)
    at = sorted({rng.randrange(2 ** rng.choice([6, 17, 36, 50])) for _ in range(120)})
    rows = spark.createDataFrame([("i", a, f"m{a}", "", 4) for a in at], "image string, address long, mnemonic string, op_str string, byte_len int")
    got = {r.address: [n.address for n in r.nearby] for r in A.with_nearby(rows).collect()}
    assert got == {a: at[max(0, k - 2) : k + 3] for k, a in enumerate(at)}


def test_windows_span_no_whole_image(spark):
    left = spark.createDataFrame([("i", 5)], "image string, a long")
    right = spark.createDataFrame([("i", 1, 1)], "image string, s long, q long")
    plan = A.as_of(left, right, "a", "s", "q", "hit")._jdf.queryExecution().optimizedPlan().toString()
    # The only window by image alone is over the top of the tree, at most 2**16 groups of buckets.
    assert plan.count("Window") > 2


def closure(rows, entries, most):
    """(address -> depth) by sweeping each function."""
    order = sorted(rows)
    at = {a: k for k, (a, *_) in enumerate(order)}
    known, frontier = {e & ~1: 0 for e in entries}, {e & ~1 for e in entries}
    depth = 0
    while frontier:
        depth += 1
        found = set()
        for a in frontier:
            for address, m, o in order[at[a] : at[a] + most] if a in at else []:
                if m in ("bl", "blx", "bx"):
                    text = o if o.startswith("0x") else o.split("#")[-1].strip() if "#" in o else ""
                    if text.startswith("0x"):
                        found.add(int(text, 16) & ~1)
                if m == "bx" and ("lr" in o or "pc" in o) or m == "pop" and "pc" in o:
                    break
        frontier = found - set(known)
        known |= dict.fromkeys(frontier, depth)
    return known


@pytest.mark.parametrize("most", [200, 5])
def test_call_closure_equals_a_sweep(spark, most):
    rng = random.Random(most)
    rows = []
    for k in range(400):
        m = rng.choice(["mov"] * 5 + ["bl", "blx", "bx", "bx", "pop"])
        to = 4 * rng.randrange(450)
        o = {"bl": hex(to), "blx": f"#{hex(to + 1)}", "bx": rng.choice(["lr", "r3", hex(to)]), "pop": rng.choice(["{r4, pc}", "{r4}"])}.get(m, "r0, #4")
        rows.append((4 * k, m, o))
    entries = [0, 401, 4 * 999]
    df = spark.createDataFrame(rows, "address long, mnemonic string, op_str string")
    got = {r.address: (r.depth, r.has_code) for r in C.call_closure(df, spark.createDataFrame([(e,) for e in entries], "address long"), most=most).collect()}
    assert got == {a: (d, a < 1600 and a % 4 == 0) for a, d in closure(rows, entries, most).items()}


def test_long_chains_of_calls_settle(spark):
    rows = [(8 * k + d, m, o) for k in range(8) for d, m, o in ((0, "bl", hex(8 * (k + 1))), (4, "bx", "lr"))]
    df = spark.createDataFrame(rows, "address long, mnemonic string, op_str string")
    got = {r.address: r.depth for r in C.call_closure(df, spark.createDataFrame([(0,)], "address long")).collect()}
    assert got == {8 * k: k for k in range(9)}


def plain_functions(code, base, arch, seeds):
    step = {"arm": 4, "thumb": 2}.get(arch, 1)
    pro = {a: [bytes.fromhex(p) for p in M.PROLOGUES[a]] for a in ("arm", "thumb", "x86")}

    def is_pro(i, a):
        return any(code[i : i + len(p)] == p for p in pro[a])

    starts = {}
    for s in seeds:
        at, thumb = (s & ~1) - base, arch == "thumb" or arch == "arm" and bool(s & 1)
        a = "thumb" if thumb else arch
        st = {"arm": 4, "thumb": 2}.get(a, 1)
        if 0 <= at < len(code):
            near = [i for i in range(at, at + 16, st) if any(code[i : i + len(p)] == p and i + len(p) <= at + 16 for p in pro[a])]
            starts.setdefault(near[0] if near else at, thumb)
    for i in range(0, len(code), step):
        if is_pro(i, arch):
            starts.setdefault(i, arch == "thumb")
    order = sorted(starts)
    return [(base + i, starts[i], (order[k + 1] if k + 1 < len(order) else len(code)) + base) for k, i in enumerate(order)]


@pytest.mark.parametrize("arch", ["arm", "thumb", "x86"])
def test_functions_of_random_bytes(arch):
    rng = random.Random(arch)
    words = [bytes.fromhex(p) for p in M.PROLOGUES[arch]] + [b"\x1e\xff\x2f\xe1", b"\x70\x47", b"\xc3", bytes(4), b"\x01\x02\x03\x04"]
    for trial in range(30):
        code = b"".join(rng.choice(words).ljust(4, b"\0") for _ in range(60)) + bytes(rng.randrange(4))
        seeds = [1000 + rng.randrange(-10, 250) for _ in range(6)]
        got = M.functions_of(code, 1000, arch, seeds)
        want = plain_functions(code, 1000, arch, seeds)
        assert [(s, t) for s, _, t, _, _ in got] == [(s, t) for s, t, _ in want]
        for (start, end, thumb, mode, crc), (_, _, limit) in zip(got, want, strict=True):
            assert start < end <= limit and mode == ("thumb" if thumb else arch)
            head = code[start - 1000 : start - 1000 + 32]
            c = zlib.crc32(head)
            assert crc == ((c ^ c >> 16) & 0xFFFF if len(head) >= 4 else None)


def test_seeds_move_to_a_prologue_nearby_and_lose_the_thumb_bit():
    push, ret = bytes.fromhex("00482de9"), bytes.fromhex("1eff2fe1")
    code = bytes(8) + push + bytes(4) + ret + bytes(12) + bytes.fromhex("80b5") + b"\x00\x00" + bytes.fromhex("7047") + bytes(30)
    got = {s: (e, t, m) for s, e, t, m, _ in M.functions_of(code, 0, "arm", [0, 33])}
    assert got == {8: (20, False, "arm"), 32: (38, True, "thumb")}
    assert M.functions_of(b"\x01\x02", 0, "arm", [0])[0][1:] == (2, False, "arm", None)
    assert M.functions_of(b"", 0, "arm", [0]) == []


def test_functions_are_found_and_named_in_one_call(spark):
    code = X.code_of(9) + X.code_of(10)
    image = elf.elf_image(code, 4096, [("first", 4096, 16)])
    crc = zlib.crc32(code[:32])
    library = spark.createDataFrame([(1, "lib_main", (crc ^ crc >> 16) & 0xFFFF, 1)], "seq long, name string, crc16 long, flags long")
    got = M.analyze_functions(spark.createDataFrame([("a.elf", bytearray(image)), ("none", bytearray(b""))], "path string, content binary"), library).orderBy("start").collect()
    assert [(int(r.start), int(r.end), r.name, r.is_library, r.confidence) for r in got] == [(4096, 4116, "lib_main", True, 0.95), (4128, 4140, "sub_1020", False, 0.0), (4160, 4180, "sub_1040", False, 0.0)]


def test_registered_analysis_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    part = X.table(spark, sf, "part").collect()
    groups = {}
    for r in sorted(part, key=lambda r: r.p_partkey):
        groups.setdefault(r.p_partkey // X.PER_IMAGE, []).append(r)
    sums = {}
    for r in part:
        if r.p_partkey % 9 == 0:
            c = zlib.crc32(X.code_of(r.p_partkey)[:32])
            k = (c ^ c >> 16) & 0xFFFF
            sums[k] = min(sums.get(k, (2, 0)), (0 if r.p_partkey % 2 else 1, r.p_partkey))
    want = []
    for k, own in groups.items():
        if k % 5 < 3:
            code, base = b"".join(X.code_of(r.p_partkey) for r in own), X.BASE + X.SPACING * X.PER_IMAGE * k
            for start, end, thumb, mode, crc in M.functions_of(code, base, "arm", [base, *(base + X.SPACING * j for j in range(len(own)))]):
                name = f"lib_{sums[crc][1]}" if crc in sums else f"sub_{start:x}"
                want.append((f"image_{k}.elf", start, end, name, thumb, mode))
    got = [(r.path, r.start, r.end, r.name, r.is_thumb, r.arch_mode) for r in R.analyze_functions(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(n.startswith("lib_") for _, _, _, n, _, _ in got)


def test_a_folder_of_libraries_of_both_kinds(spark):
    binary = b"FLIR" + bytes(12) + b"lib\0" + b"\x00\x02" + b"\x34\x12\x03\x01" + b"abc" + b"\x08\0\0\0" + b"\x35\x12\x01\x00" + b"d" + b"\x09\0\0\0"
    text = "﻿# head\n0x10 first 1\n\n20 second // note\n"
    rows = [("x/one.sig", bytearray(binary)), ("x/two.txt", bytearray(text.encode())), ("x/none", None), ("x/cut.sig", bytearray(b"FLIR"))]
    got = {(r.path, r.library, r.name, r.crc16, r.flags, r.offset) for r in G.load(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {("x/one.sig", "lib", "abc", 0x1234, 1, 8), ("x/one.sig", "lib", "d", 0x1235, 0, 9), ("x/two.txt", "two.txt", "first", 0x10, 1, None), ("x/two.txt", "two.txt", "second", 20, 0, None)}
