import random
import zlib

import pytest
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.operators import addresses as A
from boardlens.operators import cfg as C
from boardlens.operators import images as M
from boardlens.operators import logset as S
from boardlens.operators import signatures as G
from boardlens.sources.elf import elf_image

SYM = "image string, seq long, name string, start decimal(20,0), size long"


def test_as_of_equals_brute_force(spark):
    rng = random.Random(5)
    symbols = [("i", k, f"s{k}", rng.randrange(0, 60000), rng.choice([0, 4, 300, 9000])) for k in range(80)]
    addresses = sorted({rng.randrange(0, 70000) for _ in range(300)})
    rows = spark.createDataFrame([("i", a) for a in addresses], "image string, address long").withColumn("address", F.col("address").cast("decimal(20,0)"))
    table = spark.createDataFrame(symbols, "image string, seq long, name string, start long, size long").withColumn("start", F.col("start").cast("decimal(20,0)"))
    got = {int(r.address): (r.function, r.offset) for r in A.resolve_functions(rows, table).collect()}
    own = sorted((s, seq, n, z) for _, seq, n, s, z in symbols if z > 0)
    for a in addresses:
        before = [x for x in own if x[0] <= a]
        s, _, n, z = before[-1] if before else (0, 0, "", 0)
        assert got[a] == ((n, a - s) if before and a < s + z else ("???", 0))


def test_kernel_addresses_fit(spark):
    rows = spark.createDataFrame([("f", 1, "RIP: 0010:[<0xffffffffc0123456>] x, at 0xffffffffc0123456"), ("f", 2, "pc: 0x10 lr=0x20")], "file string, line_number int, raw string")
    got = {int(r.address): r.line_number for r in A.crash_addresses(rows).collect()}
    assert got == {0xFFFFFFFFC0123456: 1, 0x10: 2, 0x20: 2}
    lit = spark.createDataFrame([("0x1F",), ("31",), ("0b101",), ("zz",)], "t string").select(X.address_literal(F.col("t")).alias("a")).collect()
    assert [None if r.a is None else int(r.a) for r in lit] == [31, 31, 5, None]


def code(spark, rows):
    return spark.createDataFrame([(1, a, m, o, 4) for a, m, o in rows], "fn long, address long, mnemonic string, op_str string, byte_len int")


@pytest.mark.parametrize(
    ("arch", "rows", "blocks", "kinds"),
    [
        ("arm", [(0, "mov", "r0, r1"), (4, "add", "r0, r0, 1"), (8, "bx", "lr")], 1, ["return"]),
        ("arm", [(0, "cmp", "r0, 0"), (4, "beq", "0xc"), (8, "mov", "r0, 1"), (12, "bx", "lr")], 3, ["conditional_false", "conditional_true", "fallthrough", "return"]),
        ("arm", [(0, "bl", "0x100"), (4, "pop", "{pc}")], 2, ["call", "fallthrough", "return"]),
        ("x86", [(0, "jmp", "eax"), (4, "ret", "")], 2, ["indirect_jump", "return"]),
        ("arm64", [(0, "cbz", "0x8"), (4, "nop", ""), (8, "ret", "")], 3, ["conditional_false", "conditional_true", "fallthrough", "return"]),
    ],
)
def test_cfg(spark, arch, rows, blocks, kinds):
    df = code(spark, rows)
    assert C.blocks(df, arch).count() == blocks
    assert sorted(r.edge_type for r in C.edges(df, arch).collect()) == kinds
    s = C.statistics(df, arch).first()
    assert (s.instructions, s.blocks, s.edges, s.entry_block) == (len(rows), blocks, len(kinds), 0)


def test_every_instruction_is_in_one_block(spark):
    rng = random.Random(2)
    rows = [(4 * k, rng.choice(["mov", "beq", "bl", "b", "pop"]), rng.choice(["0x10", "{pc}", "0x40", "r1"])) for k in range(60)]
    assert C.blocks(code(spark, rows)).agg(F.sum("n")).first()[0] == 60
    assert C.predecessors(C.edges(code(spark, rows))).where("size(preds) = 0").count() == 0


def test_call_closure(spark):
    rows = [(1, 0, "bl", "0x10"), (2, 16, "bl", "0x20"), (2, 20, "bl", "0x0"), (3, 32, "bx", "lr"), (4, 48, "bx", "lr")]
    df = spark.createDataFrame(rows, "fn long, address long, mnemonic string, op_str string")
    got = C.call_closure(df, spark.createDataFrame([(0,)], "address long"))
    assert sorted(r.address for r in got.collect()) == [0, 16, 32]


def test_log_sets(spark):
    rows = [("a", 1, "kernel panic PC=0x08001234 LR=0x08005678"), ("a", 2, "timeout on retry"), ("a", 3, "invalid state"), ("a", 4, "all fine here"), ("b", 1, "ok")]
    got = {r.set_id: r for r in S.parse_sets(spark.createDataFrame(rows, "set_id string, n int, line string")).collect()}
    a, b = got["a"], got["b"]
    assert (a.error_count, a.warning_count, a.severity, a.error_type) == (3, 2, "CRITICAL", "panic")
    assert a.crash_locations == ["PC=0x08001234", "LR=0x08005678"] and [int(x) for x in a.crash_addresses] == [0x08001234, 0x08005678]
    assert b.summary == "[INFO] unknown (1 lines)" and b.severity == "INFO"
    sets = S.parse_sets(spark.createDataFrame(rows, "set_id string, n int, line string"))
    q = {r.set_id: r.q for r in sets.select("set_id", S.retrieval_query(sets).alias("q")).collect()}
    assert q["a"].startswith("panic unknown 0x08001234 0x08005678 PC=0x08001234")


def some_images(spark):
    code = bytes.fromhex("00482de9") + bytes(8) + bytes.fromhex("0088bde8") + bytes.fromhex("00482de9") + bytes(4)
    rows = [("a.elf", bytearray(elf_image(code, 0x08000100, [("main", 0x08000100, 16), ("helper", 0x08000110, 8)]))), ("b.elf", bytearray(b"\x7fELF\x01\x01")), ("c.bin", bytearray(b""))]
    return M.parse_images(spark.createDataFrame(rows, "path string, content binary"))


def test_images(spark):
    got = M.symbols(some_images(spark)).orderBy("start").collect()
    assert [(r.name, int(r.start), r.size) for r in got] == [("main", 0x08000100, 16), ("helper", 0x08000110, 8)]
    assert M.prologues(some_images(spark)).count() == 2
    ends = [(r.offset, r.end, r.source) for r in M.detect_functions(some_images(spark)).orderBy("offset").collect()]
    assert ends == [(0, 16, "symbol"), (16, 24, "symbol")]
    raw = M.parse_images(spark.createDataFrame([("r", bytearray(16))], "path string, content binary"), arch="thumb", base=64).first()
    assert raw.error is None and int(raw.base) == 64 and raw.bits == 32


def test_signatures(spark):
    lines = spark.createDataFrame([(0, "﻿# comment"), (1, "0x1F0A1 first 1"), (2, "10 second // note"), (3, "bad"), (4, "0xF0A1 third 1")], "seq long, line string")
    sigs = G.parse_text(lines)
    assert [(r.name, r.crc16, r.flags) for r in sigs.orderBy("seq").collect()] == [("first", 0xF0A1, 1), ("second", 10, 0), ("third", 0xF0A1, 1)]
    got = G.match(spark.createDataFrame([(1, 0xF0A1), (2, 5)], "fn long, crc16 long"), sigs)
    assert {r.fn: r.signature for r in got.collect()} == {1: "first", 2: None}
    binary = b"FLIR" + bytes(12) + b"lib\0" + b"\x00\x01" + b"\x34\x12\x03\x01" + b"abc" + b"\x08\0\0\0" + b"\x00\x05"
    r = G.parse_binary(spark.createDataFrame([("p", bytearray(binary))], "path string, content binary")).collect()
    assert [(x.library, x.name, x.crc16, x.flags, x.offset) for x in r] == [("lib", "abc", 0x1234, 1, 8)]
    own = {r.name: r.crc16 for r in G.builtin(spark, "freertos").collect()}
    crc = zlib.crc32(b"xTaskCreate")
    assert len(own) == 27 and own["xTaskCreate"] == (crc ^ crc >> 16) & 0xFFFF
    assert {r.name: r.crc16 for r in G.builtin(spark, "cmsis").collect()}["atexit"] == 0x0637
    with pytest.raises(ValueError, match="suite"):
        G.builtin(spark, "none")


def test_addresses_behind_prefixes(spark):
    rows = [("RIP: 0010:do_fault+0x12 end", {"12"}), ("xLR=0x80 vPC:[<0x90>]", {"80", "90"}), ("great at 0x11 from  0x12", {"11", "12"}), ("RIP: 0xff00", {"ff00"})]
    got = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(rows)], "k long, raw string")
    found = got.select("k", A.line_addresses(F.col("raw")).alias("a")).orderBy("k").collect()
    assert [{x.hex for x in r.a} for r in found] == [want for _, want in rows]


def test_neighbours_over_edges_of_functions_and_buckets(spark):
    at = [0, 4, 65532, 65536, 65540, 200000, 400000, 400004]
    rows = [("i", k // 3, a, f"m{k}", "", 4) for k, a in enumerate(at)]
    got = A.with_nearby(spark.createDataFrame(rows, "image string, fn long, address long, mnemonic string, op_str string, byte_len int"))
    assert {r.address: [n.mnemonic for n in r.nearby] for r in got.collect()} == {a: [f"m{j}" for j in range(max(0, k - 2), min(len(at), k + 3))] for k, a in enumerate(at)}
