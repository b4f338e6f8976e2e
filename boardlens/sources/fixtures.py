"""Board data derived from the test tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.sources.batches import mapped_rows
from boardlens.sources.elf import elf_image

BASE = 134217728


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Errors of the derived logs by event_id % 9; {a} is an address. Each has a pattern of crash addresses of its own.
ERRORS = (
    "kernel panic at {a}",
    "segfault, PC is at {a}",
    "BUG found, LR = {a}",
    "kernel oops, RIP: {a}",
    "system panic, pc: [<{a}>] in probe",
    "signal 11 <{a}> from {a}",
    "access violation [<{a}>]",
    "fatal exception, RIP: 0010:{a} lr:{a}",
    "Oops #1 at address {a}",
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, file, device, line_number, raw) from events: one file for each board and day.

    Some lines are indented stack or register lines, and some have a tab before their stamp and behind their end.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    n = F.floor("value").cast("string")
    address = F.format_string("0x%08x", F.lit(BASE) + 4 * F.col("event_id"))
    k = F.col("event_id")
    error = F.replace(F.element_at(F.array(*map(F.lit, ERRORS)), (k % 9 + 1).cast("int")), F.lit("{a}"), address)
    body = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("INFO voltage="), n, F.lit(" mv")))
        .when(F.col("event_type") == "click", F.concat(F.lit("INFO current="), n, F.lit(" ma")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("TRACE temp="), n, F.lit(" c")))
        .when(F.col("event_type") == "signup", F.lit("WARNING watchdog timeout, retry"))
        .otherwise(error)
    )
    stamped = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), body)
    raw = (
        F.when(k % 11 == 5, F.concat(F.lit("\thandler_"), k.cast("string"), F.lit(" called from core")))
        .when(k % 11 == 6, F.concat(F.lit("\t[<"), F.substring(address, 3, 8), F.lit(">] probe\t")))
        .when(k % 11 == 7, F.concat(F.lit("\t r"), (k % 13).cast("string"), F.lit(": "), address))
        .when(k % 11 == 9, F.concat(F.lit("\t"), stamped, F.lit("\t")))
        .otherwise(stamped)
    )
    device = F.concat(F.lit("board"), F.lpad((F.col("user_id") % 8).cast("string"), 2, "0"))
    out = e.select("event_id", "ts", device.alias("device"), raw.alias("raw"))
    out = out.withColumn("file", F.concat("device", F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".log")))
    return out.withColumn("line_number", F.expr("cast(row_number() over (partition by file order by ts, event_id) as bigint)"))


_ERRORS = "[" + ", ".join(f"'{e}'" for e in ERRORS) + "]"
LOG_LINES = rf"""
log_line AS (SELECT event_id, ts, file, device, raw, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) AS line_number FROM (
SELECT event_id, ts, device, device || '_' || strftime(ts, '%Y%m%d') || '.log' AS file, CASE event_id % 11 WHEN 5 THEN chr(9) || 'handler_' || CAST(event_id AS VARCHAR) || ' called from core'
WHEN 6 THEN chr(9) || '[<' || substr(adr, 3, 8) || '>] probe' || chr(9) WHEN 7 THEN chr(9) || ' r' || CAST(event_id % 13 AS VARCHAR) || ': ' || adr WHEN 9 THEN chr(9) || stamped || chr(9) ELSE stamped END AS raw FROM (
SELECT event_id, ts, device, adr, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || body AS stamped FROM (
SELECT event_id, ts, 'board' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0') AS device, printf('0x%08x', {BASE} + 4 * event_id) AS adr,
CASE event_type WHEN 'view' THEN 'INFO voltage=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' mv'
WHEN 'click' THEN 'INFO current=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' ma'
WHEN 'purchase' THEN 'TRACE temp=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' c'
WHEN 'signup' THEN 'WARNING watchdog timeout, retry'
ELSE replace(({_ERRORS})[event_id % 9 + 1], '{{a}}', printf('0x%08x', {BASE} + 4 * event_id)) END AS body
FROM events))))"""


#: Words that derived code names its functions by, by doc_id % 7.
NAMES = ("panic_handler", "reset_board", "watchdog", "error_log", "fix_bus", "voltage", "segfault")
#: Code around a document's text {t} for doc_id % 13, with the function's name {n} and the id {i}; the last kind is the text alone.
CODE = (
    ("c", "static int {n}_{i}(int id)\n{\n{t}\n}\n\nvoid main_{i}(void)\n{\n    {n}_{i}(1); /* error: crash */\n}\n"),
    ("py", "def {n}_{i}(x):\n    return x\n\n{t}\n\nasync def other_{i}(y):\n    return {n}_{i}(y) + 1  # fix\n"),
    ("go", "package main\n\nfunc {n}{i}(a int) int {\n{t}\n}\n"),
    ("rs", "pub fn {n}_{i}(x: i32) -> i32 {\n    x + 1\n}\n\nunsafe fn raw_{i}() {\n{t}\n}\n"),
) * 3 + (("md", "{t}"),)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content) of a code tree made from documents."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")

    def pick(values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))

    content = F.replace(F.replace(F.replace(pick([c for _, c in CODE]), F.lit("{n}"), pick(NAMES)), F.lit("{i}"), i), F.lit("{t}"), F.coalesce("text", F.lit("")))
    return d.select(F.concat(F.col("source"), F.lit("/"), i, F.lit("."), pick([e for e, _ in CODE])).alias("file_path"), content.alias("content"))


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CODE_FILES = f"""
code_file AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.' || ({_sql(e for e, _ in CODE)})[doc_id % {len(CODE)} + 1] AS file_path, ({_sql(e for e, _ in CODE)})[doc_id % {len(CODE)} + 1] AS ext,
replace(replace(replace(({_sql(c for _, c in CODE)})[doc_id % {len(CODE)} + 1], '{{n}}', ({_sql(NAMES)})[doc_id % {len(NAMES)} + 1]), '{{i}}', CAST(doc_id AS VARCHAR)), '{{t}}', coalesce(text, '')) AS content FROM documents)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, name, start, size) from part; sizes leave gaps, so some addresses miss."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.concat_ws("_", "p_name", "p_partkey").alias("name"), (F.lit(BASE) + 64 * F.col("p_partkey")).cast("long").alias("start"), F.col("p_size").cast("long").alias("size"))


SYMBOLS = f"symbol AS (SELECT p_partkey AS seq, p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, {BASE} + 64 * p_partkey AS start, CAST(p_size AS BIGINT) AS size FROM part)"

_MNEMONICS = ("mov", "cmp", "beq", "bl", "b", "nop", "pop")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn, address, mnemonic, op_str, byte_len) from orders: sixteen order keys are one function."""
    k = F.col("o_orderkey")
    target = F.format_string("0x%08x", (F.lit(BASE) + 4 * (k.bitwiseAND(-16) + (k * 7) % 16)).cast("long"))
    m = F.element_at(F.array(*map(F.lit, _MNEMONICS)), (k % 7 + 1).cast("int"))
    op = F.when(m.isin("beq", "bl", "b"), target).when(m == "pop", F.lit("{pc}")).when(m == "nop", "").otherwise("r0, r1")
    return table(spark, sf_dir, "orders").select(F.floor(k / 16).cast("long").alias("fn"), (F.lit(BASE) + 4 * k).cast("long").alias("address"), m.alias("mnemonic"), op.alias("op_str"), F.lit(4).alias("byte_len"))


INSTRUCTIONS = f"""
instruction AS (SELECT CAST(o_orderkey // 16 AS BIGINT) AS fn, {BASE} + 4 * o_orderkey AS address, m AS mnemonic,
CASE WHEN m IN ('beq', 'bl', 'b') THEN printf('0x%08x', {BASE} + 4 * (o_orderkey - o_orderkey % 16 + (o_orderkey * 7) % 16)) WHEN m = 'pop' THEN '{{pc}}' WHEN m = 'nop' THEN '' ELSE 'r0, r1' END AS op_str, 4 AS byte_len
FROM (SELECT o_orderkey, (['mov', 'cmp', 'beq', 'bl', 'b', 'nop', 'pop'])[o_orderkey % 7 + 1] AS m FROM orders))"""

#: A program whose functions call each other: of each 11 orders two call, one by # and with the Thumb bit, and one returns.
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, mnemonic, op_str) from orders."""
    k = F.col("o_orderkey")
    to = (F.lit(BASE) + 4 * ((k * 37 + 11) % 600)).cast("long")
    m = F.when(k % 11 == 3, "bl").when(k % 11 == 6, "blx").when(k % 11 == 9, "bx").otherwise("mov")
    op = F.when(m == "bl", F.format_string("0x%08x", to)).when(m == "blx", F.format_string("#0x%x", to + 1)).when(m == "bx", "lr").otherwise("r0, r1")
    return table(spark, sf_dir, "orders").select((F.lit(BASE) + 4 * k).cast("long").alias("address"), m.alias("mnemonic"), op.alias("op_str"))


#: Functions of a derived image, each SPACING bytes after the one before; the middle of every third holds a function without a symbol.
SPACING, PER_IMAGE = 64, 256


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): 32-bit ARM images with a .text section and function symbols from part, PER_IMAGE part keys an image.

    Of five images one is raw code without a header, and one is cut off within its header.
    """
    p = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / PER_IMAGE)).cast("long").alias("k"), F.col("p_partkey").alias("id"), F.concat_ws("_", "p_name", "p_partkey").alias("name"), F.col("p_size").alias("size"))
    parts = p.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("id", "name", "size"))).alias("parts"))

    def rows(k, own):
        code = b"".join(code_of(r["id"]) for r in own)
        base = BASE + SPACING * PER_IMAGE * k
        elf = elf_image(code, base, [(r["name"], base + SPACING * j, r["size"]) for j, r in enumerate(own)])
        return [(f"image_{k}." + ("bin" if k % 5 == 3 else "elf"), code if k % 5 == 3 else elf[:40] if k % 5 == 4 else elf)]

    return mapped_rows(parts, rows, {"path": pa.string(), "content": pa.binary()}, "path string, content binary", 1)


def code_of(key: int) -> bytes:
    """SPACING bytes of code: a prologue, three words from the key, an epilogue, and nops; in every third, another function in the middle."""
    own = bytes.fromhex("00482de9") + b"".join((key * m & 0xFFFFFF).to_bytes(4, "little") for m in (7, 11, 13)) + bytes.fromhex("0088bde8")
    half = bytes.fromhex("ff4f2de9") + (key & 0xFFFF).to_bytes(4, "little") + bytes.fromhex("1eff2fe1") if key % 3 == 0 else b""
    return (own.ljust(SPACING // 2, b"\0") + half).ljust(SPACING, b"\0")
