"""Function signatures: text and binary libraries, the checksum of a function's head, and matching."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.functions import text as X

# Fixed values of the formats.
MAGIC, HEAD_BYTES, PUBLIC, WEAK = b"FLIR", 32, 1, 2
# The built-in suites. The checksums of the first are given; those of the second are made from the names.
SUITES = {
    "cmsis": {
        "__aeabi_memcpy": 0xF1A3, "__aeabi_memmove": 0xB2C4, "__aeabi_memset": 0xD3E5, "memcpy": 0x1234, "memset": 0x5678, "memcmp": 0x9ABC, "strlen": 0xDEF0, "strcpy": 0x1357, "strcmp": 0x2468, "malloc": 0x369A, "free": 0x4B7C, "__libc_init_array": 0x5C8D,
        "_start": 0x6D9E, "Reset_Handler": 0x7EAF, "SystemInit": 0x8FC0, "NMI_Handler": 0xA0D1, "HardFault_Handler": 0xB1E2, "__assert_fail": 0xC2F3, "__gnu_thumb1_mcount": 0xD304, "_init": 0xE415, "_fini": 0xF526, "atexit": 0x0637, "exit": 0x1748,
    },
    "freertos": dict.fromkeys((
        "vTaskDelay", "vTaskDelete", "vTaskSuspend", "vTaskResume", "xTaskCreate", "xTaskCreateStatic", "xTaskDelayUntil", "xQueueCreate", "xQueueSend", "xQueueReceive", "vSemaphoreCreateBinary", "xSemaphoreTake", "xSemaphoreGive", "vTaskDelayUntil", "vTaskEnterCritical",
        "vTaskExitCritical", "portENABLE_INTERRUPTS", "portDISABLE_INTERRUPTS", "prvPortStartFirstTask", "pxPortInitialiseStack", "vPortYield", "vListInitialise", "vListInsertEnd", "vListRemove", "pvPortMalloc", "vPortFree", "xPortStartScheduler",
    )),
}


def fold(crc: Column) -> Column:
    """16 bits of a 32-bit checksum: its halves, exclusive-or."""
    return crc.bitwiseXOR(F.shiftrightunsigned(crc, 16)).bitwiseAND(0xFFFF)


def head_checksum(content: Column, offset: Column) -> Column:
    """Checksum of the HEAD_BYTES bytes at offset; null for fewer than 4."""
    head = F.substr(content, offset + F.lit(1), F.lit(HEAD_BYTES))
    return F.when(F.octet_length(head) >= 4, fold(F.crc32(head)))


def parse_text(lines: DataFrame) -> DataFrame:
    """lines (seq, line): `crc name [flags]`; hexadecimal with 0x, else decimal; # and // begin comments. -> (seq, name, crc16, flags)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), r"(?:#|//).*$", ""))
    own = lines.select("seq", F.split(clean, r"\s+").alias("p")).where(F.size("p") >= 2)

    def number(text: Column) -> Column:
        return F.when(text.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(text, 3, 8), 16, 10).cast("long")).when(text.rlike(r"^\d{1,10}$"), text.cast("long"))

    out = own.select("seq", F.col("p")[1].alias("name"), number(F.col("p")[0]).bitwiseAND(0xFFFF).alias("crc16"), F.coalesce(number(F.try_element_at("p", F.lit(3))), F.lit(0)).alias("flags"))
    return out.where("crc16 is not null")


def read_binary(data: bytes) -> list[tuple[str, str, int, int, int]]:
    """(library, name, crc16, flags, offset) of a binary library; what is cut off at the end is left out."""
    if len(data) < 16 or data[:4] != MAGIC:
        return []
    end = data.find(b"\0", 16)
    if end < 0:
        return []
    library, at, out = data[16:end].decode("utf-8", "replace"), end + 1, []
    while at + 2 <= len(data):
        n, at = data[at + 1], at + 2
        for _ in range(n):
            if at + 4 > len(data):
                return out
            crc, size, flags = struct.unpack_from("<HBB", data, at)
            at += 4
            if at + size + 4 > len(data):
                return out
            out.append((library, data[at : at + size].decode("utf-8", "replace"), crc, flags, struct.unpack_from("<I", data, at + size)[0]))
            at += size + 4
    return out


def parse_binary(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, seq, library, name, crc16, flags, offset)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(p, k, *r) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, r in enumerate(read_binary(c or b""))]
            names = ["path", "seq", "library", "name", "crc16", "flags", "offset"]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate(types)], names=names)

    return files.select("path", "content").mapInArrow(rows, "path string, seq long, library string, name string, crc16 int, flags int, offset long")


def load(files: DataFrame) -> DataFrame:
    """files (path, content) of either kind, told apart by their first bytes -> (path, library, seq, name, crc16, flags, offset).

    seq counts the signatures of a file in its order; text libraries are named by their file, and have no offsets.
    """
    kind = F.substring("content", 1, len(MAGIC)) == F.lit(MAGIC)
    own = files.select("path", "content").withColumn("is_binary", F.coalesce(kind, F.lit(False)))
    binary = parse_binary(own.where("is_binary")).select("path", "library", "seq", "name", F.col("crc16").cast("long"), F.col("flags").cast("long"), "offset")
    lines = own.where("not is_binary").select("path", F.posexplode(X.lines(F.make_valid_utf8(F.col("content").cast("string")))).alias("at", "line"))
    text = parse_text(lines.select(F.struct("path", "at").alias("seq"), "line"))
    text = text.select("seq.path", F.element_at(F.split("seq.path", "/"), -1).alias("library"), F.col("seq.at").cast("long").alias("seq"), "name", "crc16", "flags", F.lit(None).cast("long").alias("offset"))
    return binary.unionByName(text)


def builtin(spark: SparkSession, suite: str) -> DataFrame:
    if suite not in SUITES:
        raise ValueError(f"no such suite: {suite}")
    names = spark.createDataFrame([(k, *x) for k, x in enumerate(SUITES[suite].items())], "seq long, name string, given long")
    # The same fold as for heads of functions, so that both are numbers of one kind.
    return names.select("seq", "name", F.coalesce("given", fold(F.crc32(F.col("name").cast("binary")))).alias("crc16"), F.lit(PUBLIC).cast("long").alias("flags"))


def match(functions: DataFrame, signatures: DataFrame) -> DataFrame:
    """functions (fn, crc16) with the best signature of their checksum: public ones first, then the earliest.

    Signatures are brought down to the best of each checksum, at most 65,536 rows, before they meet the functions.
    """
    order = W.partitionBy("crc16").orderBy(F.desc(F.col("flags").bitwiseAND(PUBLIC)), "seq")
    best = signatures.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return functions.join(F.broadcast(best.select("crc16", F.col("name").alias("signature"), F.col("flags").bitwiseAND(PUBLIC).cast("boolean").alias("public"), (F.col("flags").bitwiseAND(WEAK) != 0).alias("weak"))), "crc16", "left")
