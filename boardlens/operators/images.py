"""Binary images: ELF headers, sections and symbols, raw images, prologues, and ends of functions."""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.operators import signatures
from boardlens.operators.signatures import HEAD_BYTES
from boardlens.sources.batches import mapped_rows

# Machine numbers, and the byte patterns that begin functions (as they lie in little-endian memory).
MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "arm64", 243: "riscv"}
BITS = {"arm": 32, "thumb": 32, "riscv": 32, "x86": 32, "arm64": 64, "x86_64": 64}
PROLOGUES = {
    "arm": ("00482de9", "ff4f2de9", "004b2de9"),
    "thumb": ("80b5", "f0b5"),
    "arm64": ("fd7bbfa9",),
    "x86": ("5589e5", "558bec"),
    "x86_64": ("554889e5",),
    "riscv": ("4111", "0111"),
}
_IMAGE = "path string, arch string, bits int, endian string, entry decimal(20,0), base decimal(20,0), code binary, error string, symbols array<struct<seq: long, name: string, start: decimal(20,0), size: long>>"
LEAST_CODE_BYTES, SYMBOL_TABLE, FUNCTION = 4, 2, 2
_U64 = pa.decimal128(20, 0)


def read_elf(data: bytes) -> dict:
    """arch, bits, endian, entry, base, code and function symbols of an ELF image; error tells what was wrong."""
    out = {"arch": "unknown", "bits": None, "endian": None, "entry": None, "base": None, "code": b"", "error": None, "symbols": []}
    try:
        wide, big = data[4] == 2, data[5] == 2
        e = ">" if big else "<"
        out |= {"bits": 64 if wide else 32, "endian": "big" if big else "little"}
        # What a cut header still holds is kept, field by field.
        out["arch"] = MACHINES.get(struct.unpack_from(e + "H", data, 18)[0], "unknown")
        word = "Q" if wide else "I"
        out["entry"] = struct.unpack_from(e + word, data, 24)[0]
        table = struct.unpack_from(e + word, data, 40 if wide else 32)[0]
        step, n, names_at = struct.unpack_from(e + "3H", data, 58 if wide else 46)
        sections = []
        for k in range(n):
            at = table + k * step
            name, kind = struct.unpack_from(e + "2I", data, at)
            address, offset, size = struct.unpack_from(e + 3 * word, data, at + (16 if wide else 12))
            link = struct.unpack_from(e + "I", data, at + (40 if wide else 24))[0]
            sections.append((name, kind, address, offset, size, link))

        def text(at: int) -> str:
            return data[at : data.index(b"\0", at)].decode("utf-8", "replace")

        names = sections[names_at][3]
        for name, _, address, offset, size, _ in sections:
            if text(names + name) == ".text":
                out |= {"base": address, "code": data[offset : offset + size]}
                break
        for _, kind, _, offset, size, link in sections:
            if kind != SYMBOL_TABLE:
                continue
            for k in range(size // (24 if wide else 16)):
                if wide:
                    name, info, _, _, value, length = struct.unpack_from(e + "IBBHQQ", data, offset + 24 * k)
                else:
                    name, value, length, info, _, _ = struct.unpack_from(e + "IIIBBH", data, offset + 16 * k)
                label = text(sections[link][3] + name)
                if info & 15 == FUNCTION and label and value:
                    out["symbols"].append({"seq": k, "name": label, "start": value, "size": min(length, 2**63 - 1)})
            break
    except (struct.error, IndexError, ValueError) as x:
        out["error"] = f"{type(x).__name__}: {x}"
    return out


def parse_images(files: DataFrame, arch: str = "auto", base: int = 0) -> DataFrame:
    """files (path, content) -> one row an image. Images that are not ELF need an arch; empty ones and unknown archs are errors."""
    symbol = pa.list_(pa.struct([("seq", pa.int64()), ("name", pa.string()), ("start", _U64), ("size", pa.int64())]))
    types = {"path": pa.string(), "arch": pa.string(), "bits": pa.int32(), "endian": pa.string(), "entry": _U64, "base": _U64, "code": pa.binary(), "error": pa.string(), "symbols": symbol}

    def rows(path: str, data: bytes | None) -> list[tuple]:
        data = data or b""
        if data[:4] == b"\x7fELF":
            one = read_elf(data)
        else:
            error = "empty image" if not data else "not ELF: name the arch" if arch == "auto" else None if arch in BITS else f"unknown arch {arch}"
            one = {"arch": arch if not error else "unknown", "bits": BITS.get(arch), "endian": "little", "entry": base, "base": base, "code": data, "error": error, "symbols": []}
        one |= {k: None if one[k] is None else Decimal(one[k]) for k in ("entry", "base")}
        one |= {"path": path, "symbols": [s | {"start": Decimal(s["start"])} for s in one["symbols"]]}
        return [tuple(one[k] for k in types)]

    return mapped_rows(files.select("path", "content"), rows, types, _IMAGE, 1)


def metadata(images: DataFrame) -> DataFrame:
    """(path, file_id, arch, bits, endian, entry, base, code_size, n_symbols, error); the id comes from the code."""
    return images.select("path", F.substring(F.sha2("code", 256), 1, 8).alias("file_id"), "arch", "bits", "endian", "entry", "base", F.octet_length("code").alias("code_size"), F.size("symbols").alias("n_symbols"), "error")


def symbols(images: DataFrame) -> DataFrame:
    return images.select(F.col("path").alias("image"), F.inline("symbols"))


#: Steps of instructions in bytes; how far a seed may lie before its prologue; instructions that a function has at most; confidence of a match.
STEPS = {"arm": 4, "arm64": 4, "thumb": 2, "riscv": 2}
NEAR_BYTES, MOST_STEPS, SURE = 16, 500, 0.95


def find_prologues(code: bytes, arch: str) -> list[tuple[int, str]]:
    """(offset, pattern) of all prologues of an arch, at its instruction step."""
    step, out = STEPS.get(arch, 1), []
    for pattern in PROLOGUES.get(arch, ()):
        raw = bytes.fromhex(pattern)
        at = code.find(raw)
        while at >= 0:
            if at % step == 0:
                out.append((at, pattern))
            at = code.find(raw, at + 1)
    return out


def refined(code: bytes, offset: int, arch: str) -> int:
    """The first prologue within NEAR_BYTES bytes from a seed on, at its instruction step; the seed itself if there is none."""
    step, near = STEPS.get(arch, 1), code[offset : offset + NEAR_BYTES]
    hits = [near.find(bytes.fromhex(p), k) for p in PROLOGUES.get(arch, ()) for k in range(0, len(near), step)]
    return offset + min((h for h in hits if h >= 0 and h % step == 0), default=0)


def epilogue_end(code: bytes, offset: int, arch: str) -> int | None:
    """Where the first epilogue from offset on ends, within MOST_STEPS instruction steps; None if there is none."""
    step, stop = STEPS.get(arch, 1), min(len(code), offset + MOST_STEPS * STEPS.get(arch, 4))
    for at in range(offset, stop - step + 1, step):
        own = code[at : at + 4]
        if arch == "arm" and (own == b"\x1e\xff\x2f\xe1" or own[2:] == b"\xbd\xe8" and own[1] & 0x80):
            return at + 4
        if arch == "arm64" and own == b"\xc0\x03\x5f\xd6":
            return at + 4
        if arch == "thumb" and (own[:2] == b"\x70\x47" or own[1] == 0xBD) or arch == "riscv" and own[:2] == b"\x82\x80":
            return at + 2
        if arch in ("x86", "x86_64") and own[0] in (0xC3, 0xCB):
            return at + 1
    return None


def functions_of(code: bytes, base: int, arch: str, seeds: list[int]) -> list[tuple[int, int, bool, str, int | None]]:
    """(start, end, is_thumb, mode, checksum of the head) of an image's functions, by start.

    Seeds are addresses (the lowest bit tells Thumb code, and is cleared) that are moved to a prologue nearby; prologues anywhere are
    functions too. A function ends behind its first epilogue, but before the next function and with the code at the latest; where
    fewer than 4 bytes are left, with the code. The checksum is that of signatures: crc32 of at most 32 bytes, its halves folded.
    """
    starts: dict[int, bool] = {}
    for seed in seeds:
        at = (seed & ~1) - base
        if 0 <= at < len(code):
            thumb = arch == "thumb" or arch == "arm" and bool(seed & 1)
            starts.setdefault(refined(code, at, "thumb" if thumb else arch), thumb)
    for at, _ in find_prologues(code, arch):
        starts.setdefault(at, arch == "thumb")
    order, out = sorted(starts), []
    for k, at in enumerate(order):
        thumb = starts[at]
        mode = "thumb" if thumb else arch
        following = order[k + 1] if k + 1 < len(order) else len(code)
        end = epilogue_end(code, at, mode)
        if len(code) - at < 4:
            end = len(code)
        head = code[at : at + HEAD_BYTES]
        crc = zlib.crc32(head)
        out.append((base + at, base + min(following, end if end is not None else following), thumb, mode, (crc ^ crc >> 16) & 0xFFFF if len(head) >= 4 else None))
    return out


def prologues(images: DataFrame) -> DataFrame:
    """(path, offset, pattern): where a function of the image's arch begins, at its instruction step."""

    def rows(path: str, arch: str, code: bytes | None) -> list[tuple]:
        return [(path, *hit) for hit in find_prologues(code or b"", arch)]

    types = {"path": pa.string(), "offset": pa.int64(), "pattern": pa.string()}
    return mapped_rows(images.select("path", "arch", "code"), rows, types, "path string, offset long, pattern string")


def functions(images: DataFrame) -> DataFrame:
    """(path, start, end, is_thumb, arch_mode, crc16) of images without an error, found, ended and summed in one pass over their bytes; seeds are the entry and the symbols."""
    def rows(path: str, arch: str, code: bytes | None, base: Decimal | None, entry: Decimal | None, symbols: list | None) -> list[tuple]:
        seeds = ([int(entry)] if entry is not None else []) + [int(s["start"]) for s in symbols or []]
        return [(path, Decimal(start), Decimal(end), *rest) for start, end, *rest in functions_of(code or b"", int(base or 0), arch, seeds)]

    types = {"path": pa.string(), "start": _U64, "end": _U64, "is_thumb": pa.bool_(), "arch_mode": pa.string(), "crc16": pa.int64()}
    own = images.where("error is null").select("path", "arch", "code", "base", "entry", "symbols")
    return mapped_rows(own, rows, types, "path string, start decimal(20,0), end decimal(20,0), is_thumb boolean, arch_mode string, crc16 long")


def analyze_functions(files: DataFrame, library: DataFrame | None = None, arch: str = "auto", base: int = 0) -> DataFrame:
    """files (path, content) -> (path, start, end, size, name, is_library, is_thumb, arch_mode, signature, confidence): from bytes to named functions.

    library: signatures (seq, name, crc16, flags). A function whose checksum has one takes the name of the best and is sure to SURE;
    others are sub_<start in hexadecimal>.
    """
    found = functions(parse_images(files, arch, base))
    named = signatures.match(found, library) if library is not None else found.withColumn("signature", F.lit(None).cast("string"))
    address = F.lower(F.hex(F.col("start").cast("long")))
    known = F.col("signature").isNotNull()
    return named.select("path", "start", "end", (F.col("end") - F.col("start")).cast("long").alias("size"), F.coalesce("signature", F.concat(F.lit("sub_"), address)).alias("name"), known.alias("is_library"), "is_thumb", "arch_mode", "signature", F.when(known, SURE).otherwise(0.0).alias("confidence"))


def detect_functions(images: DataFrame) -> DataFrame:
    """(path, offset, end, source): functions by symbols, entry and prologues; each ends before the next, the last with the code."""
    own = images.where("error is null")
    by_symbol = own.select("path", F.explode("symbols").alias("s"), "base").select("path", (F.col("s.start") - F.col("base")).cast("long").alias("offset"), F.lit("symbol").alias("source"))
    entry = own.select("path", (F.col("entry") - F.col("base")).cast("long").alias("offset"), F.lit("entry").alias("source"))
    found = by_symbol.unionByName(entry).unionByName(prologues(own).select("path", "offset", F.lit("prologue").alias("source")))
    found = found.join(own.select("path", F.octet_length("code").cast("long").alias("size")), "path").where("offset >= 0 and offset < size")
    one = found.groupBy("path", "offset", "size").agg(F.min_by("source", F.when(F.col("source") == "symbol", 0).when(F.col("source") == "entry", 1).otherwise(2)).alias("source"))
    end = F.coalesce(F.lead("offset").over(W.partitionBy("path").orderBy("offset")), F.col("size"))
    return one.select("path", "offset", end.alias("end"), "source")


def is_epilogue(mnemonic: Column, op: Column, arch: str) -> Column:
    m, o = F.lower(mnemonic), F.lower(op)
    if arch in ("arm", "thumb"):
        return (m == "bx") & o.rlike("lr|pc") | (m == "pop") & o.contains("pc") | m.isin("ret", "retn")
    if arch in ("x86", "x86_64"):
        return m.isin("ret", "retn", "retf")
    if arch == "riscv":
        return (m == "jalr") & o.contains("ra") | m.isin("ecall", "ret")
    return m == "ret"


def function_ends(instructions: DataFrame, arch: str = "arm", most: int = 500) -> DataFrame:
    """(fn, start, end): the first epilogue among a function's first `most` instructions, else the last of those."""
    rank = F.row_number().over(W.partitionBy("fn").orderBy("address"))
    own = instructions.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("stops", is_epilogue(F.col("mnemonic"), F.col("op_str"), arch))
    return own.groupBy("fn").agg(F.min("address").alias("start"), F.coalesce(F.expr("min(address) filter (where stops)"), F.max("address")).alias("end"))
