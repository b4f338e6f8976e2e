"""Small ELF images, for tables of images that are made from others."""

from __future__ import annotations

import struct


def elf_image(code: bytes, entry: int, symbols: list[tuple[str, int, int]], machine: int = 40) -> bytes:
    """A small 32-bit little-endian ELF image with a .text section and function symbols."""
    names, strings = b"\0.text\0.symtab\0.strtab\0.shstrtab\0", b"\0" + b"".join(n.encode() + b"\0" for n, _, _ in symbols)
    table, at = bytes(16), 1
    for n, a, s in symbols:
        table += struct.pack("<IIIBBH", at, a, s, 18, 0, 1)
        at += len(n) + 1
    parts, offsets, here = [code, table, strings, names], [], 52
    for p in parts:
        offsets.append(here)
        here += len(p)
    rows = [(0, 0, 0, 0, 0, 0), (1, 1, entry, offsets[0], len(code), 0), (7, 2, 0, offsets[1], len(table), 3), (15, 3, 0, offsets[2], len(strings), 0), (23, 3, 0, offsets[3], len(names), 0)]
    sections = b"".join(struct.pack("<10I", n, t, 0, a, o, s, k, 0, 0, 0) for n, t, a, o, s, k in rows)
    head = b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 2, machine, 1, entry, 0, here, 0, 52, 0, 0, 40, 5, 4)
    return head + b"".join(parts) + sections
