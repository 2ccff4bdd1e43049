"""Values of level-5 matrix files, as far as headers of recordings need them: numbers, texts, cells and structures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: number types, and the classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR = 1, 2, 3, 4


def _element(raw: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type, content and where the next element begins."""
    kind, size = struct.unpack_from(order + "II", raw, at)
    if kind >> 16:  # a small one: up to four bytes in the tag itself
        return kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, raw[at + 8 : end], end if kind == COMPRESSED else end + -size % 8


def _numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    return np.frombuffer(raw, order + NUMBERS[kind])


def _matrix(raw: bytes, order: str):
    """Name and value of an array: a text for characters, a list for cells, a dict for a structure (a list of them for an
    array of structures), else numbers in column order."""
    if not raw:
        return "", np.zeros(0)
    _, flags, at = _element(raw, 0, order)
    what = struct.unpack_from(order + "I", flags)[0] & 0xFF
    kind, dims, at = _element(raw, at, order)
    count = int(np.prod(_numbers(kind, dims, order).astype(np.int64)))
    _, name, at = _element(raw, at, order)
    if what == OBJECT:
        _, _, at = _element(raw, at, order)
    if what == CELL:
        out = []
        for _ in range(count):
            _, own, at = _element(raw, at, order)
            out.append(_matrix(own, order)[1])
        return name.decode("latin-1"), out
    if what in (STRUCT, OBJECT):
        kind, width, at = _element(raw, at, order)
        width = int(_numbers(kind, width, order)[0])
        _, names, at = _element(raw, at, order)
        fields = [names[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(names), width)] if width else []
        rows = []
        for _ in range(count):
            row = {}
            for f in fields:
                _, own, at = _element(raw, at, order)
                row[f] = _matrix(own, order)[1]
            rows.append(row)
        return name.decode("latin-1"), rows[0] if count == 1 else rows
    kind, data, at = _element(raw, at, order)
    if what == CHAR:
        return name.decode("latin-1"), data.decode({16: "utf-8", 17: "utf-16-le" if order == "<" else "utf-16-be", 4: "utf-16-le" if order == "<" else "utf-16-be"}.get(kind, "latin-1"))
    return name.decode("latin-1"), _numbers(kind, data, order)


def read(raw: bytes) -> dict:
    """The file's variables by name."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out, at = {}, 128
    while at + 8 <= len(raw):
        kind, content, at = _element(raw, at, order)
        if kind == COMPRESSED:
            kind, content, _ = _element(zlib.decompress(content), 0, order)
        if kind == MATRIX:
            name, value = _matrix(content, order)
            out[name] = value
    return out
