"""Reading protocol-buffer wire format: fields of a message, packed numbers, zigzag."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) in order; fixed 32 bits come as float, fixed 64 bits and lengths as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def signed32(value: int) -> int:
    """An int32 that was written as a 64-bit varint."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")
