"""CRC-32/BZIP2: polynomial 0x04C11DB7, most significant bit first, start and final XOR of all ones."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x04C11DB7
MASK = 0xFFFFFFFF


@lru_cache(maxsize=1)
def table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        x = byte << 24
        for _ in range(8):
            x = (x << 1 ^ (POLYNOMIAL if x & 0x80000000 else 0)) & MASK
        out.append(x)
    return tuple(out)


def block_crc(data: bytes) -> int:
    """By zlib's CRC of the same polynomial: mirror the bits of each byte, and of the result."""
    import zlib

    mirrored = zlib.crc32(data.translate(_MIRROR))
    return int(f"{mirrored:032b}"[::-1], 2)


_MIRROR = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8).tobytes()


def combine(stream: int, block: int) -> int:
    """The stream's checksum after one more block."""
    return ((stream << 1 | stream >> 31) & MASK) ^ block


def crc_column(data: Column) -> Column:
    """The checksum of a binary column, as a long, by built-in functions only."""
    steps = F.array(*[F.lit(x).cast("long") for x in table()])
    digits = F.hex(data)
    each = F.transform(
        F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
    )
    each = F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(each)

    def step(state: Column, byte: Column) -> Column:
        at = F.shiftright(state, 24).bitwiseXOR(byte.cast("long"))
        return F.shiftleft(state, 8).bitwiseAND(F.lit(MASK)).bitwiseXOR(F.element_at(steps, (at + 1).cast("int")))

    return F.aggregate(each, F.lit(MASK).cast("long"), step).bitwiseXOR(F.lit(MASK))


def rotated(crc: Column, by: Column) -> Column:
    """A 32-bit rotation to the left, on longs."""
    by = by % 32
    high = F.call_function("shiftleft", crc, by.cast("int")).bitwiseAND(F.lit(MASK))
    return high.bitwiseOR(F.call_function("shiftright", crc, (32 - by).cast("int")))


def stream_crc(crc: Column, blocks_after: Column) -> Column:
    """The stream's checksum as an aggregate that needs no order: each block is rotated once for each block after it."""
    return F.bit_xor(rotated(crc, blocks_after))
