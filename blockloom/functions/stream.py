"""Whole streams: compress, decompress, and the rules about what may follow what."""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from concurrent.futures import Executor
from dataclasses import dataclass

from . import block, runs
from .crc import combine
from .errors import Damaged, checked_level

#: A decoder is fed so many bytes at first and ever more then: many short streams and few long ones both take linear time.
FIRST_BYTES, MOST_BYTES = 16 << 10, 4 << 20


def compress(data: bytes, level: int = 9) -> bytes:
    return bz2.compress(data, checked_level(level))


def compress_in_blocks(data: bytes, level: int = 9, block_bytes: int | None = None) -> bytes:
    """The same stream for any number of tasks: blocks cut where the coded runs fill them, each encoded alone."""
    return block.assembled([block.encode_chunk(data[a:b], level) for a, b, _ in runs.cuts(data, level, block_bytes)], level)


def header_level(data: bytes, byte: int = 0) -> int | None:
    head = data[byte : byte + 4]
    return head[3] - 48 if len(head) == 4 and head[:3] == b"BZh" and 49 <= head[3] <= 57 else None


@dataclass
class Decoded:
    raw: bytes
    trailing: bool
    error: str | None
    streams: int


def decompress(data: bytes) -> Decoded:
    """All concatenated streams of data. Bytes behind the last one that start no stream are ignored and reported."""
    out, at, streams, view = [], 0, 0, memoryview(data)
    while True:
        if header_level(data, at) is None:
            if streams == 0:
                return Decoded(b"", False, "Truncated" if data and b"BZh".startswith(data[:3]) and len(data) < 4 else "NotBzip2", 0)
            return Decoded(b"".join(out), at < len(data), None, streams)
        decoder, fed, step = bz2.BZ2Decompressor(), at, FIRST_BYTES
        try:
            while not decoder.eof and fed < len(data):
                out.append(decoder.decompress(view[fed : fed + step]))
                fed, step = min(fed + step, len(data)), min(2 * step, MOST_BYTES)
            error = None if decoder.eof else "Truncated"
        except (OSError, ValueError):
            error = first_error(data, at)
        if error:
            return Decoded(b"".join(out), False, error, streams)
        at = fed - len(decoder.unused_data)
        streams += 1


def places(data: bytes) -> tuple[list[tuple[int, int]], int, int] | None:
    """((start bit, length) of each block, streams, byte behind the last stream), as markers and stored checksums have it; None where
    these don't agree: data is damaged, or a marker false."""
    found, out, streams, at, state, opened = block.markers(data), [], 0, 32, 0, header_level(data) is not None
    stops = [b for b, _ in found[1:]] + [8 * len(data)]
    last = 0
    for (bit, kind), stop in zip(found, stops, strict=False):
        if not opened:
            break
        if bit != at or bit + 80 > 8 * len(data):
            return None
        crc = block.Bits(data, bit + 48).take(32)
        if kind == "block":
            out.append((bit, stop - bit))
            state, at = combine(state, crc), stop
        elif crc != state:
            return None
        else:
            streams, state, last = streams + 1, 0, bit + 87 >> 3
            opened, at = header_level(data, last) is not None, 8 * last + 32
    return None if opened or not streams else (out, streams, last)


def _decoded_block(part: tuple[bytes, int, int]) -> bytes | None:
    try:
        return block.decode_block(*part, 9)
    except Damaged:
        return None


def decompress_on(pool: Executor, data: bytes) -> Decoded:
    """As `decompress`, blocks side by side; what isn't clearly whole is left to that."""
    found = places(data)
    if found is None or len(found[0]) < 2:
        return decompress(data)
    parts = ((data[bit >> 3 : bit + n + 7 >> 3], bit & 7, n) for bit, n in found[0])
    raw = list(pool.map(_decoded_block, parts))
    if None in raw:
        return decompress(data)
    return Decoded(b"".join(raw), found[2] < len(data), None, found[1])


def blocks_of(data: bytes, byte: int, level: int) -> Iterator[tuple[int, int, bytes]]:
    """Start bit, end bit and raw bytes of each block of the stream that starts at a byte; ends with its end marker's bit."""
    found = block.markers(data[byte:])
    stops = sorted({8 * byte + b for b, _ in found} | {8 * len(data)})
    at = 8 * byte + 32
    while True:
        magic = block.Bits(data, at).take(48)
        if magic == block.END_MAGIC:
            yield at, at, b""
            return
        if magic != block.BLOCK_MAGIC:
            raise Damaged("BadBlockMagic")
        ahead = [s for s in stops if s > at and s - at <= 8 * block.MOST_COMPRESSED + 8]
        k, error = 1, Damaged("Truncated")
        while ahead:
            stop = ahead[min(k, len(ahead)) - 1]
            try:
                raw = block.decode_block(data, at, stop - at, level)
                break
            except Damaged as e:
                error = e
                if k >= len(ahead) or e.name != "Truncated":
                    # Cut short, a block can also look damaged; only the longest try tells.
                    if k >= len(ahead):
                        raise
                k *= 2
        else:
            raise error
        if stop == stops[-1] and stop == 8 * len(data):
            stop = block.decode_slowly(data, at, stop, level)[3]
        yield at, stop, raw
        at = stop


def first_error(data: bytes, byte: int = 0) -> str:
    """Why the stream at this byte can't be read."""
    level = header_level(data, byte)
    if level is None:
        return "NotBzip2"
    crc = 0
    try:
        for start, stop, _ in blocks_of(data, byte, level):
            if start == stop:
                if block.Bits(data, start + 48).take(32) != crc:
                    return "StreamCrcMismatch"
            else:
                crc = combine(crc, block.Bits(data, start + 48).take(32))
    except Damaged as e:
        return e.name
    return "Truncated"
