"""Streams piece by piece, in bounded memory: push bytes in, take bytes out."""

from __future__ import annotations

import bz2
from collections.abc import Iterable, Iterator

from . import block, runs
from .crc import combine
from .errors import Damaged, checked_level
from .stream import first_error, header_level

#: Fixed value: no block near a known end gets smaller than so many coded bytes.
LEAST_TAIL = 99_981
#: So much of a damaged stream is looked at to name what is wrong; beyond that, the name is general.
LOOKED_AT = 8 << 20


class Packer:
    """Compresses what is written, holding little more than a block. The bytes are those of `stream.compress_in_blocks` unless `expected` is given.

    expected: how many bytes will come; blocks near the end are then made so small that each of `workers` gets one of them.
    """

    def __init__(self, level: int = 9, expected: int | None = None, workers: int = 1):
        self.level, self.left, self.workers = checked_level(level), expected, max(1, workers)
        self.held, self.crc = b"", 0
        self.bits = (b"BZh" + str(level).encode(), 32)

    def _block_bytes(self) -> int | None:
        return None if self.left is None else max(LEAST_TAIL, self.left // self.workers)

    def _add(self, part: bytes, length: int) -> bytes:
        data, n = block.joined([self.bits, (part, length)])
        self.bits = (data[n >> 3 :], n & 7)
        return data[: n >> 3]

    def _take(self, whole: bool) -> Iterator[bytes]:
        """The finished blocks; with whole, all that is held."""
        while self.held:
            cuts = runs.cuts(self.held, self.level, self._block_bytes())
            _, end, _ = next(cuts)
            if end == len(self.held) and not whole:
                return
            chunk, self.held = self.held[:end], self.held[end:]
            payload, length, crc = block.encode_chunk(chunk, self.level)
            self.crc = combine(self.crc, crc)
            if self.left is not None:
                self.left = max(0, self.left - end)
            yield self._add(payload, length)

    def write(self, data: bytes) -> bytes:
        self.held += data
        # A run that reaches the end may go on.
        return b"".join(self._take(False)) if len(self.held) > runs.block_limit(self.level) else b""

    def finish(self) -> bytes:
        out = b"".join(self._take(True))
        tail = (block.END_MAGIC << 32 | self.crc).to_bytes(10, "big")
        out += self._add(tail, 80)
        return out + self.bits[0][: (self.bits[1] + 7) >> 3]


class Unpacker:
    """Decompresses what is written, streams in a row, holding no more than is decoded from one piece. What follows the last stream is
    ignored and sets `trailing`."""

    def __init__(self):
        self.head, self.decoder, self.streams, self.trailing, self.seen = b"", None, 0, False, b""

    def write(self, data: bytes) -> bytes:
        out, data = [], self.head + data if self.decoder is None else data
        self.head = b""
        while data and not self.trailing:
            if self.decoder is None:
                if len(data) < 4 and b"BZh".startswith(data[:3]):
                    self.head = data
                    break
                if header_level(data) is None:
                    if not self.streams:
                        raise Damaged("NotBzip2")
                    self.trailing = True
                    break
                self.decoder, self.seen = bz2.BZ2Decompressor(), b""
            self.seen = (self.seen + data)[: LOOKED_AT + 1]
            try:
                out.append(self.decoder.decompress(data))
            except (OSError, ValueError):
                name = first_error(self.seen) if len(self.seen) <= LOOKED_AT else "BadHuffmanCode"
                raise Damaged("BadHuffmanCode" if name == "Truncated" else name) from None
            data = b""
            if self.decoder.eof:
                data, self.decoder, self.streams = self.decoder.unused_data, None, self.streams + 1
        return b"".join(out)

    def finish(self) -> None:
        """Says that nothing follows."""
        if self.decoder is not None or self.head and not self.streams:
            raise Damaged("Truncated")
        if not self.streams:
            raise Damaged("NotBzip2")
        self.trailing |= bool(self.head)


def packed(parts: Iterable[bytes], level: int = 9, expected: int | None = None, workers: int = 1) -> Iterator[bytes]:
    """A stream of parts, in pieces."""
    packer = Packer(level, expected, workers)
    for p in parts:
        if out := packer.write(p):
            yield out
    yield packer.finish()


def unpacked(parts: Iterable[bytes]) -> Iterator[bytes]:
    """What parts of streams in a row hold, in pieces; raises Damaged."""
    unpacker = Unpacker()
    for p in parts:
        if out := unpacker.write(p):
            yield out
    unpacker.finish()
