"""One block of a stream: bits to bytes and back, and the parts of its header."""

from __future__ import annotations

import bz2
from dataclasses import dataclass, field

import numpy as np

from . import huffman, runs, transform
from .crc import block_crc, combine
from .errors import Damaged, checked_level

BLOCK_MAGIC, END_MAGIC = 0x314159265359, 0x177245385090
MOST_SELECTORS = 18_002
MOST_CODE = 20
MOST_COMPRESSED = 2_400_000


class Bits:
    """Reads from most to least significant bit, between two bit positions."""

    def __init__(self, data: bytes, start: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, start, 8 * len(data) if end is None else end

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise Damaged("Truncated")
        first, last = self.at >> 3, self.at + n + 7 >> 3
        word = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return word & (1 << n) - 1


class BitWriter:
    def __init__(self):
        self.parts: list[str] = []
        self.length = 0

    def put(self, value: int, n: int) -> None:
        self.parts.append(f"{value:0{n}b}" if n else "")
        self.length += n

    def put_text(self, bits: str) -> None:
        self.parts.append(bits)
        self.length += len(bits)

    def bits(self) -> str:
        return "".join(self.parts)


def shifted(data: bytes, start: int, length: int) -> bytes:
    """`length` bits from bit `start` on, moved to the front and padded with zeros."""
    first, last = start >> 3, start + length + 7 >> 3
    part = np.frombuffer(data, np.uint8)[first:last]
    by = start & 7
    if by:
        after = np.append(part[1:], np.uint8(0))
        part = (part << np.uint8(by)) | (after >> np.uint8(8 - by))
    part = part[: length + 7 >> 3].copy()
    if length & 7 and len(part):
        part[-1] &= 0xFF << (8 - (length & 7)) & 0xFF
    return part.tobytes()


def joined(parts: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    """Bit strings, each left-aligned with its length, one behind the other."""
    total = sum(n for _, n in parts)
    out = np.zeros((total + 7 >> 3) + 1, np.uint8)
    at = 0
    for data, n in parts:
        by, first = at & 7, at >> 3
        a = np.frombuffer(data, np.uint8)[: n + 7 >> 3]
        if by == 0:
            out[first : first + len(a)] |= a
        else:
            out[first : first + len(a)] |= a >> np.uint8(by)
            out[first + 1 : first + 1 + len(a)] |= (a << np.uint8(8 - by))[: len(out) - first - 1]
        at += n
    return out[: total + 7 >> 3].tobytes(), total


def markers(data: bytes, first_bit: int = 0) -> list[tuple[int, str]]:
    """(bit, kind) of every block or end marker at any bit; some may be false. Byte pairs inside a marker are looked up first."""
    found = []
    a = np.frombuffer(data, np.uint8)
    if len(a) < 6:
        return found
    pairs = a[:-1].astype(np.uint16) << 8 | a[1:]
    for kind, magic in (("block", BLOCK_MAGIC), ("end", END_MAGIC)):
        for by in range(8):
            head = (8 - by) % 8  # bits of the marker in the byte before its first whole one
            inner = [magic >> 40 - head - 8 * k & 0xFF for k in range(2)]
            ahead = 1 if by else 0
            look = np.flatnonzero(pairs == inner[0] << 8 | inner[1]) - ahead
            for byte in look[(look >= 0) & (look + 6 + (by > 0) <= len(a))].tolist():
                if int.from_bytes(data[byte : byte + 6 + (by > 0)], "big") >> (8 - by if by else 0) & (1 << 48) - 1 == magic:
                    found.append((8 * byte + by, kind))
    return sorted(m for m in found if m[0] >= first_bit)


@dataclass
class Header:
    crc: int
    randomized: bool
    origin: int
    used: list[int]
    groups: int
    selectors: list[int]
    lengths: list[list[int]] = field(repr=False)


def read_header(bits: Bits, level: int = 9) -> Header:
    """Everything of a block before its symbols."""
    if bits.take(48) != BLOCK_MAGIC:
        raise Damaged("BadBlockMagic")
    crc, randomized, origin = bits.take(32), bits.take(1), bits.take(24)
    if origin > level * 100_000 + 10:
        raise Damaged("BadOriginPointer")
    rows = bits.take(16)
    used = []
    for high in range(16):
        if rows >> (15 - high) & 1:
            row = bits.take(16)
            used += [16 * high + low for low in range(16) if row >> (15 - low) & 1]
    if not used:
        raise Damaged("BadSymbolMap")
    groups = bits.take(3)
    if not 2 <= groups <= 6:
        raise Damaged("BadGroupCount")
    count = bits.take(15)
    if count == 0:
        raise Damaged("BadSelectors")
    recent, selectors = list(range(groups)), []
    for k in range(count):
        at = 0
        while bits.take(1):
            at += 1
            if at >= groups:
                raise Damaged("BadSelectors")
        recent.insert(0, recent.pop(at))
        if k < MOST_SELECTORS:
            selectors.append(recent[0])
    lengths = []
    for _ in range(groups):
        now, own = bits.take(5), []
        for _ in range(len(used) + 2):
            while True:
                if not 1 <= now <= MOST_CODE:
                    raise Damaged("BadCodeLengths")
                if not bits.take(1):
                    break
                now += -1 if bits.take(1) else 1
            own.append(now)
        lengths.append(own)
    return Header(crc, bool(randomized), origin, used, groups, selectors, lengths)


def read_symbols(bits: Bits, header: Header, most: int) -> list[int]:
    """Symbols up to the end of the block, without it."""
    tables = []
    for lengths in header.lengths:
        own: dict[tuple[int, int], int] = {}
        for s, (n, code) in enumerate(zip(lengths, huffman.canonical_codes(lengths), strict=True)):
            if code < 1 << n:  # of an over-full table, the codes that exist
                own.setdefault((n, code), s)
        tables.append((own, min(lengths), max(lengths)))
    end, out = len(header.used) + 1, []
    for selector in header.selectors:
        own, least, longest = tables[selector]
        for _ in range(huffman.CHUNK):
            n, code = least, bits.take(least)
            while (s := own.get((n, code))) is None:
                if n >= longest:
                    raise Damaged("BadHuffmanCode")
                code, n = code << 1 | bits.take(1), n + 1
            if s == end:
                return out
            out.append(s)
            if len(out) > 2 * most:
                raise Damaged("BlockTooLarge")
    raise Damaged("BadSelectors")


def decode_slowly(data: bytes, start: int, end: int, level: int) -> tuple[bytes, Header, int, int]:
    """A block by this module alone: raw bytes, header, coded length, bit behind it. For errors and for looking inside."""
    bits = Bits(data, start, end)
    header = read_header(bits, level)
    most = level * 100_000
    positions = transform.expand_zeros(read_symbols(bits, header, most), most)
    column = transform.front_to_bytes(positions, header.used)
    if header.origin >= max(1, len(column)):
        raise Damaged("BadOriginPointer")
    return runs.decode(transform.inverse(column, header.origin)), header, len(column), bits.at


def wrapped(data: bytes, start: int, length: int, level: int) -> bytes:
    """The bits of one block as a stream of their own."""
    crc = Bits(data, start + 48, start + 80).take(32) if length >= 80 else 0
    head = b"BZh" + str(level).encode()
    end = (END_MAGIC << 32 | crc).to_bytes(10, "big")
    return joined([(head, 32), (shifted(data, start, length), length), (end, 80)])[0]


def decode_block(data: bytes, start: int, length: int, level: int) -> bytes:
    """Raw bytes of the block in these bits, by the C library; raises Damaged. Randomised blocks included."""
    whole = wrapped(data, start, length, checked_level(level))
    try:
        decoder = bz2.BZ2Decompressor()
        raw = decoder.decompress(whole)
        if decoder.eof:
            return raw
    except (OSError, ValueError):
        pass
    end = start + length
    raw, header, _, _ = decode_slowly(data, start, end, level)
    if not header.randomized and block_crc(raw) != header.crc:
        raise Damaged("BlockCrcMismatch")
    raise Damaged("Truncated" if header.randomized else "BadHuffmanCode")


def encode_chunk(raw: bytes, level: int) -> tuple[bytes, int, int]:
    """One block by the C library: its bits, left-aligned, their number, and its checksum. raw must fit into one block."""
    whole = bz2.compress(raw, checked_level(level))
    # The end marker stands 80 bits before the padding, of which the last byte has 0 to 7 bits.
    for pad in range(8):
        end = 8 * len(whole) - 80 - pad
        if Bits(whole, end).take(48) == END_MAGIC:
            break
    length = end - 32
    crc = Bits(whole, 32 + 48).take(32)
    if Bits(whole, end + 48).take(32) != crc:
        raise ValueError("more than one block")
    return shifted(whole, 32, length), length, crc


def encode_slowly(raw: bytes) -> tuple[bytes, int, int]:
    """One block by this module alone, like `encode_chunk`; padded inside so that it ends on a byte."""
    coded = runs.encode(raw)
    column, origin = transform.burrows_wheeler(coded)
    positions, used = transform.move_to_front(column)
    symbols = np.array(transform.code_zeros(positions, len(used)))
    lengths, selectors = huffman.choose_tables(symbols, len(used) + 2)
    codes = [huffman.canonical_codes(x) for x in lengths]

    def written(spare: int, detour: int) -> str:
        out = BitWriter()
        out.put(BLOCK_MAGIC, 48)
        out.put(block_crc(raw), 32)
        out.put(0, 1)
        out.put(origin, 24)
        rows = [[b for b in used if b >> 4 == high] for high in range(16)]
        out.put_text("".join("1" if r else "0" for r in rows))
        for r in rows:
            if r:
                out.put(sum(1 << 15 - (b & 15) for b in r), 16)
        out.put(len(lengths), 3)
        out.put(len(selectors) + spare, 15)
        recent = list(range(len(lengths)))
        for s in [*selectors, *selectors[-1:] * spare]:
            at = recent.index(s)
            out.put_text("1" * at + "0")
            recent.insert(0, recent.pop(at))
        for t, own in enumerate(lengths):
            first = own[0] + (detour if t == 0 else 0) * (1 if own[0] <= MOST_CODE - 4 else -1)
            out.put(first, 5)
            now = first
            for n in own:
                out.put_text(("10" if n > now else "11") * abs(n - now) + "0")
                now = n
        table = np.repeat(np.array(selectors), huffman.CHUNK)[: len(symbols)]
        width, code = np.array(lengths)[table, symbols], np.array(codes)[table, symbols]
        out.put_text("".join([f"{c:0{w}b}" for c, w in zip(code.tolist(), width.tolist(), strict=True)]))
        return out.bits()

    bits = written(0, 0)
    missing = -len(bits) % 8
    if missing:
        bits = written(missing & 1, missing >> 1)
    assert len(bits) % 8 == 0
    return int(bits, 2).to_bytes(len(bits) // 8, "big"), len(bits), block_crc(raw)


def assembled(blocks: list[tuple[bytes, int, int]], level: int) -> bytes:
    """One stream of blocks (bits, their number, checksum) in order."""
    crc = 0
    for _, _, c in blocks:
        crc = combine(crc, c)
    head, tail = b"BZh" + str(checked_level(level)).encode(), (END_MAGIC << 32 | crc).to_bytes(10, "big")
    return joined([(head, 32), *((b, n) for b, n, _ in blocks), (tail, 80)])[0]
