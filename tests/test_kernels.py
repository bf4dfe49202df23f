"""Kernels against the C library, known vectors and plain definitions."""

import bz2
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions import block, crc, huffman, runs, stream, transform
from blockloom.functions.errors import Damaged


#: Fixed values from here to SIZES: the recipes of inputs whose packed sizes are published, and those of the C library at levels 1, 2 and 9.
def noise(length, seed):
    s, out = seed | 1, bytearray()
    for _ in range(length):
        s ^= s << 13 & (1 << 64) - 1
        s ^= s >> 7
        s ^= s << 17 & (1 << 64) - 1
        out.append(s >> 32 & 255)
    return bytes(out)


def lines(n):
    return b"".join(b"line %d holds %d\n" % (i, i * i % 9973) for i in range(n))


SAMPLES = {
    "empty": b"",
    "one byte": b"x",
    "every byte value": bytes(range(256)),
    "zeros": bytes(300_000),
    "noise": noise(150_000, 7),
    "text": lines(15_000),
    "runs": b"".join(bytes([k % 251]) * k for k in range(1, 601)),
    "four": b"aaaabbbbccccdddd" * 1000,
    "five": b"aaaaabbbbbcccccddddd" * 1000,
    "periodic": b"abcdefghij" * 5000,
    "zero origin": bytes([0, 0, 67, 0, 67, 0, 0, 5, 0, 0]),
}
SIZES = {
    "empty": (14, 14, 14), "one byte": (37, 37, 37), "every byte value": (425, 425, 425), "zeros": (47, 47, 47), "noise": (151_372, 151_094, 151_094),
    "text": (61_981, 61_615, 62_138), "runs": (2_152, 2_152, 2_152), "four": (69, 69, 69), "five": (69, 69, 69),
}


@pytest.mark.parametrize("name", SIZES)
def test_packed_sizes(name):
    assert tuple(len(stream.compress(SAMPLES[name], level)) for level in (1, 2, 9)) == SIZES[name]
    for level, size in zip((1, 9), SIZES[name][::2], strict=True):
        # Whole runs stay in one block, so cuts are a little different.
        assert len(stream.compress_in_blocks(SAMPLES[name], level)) <= 1.005 * size + 8


@pytest.mark.parametrize("name", SAMPLES)
def test_own_blocks_are_read_by_the_c_library(name):
    data = SAMPLES[name]
    own = block.assembled([block.encode_slowly(data[a:b]) for a, b, _ in runs.cuts(data, 9)], 9)
    assert bz2.decompress(own) == data
    assert len(own) <= 1.005 * len(bz2.compress(data, 9)) + 8


@pytest.mark.parametrize("level", [1, 2, 9])
@pytest.mark.parametrize("name", SAMPLES)
def test_block_parallel_streams(name, level):
    data = SAMPLES[name]
    packed = stream.compress_in_blocks(data, level)
    assert bz2.decompress(packed) == data
    got = stream.decompress(packed)
    assert (got.raw, got.trailing, got.error, got.streams) == (data, False, None, 1)


@pytest.mark.parametrize("name", ["one byte", "every byte value", "text", "runs", "periodic", "zero origin"])
def test_own_decoder(name):
    data = SAMPLES[name]
    packed = bz2.compress(data, 9)
    raw, header, _, end = block.decode_slowly(packed, 32, 8 * len(packed), 9)
    assert raw == data and header.crc == crc.block_crc(data)
    assert block.Bits(packed, end).take(48) == block.END_MAGIC


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.lists(st.sampled_from([b"a", b"b" * 300, b"ab"]), max_size=40).map(b"".join))
def test_transforms_undo_each_other(data):
    assert runs.decode(runs.encode(data)) == data
    column, origin = transform.burrows_wheeler(data)
    assert transform.inverse(column, origin) == data
    positions, used = transform.move_to_front(column)
    assert transform.front_to_bytes(positions, used) == column
    symbols = transform.code_zeros(positions, len(used))
    assert symbols[-1] == len(used) + 1 and transform.expand_zeros(symbols[:-1]) == positions
    if data:
        turned = [data[i:] + data[:i] for i in range(len(data))]
        assert column == bytes(r[-1] for r in sorted(turned)) and turned[transform.least_rotation(data)] == min(turned)
        p = transform.period(data)
        assert data[:p] * (len(data) // p) == data


def test_checksums():
    assert crc.block_crc(b"123456789") == 0xFC891918
    checks, state = [crc.block_crc(bytes([i])) for i in range(70)], 0
    for c in checks:
        state = crc.combine(state, c)
    closed = 0
    for i, c in enumerate(checks):
        by = (len(checks) - 1 - i) % 32
        closed ^= (c << by | c >> (32 - by)) & crc.MASK if by else c
    assert closed == state


def test_codes():
    assert huffman.code_lengths([1, 1, 2, 3, 5, 8, 13, 21]) == [7, 7, 6, 5, 4, 3, 2, 1]
    assert huffman.code_lengths([0, 0, 5]) == [2, 2, 1]
    assert huffman.canonical_codes([3, 2, 3, 2, 2]) == [0b110, 0b00, 0b111, 0b01, 0b10]
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths = huffman.code_lengths(fibonacci)
    assert max(lengths) == 17 and sum(2.0**-n for n in lengths) == 1
    assert [huffman.table_count(n) for n in (1, 199, 200, 600, 1200, 2400)] == [2, 2, 3, 4, 5, 6]


def test_block_limit():
    for n, blocks in ((99_980, 1), (99_981, 1), (99_982, 2), (299_950, 4)):
        data = noise(n, 3)
        assert len(list(runs.cuts(data, 1))) == blocks
        assert bz2.decompress(stream.compress_in_blocks(data, 1)) == data
    run = noise(99_978, 1) + b"r" * 1000 + noise(99_981, 2)
    assert bz2.decompress(stream.compress_in_blocks(run, 1)) == run


def test_markers_at_every_bit():
    rng = random.Random(5)
    for shift in range(16):
        body = rng.randbytes(40)
        data = block.joined([(bytes(2), shift), (body, 320), (block.BLOCK_MAGIC.to_bytes(6, "big"), 48), (body, 320), (block.END_MAGIC.to_bytes(6, "big"), 48)])[0]
        assert block.markers(data) == [(shift + 320, "block"), (shift + 688, "end")]


def test_damage_is_refused():
    packed = bz2.compress(lines(60_000), 1)
    for at in (20, len(packed) // 3, len(packed) // 2, len(packed) - 20):
        bad = bytearray(packed)
        bad[at] ^= 0x10
        assert stream.decompress(bytes(bad)).error
    for keep in (3, 4, 10, len(packed) // 2, len(packed) - 1):
        assert stream.decompress(packed[:keep]).error == "Truncated"
    for other in (b"", b"plain text, not bzip2", b"BZh0", packed[1:]):
        assert stream.decompress(other).error == "NotBzip2"


def test_what_follows_a_stream():
    packed = bz2.compress(b"the end", 5)
    for tail in (b"garbage", b"\0", bytes(3), bytes(100), b"BZ", block.BLOCK_MAGIC.to_bytes(6, "big") + b"\0\0", block.END_MAGIC.to_bytes(6, "big") + b"\0\0"):
        got = stream.decompress(packed + tail)
        assert got.raw == b"the end" and got.trailing and got.error is None
    assert stream.decompress(packed + b"BZh9").error == "Truncated"
    three = bz2.compress(lines(3000), 1) + bz2.compress(noise(1500, 3), 9) + packed
    got = stream.decompress(three)
    assert got.raw == lines(3000) + noise(1500, 3) + b"the end" and got.streams == 3 and not got.trailing


def test_levels():
    for level in (0, 10):
        with pytest.raises(Damaged, match="BadLevel"):
            stream.compress(b"x", level)
    large = noise(150_000, 9)
    packed = bz2.compress(large, 9)
    assert stream.decompress(b"BZh1" + packed[4:]).error is not None


def test_coded_length():
    for data in [*SAMPLES.values(), b"", b"a", b"a" * 3, b"a" * 4, b"a" * 255, b"a" * 258, b"a" * 259, b"a" * 600 + b"b"]:
        assert runs.coded_length(data) == len(runs.encode(data))


def test_many_streams_in_a_row_take_linear_time():
    one = bz2.compress(noise(3_000, 9), 1)
    got = stream.decompress(one * 400 + bz2.compress(bytes(9_000_000)) + b"tail")
    assert got.streams == 401 and got.trailing and got.error is None and len(got.raw) == 400 * 3_000 + 9_000_000

    def seconds(n):
        began = time.process_time()
        assert stream.decompress(one * n).streams == n
        return time.process_time() - began

    assert min(seconds(1_600) for _ in range(2)) < 8 * min(seconds(400) for _ in range(2)) + 0.1


def test_blocks_side_by_side():
    from concurrent.futures import ThreadPoolExecutor

    packed = bz2.compress(lines(30_000), 1)
    spoiled = packed[:2_000] + bytes([packed[2_000] ^ 1]) + packed[2_001:]
    cases = [packed, packed + bz2.compress(b"more") + b"junk", packed[:-3], spoiled, packed[:-4] + b"\1\2\3\4", packed + b"BZh1", b"", b"BZh", bz2.compress(b"")]
    with ThreadPoolExecutor(3) as pool:
        for data in cases:
            assert stream.decompress_on(pool, data) == stream.decompress(data)
    assert len(stream.places(packed)[0]) > 3 and stream.places(packed[:-3]) is None


@pytest.mark.parametrize("step", [1_000, 70_001, 1 << 20])
def test_pieces_are_packed_and_unpacked(step):
    from blockloom.functions import pieces

    in_steps = lambda data: (data[i : i + step] for i in range(0, len(data), step))
    for name, data in SAMPLES.items():
        whole = b"".join(pieces.packed(in_steps(data), 1))
        assert whole == stream.compress_in_blocks(data, 1), name
        assert b"".join(pieces.unpacked(in_steps(whole + whole))) == data + data
    data = lines(40_000)
    shared = b"".join(pieces.packed(in_steps(data), 9, expected=len(data), workers=4))
    assert bz2.decompress(shared) == data and len(stream.places(shared)[0]) >= 4 > len(stream.places(bz2.compress(data))[0])


def test_pieces_name_what_is_wrong():
    from blockloom.functions import pieces

    data = bz2.compress(lines(2_000), 1)
    flipped = data[:11] + bytes([data[11] ^ 4]) + data[12:]
    for content, name in ((b"", "NotBzip2"), (b"plain", "NotBzip2"), (b"BZ", "Truncated"), (data[:-3], "Truncated"), (data + b"BZh9", "Truncated"), (flipped, "BlockCrcMismatch"), (data[:-2] + b"\0\1", "StreamCrcMismatch")):
        with pytest.raises(Damaged) as e:
            list(pieces.unpacked(content[i : i + 7] for i in range(0, len(content), 7)))
        assert e.value.name == name
    unpacker = pieces.Unpacker()
    assert unpacker.write(data + b"BZ") == lines(2_000) and not unpacker.trailing
    unpacker.finish()
    assert unpacker.trailing
