"""Packing of short pieces to the token."""

import random
from collections import Counter, defaultdict

import pytest

from blockloom.llm import packing

from .fixtures import documents


@pytest.mark.parametrize("text", [None, "", "a b c d e f g h"])
def test_tables_of_short_texts_are_packed_whole(spark, text):
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    rows = [(k, text) for k in range(5_000)]
    held = defaultdict(list)
    for r in packing.pack(documents(spark, rows)).collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    each = held[0][0][1]
    assert len(held) == -(-5_000 // (packing.LENGTH // each))
    for own in held.values():
        assert sorted(o for o, _ in own) == list(range(0, each * len(own), each)) and each * len(own) <= packing.LENGTH


def test_plans_hold_all_pieces_and_little_padding():
    rng = random.Random(5)
    for longest, padding in ((packing.SHORT, 0.002), (600, 0.02), (2048, 0.02)):
        histogram = Counter()
        for _ in range(40_000):
            n = rng.randrange(1, longest + 1)
            histogram[n if n <= packing.SHORT else -(-n // packing.QUANTUM) * packing.QUANTUM] += 1
        held, sequences = Counter(), 0
        for own, times in packing.planned(dict(histogram), packing.LENGTH, packing.QUANTUM):
            assert times > 0 and sum(w * k for w, k in own.items()) <= packing.LENGTH
            sequences += times
            for w, k in own.items():
                held[w] += k * times
        assert all(held[w] >= n for w, n in histogram.items()) and all(held[w] == n for w, n in histogram.items() if w <= packing.SHORT)
        assert sequences * packing.LENGTH * (1 - padding) <= sum(w * n for w, n in histogram.items()) + packing.LENGTH
    assert packing.planned({}, packing.LENGTH, packing.QUANTUM) == []
