"""Tokens, packing, sharding and licenses against brute force and exact round trips."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import licenses, packing, sharding, tokens

from .fixtures import awkward, documents, prose

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(tokens.default_vocabulary())


ODD = [
    "!'s a!'s 'sad x'RE It'S '' 's's don't", "<|endoftext|>x <|ENDOFTEXT|>", "é Á .́ ́", "a\x1cb\x1d c\x85d\xa0e f", "İstanbul ΣΑΣ ǅ",
    "!¿que? «a»b ½ ² x²3", "​﻿ zero", "12a34 5,6.7", "naïve–dash…", "\x00\x07 ctl", "a" * 5000 + "." * 3000, "|x| <| |> <|a", "ﬁ ﬃ Å Å",
]


def test_fragments_give_the_same_tokens(whole):
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(1, 128)] + list("éñßüøΩ中🙂́̈ İ½²") + [" "] * 30 + list("'sStTdDmMlLrRvVeE") * 3
    alphabet += list("ÀÉÖßÿ×÷ÅAÞ东京都の。、ガ゙！，") + ["\u0301", "\u0338", "\u030a"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(3000)]
    for at_once in (50, 4_000_000):
        known = tokens.Fragments(tokens.default_vocabulary(), remembered=200, at_once=at_once)
        for text, got in zip(texts, known.encode(pa.array(texts)), strict=True):
            want = whole.encode(text, add_special_tokens=False).ids
            assert got.tolist() == want, text
            assert b"".join(known.decoded(got)).decode() == whole.decode(want, skip_special_tokens=False), text


def test_long_texts_without_spaces(whole):
    rng = random.Random(5)
    wide = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(20_000))
    texts = [wide, "。".join(wide[i : i + 25] for i in range(0, len(wide), 25)), "".join(rng.choice("abcdefgh") for _ in range(50_000)), "Straße" * 5_000, "のガ" * 3_000]
    known = tokens.Fragments(tokens.default_vocabulary(), at_once=1_000)
    for text, got in zip(texts, known.encode(pa.array(texts)), strict=True):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids
    known = tokens.Fragments(tokens.default_vocabulary())
    assert sum(len(x) for x in known.encode(pa.array([wide * 80]))) > 1_000_000  # 4.8 MB


def test_encode_documents(spark, whole):
    got = tokens.encode_documents(documents(spark, awkward())).collect()
    texts = {i: t or "" for i, t in awkward() if i is not None}
    assert len(got) == len(awkward())
    for r in got:
        if r["doc_id"] is not None:
            want = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
            assert r["decoded"] == whole.decode(want, skip_special_tokens=False)
    assert tokens.token_digests(documents(spark, awkward())).count() == len(awkward())
    assert tokens.token_digests(documents(spark, [])).count() == tokens.encode_documents(documents(spark, [])).count() == 0


def test_packing(spark, whole):
    rows = [r for r in awkward() if r[0] is not None and r != (8, None)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(1000 + i, t) for i, t in prose(150)]
    pieces = packing.pack(documents(spark, rows)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
    total = sum(p["length"] for p in pieces)
    assert sorted(by_sequence) == list(range(len(by_sequence))) and total >= 0.95 * packing.LENGTH * (len(by_sequence) - 1)
    assert packing.pack(documents(spark, awkward())).selectExpr("sum(length)").first()[0] > 0
    assert packing.pack(documents(spark, [])).count() == 0


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(1)
    for _ in range(10):
        capacity = 64
        histogram = {int(w): int(rng.integers(1, 200)) for w in rng.choice(np.arange(1, 65), 20, replace=False)}
        plan = packing.patterns(dict(histogram), capacity)
        held = Counter()
        for own, times in plan:
            assert sum(w * k for w, k in own.items()) <= capacity
            for w, k in own.items():
                held[w] += k * times
        assert all(held[w] >= n for w, n in histogram.items())
        weights = np.array(sorted(set(histogram) - {capacity}))
        least = sum(a for _, a in packing.column_generation(weights, np.array([histogram[w] for w in weights], float), capacity))
        assert sum(t for _, t in plan) <= least + histogram.get(capacity, 0) + len(weights)


def test_knapsack():
    rng = np.random.default_rng(3)
    for _ in range(20):
        weights = np.sort(rng.choice(np.arange(1, 15), 5, replace=False))
        values = rng.random(5)
        value, counts = packing.knapsack(values, weights, 20)
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - w] + v for w, v in zip(weights.tolist(), values, strict=True) if w <= c)])
        assert abs(value - best[20]) < 1e-9 and counts @ weights <= 20 and abs(counts @ values - value) < 1e-9


def smallest(sizes, shards):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if fits(middle) else (middle + 1, hi)
    return lo


@pytest.mark.parametrize("cells", [3, 4096])
@pytest.mark.parametrize("rows", [prose(200, seed=8), awkward(), [(k, "same") for k in range(60)] + [(100 + k, f"own {k}") for k in range(90)]])
def test_sharding(spark, monkeypatch, rows, cells):
    monkeypatch.setattr(sharding.Sums.__init__, "__defaults__", (cells,))
    got = sharding.shard(documents(spark, rows)).collect()
    text = defaultdict(set)
    slots, held = defaultdict(list), Counter()
    where = {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        where[r["doc_id"]] = r["shard"]
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
        if i is not None:
            text[t or ""].add(where[i])
    assert all(len(s) == 1 for s in text.values())
    order = sorted(groups, key=lambda t: min((i for i in groups[t] if i is not None), default=-1))
    sizes = [(len(t.encode()) + 1) * len(groups[t]) for t in order]
    assert max(held.values()) == smallest(sizes, 16) or max(held.values()) <= smallest(sizes, 16)
    assert sum(held.values()) == sum(sizes)
    placed = [min(where[i] for i in groups[t] if i is not None) for t in order if any(i is not None for i in groups[t])]
    assert placed == sorted(placed)


def test_sharding_edge_cases(spark):
    assert sharding.shard(documents(spark, [])).count() == 0
    few = sharding.shard(documents(spark, [(1, "a"), (2, None), (3, "")])).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in few} == {1: (2, zlib.crc32(b"a")), 2: (1, 0), 3: (1, 0)}
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in few)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENSED = [
    (1, "Licensed under CC BY-NC 4.0. And cc, by the way; CC-BY"), (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "All rights\nreserved. all RIGHTS reserved"), (4, "Released under the MIT License."), (5, "Permission is hereby granted, free of charge, to any person"),
    (6, "cc" + " word" * 100 + " by"), (7, "x " * 5000 + "all rights reserved " + "y " * 5000), (8, "licensed rights of the version"), (9, None), (10, ""), (10, ""),
]


def brute_licenses(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                at.append(k)
                base.add(label)
    more, step = {}, licenses.BLOCK // 2
    for label, template in licenses.TEMPLATES:
        t = set(template.split())
        for start in range(0, len(words), step):
            share = len(t & set(words[start : start + licenses.BLOCK])) / len(t)
            if share >= licenses.CONTAINMENT - 1e-12:
                more[label] = max(more.get(label, 0), share)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(more))), 1.0 if base else max(more.values(), default=0.0))


def test_licenses(spark):
    rows = LICENSED + [(100 + (i or 50), t) for i, t in awkward()]
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    want = Counter((i, *brute_licenses(t)) for i, t in rows)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert licenses.scan_licenses(documents(spark, [])).count() == 0
