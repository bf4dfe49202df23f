"""Exact dedup, fingerprints and the Jaccard join against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import exact_dedup, fingerprints, jaccard_join

from .fixtures import awkward, documents, prose


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("capacity", [1, 512])
@pytest.mark.parametrize("rows", [awkward(), prose(120)], ids=["awkward", "prose"])
def test_exact_dedup(spark, rows, capacity):
    got = exact_dedup.exact_dedup(documents(spark, rows), capacity=capacity).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = Counter()
    for i, t in rows:
        own = groups[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_buckets_split_until_they_fit(spark):
    rows = prose(300, seed=9)
    index = exact_dedup.build_index(documents(spark, rows), capacity=4)
    entries = index.entries.collect()
    held = Counter((r["bucket"], r["depth"]) for r in entries)
    assert max(held.values()) <= 4 and len(held) > 10
    for r in entries:
        prefix = (r["hash"] & (1 << 64) - 1) >> 64 - index.max_depth
        assert prefix >> index.max_depth - r["depth"] << index.max_depth - r["depth"] == r["bucket"]
    spans = sorted((b, b + (1 << index.max_depth - d)) for b, d in held)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_colliding_hashes_chain(spark):
    rows = [(k, f"Text {k % 40}") for k in range(120)] + [(200, None), (201, "")]
    few = lambda c: F.pmod(F.length(c), F.lit(3)).cast("long")
    got = exact_dedup.exact_dedup(documents(spark, rows), capacity=4, hash_of=few).collect()
    assert len(got) == len(rows) and max(r["chain"] for r in got) > 10
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(k, k % 40 + 80, 3) for k in range(120)} | {(200, 201, 2), (201, 201, 2)}
    assert len({(r["bucket"], r["chain"], r["text_sha256"]) for r in got}) == 41


def test_drop_copies_keeps_rows_whole(spark):
    docs = documents(spark, [(1, "A b"), (2, "a B"), (2, "a B"), (3, "c"), (None, "d"), (None, "d"), (4, None), (5, "")])
    docs = docs.selectExpr("*", "'own' AS sha", "'own' AS its", "'own' AS __sha", "'own' AS __keep_id")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(2, "a B"), (3, "c"), (None, "d"), (5, "")], key=repr)


def test_fingerprints(spark):
    rows = [(i, t) for i, t in awkward() if i is not None and (i, t) != (8, None)][:-1]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(documents(spark, rows)).collect()}
    simhash, rows = fingerprints.SimHash(), sorted(rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        text, follows = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, its = (simhash.fingerprint(x) for x in (text, edited, follows))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.hex(), changed.hex())
        assert r["near_edited"] == fingerprints.likeness(own, changed) and r["near_next"] == fingerprints.likeness(own, its)


def test_votes_of_shingles(monkeypatch):
    """Against a count of votes bit by bit; only the terms' hashes are taken from the module."""
    rng = random.Random(3)
    for n in (1, 4, 5, 6, 30, 400):
        words = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]
        simhash = fingerprints.SimHash()
        grams = [words[i : i + 5] for i in range(max(1, n - 4))]
        hashes = [b"".join(int(x).to_bytes(8, "little") for x in simhash.terms(simhash.word_hashes(g))[0]) for g in grams]
        bits = []
        for k in range(128):
            ayes = sum(h[k // 8] >> 7 - k % 8 & 1 for h in hashes)
            tie = min(hashes, key=lambda h: int.from_bytes(h[:8], "little"))[k // 8] >> 7 - k % 8 & 1
            bits.append(tie if 2 * ayes == len(hashes) else int(2 * ayes > len(hashes)))
        for at_once in (1, 7, 1 << 15):
            monkeypatch.setattr(fingerprints, "TERMS_AT_ONCE", at_once)
            assert simhash.fingerprint(" ".join(words)) == int("".join(map(str, bits)), 2).to_bytes(16, "big")


def test_fingerprints_across_blocks_and_edges(spark):
    rows = [(2**62 if k == 89 else -(2**40) if k == 0 else k, t) for k, t in prose(90, seed=5)]
    blocks = fingerprints.in_blocks(documents(spark, rows), "doc_id", "text", 4)
    held = defaultdict(list)
    for r in blocks.collect():
        held[r["block"]].append((r["tail"], r["id"]))
    starts = [min(i for tail, i in own if not tail) for _, own in sorted(held.items())]
    assert len(held) > 3
    assert [[i for tail, i in own if tail] for _, own in sorted(held.items())] == [[x] for x in starts[1:] + starts[:1]]
    one = fingerprints.fingerprint_documents(documents(spark, [(5, "only one")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(documents(spark, awkward())).count() == len(awkward())


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_search_within_a_radius(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(128) for _ in range(6)]
    points = [c ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(0, 2 * radius + 2))) for c in centres for _ in range(12)] + centres[:2] * 2
    halves = [fingerprints.halves(p.to_bytes(16, "big")) for p in points]
    df = spark.createDataFrame(halves, "hi bigint, lo bigint")
    got = {(r["hi"], r["lo"]): r["n"] for r in fingerprints.count_within(df, df, radius).collect()}
    for p, h in zip(points, halves, strict=True):
        assert got[h] == sum((p ^ q).bit_count() <= radius for q in points)


@pytest.mark.parametrize("radius", [0, 5, 28])
def test_search_within_any_radius(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(128) for _ in range(6)]
    points = [c ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(0, radius + 2))) for c in centres for _ in range(12)] + centres[:2] * 2
    halves = [fingerprints.halves(p.to_bytes(16, "big")) for p in points]
    df = spark.createDataFrame(halves, "hi bigint, lo bigint")
    got = {(r["hi"], r["lo"]): r["n"] for r in fingerprints.count_within(df.limit(20), df, radius).collect()}
    assert got == {h: sum((p ^ q).bit_count() <= radius for q in points) for p, h in list(zip(points, halves, strict=True))[:20]}
    assert fingerprints.count_within(df.limit(0), df, radius).count() == fingerprints.count_within(df, df.limit(0), radius).count() == 0


def test_near_copies_of_edited_texts_are_found(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    simhash, pairs = fingerprints.SimHash(), []
    for _ in range(400):
        own = [rng.choice(words) for _ in range(rng.randrange(40, 400))]
        edited = list(own)
        for _ in range(max(1, int(len(own) * rng.uniform(0.003, 0.022)))):
            k = rng.randrange(len(edited))
            edited[k : k + rng.randrange(2)] = [rng.choice(words)]
        a, b = shingles(" ".join(own), 5), shingles(" ".join(edited), 5)
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((" ".join(own), " ".join(edited)))
    prints = [[fingerprints.halves(simhash.fingerprint(t)) for t in pair] for pair in pairs]
    asked = spark.createDataFrame([p[0] for p in prints], "hi bigint, lo bigint")
    corpus = spark.createDataFrame([p[1] for p in prints], "hi bigint, lo bigint")
    found = fingerprints.count_within(asked, corpus).collect()
    assert len(pairs) > 250 and len(found) >= 0.95 * len(pairs)
    assert sum(r["n"] for r in found) == len(found)  # nobody else's copy


def test_short_texts_are_not_near_the_empty_text():
    simhash, rng = fingerprints.SimHash(), random.Random(1)
    for n in (6, 8):  # two and four shingles: votes are often equal
        texts = [" ".join(str(rng.random()) for _ in range(n)) for _ in range(100)]
        ones = [int.from_bytes(simhash.fingerprint(t), "big").bit_count() for t in texts]
        assert min(ones) > fingerprints.RADIUS and abs(sum(ones) / len(ones) - 64) < 3


def shingles(text, size):
    words = lowered(text).replace("\x0b", " ").split() if text else []
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("run", [2, 5, 400])
@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard_components(spark, monkeypatch, run, size, num, den):
    monkeypatch.setattr(jaccard_join, "RUN", run)
    monkeypatch.setattr(jaccard_join, "COMMON_FROM", 3)
    if run == 2:
        monkeypatch.setattr(jaccard_join, "MANY", 1)  # many groups are split by pairs of n-grams
        monkeypatch.setattr(jaccard_join, "BITMAP", 64)  # a full bitmap lets nearly all texts pass
    if run == 5:
        monkeypatch.setattr(jaccard_join, "HOT_FROM", 6)
        monkeypatch.setattr(jaccard_join, "HOT", 100)
    rows = prose(110, seed=run)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, rows), size=size, num=num, den=den).collect()}
    assert got == components(rows, size, num, den)


def test_jaccard_edge_cases(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = jaccard_join.jaccard_components(documents(spark, awkward()), size=4, num=85, den=100).collect()
    assert len(got) == len(awkward())
    want = components(rows, 4, 85, 100)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = jaccard_join.drop_near_copies(documents(spark, awkward()))
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns[:2] == ["doc_id", "text"]


def test_trie_finds_all_links():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = [np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(3)]
        sets = []
        for _ in range(25):
            own = set(base[rng.integers(3)].tolist())
            own ^= set(rng.integers(0, 60, rng.integers(0, 5)).tolist())
            if own:
                sets.append(np.array(sorted(own)))
        sets.sort(key=lambda s: s.astype(">u4").tobytes())
        trie, mask = jaccard_join.Trie(sets), np.zeros(60, bool)
        for x, own in enumerate(sets):
            mask[own] = True
            found = set(trie.search(x, mask, 80, 100, lambda y: False))
            mask[own] = False
            assert found == {y for y in range(x + 1, len(sets)) if 100 * len(np.intersect1d(own, sets[y])) >= 80 * len(np.union1d(own, sets[y]))}


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.drop_near_copies(none).count() == 0


def test_sql_of_exact_dedup(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    documents(spark, [(i, t) for i, t in prose(150) + [(900, None), (901, ""), (902, "ÀÉ x"), (903, "ÀÉ X")]], clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(exact_dedup.OP1_SQL.replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'"))
    got = exact_dedup.op1_exact_dedup(spark, str(tmp_path))
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_large_groups_stay_linear(spark):
    """5,000 sets that share one n-gram, and a large component with some others."""
    rng = np.random.default_rng(1)
    shared, n = np.uint64(77), 100
    prefixes = [np.sort(np.append(rng.integers(1 << 40, 1 << 60, 16, dtype=np.uint64), shared)).tobytes() for _ in range(5_000)]
    reps = spark.createDataFrame([(i, n, bytearray(p)) for i, p in enumerate(prefixes)], "rep bigint, n bigint, prefix binary")
    apart = spark.createDataFrame([(77, 5_000, i, i) for i in range(5_000)], "gram bigint, size bigint, rep bigint, component bigint")
    assert jaccard_join.split_by_pairs(apart, reps, 5_000, 85, 100).count() == 0
    mostly = spark.createDataFrame([(77, 5_000, i, max(0, i - 4_500), n) for i in range(5_000)], "gram bigint, size bigint, rep bigint, component bigint, n bigint")
    units = jaccard_join.in_units(mostly, 85, 100)
    sizes = units.groupBy("unit").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 3 * jaccard_join.RUN and sizes[1] <= 8 * 5_000
    # Everyone outside the main component meets everyone.
    meets = units.select("unit", "rep").where("rep >= 4990").join(units.selectExpr("unit", "rep AS other"), "unit").where("rep <> other").distinct()
    assert meets.select("rep", "other").distinct().count() == 10 * 4_999
