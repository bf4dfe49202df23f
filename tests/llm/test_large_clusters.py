import random

import pytest

from blockloom.llm import jaccard_join

from .fixtures import documents
from .test_copies import components


def cluster(members, outsiders, seed=2):
    """Near copies of one text, and texts that share many of its n-grams but don't reach the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(200)]
    rows = []
    for k in range(members + outsiders):
        own = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 4) if k < members else 9):
            own[at] = word()
        rows.append((k, " ".join(own)))
    return rows


def test_outsiders_meet_a_large_component_once(spark, monkeypatch):
    """Not once for each n-gram they share with it."""
    monkeypatch.setattr(jaccard_join, "RUN", 20)
    met, search = [], jaccard_join.search_units
    monkeypatch.setattr(jaccard_join, "search_units", lambda units, *a: met.append(units.count()) or search(units, *a))
    rows = cluster(150, 10)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == components(rows, 5, 80, 100)
    assert len({c for _, c in got.values()}) > 5
    # The runs of the main component, in two windows of sizes each, and the others with each of these runs.
    assert len(met) == 2 and met[1] <= 10 * len(rows)


def test_sets_of_the_main_component_are_not_searched(monkeypatch):
    searched, search = [], jaccard_join.Trie.search
    monkeypatch.setattr(jaccard_join.Trie, "search", lambda self, x, *a: searched.append(x) or search(self, x, *a))
    rng = jaccard_join.np.random.default_rng(1)
    sets = [jaccard_join.distinct(rng.integers(0, 1 << 60, 40, dtype="uint64")) for _ in range(50)]
    found = [*sets, sets[7].copy(), sets[49].copy()]
    links = jaccard_join.links_of(found, list(range(52)), [0] * 49 + [49, 50, 51], 80, 100)
    assert {frozenset(x) for x in links} == {frozenset((7, 50)), frozenset((49, 51))} and len(searched) <= 3


@pytest.mark.parametrize("seed", range(4))
def test_links_span_the_components(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(200), 30) for _ in range(3)]
    sets = []
    for _ in range(40):
        own = set(rng.choice(base)) ^ set(rng.sample(range(200), rng.randrange(6)))
        sets.append(jaccard_join.np.array(sorted(own), jaccard_join.np.uint64))
    near = lambda a, b: 100 * len(set(a.tolist()) & set(b.tolist())) >= 80 * len(set(a.tolist()) | set(b.tolist()))
    given = jaccard_join.Union(list(range(40)))
    for y in range(40):  # some are connected already
        for x in range(y):
            if near(sets[x], sets[y]) and rng.random() < 0.3:
                given.join(x, y)
    labels = [given.find(x) for x in range(40)]
    got = jaccard_join.Union(labels)
    for a, b in jaccard_join.links_of(sets, list(range(40)), labels, 80, 100):
        assert near(sets[a], sets[b])
        got.join(a, b)
    want = jaccard_join.Union(list(range(40)))
    for y in range(40):
        for x in range(y):
            if near(sets[x], sets[y]):
                want.join(x, y)
    assert [[got.find(a) == got.find(b) for b in range(40)] for a in range(40)] == [[want.find(a) == want.find(b) for b in range(40)] for a in range(40)]
