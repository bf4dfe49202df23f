"""Quality, toxicity, language model and pipeline: held-out accuracy, brute-force sums and edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from blockloom.llm import language_model, quality, toxicity

from .fixtures import awkward, documents, prose


def graded(count=400, seed=1):
    """Rows and grades 0 to 2: shouting, half-and-half, prose."""
    rng = random.Random(seed)
    rows, grades = [], []
    for k, (_, text) in enumerate(prose(count, seed)):
        grade = rng.randrange(3)
        words = text.split() or ["a"]
        rows.append((k, " ".join(w.upper() + "!!" if grade == 0 or grade == 1 and i % 2 else w for i, w in enumerate(words))))
        grades.append((k, grade))
    return rows, grades


def test_ordinal_regression(spark):
    rows, grades = graded()
    labels = spark.createDataFrame([(i, g) for i, g in grades if i % 4], "doc_id bigint, quality int")
    docs = documents(spark, rows)
    model = quality.train_quality(docs, labels)
    assert model.grades == [0, 1, 2] and np.all(np.diff(model.thresholds) > 0)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model, target=2).collect()}
    truth = dict(grades)
    held = [i for i in truth if i % 4 == 0 and len(rows[i][1].split()) > 5]
    assert np.mean([round(got[i]["expected_grade"]) == truth[i] for i in held]) > 0.9
    assert np.mean([got[i]["kept"] == (truth[i] == 2) for i in held]) > 0.9
    again = quality.train_quality(docs, labels)
    assert np.array_equal(model.weights, again.weights)


def test_quality_edge_cases(spark):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(3, 1), (4, None)], "doc_id bigint, quality int")
    for labels in (none, one):
        scored = quality.score_quality(docs, quality.train_quality(docs, labels))
        assert scored.count() == len(awkward()) and scored.select("tail_prob").where("tail_prob is null").count() == 0
    rows, grades = graded(80)
    model = quality.train_quality(documents(spark, rows), spark.createDataFrame(grades, "doc_id bigint, quality int"))
    assert quality.score_quality(docs, model).count() == len(awkward())
    assert quality.score_quality(documents(spark, []), model).count() == 0


def test_all_of_an_unspaced_text_counts():
    rng = random.Random(4)
    calm = lambda: "".join(rng.choice("東京大阪名古屋") for _ in range(1000))
    loud = lambda: "".join(rng.choice("ABCDEF") + "!!" for _ in range(333))
    head = "文" * 64
    rows = [(k % 2, head + (calm() if k % 2 else loud())) for k in range(60)]
    read = []
    for grade, text in rows[:40]:
        own, n = quality.slots(text)
        held, counts = np.unique(own, return_counts=True)
        read.append((grade, held, counts / (n + quality.DRAW)))
        assert n == -(-len(text) // quality.PIECE)
    model = quality.fit(read)
    etas = [(model.eta(text) > model.thresholds[0]) == bool(grade) for grade, text in rows[40:]]
    assert all(etas)
    for k in (1, 63, 64):
        assert quality.pieces(["a" * k, "b"]) == ["a" * k, "b"]
    assert "".join(quality.pieces(["ab" * 500])) == "ab" * 500 and max(map(len, quality.pieces(["ab" * 500]))) <= quality.LONG
    # Once more, now that pieces are known.
    assert quality.slots("x " + "ab" * 500)[1] == 1 + len(quality.pieces(["ab" * 500]))


def insulted(count=900, seed=2):
    rng = random.Random(seed)
    bad = ["grumblefink", "snotweasel", "dribblox", "vexquat", "vexquem", "vexquor"]
    rows, labels = [], []
    for k, (_, text) in enumerate(prose(count, seed, 2000)):
        toxic = rng.random() < 0.3
        words = text.split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = insulted()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # Labels of held-out rows are turned round: they must not matter.
    table = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in labels], "doc_id bigint, toxic int")
    docs = documents(spark, rows)
    got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table)).withColumn("held_out", toxicity.held_out()).collect()
    truth = dict(labels)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    tried = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in tried]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_label_model_weighs_correlated_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    copied = np.concatenate([votes, votes[:, 3:], votes[:, 3:], votes[:, 3:]], axis=1)
    model = toxicity.fit_label_model(copied, np.where(votes.sum(1) > 0, 0.8, 0.2))
    assert model.weight[:3].min() > model.weight[3:].max()
    assert np.mean((model.posterior(copied) > 0.5) == truth) > 0.88


def test_toxicity_edge_cases(spark):
    docs = documents(spark, awkward())
    for rows in ([], [(3, 1)], [(3, 0), (4, None)], [(3, 1), (4, 0), (6, 1)]):
        model = toxicity.train_toxicity(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == len(awkward())
    assert toxicity.score_toxicity(documents(spark, []), model).count() == 0


def words_of(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def brute_base(rows):
    c = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in rows:
        if not held(i):
            c.update(words_of(t))
            c[None] += 1
    n, d = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    out = Counter()
    for i, t in rows:
        words = [*words_of(t), None]
        out[i, held(i), len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 0.1) / d) for w in words), 4)] += 1
    return out


@pytest.mark.parametrize("looked_up", [5, 1 << 18])
@pytest.mark.parametrize("rows", [prose(150, seed=6), awkward()], ids=["prose", "awkward"])
def test_language_model_counts(spark, monkeypatch, rows, looked_up):
    monkeypatch.setattr(language_model, "LOOKED_UP", looked_up)
    monkeypatch.setattr(language_model, "SEEN", 0)
    got = language_model.score_texts(documents(spark, rows)).collect()
    keys = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter((*(r[k] for k in keys), round(r["base_score"], 4)) for r in got) == brute_base(rows)
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("looked_up", [300, 1 << 18])
def test_language_model_scores(spark, monkeypatch, looked_up):
    """Against a plain evaluation, word by word, of the model as it is before any training."""
    rows = [(i, t) for i, t in prose(60, seed=8, vocabulary=900) + awkward() if i is not None]
    monkeypatch.setattr(language_model, "LOOKED_UP", looked_up)
    monkeypatch.setattr(language_model, "trained", lambda training, shared, model, passes: model)
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in language_model.score_texts(documents(spark, rows)).collect())
    key = lambda w: int(language_model.keys_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in words_of(t))
    ends = sum(zlib.crc32(str(i).encode()) % 10 > 0 for i, _ in rows)
    bits = language_model.class_bits(sum(c.values()) + ends)
    count, letters = 1 << bits, 1 << bits - 2
    end = count - letters - 1
    held = min(end, least_held(c, looked_up))  # all words of a level of counts are looked up, or none
    own = {w: k for k, w in enumerate(sorted(c, key=lambda w: (-c[w], key(w)))[:held])}
    kind = lambda w: own.get(w, end + 1 + ((key(w) & (1 << 64) - 1) >> 64 - language_model.TAIL_BITS) % letters)
    mass, places = np.zeros(count), np.ones(count)
    for w, n in c.items():
        mass[kind(w)] += n
        places[kind(w)] += 1
    mass[end] = ends
    model = language_model.beginning((mass + 0.5) / (mass + 0.5).sum())
    want = Counter()
    for i, t in rows:
        total, v1, v2 = 0.0, end, end
        for w in [*words_of(t), None]:
            k = end if w is None else kind(w)
            s = model.target.astype(float) @ (model.first @ model.context[v1] + model.second @ model.context[v2]) + model.bias
            total += s[k] - np.log(np.exp(s).sum())
            if k > end:
                total += math.log((c[w] + 0.1) / (mass[k] + 0.1 * places[k]))
            v1, v2 = k, v1
        want[i, len(words_of(t)) + 1, round(total / math.log(10), 3)] += 1
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in sorted(got.elements())], [x[2] for x in sorted(want.elements())], atol=0.02, rtol=1e-4)


def least_held(c, most):
    """How many words have a count whose level, and all above it, are at most `most` words."""
    levels = Counter(math.floor(8 * math.log2(n)) for n in c.values())
    held = 0
    for level in sorted(levels, reverse=True):
        if held + levels[level] > most:
            return held
        held += levels[level]
    return held


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    n = 40
    chain = rng.dirichlet(np.full(n, 0.1), (n, n))
    line = [0, 0]
    for _ in range(60_000):
        line.append(int(rng.choice(n, p=0.5 * chain[line[-1], 0] + 0.5 * chain[0, line[-2]])))
    line = np.array(line)
    windows = (line[2:], line[1:-1], line[:-2])
    unigram = (np.bincount(line, minlength=n) + 0.5) / (len(line) + 0.5 * n)
    trainer = language_model.Trainer(language_model.beginning(unigram), unigram, 1)
    for _ in range(6):
        trainer.read(windows)
    a, b, z = trainer.model.tables()
    logs = a[:, None, :] + b[None, :, :] - z[:, :, None]
    assert np.allclose(np.exp(logs).sum(2), 1)
    one = np.array([[p.mean() for p in (logs[windows[1], windows[2], windows[0]], np.log(unigram)[windows[0]])]])
    assert one[0, 0] > one[0, 1] + 0.25


def test_language_model_beats_single_words(spark):
    rng = random.Random(3)
    pairs = [f"w{k} v{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(pairs) for _ in range(150))) for k in range(120)]
    got = language_model.score_texts(documents(spark, rows)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert got["s"] > got["b"] + 0.3 * got["n"]


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = language_model.score_texts(documents(spark, [(held, "some words")])).collect()
    assert [(r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0.0, 0.0)]
    assert language_model.score_texts(documents(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, _ = insulted(300, 4)
    rows += [(1000 + i, t) for i, t in rows[:40]] + [(2000, None), (2001, ""), (2002, None)]
    docs = documents(spark, rows, clashing=False)
    labels = [(i, int(i % 3 > 0), int("gr" in (t or "") and "umble" in t)) for i, t in rows[:200]]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "exact dedup", "n-gram jaccard join", "packing"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
    ids = {r["doc_id"] for r in now.collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == ids
