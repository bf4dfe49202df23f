"""Small tables with the cases every operator must take."""

from __future__ import annotations

import random

#: Columns whose names an operator might use itself.
CLASHING = "id string, hash string, score string, kept string, block string, row string, component string, n string"


def documents(spark, rows, clashing=True):
    """rows: (doc_id, text)."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if clashing:
        full = [(*r, *["x"] * 8) for r in full]
        schema += ", " + CLASHING
    return spark.createDataFrame(full, schema)


def awkward(seed=1):
    """Nulls, empty and white texts, one very long text, repeats, ties, letters of several scripts."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "River", "stone", "café", "naïve", "Größe", "ñandú", "it's", "x'sad", "42", "a.b!c", "Æther", "東京", "🙂"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(30_000)
    same = prose(60)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "word"), (4, "Two words"), (5, long), (6, same), (7, same.upper()), (8, same), (9, same + " tail")]
    rows += [(k, prose(rng.randrange(1, 200))) for k in range(10, 40)]
    return rows + [(8, same), (None, "no id at all"), (None, None)]


def prose(count, seed=3, vocabulary=400):
    """Rows of invented prose with exact and near copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9))) for _ in range(vocabulary)]
    rows = []
    for k in range(count):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.45:
            own = rng.choice(rows)[1].split()
            for _ in range(max(1, len(own) // rng.choice([10, 40, 100]))):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 250)))
        rows.append((k, text))
    return rows
