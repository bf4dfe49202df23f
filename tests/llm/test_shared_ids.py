"""Near copies among rows that share an id."""

import random

from blockloom.llm import jaccard_join

from .fixtures import documents


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(100)) for _ in range(4))
    near = lambda t: t + " tail"
    rows = [(3, near(a)), (7, a), (7, b), (8, c), (8, d), (9, near(d)), (10, near(b)), (11, c), (12, a), (12, near(a)), (13, ""), (13, d + " x y"), (None, "own text")]
    want = [(3, near(a)), (7, b), (8, c), (8, d), (13, ""), (None, "own text")]
    docs = documents(spark, rows).selectExpr("*", "1 AS __row", "'own' AS __text", "2 AS __n", "3 AS __id", "4 AS __key", "5 AS __whole")
    got = jaccard_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
