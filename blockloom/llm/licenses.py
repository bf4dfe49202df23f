"""License scans: phrases by place, and templates by an exact set-similarity join.

A text's blocks are runs of `BLOCK` words, one starting at every `BLOCK / 2` words. A block matches a template if
it holds at least `CONTAINMENT` of the template's distinct words. Template words are ordered by how many
documents of the whole corpus hold them, rarest first; a block that matches must hold one of the first
|T| - need + 1 words (prefix), have at least `need` distinct words (length), and, if its first shared
word is the i-th, still have |T| - i >= need (positional). What passes is verified, and must hold those of the template's words
that tell related licenses apart (`DISTINGUISHING`), however short the template. Only documents that hold some
prefix word look at blocks at all. Templates are a fixed list; the words counted are theirs alone.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._shared import documents

CONTAINMENT = 0.85
BLOCK = 64

#: The base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The opening words of public license notices, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-notice", "this work is licensed under the gnu general public license version"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words without which a block matches no template that has them: all others are common to related licenses.
DISTINGUISHING = frozenset({b"apache", b"gnu", b"mozilla", b"nc", b"sharealike"})

#: ASCII bytes that are no letters or digits become spaces, A-Z become a-z; bytes from 0x80 on stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def phrase_places(words: list[bytes], held: set[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    if not held.issuperset(phrase):
        return []
    found, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if tuple(words[at : at + n]) == phrase:
            found.append(at)


def word_frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents."""
    wanted = frozenset(w for _, t in templates for w in t.encode().split())

    def run(batches):
        counts = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in raw_texts(batch, "__text"):
                for w in wanted.intersection(words_of(text)):
                    counts[w] += 1
        names = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in names]), pa.array([counts[w] for w in names], pa.int64())], ["word", "n"])

    counted = docs.select(docs[text_col].alias("__text")).mapInArrow(run, "word string, n bigint")
    return {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Templates:
    """The templates with their words in the global order, and an index of their prefixes."""

    def __init__(self, frequencies: dict[bytes, int], templates=TEMPLATES, containment: float = CONTAINMENT):
        self.rows = []
        self.by_prefix: dict[bytes, list[int]] = {}
        for k, (label, text) in enumerate(templates):
            ordered = sorted(set(text.encode().split()), key=lambda w: (frequencies.get(w, 0), w))
            need = max(1, ceil(containment * len(ordered) - 1e-9))
            self.rows.append((label, ordered, need, DISTINGUISHING.intersection(text.encode().split())))
            for w in ordered[: len(ordered) - need + 1]:
                self.by_prefix.setdefault(w, []).append(k)
        self.prefixes = frozenset(self.by_prefix)

    def match(self, words: list[bytes], held: set[bytes], block: int = BLOCK) -> dict[str, float]:
        """Label: the greatest containment of one of its templates in any block that matches."""
        found: dict[str, float] = {}
        hit = self.prefixes & held
        if not hit:
            return found
        step = block // 2
        starts: dict[int, set[int]] = {}
        for at, w in enumerate(words):
            if w in hit:
                for start in {at // step * step, max(0, at // step * step - step)}:
                    starts.setdefault(start, set()).update(self.by_prefix[w])
        for start, candidates in starts.items():
            own = set(words[start : start + block])
            for k in candidates:
                label, ordered, need, must = self.rows[k]
                if len(own) < need or not own.issuperset(must):
                    continue
                first = next((i for i, w in enumerate(ordered) if w in own), len(ordered))
                if len(ordered) - first < need:
                    continue
                share = len(own.intersection(ordered)) / len(ordered)
                if share * len(ordered) >= need - 1e-9:
                    found[label] = max(found.get(label, 0.0), share)
        return found


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    first_word and last_word are the smallest and largest start of a base phrase, null if there is none; the score is 1
    with a base phrase, else the greatest containment of a matching template, else 0. A null or empty text has no words
    and no labels. Texts are read whole; rows that repeat give equal rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    known = Templates(word_frequencies(docs, text_col, templates), templates, containment)
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]

    def run(batches):
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for text in raw_texts(batch, "__text"):
                words = words_of(text)
                held = set(words)
                places = [(at, label) for p, label in phrases for at in phrase_places(words, held, p)]
                base = {label for _, label in places}
                more = known.match(words, held)
                at = [x for x, _ in places]
                rows.append(
                    (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                     ",".join(sorted(base | set(more))), 1.0 if base else max(more.values(), default=0.0))
                )
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))
    out = read.mapInArrow(
        run,
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    )
    return out.withColumnRenamed("id", id_col)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def sql(templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """What scan_licenses gives, by looking at every block for every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for label, text in templates:
        own = sorted(set(text.split()))
        must = [w for w in own if w.encode() in DISTINGUISHING]
        rows.append(f"('{label}', {quoted(own)}, {quoted(must)}::VARCHAR[], {max(1, ceil(containment * len(own) - 1e-9))})")
    found = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(phrase.split()))
        found.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {same}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_concat({found[0]}, list_concat({found[1]}, {found[2]})) AS f FROM d),
t(label, own, must, need) AS (VALUES {", ".join(rows)}),
b AS (SELECT doc_id, list_distinct(w[start + 1:start + {BLOCK}]) AS block FROM (SELECT doc_id, w, unnest(range(0, len(w), {BLOCK // 2})) AS start FROM d)),
m AS (SELECT doc_id, label, max(CAST(len(list_intersect(own, block)) AS DOUBLE) / len(own)) AS share FROM b, t
    WHERE list_has_any(block, own) AND list_has_all(block, must) AND len(list_intersect(own, block)) >= need GROUP BY doc_id, label),
more AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM m GROUP BY doc_id),
r AS (SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(f) AS BIGINT) AS n_base, list_min(list_transform(f, lambda x: x.at)) AS first_word,
    list_max(list_transform(f, lambda x: x.at)) AS last_word, list_distinct(list_transform(f, lambda x: x.label)) AS base, coalesce(more.labels, []) AS added, more.share FROM p LEFT JOIN more USING (doc_id))
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(base, added))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score FROM r
"""


OP6_SQL = sql()
