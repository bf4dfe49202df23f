"""N-gram Jaccard join by prefix trees.

A document's set: its distinct word n-grams, as 64-bit keys; with fewer words, the whole sequence as one. Two documents link when
their sets' Jaccard similarity reaches the threshold. Documents with equal sets are one from here on.

A key is a class of frequency before a hash of the n-gram, so its value is its place in the global order: n-grams of rare words first,
those of frequent words later, those that are common themselves last. The classes come from counts over all documents, held in
tables of fixed size by hash, where rare words may share a place; any total order gives right results, this one makes chance meetings of long
documents rare. Two sets that link share one of their first n - ceil(t n) + 1 n-grams (their prefixes). Prefixes are dealt by
n-gram into buckets of bounded size, in blocks of 16 bytes an n-gram; each n-gram that at least two prefixes share makes a group, and groups
with the same members are one. A group's sets go into a trie in the global order, and each set traverses the trie once: documents
that share a beginning share the overlap counted there, and a subtree is left where even all that remains of both
sides can't reach the needed overlap. Sets that are already connected aren't compared again.

Groups of more than `RUN` sets: a first round gives each document to one of them only, and what it connects makes most of them
needless. In those that still hold two components, sets that are far from the main component are many or few. Where they are
many, the group is replaced by groups for pairs of n-grams: sets that link share two of their first n - ceil(t n) + 2, too. Else
sets meet in windows of sizes that can link, runs of the others meeting each run of the main component, whose own runs never
meet and whose own sets don't search. Groups with the same main component are one where fewer pairs meet so: those outside meet it once,
not once for each n-gram. So no group meets in one task. N-grams that a great share of all sets have in their prefixes are found by counts first and
treated as such groups without passing through a bucket.

Before texts are sent, bucket counts of the sets rule out pairs that can't reach the threshold; texts are sent for the others only, picked
by a bitmap of their ids of at most `BITMAP` bits. The plan is the same at every size: the bitmap only lets more pass when it is full.
The links found span the components; these come from repeated joins, never on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

from ..session import ship
from ._bytes import flat, lean, mixed, row_groups, runs, word_hashes
from ._shared import documents, dropped, written

#: Places of the tables of frequencies, a byte each, as powers of two.
WORD_BITS, GRAM_BITS = 20, 22
WORDS_FROM, COMMON_FROM = 8, 4
DOCS_AT_ONCE = 2_000
#: Places of common n-grams that are told apart, at most; the rarest beyond that count as not common.
COMMON = 1 << 18
RUN = 400
#: From so many runs of sets outside the main component on, a group is split by pairs of n-grams.
MANY = 4
TOKENS_A_BUCKET = 500_000
#: N-grams in more than one of so many prefixes don't pass through a bucket.
HOT = 1_000
HOT_FROM = 100_000
BITMAP = 1 << 27

FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def needed(a, b, num: int, den: int):
    """The least overlap with which sets of these sizes link: den * o >= num * (a + b - o)."""
    return -(-num * (a + b) // (num + den))


class Order:
    """The global order: classes of frequency by hash, for words and for n-grams."""

    def __init__(self, size: int, words: np.ndarray, grams: np.ndarray):
        self.size, self.words, self.grams = size, words, grams


def no_order(size: int) -> Order:
    return Order(size, np.zeros(1 << WORD_BITS, np.uint8), np.zeros(1 << GRAM_BITS, np.uint8))


def word_place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def hashed_grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words."""
    n = len(words) - size + 1
    total = np.full(max(n, 0), size, np.uint64)
    for i in range(size if n > 0 else 0):
        total = mixed(total + words[i : i + n]) * FACTORS[i % len(FACTORS)]
    return mixed(total)


def gram_rows(data: np.ndarray, starts: np.ndarray, order: Order) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the keys of its n-grams in their places, repeats included, and its words' hashes."""
    words, before = word_hashes(data, starts)
    size = order.size
    hashes, scores = hashed_grams(words, size), np.concatenate([[0], np.cumsum(order.words[word_place(words)], dtype=np.int64)])
    keys = keyed(hashes, scores[size:] - scores[:-size] if len(hashes) else np.zeros(0, np.int64), order)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        own = words[lo:hi]
        if 0 < hi - lo < size:
            yield keyed(hashed_grams(own, hi - lo), scores[hi : hi + 1] - scores[lo : lo + 1], order), own
        else:
            yield keys[lo : max(lo, hi - size + 1)], own


def keyed(hashes: np.ndarray, scores: np.ndarray, order: Order) -> np.ndarray:
    """Keys: ten bits of class and 54 of hash."""
    hashes = hashes >> np.uint64(10)
    common = order.grams[gram_place(hashes)].astype(np.int64)
    kind = np.where(common > 0, 512 + common, np.minimum(scores, 511))
    return kind.astype(np.uint64) << np.uint64(54) | hashes


def gram_place(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(54 - GRAM_BITS)).astype(np.int64) & (1 << GRAM_BITS) - 1


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def sets_of(column: pa.Array, order: Order) -> Iterator[np.ndarray]:
    """The set of each row, ascending."""
    data, starts = flat(column)
    for first, stop in row_groups(starts):
        for keys, _ in gram_rows(data[starts[first] : starts[stop]], starts[first : stop + 1] - starts[first], order):
            yield distinct(keys)


def identity(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as signed integers."""
    return tuple(int(mixed(own + f).sum().astype(np.int64)) for f in (FACTORS[0], FACTORS[1]))


def corpus_order(docs: DataFrame, text_col: str, size: int) -> Order:
    """Counts words and n-grams over all documents: those that several of the documents a task holds at a time share."""

    def run(batches):
        blank, held, words, docs_held = no_order(size), [], [], 0

        def rows():
            for kind, places, least in (("gram", gram_place(np.concatenate(held)), COMMON_FROM), ("word", word_place(np.concatenate(words)), WORDS_FROM)):
                n = np.bincount(places)
                at = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["kind", "at", "n"])

        for batch in batches:
            data, starts = flat(batch.column("__text"))
            for first, stop in row_groups(starts):
                for keys, own in gram_rows(data[starts[first] : starts[stop]], starts[first : stop + 1] - starts[first], blank):
                    held.append(distinct(keys))
                    words.append(own)
                docs_held += stop - first
                if docs_held >= DOCS_AT_ONCE:
                    yield from rows()
                    held, words, docs_held = [], [], 0
        if held:
            yield from rows()

    counts = docs.select(F.col(text_col).alias("__text")).mapInArrow(lean(run), "kind string, at int, n bigint")
    counts = written(counts.groupBy("kind", "at").agg(F.sum("n").alias("n")), "jaccard-counts")
    level = F.floor(8 * F.log2("n")).cast("int")
    heights = {r["level"]: r["held"] for r in counts.where("kind = 'gram'").groupBy(level.alias("level")).agg(F.count("*").alias("held")).collect()}
    least, room = 0, COMMON
    for h in sorted(heights, reverse=True):
        room -= heights[h]
        if room < 0:
            least = h + 1
            break
    tables = {}
    for kind, bits, wanted, top in (("word", WORD_BITS, F.lit(True), 102), ("gram", GRAM_BITS, level >= least, 255)):
        got = counts.where((F.col("kind") == kind) & wanted).select("at", "n").toArrow()
        n = np.asarray(got["n"].to_numpy(), np.float64)
        tables[kind] = np.zeros(1 << bits, np.uint8)
        tables[kind][got["at"].to_numpy()] = np.minimum(4 * np.log2(n + 1), top).astype(np.uint8)
    dropped(counts)
    return Order(size, tables["word"], tables["gram"])


def bucket_counts(own: np.ndarray) -> np.ndarray:
    """How many n-grams of a set have each value of their last bits; about n / 4 values, a power of two."""
    bits = max(3, (len(own) // 4).bit_length())
    n = np.bincount((own & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8 if n.max() < 256 else np.uint32)


def counts_of(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, np.uint8 if len(held) == 1 << max(3, (n // 4).bit_length()) else np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, order) -> DataFrame:
    """id, n, h1, h2, prefix, counts: size of the set, 128 bits that tell sets apart, the prefix and one n-gram more, the bucket counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for own in sets_of(batch.column("__text"), order.value):
                first = own[: prefix_length(len(own), num, den) + 1 if len(own) else 0]
                rows.append((len(own), *identity(own), first.tobytes(), bucket_counts(own).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n", "h1", "h2", "prefix", "counts"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    return read.mapInArrow(lean(run), "id bigint, n bigint, h1 bigint, h2 bigint, prefix binary, counts binary")


def prefix_groups(tokens: DataFrame, sets: int) -> DataFrame:
    """gram, size, members: the groups with two members or more, one for each set of members; large ones in several rows.

    tokens: rep, grams (binary, 64-bit). sets: how many reps there are. A group's members come in arrays of at most RUN.
    """
    tokens = written(tokens, "jaccard-tokens")
    total = tokens.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0)).alias("n")).first()["n"] // 8
    buckets = max(64, -(-total // TOKENS_A_BUCKET))
    spark = tokens.sparkSession
    most = max(HOT_FROM, sets // HOT)

    def often(batches):
        for batch in batches:
            data, _ = flat(batch.column("grams"))
            grams, n = np.unique(data.view(np.uint64), return_counts=True)
            some = n > batch.num_rows // (2 * HOT) + 1
            yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(n[some], pa.int64())], ["gram", "n"])

    hot = np.zeros(0, np.uint64)
    if sets > most:  # no more grams than prefix length * HOT can be so frequent
        found = tokens.select("grams").mapInArrow(lean(often), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        hot = np.sort(found.where(F.col("n") > most).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast(hot)

    def dealt(batches):
        for batch in batches:
            data, starts = flat(batch.column("grams"))
            grams, reps = data.view(np.uint64), np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), np.diff(starts) // 8)
            if len(held.value):
                own = held.value[np.minimum(np.searchsorted(held.value, grams), len(held.value) - 1)] == grams
                grams, reps = grams[~own], reps[~own]
            bucket = (mixed(grams) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            grams, reps = grams[by], reps[by]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            rows = [(k, grams[a:b].tobytes(), reps[a:b].tobytes()) for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "grams", "reps"])

    def grouped(batches):
        for table in by_unit(batches, "bucket"):
            grams, reps = (flat(table.column(c).combine_chunks())[0].view(np.uint64) for c in ("grams", "reps"))
            by = np.lexsort((reps, grams))
            grams, reps = grams[by], reps[by].view(np.int64)
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            size = np.diff(np.append(first, len(grams)))
            mark = np.add.reduceat(mixed(mixed(reps.view(np.uint64))), first)
            some = np.flatnonzero(size >= 2)
            parts = -(-size[some] // RUN)
            which = np.repeat(some, parts)
            start = first[which] + runs(np.zeros(len(parts), np.int64), parts) * RUN
            length = np.minimum(RUN, first[which] + size[which] - start)
            members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(reps[runs(start, length)]))
            columns = [pa.array(x) for x in (grams[first[which]].view(np.int64), size[which], mark[which].view(np.int64), reps[first[which]])]
            yield pa.RecordBatch.from_arrays([*columns, members], ["gram", "size", "mark", "anchor", "members"])

    deal = tokens.mapInArrow(lean(dealt), "bucket bigint, grams binary, reps binary").repartition("bucket").sortWithinPartitions("bucket")
    found = written(deal.mapInArrow(lean(grouped), "gram bigint, size bigint, mark bigint, anchor bigint, members array<bigint>"), "jaccard-grouped")
    one = found.groupBy("size", "mark", "anchor").agg(F.min("gram").alias("gram")).select("gram")
    members = found.join(one, "gram", "left_semi").select("gram", "size", F.explode("members").alias("rep"))
    if len(hot):
        wanted = held.value.view(np.int64)

        def picked(batches):
            for batch in batches:
                data, starts = flat(batch.column("grams"))
                grams, reps = data.view(np.int64), np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), np.diff(starts) // 8)
                own = np.isin(grams, wanted)
                yield pa.RecordBatch.from_arrays([pa.array(grams[own]), pa.array(np.full(int(own.sum()), most + 1)), pa.array(reps[own], pa.int64())], ["gram", "size", "rep"])

        members = members.union(tokens.mapInArrow(lean(picked), "gram bigint, size bigint, rep bigint"))
    members = written(members, "jaccard-members")
    dropped(tokens, found)
    return members


def by_unit(batches, column: str) -> Iterator[pa.Table]:
    """The rows of each unit, of batches in which units follow one another."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table])
        if not table.num_rows:
            continue
        units = table.column(column).combine_chunks().to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(units[1:] != units[:-1]) + 1
        start = 0
        for end in ends.tolist():
            yield table.slice(start, end - start)
            start = end
        left = table.slice(start)
    if left is not None and left.num_rows:
        yield left


class Trie:
    """Sets in the global order as a radix tree; nodes are runs of n-grams that the sets below share."""

    def __init__(self, sets: list[np.ndarray]):
        """sets: ascending ranks, themselves in lexicographic order."""
        self.sets = sets
        shared = [0]
        for a, b in zip(sets, sets[1:], strict=False):
            k = min(len(a), len(b))
            apart = np.flatnonzero(a[:k] != b[:k])
            shared.append(int(apart[0]) if len(apart) else k)
        sizes = [len(s) for s in sets]
        self.nodes: list[tuple] = []  # segment, depth behind it, first set, set behind the last, least and greatest size, children
        self.roots = self._grow(shared, sizes)

    def _grow(self, shared: list[int], sizes: list[int]) -> list[int]:
        roots: list[int] = []
        todo = [(0, len(sizes), 0, roots)]
        while todo:
            lo, hi, depth, siblings = todo.pop()
            start = lo
            for k in range(lo + 1, hi + 1):
                if k == hi or shared[k] <= depth:
                    end = min([sizes[start], *shared[start + 1 : k]])
                    children: list[int] = []
                    siblings.append(len(self.nodes))
                    self.nodes.append((self.sets[start][depth:end], end, start, k, min(sizes[start:k]), max(sizes[start:k]), children))
                    if k - start > 1:
                        first = start
                        while first < k and sizes[first] == end:
                            first += 1
                        if first < k:
                            todo.append((first, k, end, children))
                    start = k
        return roots

    def search(self, x: int, mask: np.ndarray, num: int, den: int, skip, mains: list[int] | None = None):
        """Sets behind x that link with it; skip(y) tells which needn't be found.

        mains: for each set how many before it are of the main component, which x is not of; those before x are searched, too.
        """
        own = self.sets[x]
        n = len(own)
        todo = [(r, 0) for r in self.roots]
        while todo:
            k, overlap = todo.pop()
            segment, depth, lo, hi, least, most, children = self.nodes[k]
            if den * most < num * n or den * n < num * least:
                continue
            main = mains[hi] - mains[lo] if mains else 0
            if hi <= x + 1 and not main or main == hi - lo and skip(lo):
                continue
            if len(segment):
                overlap += int(np.count_nonzero(mask[segment]))
                rest = n - int(np.searchsorted(own, segment[-1], side="right"))
            else:
                rest = n
            if overlap + min(rest, most - depth) < needed(n, least, num, den):
                continue
            y = lo
            while y < hi and len(self.sets[y]) == depth:
                if (y > x or main and mains[y + 1] > mains[y]) and overlap >= needed(n, depth, num, den) and not skip(y):
                    yield y
                y += 1
            todo += [(c, overlap) for c in children]


class Union:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]
        self.parts = len(first)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.parts -= 1


def links_of(found: list[np.ndarray], ids: list[int], components: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all sets that links connect, but for those of one component already. found: sets, ascending."""
    vocabulary, ranks = np.unique(np.concatenate(found), return_inverse=True)
    ends = np.cumsum([len(s) for s in found])
    ranked = np.split(ranks, ends[:-1])
    at = sorted(range(len(ranked)), key=lambda i: ranked[i].astype(">u4").tobytes())
    sets = [ranked[i] for i in at]
    labels = [components[i] for i in at]
    main = max(Counter(labels).items(), key=lambda c: c[1])[0]
    mains = [0, *accumulate(int(label == main) for label in labels)]
    trie, union = Trie(sets), Union(labels)
    mask, out = np.zeros(len(vocabulary), bool), []
    for x in range(len(sets)):
        if union.parts == 1:
            break
        if labels[x] == main:  # the others search it
            continue
        mask[sets[x]] = True
        for y in trie.search(x, mask, num, den, lambda y, x=x: union.find(y) == union.find(x), mains):
            out.append((ids[at[x]], ids[at[y]]))
            union.join(x, y)
        mask[sets[x]] = False
    return out


def search_units(units: DataFrame, docs: DataFrame, id_col: str, text_col: str, num: int, den: int, order) -> DataFrame:
    """a, b: links within units. units: unit, rep, h1, component. Of rows that share an id, those whose set is the unit's are meant."""

    def run(batches):
        for table in by_unit(batches, "unit"):
            found: dict[tuple, tuple] = {}
            rows = zip(table.column("rep").to_pylist(), table.column("h1").to_pylist(), table.column("component").to_pylist(), sets_of(table.column("__text").combine_chunks(), order.value), strict=True)
            for rep, h1, component, own in rows:
                if identity(own)[0] == h1:
                    found[rep, h1] = (own, component)
            if len(found) > 1:
                got = links_of([own for own, _ in found.values()], [rep for rep, _ in found], [c for _, c in found.values()], num, den)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("__text"))
    texts = texts.where(in_bitmap(units.select("rep").distinct(), "rep"))
    joined = units.join(texts, "rep").select("unit", "rep", "h1", "component", "__text")
    return joined.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "a bigint, b bigint")


def in_bitmap(ids: DataFrame, column: str):
    """A condition that holds for all of ids and few others: a bit for each hash, 16 times as many bits as ids, BITMAP at most."""
    spark = ids.sparkSession
    ids = written(ids, "jaccard-ids")
    size = min(BITMAP, 1 << max(16, (16 * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    word = F.shiftright(slot(column), 5).cast("int")
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), {size}L) & 31 AS int))")).alias("bits")).toArrow()
    table = np.zeros(size >> 5, np.uint32)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    held = spark.sparkContext.broadcast(table)
    dropped(ids)

    @pandas_udf("boolean")
    def known(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((held.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return known(slot(column))


def connected(links: DataFrame) -> DataFrame:
    """v, component: the smallest vertex that links reach, for all vertices of links (columns a and b)."""
    edges = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).toDF("v", "w").distinct(), "links")
    labels = written(edges.groupBy("v").agg(F.least("v", F.min("w")).alias("component")), "labels")
    while True:
        near = edges.join(labels.toDF("w", "its"), "w").groupBy("v").agg(F.min("its").alias("its"))
        lower = labels.join(near, "v").select("v", "component", F.least("component", "its").alias("low"))
        above = labels.toDF("low", "top")
        step = written(lower.join(above, "low").select("v", "component", F.least("low", "top").alias("new")), "labels")
        dropped(labels)
        done = step.where("new <> component").isEmpty()
        labels = step.select("v", F.col("new").alias("component"))
        labels.folder = step.folder
        if done:
            dropped(edges)
            return labels


def screen(members: DataFrame, num: int, den: int) -> DataFrame:
    """The members (gram, size, rep, h1, component, n) for whom some fellow of another component may link by size and bucket counts.

    Sets can't share more than the smaller count in each bucket; the sum of these bounds the overlap. members: these and counts.
    """

    def run(batches):
        for table in by_unit(batches, "unit"):
            stays = may_link(table, num, den)
            if stays.any():
                yield from table.filter(pa.array(stays)).select(["gram", "size", "rep", "h1", "component", "n"]).combine_chunks().to_batches()

    joined = in_units(members, num, den).select("unit", "gram", "size", "rep", "h1", "component", "n", "counts")
    kept = joined.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "gram bigint, size bigint, rep bigint, h1 bigint, component bigint, n bigint")
    return kept.distinct()


def may_link(table: pa.Table, num: int, den: int) -> np.ndarray:
    n, component = (np.asarray(table.column(c).to_numpy()) for c in ("n", "component"))
    stays = np.zeros(len(n), bool)
    if len(n) < 2 or (component == component[0]).all():
        return stays
    by = np.argsort(n, kind="stable")
    n, component = n[by], component[by]
    held = table.column("counts").to_pylist()
    counts = [counts_of(held[i], k) for i, k in zip(by.tolist(), n.tolist(), strict=True)]
    widths = np.array([len(c) for c in counts])
    reach = np.searchsorted(n * num, n * den, side="right")  # behind the last that x may link with by size
    folded: dict[int, tuple[int, np.ndarray]] = {}
    ok = np.zeros(len(n), bool)
    for x in range(len(n) - 1):
        stop = int(reach[x])
        if stop <= x + 1:
            continue
        width = int(widths[x])
        if width not in folded:
            last = int(reach[np.flatnonzero(widths == width)[-1]])
            folded[width] = x, np.stack([c.reshape(-1, width).sum(0, dtype=np.int32) for c in counts[x:last]])
        base, matrix = folded[width]
        some = np.arange(x + 1, stop)
        some = some[(component[some] != component[x]) & ~(ok[some] & ok[x])]
        if len(some):
            most = np.minimum(matrix[some - base], matrix[x - base]).sum(1)
            near = some[most >= needed(n[x], n[some], num, den)]
            ok[near] = True
            ok[x] |= len(near) > 0
    stays[by] = ok
    return stays


def in_units(members: DataFrame, num: int, den: int) -> DataFrame:
    """members with their units: a group, or what a group of more than RUN sets is split into.

    members: gram, size, rep, component, n and others.
    """
    few = members.where(F.col("size") <= RUN).withColumn("unit", F.xxhash64("gram"))
    of = F.floor(F.log("n") / F.lit(1.0001 * log(den / num))).cast("int")
    window = F.explode(F.array(of, of + 1)).alias("window")
    many = members.where(F.col("size") > RUN).select("*", window).withColumn("key", F.xxhash64("gram", "window"))
    held = many.groupBy("key", "component").agg(F.count("*").alias("held"))
    held = held.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.max("held").alias("mains"), F.sum("held").alias("all"))
    held = held.where("all > mains").select("key", "main", F.ceil(F.col("mains") / RUN).alias("j"), F.ceil((F.col("all") - F.col("mains")) / RUN).alias("k"))
    many = many.join(held, "key").withColumn("in_main", F.col("component") == F.col("main"))
    many = many.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("in_main"), F.col("j")).otherwise(F.col("k"))))
    turn = lambda c: F.sequence(F.lit(0), c - 1)
    with_main = lambda a, b: F.xxhash64("key", F.lit(1), a, b)
    with_rest = lambda o: F.xxhash64("key", F.lit(2), F.least("own", o), F.greatest("own", o))
    units = F.when(F.col("in_main"), F.transform(turn(F.col("k")), lambda o: with_main(F.col("own"), o))).otherwise(
        F.concat(F.transform(turn(F.col("j")), lambda o: with_main(o, F.col("own"))), F.transform(turn(F.col("k")), with_rest))
    )
    many = many.select(*members.columns, F.explode(units).alias("unit"))
    return few.select(*members.columns, "unit").unionByName(many)


def by_main(members: DataFrame) -> DataFrame:
    """members (gram, size, rep, h1, component, n), the groups of more than RUN sets that have the same main component made one where fewer pairs meet so.

    The n-grams of a large component's prefixes make a group each, with nearly the same sets: in one group, those outside meet it once.
    """
    large = members.where(F.col("size") > RUN)
    held = large.groupBy("gram", "component").agg(F.count("*").alias("held"))
    held = held.groupBy("gram").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.max("held").alias("mains"), F.sum("held").alias("all"))
    held = written(held, "jaccard-mains")
    apart = held.groupBy("main").agg(F.sum((F.col("all") - F.col("mains")) * F.col("all")).alias("apart"), F.count("*").alias("groups")).where("groups > 1")
    if apart.isEmpty():
        return members
    once = written(large.join(held.select("gram", "main"), "gram").select("main", "rep", "h1", "component", "n").distinct(), "jaccard-once")
    sums = once.groupBy("main").agg(F.count("*").alias("size"), F.sum((F.col("component") != F.col("main")).cast("long")).alias("rest"))
    wanted = written(sums.join(apart, "main").where("rest * size <= apart").select("main", "size"), "jaccard-joint")
    joint = once.join(wanted, "main").withColumn("gram", F.xxhash64("main", F.lit("main")))
    others = members.join(held.join(wanted, "main", "left_semi").select("gram"), "gram", "left_anti")
    return others.unionByName(joint.select(*others.columns))


def split_by_pairs(members: DataFrame, reps: DataFrame, sets: int, num: int, den: int) -> DataFrame:
    """members (gram, size, rep, component), the groups with many sets outside their main component replaced by those of pairs of n-grams."""
    large = members.where(F.col("size") > RUN)
    held = large.groupBy("gram", "component").agg(F.count("*").alias("held")).groupBy("gram").agg((F.sum("held") - F.max("held")).alias("rest"))
    wide = written(held.where(F.col("rest") > MANY * RUN).select("gram"), "jaccard-wide")
    if wide.isEmpty():
        return members
    least = den // num + 1  # smaller sets may link with an overlap of one

    def pairs(batches):
        for batch in batches:
            data, starts = flat(batch.column("prefix"))
            out = []
            for k, (grams, n) in enumerate(zip(batch.column("grams").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                prefix = data[starts[k] : starts[k + 1]].view(np.uint64)
                # The n-gram beyond the usual prefix can only be a pair's second.
                wanted = np.isin(prefix[: prefix_length(n, num, den)], np.array(grams, np.int64).view(np.uint64))
                keys = [mixed(np.delete(prefix, i) * FACTORS[1] + prefix[i]) for i in np.flatnonzero(wanted).tolist()]
                out.append(np.concatenate(keys).tobytes() if keys else b"")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.binary())], ["rep", "grams"])

    chosen = large.join(wide, "gram", "left_semi").join(reps.select("rep", "n", "prefix"), "rep").where(F.col("n") >= least)
    mine = chosen.groupBy("rep").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.collect_list("gram").alias("grams"))
    tokens = mine.select("rep", "prefix", "n", "grams").mapInArrow(lean(pairs), "rep bigint, grams binary")
    labels = members.select("rep", "component").distinct()
    finer = prefix_groups(tokens, sets).join(labels, "rep").select("gram", "size", "rep", "component")
    tiny = large.join(wide, "gram", "left_semi").join(reps.where(F.col("n") <= 2 * least).select("rep"), "rep", "left_semi")
    rest = members.join(wide, "gram", "left_anti")
    return written(rest.unionByName(finer).unionByName(tiny.select(*rest.columns)), "jaccard-split")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """id, n_shingles, component_id: one row per input row.

    Words are runs of anything but white space (ASCII) after lower-casing A-Z. Null and empty texts have no n-grams, link
    with nothing and are their own components. Two documents link when den * intersection >= num * union. Equal sets
    link. Ids are integers; null ids get a null component unless their set has another document. Rows that repeat get
    equal rows. Rows that share an id but not the text are one document with the links of all its texts. Other columns, whatever
    their names, are ignored.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast(corpus_order(docs, text_col, size))
    found = written(sketches(docs, id_col, text_col, num, den, order), "jaccard-sketches")
    sets = found.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    sets = written(sets, "jaccard-sets")
    first = sets.where("rep is not null").withColumnRenamed("rep", "id")
    reps = found.join(first, ["id", "h1", "h2"], "left_semi").select(F.col("id").alias("rep"), "n", "h1", "prefix", "counts").dropDuplicates(["rep", "h1"])
    reps = written(reps, "jaccard-reps")
    count = reps.count()
    usual = F.expr(f"substring(prefix, 1, int(8 * (n - ceil({num} * n / {den}) + 1)))")
    members = prefix_groups(reps.where("n > 0").select("rep", usual.alias("grams")), count)
    marks = reps.select("rep", "h1", "n", "counts")

    large = members.where(F.col("size") > RUN)
    links, labels = None, None
    if not large.isEmpty():
        mine = large.groupBy("rep").agg(F.min(F.struct("gram", "size")).alias("group"))
        parts = F.ceil(F.col("group.size") / RUN).cast("int")
        turn = F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
        unit = F.xxhash64("group.gram", "turn", F.pmod(F.xxhash64("rep", "turn"), parts))
        units = mine.select("rep", F.col("rep").alias("component"), "group", turn).withColumn("unit", unit)
        units = written(units.join(reps.select("rep", "h1"), "rep").select("unit", "rep", "h1", "component"), "jaccard-units")
        links = written(search_units(units, docs, id_col, text_col, num, den, order), "jaccard-links")
        labels = connected(links)
        dropped(units)
    members = members.withColumn("component", F.col("rep"))
    if labels is not None:
        known = labels.toDF("rep", "label")
        members = members.drop("component").join(known, "rep", "left").select("gram", "size", "rep", F.coalesce("label", "rep").alias("component"))
        members = written(members, "jaccard-labelled")
        open_ = members.groupBy("gram").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
        members = members.join(open_.select("gram"), "gram", "left_semi")
        members = split_by_pairs(written(members, "jaccard-open"), reps, count, num, den)
    kept = written(screen(members.join(marks, "rep"), num, den), "jaccard-kept")
    held = kept.groupBy("gram").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.min("rep").alias("anchor"))
    held = held.groupBy("size", "mark", "anchor").agg(F.min("gram").alias("gram")).select("gram", "size")
    kept = kept.drop("size").join(written(held, "jaccard-held"), "gram")
    units = written(in_units(by_main(kept), num, den).select("unit", "rep", "h1", "component"), "jaccard-units")
    more = written(search_units(units, docs, id_col, text_col, num, den, order), "jaccard-links")
    labels = connected(more if links is None else links.union(more))
    named = sets.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named.select("h1", "h2", "component"), "jaccard-named")
    dropped(*(t for t in (sets, reps, links, labels, more, units) if hasattr(t, "folder")))
    out = found.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay, with their own columns: of each component the one with the smallest id, once.

    Rows that share an id but not the text are documents of their own.
    """
    rows, others = with_rows(docs, id_col, text_col)
    names = jaccard_components(rows, "__row", "__text", size, num, den)
    if others is None:
        stay = names.where(F.col("__row").eqNullSafe(F.col("component_id"))).select(F.col("__row").alias("__stays")).distinct()
    else:
        # The component's id is its smallest row; of its rows, the one with the smallest id of docs stays.
        named = names.join(others.select("__row", "id"), "__row", "left")
        first = F.min(F.struct(F.coalesce("id", "__row").alias("id"), F.col("__row")))
        stay = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__stays"))
    kept = rows.join(stay, F.col("__row").eqNullSafe(F.col("__stays")), "left_semi")
    one = W.partitionBy("__row").orderBy(F.xxhash64(F.coalesce("__text", F.lit(""))))
    return kept.withColumn("__n", F.row_number().over(one)).where(F.col("__row").isNull() | (F.col("__n") == 1)).select("__whole.*")


def with_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Each row of docs as __whole, its text as __text, and __row, an id that different texts don't share; and the rows (__row, id, key) whose __row isn't their id, if any.

    Of the texts of an id the one with the smallest hash has the id itself; the others get numbers above all ids. Null ids stay null.
    """
    docs = docs.select(F.struct(*docs.columns).alias("__whole"), F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("__own"))
    own, key = F.col("__own"), F.xxhash64(F.coalesce("__text", F.lit("")))
    keys = docs.select(own.alias("id"), key.alias("key")).where("id is not null")
    shared = keys.groupBy("id").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    shared = written(shared.select("id", "first"), "jaccard-shared")
    if shared.isEmpty():
        return docs.withColumn("__row", own), None
    beyond = keys.agg(F.max("id")).first()[0] + 1
    others = keys.join(shared, "id").where("key <> first").select("id", "key").distinct()
    others = written(others.withColumn("__row", F.lit(beyond) + F.monotonically_increasing_id()), "jaccard-rows")
    marked = others.toDF("__id", "__key", "__other")
    rows = docs.join(marked, (own == F.col("__id")) & (key == F.col("__key")), "left")
    return rows.withColumn("__row", F.coalesce("__other", own)).drop("__id", "__key", "__other"), others


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), size=4, num=85, den=100)


def sql(size: int, num: int, den: int) -> str:
    """What jaccard_components gives, by all pairs that share an n-gram; for small tables."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END AS l FROM d),
s AS (SELECT DISTINCT doc_id, hash(x) AS h, x FROM (SELECT doc_id, unnest(l) AS x FROM g)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {den} * o >= {num} * (a.n + b.n - o)),
links AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, links.y FROM reach r JOIN links ON r.y = links.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""


OP4_SQL = sql(4, 85, 100)
