"""BPE encoding and decoding by forced boundaries.

A cut between two bytes is certain where the pair never occurs inside any token of the vocabulary and the
splitting into words separates the two as well (this vocabulary marks word ends, so a cut inside a word
would change its tokens). White space is never part of a token. Fragments between certain cuts are encoded
each on its own, a fragment that repeats within a few megabytes once, and the ids are concatenated.

Cuts are found for whole buffers of text at a time. Most fragments are runs of letters or of signs, each one word: all those
of a length stand in a matrix, and every step merges each row's first pair of the lowest rank. Long words are cut inside, too, where a pair is in
no token; their parts but the last have no word end. Fragments with other characters go to the tokenizers library, one by one.

The cut table and the merges come from the vocabulary file; nothing is known of single words in advance. Texts are taken in
slices of about `BYTES_AT_ONCE`, so memory is bounded in bytes, but for a single fragment and for the ids of one text.
The short fragments that the library encoded are remembered, at most `REMEMBERED` bytes of them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ._bytes import LOWER, binary, flat, runs
from ._shared import documents

BYTES_AT_ONCE = 4_000_000
TOKENS_AT_ONCE = 1_000_000
REMEMBERED = 16_000_000
#: Longer fragments go to the library and are not remembered.
LONG = 48
ROWS_AT_ONCE = 8_192
#: Longer than any special token.
EDGE = 16

MARKED, LETTER, DIGIT, SIGN, SPACE = range(5)
#: By byte; 0x1C-0x1F are signs to this vocabulary. Bytes from 0x80 on are in doubt, but for letters up to U+00FF.
KIND = np.array(
    [MARKED if b >= 128 else SPACE if b == 32 or 9 <= b <= 13 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256)], np.uint8
)
LATIN = 0xC3  # the lead byte of U+00C0 to U+00FF, all letters but U+00D7 and U+00F7
#: More characters of three bytes that nothing changes and whose kind is sure: (first, last, kind).
WIDE = ((0x3001, 0x3002, SIGN), (0x3041, 0x3096, LETTER), (0x30A1, 0x30FA, LETTER), (0x4E00, 0x9FBF, LETTER), (0xFF01, 0xFF01, SIGN), (0xFF0C, 0xFF0C, SIGN))
#: First letters of the endings that the vocabulary's word rule takes together with an apostrophe.
ENDINGS = b"strvmld"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def never_inside(vocabulary: Iterable[str], word_end: str) -> np.ndarray:
    """65,536 flags, by first byte * 256 + second byte: the pair is in no token, nor does an ending start there."""
    flags, to_byte = np.ones(65536, bool), byte_of()
    for token in vocabulary:
        raw = [to_byte[c] for c in token.removesuffix(word_end)]
        for a, b in zip(raw, raw[1:], strict=False):
            flags[a << 8 | b] = False
    flags[[39 << 8 | c for c in ENDINGS]] = False
    return flags


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and where the second bytes of capitals beyond ASCII are."""
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == LATIN)
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    wide = np.flatnonzero(data[:-2] >= 0xE3)
    wide = wide[data[wide] < 0xF0]
    if len(wide):
        point = (data[wide].astype(np.int64) & 15) << 12 | (data[wide + 1].astype(np.int64) & 63) << 6 | data[wide + 2] & 63
        for first, last, own in WIDE:
            at = wide[(point >= first) & (point <= last)]
            kind[at] = kind[at + 1] = kind[at + 2] = own
    return kind, lead[data[lead + 1] < 0x9F] + 1


class Merges:
    """The vocabulary's merges on matrices of symbols."""

    NONE = np.int32(1 << 30)

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str):
        stands_for = {b: c for c, b in byte_of().items()}
        self.inner = np.array([vocabulary[stands_for[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[stands_for[b] + word_end] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint64)
        # A table by hash, in which a key stands at most `probes` places behind its own.
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(32 - bits), (1 << bits) - 1
        self.keys, self.ranks, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32), 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.place(keys).tolist(), strict=True)):
            away = 1
            while self.keys[at] >= 0:
                at, away = at + 1 & self.mask, away + 1
            self.keys[at], self.ranks[at], self.probes = key, rank, max(self.probes, away)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE if there is none."""
        keys = a.astype(np.int64) << 16 | b
        at = self.place(keys.view(np.uint64))
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], self.NONE)
        open_ = np.nonzero((held != keys) & (held >= 0))
        for _ in range(1, self.probes):
            if not len(open_[0]):
                break
            at[open_] = at[open_] + 1 & self.mask
            held, wanted = self.keys[at[open_]], keys[open_]
            out[open_] = np.where(held == wanted, self.ranks[at[open_]], self.NONE)
            open_ = tuple(x[(held != wanted) & (held >= 0)] for x in open_)
        return out

    def words(self, raw: np.ndarray, ended: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) for words of one length, one word's bytes in each row; all rows of a yield have as many ids.
        ended: their ends are ends of words."""
        symbols = self.inner[raw]
        if ended:
            symbols[:, -1] = self.last[raw[:, -1]]
        rows, ranks = np.arange(len(raw)), self.rank(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            done = least == self.NONE
            if done.any():
                yield rows[done], symbols[done]
                rows, symbols, ranks, at, least = (x[~done] for x in (rows, symbols, ranks, at, least))
                if not len(rows):
                    return
            here, column = np.arange(len(rows)), np.arange(symbols.shape[1] - 1)
            behind = column > at[:, None]
            symbols = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[here, at] = self.result[least]
            ranks = np.where(column[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(symbols[left, at[left] - 1], symbols[left, at[left]])
            right = np.flatnonzero(at < symbols.shape[1] - 1)
            ranks[right, at[right]] = self.rank(symbols[right, at[right]], symbols[right, at[right] + 1])
        if len(rows):
            yield rows, symbols


class Fragments:
    """Encodes texts with the vocabulary of one file."""

    def __init__(self, path: str, remembered: int = REMEMBERED, at_once: int = BYTES_AT_ONCE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.sure = never_inside(model["vocab"], end)
        self.merges = Merges(model["vocab"], model["merges"], end)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        names = self.whole.get_vocab(with_added_tokens=True)
        by_id = {i: token for token, i in names.items()}
        self.names = pa.array([by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)], pa.large_binary())
        self.remembered, self.at_once = remembered, at_once
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0

    def by_library(self, fragments: list[bytes]) -> list[np.ndarray]:
        """Each fragment's ids, as the library has them; short fragments are remembered."""
        if self.held > self.remembered:
            self.forget()
        out = [self.known.get(f) for f in fragments]
        missing, count = [k for k, got in enumerate(out) if got is None], 0
        while count < len(missing):
            some, size = [], 0
            while count < len(missing) and (not some or size < self.at_once // 8):
                some.append(missing[count])
                size += len(fragments[missing[count]])
                count += 1
            texts = [fragments[k].decode("utf-8", "surrogatepass") for k in some]
            for k, e in zip(some, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4")
                if len(fragments[k]) <= LONG:
                    self.known[fragments[k]] = out[k]
                    self.held += len(fragments[k]) + 200
        return out

    def long_words(self, data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of these fragments, long runs of letters, by number: cut inside where no token can reach. One with a part that is still
        long has none."""
        lengths = starts[at + 1] - starts[at]
        raw, first = data[runs(starts[at], lengths)], np.cumsum(lengths) - lengths
        begins = np.ones(len(raw) + 1, bool)
        begins[1:-1] = self.sure[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        begins[first] = True
        part = np.flatnonzero(begins)
        size, part = np.diff(part), part[:-1]
        begun = np.searchsorted(part, first)
        good = np.maximum.reduceat(size, begun) <= LONG
        owner = np.searchsorted(first, part, side="right") - 1
        last = np.append(owner[1:] != owner[:-1], True)
        counts, found = np.zeros(len(part), np.int64), []
        for ended in (False, True):
            some = np.flatnonzero(good[owner] & (last == ended))
            if len(some):
                coded = binary(raw[runs(part[some], size[some])], np.append(0, np.cumsum(size[some]))).dictionary_encode()
                ids, held = self.plain(*flat(coded.dictionary), ended)
                which = coded.indices.to_numpy()
                counts[some] = held[which]
                found.append((some, ids[runs((np.cumsum(held) - held)[which], held[which])]))
        place = np.append(0, np.cumsum(counts))
        out = np.empty(int(place[-1]), "<u4")
        for some, ids in found:
            out[runs(place[some], counts[some])] = ids
        ends = place[np.append(begun[1:], len(part))]
        return {k: out[lo:hi] for k, lo, hi, ok in zip(at.tolist(), place[begun].tolist(), ends.tolist(), good.tolist(), strict=True) if ok}

    def certain(self, kind: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The places of bytes that a certain cut parts from the one before."""
        a, b = kind[:-1], kind[1:]
        apart = np.flatnonzero(((a != b) | (a == DIGIT)) & (a != MARKED) & (b != MARKED) & (a != SPACE) & (b != SPACE))
        return apart[self.sure[low[apart].astype(np.int64) << 8 | low[apart + 1]]] + 1

    def cut(self, data: np.ndarray, starts: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fragments of the rows that start there: their bytes without white space, where each starts in these, and how many
        there are before each row. ASCII and Latin capitals become small, as the vocabulary's rules do first of all, but for a letter
        that something may join. special: cut at white space only."""
        kind, capitals = kinds(data)
        low = LOWER[data]
        low[capitals] += 0x20
        begins = np.zeros(len(data) + 1, bool)
        begins[starts] = True
        space = kind == SPACE
        begins[1:][space] = True
        if not special:
            begins[self.certain(kind, low)] = True
        joined = kind[1:] == MARKED
        joined[starts[(starts > 0) & (starts < len(data))] - 1] = False
        joined = np.flatnonzero(joined)
        low[joined] = data[joined]
        if special:
            low = data
        kept = ~space
        first = np.flatnonzero(begins[:-1] & kept)
        packed = np.cumsum(kept)[first] - 1
        bytes_ = low[kept]
        return bytes_, np.append(packed, len(bytes_)), np.searchsorted(first, starts)

    def plain(self, data: np.ndarray, starts: np.ndarray, ended: bool, wanted: np.ndarray | None = None, others: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the fragments, one after another, and how many each has: by matrices those wanted (None: all), else as others say."""
        lengths, others = np.diff(starts), others or {}
        counts, found = np.zeros(len(lengths), np.int64), []
        kept = np.ones(len(lengths), bool) if wanted is None else wanted
        for length in np.unique(lengths[kept]).tolist():
            at = np.flatnonzero(kept & (lengths == length))
            for some in (at[i : i + ROWS_AT_ONCE] for i in range(0, len(at), ROWS_AT_ONCE)):
                for rows, ids in self.merges.words(data[starts[some][:, None] + np.arange(length)], ended):
                    counts[some[rows]] = ids.shape[1]
                    found.append((some[rows], ids))
        rest = np.array(sorted(others), np.int64)
        counts[rest] = [len(others[k]) for k in rest.tolist()]
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), "<u4")
        for rows, own in found:
            ids[first[rows][:, None] + np.arange(own.shape[1])] = own
        if len(rest):
            ids[runs(first[rest], counts[rest])] = np.concatenate([others[k] for k in rest.tolist()])
        return ids, counts

    def distinct(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the fragments, one after another, and how many each has."""
        lengths, (kind, _) = np.diff(starts), kinds(data)
        least, most = np.minimum.reduceat(kind, starts[:-1]), np.maximum.reduceat(kind, starts[:-1])
        one_word = (least == most) & (least != MARKED) & ((least != DIGIT) | (lengths == 1))
        wanted = one_word & (lengths <= LONG)
        others = {}
        for k in np.flatnonzero(~wanted).tolist():
            others[k] = data[starts[k] : starts[k + 1]].tobytes()
        if len(long := np.flatnonzero(one_word & ~wanted)):
            others.update(self.long_words(data, starts, long))
        left = [k for k, x in others.items() if isinstance(x, bytes)]
        others.update(zip(left, self.by_library([others[k] for k in left]), strict=True))
        return self.plain(data, starts, True, wanted, others)

    def encode_flat(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's start and the last one's end."""
        special = any(data.tobytes().find(s) >= 0 for s in self.special)
        packed, at, before = self.cut(data, starts, special)
        if len(at) == 1:
            return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
        coded = binary(packed, at).dictionary_encode()
        which = coded.indices.to_numpy()
        if special:
            found = self.by_library(coded.dictionary.to_pylist())
            ids, counts = np.concatenate(found), np.array([len(x) for x in found])
        else:
            ids, counts = self.distinct(*flat(coded.dictionary))
        own = counts[which]
        ends = np.append(0, np.cumsum(own))
        return ids[runs((np.cumsum(counts) - counts)[which], own)], ends[before]

    def gap(self, data: np.ndarray, at: int) -> int:
        """The first place from there on where white space or a certain cut is; the end if there is none."""
        while at < len(data):
            some = data[at - EDGE : at + self.at_once]
            kind, _ = kinds(some)
            gaps = np.append(np.flatnonzero(kind == SPACE), self.certain(kind, LOWER[some]) if b"<|" not in some.tobytes() else [])
            gaps = gaps[(gaps >= EDGE) & (gaps < len(some) - EDGE)]  # what stands at the edges may be incomplete
            if len(gaps):
                return at - EDGE + int(gaps.min())
            at += max(1, len(some) - 2 * EDGE)
        return len(data)

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row behind the last, bytes, starts) with about `at_once` bytes each; a longer row comes in several."""
        data, starts = flat(column)
        row, rows = 0, len(column)
        while row < rows:
            stop = max(row + 1, int(np.searchsorted(starts, starts[row] + self.at_once, side="right")) - 1)
            lo, hi = int(starts[row]), int(starts[stop])
            while stop == row + 1 and hi - lo > self.at_once:
                end = self.gap(data[lo:hi], self.at_once) + lo
                if end >= hi:
                    break
                yield row, row, data[lo:end], np.array([0, end - lo])
                lo = end
            yield row, stop, data[lo:hi], np.append(lo, starts[row + 1 : stop + 1]) - lo
            row = stop

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each row its ids, unsigned 32-bit."""
        begun: list[np.ndarray] = []
        for first, stop, data, starts in self.slices(column):
            ids, at = self.encode_flat(data, starts)
            if stop == first:
                begun.append(ids)
                continue
            for k in range(stop - first):
                own = ids[at[k] : at[k + 1]]
                yield np.concatenate([*begun, own]) if begun else own
                begun = []

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decoded text of ids in pieces."""
        for at in range(0, len(ids), TOKENS_AT_ONCE):
            got, _ = flat(self.names.take(pa.array(ids[at : at + TOKENS_AT_ONCE])))
            yield got[: len(got) - (at + TOKENS_AT_ONCE >= len(ids))].tobytes()


@lru_cache(maxsize=2)
def fragments(path: str) -> Fragments:
    return Fragments(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit), n_tokens, decoded: one row per input row.

    Null texts count as empty: no ids, decoded to the empty text. Null ids and repeated rows pass through.
    Texts of any length are encoded whole. Other columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        known = fragments(path)
        for batch in batches:
            ids, decoded = [], []
            for own in known.encode(batch.column("__text")):
                ids.append(own.tobytes())
                decoded.append(b"".join(known.decoded(own)))
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), n, pa.array(decoded, pa.binary()).cast(pa.string())], ["id", "ids", "n_tokens", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))
    return read.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Like `encode_documents`, with SHA-256 digests instead of the ids and the decoded text."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        known = fragments(path)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in known.encode(batch.column("__text")):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text = hashlib.sha256()
                for piece in known.decoded(ids):
                    text.update(piece)
                decoded_sha.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["id", "n", "i", "d"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))
    out = read.mapInArrow(run, f"id {kind}, n bigint, i string, d string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def op9_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
