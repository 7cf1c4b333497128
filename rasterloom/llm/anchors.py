"""Substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of words, the anchors; a repeated window of w words holds at least one whole anchor of its own document
if an anchor has (w + 1) // 2 words. The anchors of all documents are the index; every rolling window of an anchor's length is a probe. An anchor that a
probe from anywhere else hits is extended: each window of w words around it is looked up among all the windows around hits, and runs of windows that
are there twice are the maximal exact repeats. Anchors and probes meet by 48 bits of a rolling hash over hashes of their words, where a mistaken hit only
costs another look. What decides are 128-bit cryptographic digests of the words of a window, taken from the text itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks as B
from .common import U64, WORDS, Words, digests, paired, partitions


class Passages(Words):
    """The words of some documents in a row, hashed."""

    def __init__(self, said: list[bytes]):
        super().__init__(said)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in self.words], U64)[self.of]
        self.line = self.joined()
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.begins = self.ends - self.sizes
        counts = np.diff(self.firsts)
        self.left = np.repeat(self.firsts[1:], counts) - np.arange(len(self.hashes))  # words to the document's end, this one included
        self.at = np.arange(len(self.hashes)) - np.repeat(self.firsts[:-1], counts)

    def exactly(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the windows that start there, each of its words joined by one space."""
        line = self.line
        return digests([line[a:b] for a, b in zip(self.begins[starts].tolist(), self.ends[starts + width - 1].tolist())])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows within documents, and their rolling hashes."""
        starts = np.flatnonzero(self.left >= width)
        return starts, WORDS.slices(WORDS.sums(self.hashes), starts, starts + width)


def _anchors(width: int, n: int):
    """Per block: all probes, marked if they are there twice or are anchors."""

    def ask(parts, _):
        probes, anchors = [], []
        for _, said in parts:
            words = Passages(said)
            starts, keys = words.windows(width)
            keys = B.shorten(keys)
            probes.append(keys)
            anchors.append(keys[words.at[starts] % width == 0])
        keys, twice = B.distinct(np.concatenate(probes))
        mine = np.zeros(len(keys), bool)
        mine[np.searchsorted(keys, np.concatenate(anchors))] = True
        cuts = B.bucket_cuts(keys, n)
        for i in range(n):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                yield i, 0, (int(b - a), B.pack(keys[a:b]), B.bits(twice[a:b]), B.bits(mine[a:b]))

    return ask


def _hit(said):
    """Which anchors have a probe besides themselves."""
    keys = [B.unpack(d[1]) for _, d in said]
    once, several = B.distinct(np.concatenate(keys))
    for (_, d), k in zip(said, keys):
        several[np.searchsorted(once, k)] |= B.flags(d[2], d[0])
    for (block, d), k in zip(said, keys):
        mine = B.flags(d[3], d[0])
        yield block, 0, B.bits(several[np.searchsorted(once, k[mine])])


def _read_hits(parts: list[Passages], width: int, n: int, heard: dict) -> np.ndarray:
    """The sorted short keys of this block's anchors that were hit."""
    mine = []
    for words in parts:
        starts = np.flatnonzero((words.left >= width) & (words.at % width == 0))
        mine.append(B.shorten(WORDS.slices(WORDS.sums(words.hashes), starts, starts + width)))
    mine, _ = B.distinct(np.concatenate(mine))
    cuts = B.bucket_cuts(mine, n)
    hit = np.zeros(len(mine), bool)
    for i, data in heard.get(0, {}).items():
        a, b = cuts[i], cuts[i + 1]
        hit[a:b] = B.flags(data, b - a)
    return mine[hit]


def _around(words: Passages, hits: np.ndarray, anchor: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, keys and second keys of the windows that hold an anchor that was hit."""
    n = len(words.hashes)
    starts = np.flatnonzero((words.left >= anchor) & (words.at % anchor == 0))
    keys = B.shorten(WORDS.slices(WORDS.sums(words.hashes), starts, starts + anchor))
    at = np.searchsorted(hits, keys)
    found = starts[hits[np.minimum(at, len(hits) - 1)] == keys] if len(hits) else starts[:0]
    turn = np.zeros(n + 1, np.int32)
    np.add.at(turn, np.maximum(found - (width - anchor), found - words.at[found]), 1)
    np.add.at(turn, found + 1, -1)
    where = np.cumsum(turn[:-1]) > 0
    at = np.flatnonzero((words.left >= width) & where)
    return at, *words.exactly(at, width)


def _windows(anchor: int, width: int, n: int):
    """Per block: the windows around hits, marked if they are there twice."""

    def ask(parts, heard):
        words = [Passages(said) for _, said in parts]
        hits = _read_hits(words, anchor, n, heard)
        found = [_around(w, hits, anchor, width)[1:] for w in words]
        first, second, times, _ = paired(np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found]))
        cuts = B.bucket_cuts(first, n)
        for i in range(n):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                yield i, 1, (first[a:b], second[a:b], B.bits(times[a:b] > 1))

    return ask


def _repeated(said):
    """Which windows are there twice in all."""
    sizes = [len(d[0]) for _, d in said]
    _, _, times, where = paired(np.concatenate([d[0] for _, d in said]), np.concatenate([d[1] for _, d in said]))
    several = times > 1
    twice = np.concatenate([B.flags(d[2], k) for (_, d), k in zip(said, sizes)])
    several[where[twice]] = True
    at = 0
    for (block, _), k in zip(said, sizes):
        yield block, 1, B.bits(several[where[at : at + k]])
        at += k


def _removal(anchor: int, width: int, n: int, whole: bool):
    def conclude(parts, heard):
        held = [(ids, Passages(said)) for ids, said in parts]
        hits = _read_hits([w for _, w in held], anchor, n, heard)
        around = [_around(w, hits, anchor, width) for _, w in held]
        first, _, _, where = paired(np.concatenate([a[1] for a in around]), np.concatenate([a[2] for a in around]))
        cuts = B.bucket_cuts(first, n)
        again = np.zeros(len(first), bool)
        for i, data in heard.get(1, {}).items():
            a, b = cuts[i], cuts[i + 1]
            again[a:b] = B.flags(data, b - a)
        at = 0
        for (ids, words), (starts, _, _) in zip(held, around):
            starts, at = starts[again[where[at : at + len(starts)]]], at + len(starts)
            turn = np.zeros(len(words.hashes) + 1, np.int32)
            np.add.at(turn, starts, 1)
            np.add.at(turn, starts + width, -1)
            gone = np.cumsum(turn[:-1]) > 0
            for doc, a, b in zip(ids, words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
                mask = gone[a:b]
                removed = int(mask.sum())
                line = words.line[words.begins[a] : words.ends[b - 1]] if b > a else b""
                if removed:
                    line = b" ".join([w for w, g in zip(line.split(b" "), mask.tolist()) if not g])
                row = (doc, int(b - a), removed, hashlib.sha256(line).hexdigest())
                if whole:
                    turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                    row += ([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])], line.decode("utf-8", "replace"))
                yield row

    return conclude


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, whole: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256; whole=True adds spans (of removed words) and kept (words joined by one space).

    A word goes if it lies in a window of `width` words whose sequence also starts anywhere else, in this document or another; first copies go too. A null
    text has no words; shorter texts than a window keep all. Repeated rows are documents each, so their windows repeat. Words are cut at ASCII white space
    and windows compared by 128-bit cryptographic digests of their bytes. An empty table gives an empty result; other columns play no part.
    """
    n, anchor = partitions(docs.sparkSession), (width + 1) // 2
    fields = [(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    ddl = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string"
    if whole:
        fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())]
        ddl += ", spans array<struct<start: long, end: long>>, kept string"
    rows = B.blocked(docs, id_col, text_col, n)
    hits = B.answered(B.first_questions(rows, _anchors(anchor, n), n), _hit, n)
    again = B.answered(B.next_questions(rows, hits, _windows(anchor, width, n), n), _repeated, n)
    return B.concluded(rows, hits.union(again), _removal(anchor, width, n, whole), pa.schema(fields), ddl)
