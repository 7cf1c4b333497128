"""Suffix-array deduplication by longest-previous-factor arrays.

The corpus is one text, documents in the order of their ids. Removed is every byte of a match of at least `width` bytes with an earlier document, which is
what the longest-previous-factor array says: in suffix order, the nearest suffixes before and after that belong to a smaller document are the ones
with which a suffix has most in common. No machine holds the suffix array of everything, so suffixes are dealt out so that those which share `width` bytes
meet: each string of that length is known by the smallest hash among its k-byte substrings. First, blocks of documents ask which of these hashes
more than one document has; then the stretches under such a hash go to its bucket, each distinct stretch once per block with its smallest document. A
bucket sorts its suffixes up to `width` bytes, a few megabytes at a time, and from previous and next smaller documents and the common prefixes on the way
there gets the length of each suffix's longest previous factor, up to `width`; where it is reached, the suffix has an earlier match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .common import BYTES, U64, mix, partitions

#: The id of documents without one: after all others.
LAST = (1 << 63) - 1
#: Bytes of stretches in one suffix array; the stretches of one hash stay together even if they are more.
ARRAY_BYTES = 2 << 20


class Stretches:
    """Some documents in a row; the smallest hash under each string of `width` bytes."""

    def __init__(self, said: list[bytes], width: int, k: int):
        self.bytes = b"".join(said)
        self.bounds = np.cumsum([0] + [len(t) for t in said])
        buf = np.frombuffer(self.bytes, np.uint8)
        n = len(buf) - width + 1
        self.keys = self.starts = self.ends = self.docs = np.zeros(0, np.int64)
        if n <= 0:
            self.keys = self.keys.view(U64)
            return
        least, span, w = BYTES.windows(BYTES.sums(BYTES.values[buf]), k), 1, width - k + 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        turn = np.ones(n, bool)
        turn[1:] = least[1:] != least[:-1]
        turn[self.bounds[1:-1][self.bounds[1:-1] < n]] = True
        starts = np.flatnonzero(turn)
        ends = np.append(starts[1:], n)
        doc = np.searchsorted(self.bounds, starts, "right") - 1
        ends = np.minimum(ends, self.bounds[doc + 1] - width + 1)  # no string goes over a document's end
        there = ends > starts
        self.starts, self.ends, self.docs = starts[there], ends[there], doc[there]
        self.keys = B.shorten(mix(least[self.starts]))  # smallest hashes lie close to zero: spread again, they fill the buckets evenly


def _rank(ident) -> int:
    return LAST if ident is None else ident


def _hashes(width: int, k: int, n: int):
    """Per block: the hashes, marked if two of its documents have them."""

    def ask(parts, _):
        keys, docs, before = [], [], 0
        for ids, said in parts:
            s = Stretches(said, width, k)
            if len(s.keys):
                keys.append(s.keys)
                docs.append(s.docs + before)
            before += len(ids)
        if not keys:
            return
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        keys = keys[np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(docs, prepend=-1) != 0))]
        keys, twice = B.distinct(keys)
        cuts = B.bucket_cuts(keys, n)
        for i in range(n):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                yield i, 0, (int(b - a), B.pack(keys[a:b]), B.bits(twice[a:b]))

    return ask


def _shared(said):
    """Which hashes more than one document has."""
    keys = [B.unpack(d[1]) for _, d in said]
    once, several = B.distinct(np.concatenate(keys))
    for (_, d), k in zip(said, keys):
        several[np.searchsorted(once, k)] |= B.flags(d[2], d[0])
    for (block, _), k in zip(said, keys):
        yield block, 0, B.bits(several[np.searchsorted(once, k)])


class Shared:
    """The stretches of a block whose hash is shared: each distinct one with its smallest document, in the order of their keys and bytes."""

    def __init__(self, parts, width: int, k: int, n: int, heard: dict):
        self.parts = [(ids, said, Stretches(said, width, k)) for ids, said in parts]
        mine, _ = B.distinct(np.concatenate([s.keys for _, _, s in self.parts])) if self.parts else (np.zeros(0, U64), None)
        cuts = B.bucket_cuts(mine, n)
        hit = np.zeros(len(mine), bool)
        for i, data in heard.get(0, {}).items():
            hit[cuts[i] : cuts[i + 1]] = B.flags(data, cuts[i + 1] - cuts[i])
        index: dict[bytes, int] = {}
        keys, least = [], []
        #: For each part of the block: where its shared stretches start, whose they are, and which.
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for ids, _, s in self.parts:
            at = np.flatnonzero(hit[np.searchsorted(mine, s.keys)]) if len(mine) else np.zeros(0, np.int64)
            ranks = np.array([_rank(i) for i in ids], np.int64)[s.docs[at]] if len(at) else np.zeros(0, np.int64)
            said, which = s.bytes, []
            for start, end, key, rank in zip(s.starts[at].tolist(), (s.ends[at] + width - 1).tolist(), s.keys[at].tolist(), ranks.tolist()):
                name = said[start:end]
                j = index.get(name)
                if j is None:
                    j = index[name] = len(keys)
                    keys.append(key)
                    least.append(rank)
                elif rank < least[j]:
                    least[j] = rank
                which.append(j)
            self.found.append((s.starts[at], ranks, np.array(which, np.int64)))
        names = sorted(index)
        of = np.array([index[x] for x in names], np.int64)
        keys, least = np.array(keys, U64), np.array(least, np.int64)
        order = np.argsort(keys[of], kind="stable")
        of = of[order]
        self.names = [names[i] for i in order.tolist()]
        self.keys, self.least = keys[of], least[of]
        place = np.empty(len(of), np.int64)
        place[of] = np.arange(len(of))
        self.found = [(starts, ranks, place[which]) for starts, ranks, which in self.found]
        self.sizes = np.array([len(x) for x in self.names], np.int64) - width + 1
        self.cuts = B.bucket_cuts(self.keys, n)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its size says, one span after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _stretches(width: int, k: int, n: int):
    """Per block: its distinct stretches under shared hashes, and the smallest document of each."""

    def ask(parts, heard):
        shared = Shared(parts, width, k, n, heard)
        for i in range(n):
            a, b = shared.cuts[i], shared.cuts[i + 1]
            if b > a:
                yield i, 1, (shared.keys[a:b], shared.sizes[a:b], b"".join(shared.names[a:b]), shared.least[a:b])

    return ask


def suffix_order(text: np.ndarray, where: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `where` in the order of their first `width` bytes, equal ones by document; and how many bytes, up to width, each has in
    common with the one before it. Sorted by words of eight bytes, the last two overlapping; only these suffixes are sorted, not those that start between
    them. text has width bytes more behind it.
    """
    if width < 8:
        raise ValueError("matches have 8 bytes at least")
    n = len(text) - 8
    word = np.zeros(n, U64)
    for i in range(8):
        word = word << U64(8) | text[i : i + n].astype(U64)
    offsets = [*range(0, width - 8, 8), width - 8]
    words = [word[where + at] for at in offsets]
    order = np.lexsort((docs, *words[::-1]))
    common = np.full(len(where), width, np.int32)
    common[:1] = 0
    same = np.arange(1, len(where))
    for at, w in zip(offsets, words):
        differ = w[order[same]] ^ w[order[same - 1]]
        found = differ != 0
        equal = np.zeros(int(found.sum()), np.int32)
        for byte in range(1, 8):
            equal += differ[found] < U64(1 << 8 * byte)
        common[same[found]] = at + equal
        same = same[~found]
    return order, common


def longest_with_smaller(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order: how many bytes each suffix has in common with the nearest one before it that belongs to a smaller document, by pointers that jump
    over what is not smaller, each with the least common prefix on its way."""
    low = np.append(docs, docs.min(initial=0) - 1)  # at -1, smaller than any
    at, reach = np.arange(len(docs)) - 1, common.copy()
    todo = np.flatnonzero((low[at] >= docs) & (reach > 0))
    while len(todo):
        over = at[todo]
        reach[todo] = np.minimum(reach[todo], reach[over])
        at[todo] = at[over]
        todo = todo[(low[at[todo]] >= docs[todo]) & (reach[todo] > 0)]
    return np.where(at >= 0, reach, 0)


def previous_factors(text: np.ndarray, where: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """The longest-previous-factor array, up to width: for each suffix, how long a string that starts there also starts in a smaller document."""
    order, common = suffix_order(text, where, docs, width)
    docs = docs[order]
    before = longest_with_smaller(docs, common)
    after = longest_with_smaller(docs[::-1].copy(), np.append(common[1:], 0)[::-1].astype(np.int32))[::-1] if len(docs) else before
    out = np.empty(len(order), np.int32)
    out[order] = np.maximum(before, after)
    return out


def _matches(width: int):
    def answer(said):
        """For each block's stretches, in order, bits: does a smaller document have the string that starts here."""
        index: dict[bytes, int] = {}
        keys, least, which = [], [], []
        for _, (sent, sizes, joined, owners) in said:
            ends = np.cumsum(sizes + width - 1).tolist()
            here, start = [], 0
            for key, end, owner in zip(sent.tolist(), ends, owners.tolist()):
                name = joined[start:end]
                start = end
                j = index.get(name)
                if j is None:
                    j = index[name] = len(keys)
                    keys.append(key)
                    least.append(owner)
                elif owner < least[j]:
                    least[j] = owner
                here.append(j)
            which.append(np.array(here, np.int64))
        names, least = list(index), np.array(least, np.int64)
        sizes = np.array([len(x) for x in names], np.int64) - width + 1
        firsts = np.cumsum(sizes) - sizes
        marked = np.zeros(int(sizes.sum()), bool)
        keys = np.array(keys, U64)
        order = np.argsort(keys, kind="stable")
        new = np.append(np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0), len(order))
        held = np.concatenate([[0], np.cumsum(sizes[order] + width - 1)])
        at = 0
        while at < len(new) - 1:  # whole hashes, up to ARRAY_BYTES
            to = max(at + 1, int(np.searchsorted(held[new], held[new[at]] + ARRAY_BYTES, "right")) - 1)
            some = order[new[at] : new[to]]
            text = np.frombuffer(b"".join([names[i] for i in some.tolist()]) + bytes(width), np.uint8)
            long = sizes[some] + width - 1
            where = spans(np.cumsum(long) - long, sizes[some])
            marked[spans(firsts[some], sizes[some])] = previous_factors(text, where, np.repeat(least[some], sizes[some]), width) >= width
            at = to
        for (block, (_, _, _, owners)), here in zip(said, which):
            later = np.repeat(owners > least[here], sizes[here])  # another block has the stretch in a smaller document
            yield block, 1, B.bits(marked[spans(firsts[here], sizes[here])] | later)

    return answer


def _removal(width: int, k: int, n: int, whole: bool):
    def conclude(parts, heard):
        shared = Shared(parts, width, k, n, heard)
        firsts = np.cumsum(shared.sizes) - shared.sizes
        marked = np.zeros(int(shared.sizes.sum()), bool)
        for i, data in heard.get(1, {}).items():
            a, b = shared.cuts[i], shared.cuts[i + 1]
            if b > a:
                size = int(shared.sizes[a:b].sum())
                marked[firsts[a] : firsts[a] + size] = B.flags(data, size)
        for (ids, said, s), (starts, ranks, which) in zip(shared.parts, shared.found):
            sizes = shared.sizes[which]
            here = marked[spans(firsts[which], sizes)] | np.repeat(ranks > shared.least[which], sizes)  # the block has it in a smaller document
            at = spans(starts, sizes)[here]
            turn = np.zeros(len(s.bytes) + 1, np.int32)
            turn[at] += 1
            turn[at + width] -= 1
            gone = np.cumsum(turn[:-1]) > 0
            buf = np.frombuffer(s.bytes, np.uint8)
            for doc, text, a, b in zip(ids, said, s.bounds[:-1].tolist(), s.bounds[1:].tolist()):
                mask = gone[a:b]
                removed = int(mask.sum())
                kept = buf[a:b][~mask].tobytes() if removed else text
                turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)) if removed else []
                row = (doc, b - a, removed, len(turns) // 2, hashlib.sha256(kept).hexdigest())
                if whole:
                    row += ([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])], kept)
                yield row

    return conclude


def earlier_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, k: int = 24, whole: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; whole=True adds spans (of removed bytes) and kept (binary).

    A byte of a text's UTF-8 goes if it lies in a string of `width` bytes that also starts in a document with a smaller id; the smallest document keeps
    all. Documents with one id never take from each other, so repeated rows fare alike; a null id counts as the largest. A null text has no bytes, and
    a shorter text than width keeps all; an empty table gives an empty result; other columns play no part. k: bytes of the substrings whose smallest hash deals a string out; it changes the cost, not the result.
    """
    if not 8 <= k <= width:
        raise ValueError("8 <= k <= width")
    n = partitions(docs.sparkSession)
    fields = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if whole:
        fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
        ddl += ", spans array<struct<start: long, end: long>>, kept binary"
    rows = B.blocked(docs, id_col, text_col, n)
    shared = B.answered(B.first_questions(rows, _hashes(width, k, n), n), _shared, n)
    found = B.answered(B.next_questions(rows, shared, _stretches(width, k, n), n), _matches(width), n)
    return B.concluded(rows, shared.union(found), _removal(width, k, n, whole), pa.schema(fields), ddl)
