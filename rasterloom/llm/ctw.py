"""Language-model scores by context-tree weighting.

A byte is eight binary decisions, each in the context of the bits already read of it and of up to `depth` bytes before. Every node of the context tree
has a Krichevsky-Trofimov estimate of its bits; going up, a node's probability is the mean of its own estimate and the product of its children's, so
that all depths mix by how well they did on the training texts. The tree grows with the corpus and stays on the cluster (deep.py): blocks of documents
send their contexts to buckets and are told the probability of each. A text's code length per byte is -score * log2(10) / bytes.

Beside it the unigram base score, whose vocabulary is not bounded: counts of words are summed up in buckets by digest, and each block of documents is
told those of its own words.
"""

from __future__ import annotations

import bisect
import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import deep
from .common import U64, Words, digests, given_back, kept_at_hand, paired, partitions, rows_of, texts
from .simhash import LOWER

#: A bucket of a deeper tree goes through its contexts in so many ranges, one at a time.
RANGES = 2
#: And a range of more entries than that, those of all blocks counted, in so many parts.
MOST = 1 << 20
#: The digest of the end token: of a space, which no word is.
END = np.concatenate(digests([b" "]))


def held_out(ident, folds: int = 7, fold: int = 2) -> bool:
    """By the CRC of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if ident is None else str(ident).encode()) % folds == fold


# ---------------------------------------------------------------- over the corpus


def _tokens(said: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which of the distinct lower-cased words each token is, these words, and where each document's tokens begin; ends are left out."""
    found = Words([t.translate(LOWER) for t in said])
    return found.of.astype(np.int32), found.distinct, found.firsts


def _merged(parts: Iterable[tuple[list, list[bytes]]], most: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Chunks of documents as fewer ones, so that a word's digest is made less often."""
    ids, said, size = [], [], 0
    for a, b in parts:
        ids += a
        said += b
        size += sum(map(len, b))
        if size >= most:
            yield ids, said
            ids, said, size = [], [], 0
    if ids:
        yield ids, said


def _vocabulary(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the distinct words of some lists of them, in order, and which each word is; the end token is the first that goes in."""
    found = pa.concat_arrays(parts or [pa.array([], pa.large_binary())]).dictionary_encode()
    one, two = digests(found.dictionary.to_pylist())
    first, second, _, where = paired(np.append(END[:1], one), np.append(END[1:], two))
    return first, second, np.append(where[:1], where[1:][found.indices.to_numpy()])


def _splitters(docs: DataFrame, id_col: str, text_col: str, depth: int, n: int) -> list[int]:
    """The smallest context of each range; there are at most RANGES for each of n buckets."""

    def run(batches):
        # what partitions take must not be the same contexts: then a few common ones would be all that is found, however many partitions there are
        salt = deep.mix(np.array([TaskContext.get().partitionId() + 1], U64))[0]
        some = (b.take(pa.array(np.arange(int(salt) % 4, len(b), 4))) if len(b) >= 64 else b for b in batches)
        held = [deep.sampled([t for _, t in chunk], depth, 256, salt) for chunk in rows_of(some, 4 << 20)]
        if held:
            found = np.concatenate(held)
            found = found[np.argsort(deep.mix(found ^ salt))[:1024]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["context"])

    rows = texts(docs, id_col, text_col).mapInArrow(run, "context long").toArrow()  # at most 1024 from each partition
    found = np.sort(rows["context"].to_numpy().view(U64))
    return sorted({0, *(int(x) for x in found[[len(found) * i // (RANGES * n) for i in range(1, RANGES * n)]])} if len(found) else {0})


def _by_last(held: list, depth: int, train) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block's distinct (context, byte) in order, and how often its training documents have each, a last byte of the contexts at a time."""
    places = deep.Places([t for _, said in held for t in said], depth)
    learn = np.repeat(np.array([train(i) for ids, _ in held for i in ids], bool), [len(t) + 1 + deep.MOST for _, said in held for t in said])
    for v, at, keys in places.by_last():
        mine = learn[at]
        taught, times = deep.tallied(keys[mine])
        other, _ = deep.tallied(keys[~mine])
        at = np.searchsorted(taught, other)
        new = at == len(taught)
        new[~new] = taught[at[~new]] != other[~new]
        at = at[new] + np.arange(np.count_nonzero(new))  # where the places of held-out texts alone go
        once, count = np.empty(len(taught) + len(at), U64), np.zeros(len(taught) + len(at), np.int64)
        known = np.ones(len(once), bool)
        known[at] = False
        once[at], once[known], count[known] = other[new], taught, times
        yield *deep.split(v, once), deep.narrow(count)


def _entries(held: list, depth: int, train) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of them at once."""
    return tuple(map(np.concatenate, zip(*_by_last(held, depth, train))))


def _packed(held: list, depth: int, train, low: list[int]) -> dict[int, tuple]:
    """They by range, packed as soon as a range is whole."""
    out, rest, j = {}, [], 0
    for found in _by_last(held, depth, train):
        rest.append(found)
        done = bisect.bisect_right(low, int(found[0][-1]))  # ranges before the one of the last context are whole
        if done - 1 > j:
            j = done - 1
            rest = _cut(out, rest, low, j)
    if rest:
        _cut(out, rest, low, len(low))
    return out


def _cut(out: dict, rest: list, low: list[int], upto: int) -> list:
    """Ranges below that number go to out; what is left of rest."""
    columns = tuple(map(np.concatenate, zip(*rest)))
    first = bisect.bisect_right(low, int(columns[0][0])) - 1
    ends = np.searchsorted(columns[0], np.array(low[first + 1 : upto + 1], U64)).tolist()
    if upto == len(low):
        ends.append(len(columns[0]))
    for j, a, b in zip(range(first, upto), [0, *ends], ends):
        if b > a:
            out[j] = deep.pack(*(x[a:b] for x in columns))
    at = ends[-1] if ends else 0
    return [tuple(x[at:].copy() for x in columns)] if at < len(columns[0]) else []


def _ends(low: list[int], i: int) -> tuple[int, int]:
    """The first and the last context of a range."""
    return low[i], low[i + 1] - 1 if i + 1 < len(low) else deep.ALL


def _ask(n: int, folds: int, fold: int, depth: int, low: list[int]):
    """Per block: (words' first halves, packed, their training counts, per range its number, packed contexts and training counts, words' second halves)."""

    def ask(parts, _):
        kept_at_hand()
        held, words, counts = [], [], [np.zeros(1, np.int64)]
        for ids, said in _merged(parts):
            held.append((ids, said))
            train = [not held_out(i, folds, fold) for i in ids]
            of, distinct, firsts = _tokens(said)
            words.append(distinct)
            counts.append(np.bincount(of[np.repeat(train, np.diff(firsts))], minlength=len(distinct)))
            counts[0] += sum(train)
        one, two, where = _vocabulary(words)
        del words
        counts = np.bincount(where, np.concatenate(counts), len(one)).astype(np.int64)
        cuts = B.bucket_cuts(one, n)
        given_back()
        packed = _packed(held, depth, lambda i: not held_out(i, folds, fold), low)
        for i in range(n):
            mine = {j: packed[j] for j in range(RANGES * i, min(RANGES * (i + 1), len(low))) if j in packed}
            if cuts[i + 1] > cuts[i] or mine:
                yield i, 0, (deep.pack_keys(one[cuts[i] : cuts[i + 1]]), deep.narrow(counts[cuts[i] : cuts[i + 1]]), mine, two[cuts[i] : cuts[i + 1]])

    return ask


def _parts(found: list[np.ndarray], first: int, last: int) -> list[tuple[int, int]]:
    """The ends of the parts in which to go through a range, with about MOST entries each. They follow from the entries, so they are the same each time."""
    n = -(-sum(map(len, found)) // MOST)
    if n < 2:
        return [(first, last)]
    some = np.sort(np.concatenate([c[::64] for c in found]))
    low = sorted({first, *(int(x) for x in some[[len(some) * i // n for i in range(1, n)]])})
    return list(zip(low, [*(x - 1 for x in low[1:]), last]))


def _ranges(said, depth: int, low: list[int]):
    """The subtrees of each range of a bucket, or of each part of one, which code each entry of each block is, and (index of the block, where its entries begin and end)."""
    for j in sorted({j for _, d in said for j in d[2]}):
        there = [k for k, (_, d) in enumerate(said) if j in d[2]]
        found = [deep.unpack(said[k][1][2][j]) for k in there]
        for first, last in _parts([f[0] for f in found], *_ends(low, j)):
            ends = [np.searchsorted(f[0], U64(first)).item() for f in found], [np.searchsorted(f[0], U64(last), "right").item() for f in found]
            cuts = np.cumsum([0] + [b - a for a, b in zip(*ends)])
            if not cuts[-1]:
                continue
            once, code, total, back = deep.entries(*(np.concatenate([x[a:b] for x, a, b in zip(c, *ends)]) for c in zip(*found)))
            yield deep.Subtrees(once, code, total, depth, first, last), back, list(zip(there, cuts[:-1], cuts[1:]))


def _summed(said) -> tuple[np.ndarray, np.ndarray]:
    """How often all training documents have each of a bucket's words, and which of these each word of each block is."""
    _, _, times, of = paired(np.concatenate([deep.unpack_keys(d[0]) for _, d in said]), np.concatenate([d[3] for _, d in said]))
    return np.bincount(of, np.concatenate([d[1] for _, d in said]), len(times)).astype(np.int64), of


def _climb(depth: int, low: list[int]):
    """To block -1: tokens, types and the open nodes of a bucket's ranges."""

    def answer(said):
        kept_at_hand()
        counts, _ = _summed(said)
        opened = []
        for tree, _, _ in _ranges(said, depth, low):
            opened = deep.summed(opened + tree.opened())
        yield -1, 1, (int(counts.sum()), int((counts > 0).sum()), opened)

    return answer


def _tell(depth: int, low: list[int], spine):
    """To each block the training counts of its words, and log10 of the probability of each of its entries."""

    def answer(said):
        kept_at_hand()
        counts, of = _summed(said)
        counts = counts[of]
        told = [[np.zeros(0, np.float32)] for _ in said]
        for tree, back, blocks in _ranges(said, depth, low):
            logs = tree.logs(spine.value).astype(np.float32)
            for k, a, b in blocks:
                told[k].append(logs[back[a:b]])
        at = 0
        for (block, d), logs in zip(said, told):
            mine = counts[at : at + len(d[3])]
            yield block, 0, (deep.narrow(mine), deep.pack_logs(np.concatenate(logs)))
            at += len(d[3])

    return answer


def _score(n: int, folds: int, fold: int, depth: int, tokens: int, types: int):
    def conclude(parts, heard):
        kept_at_hand()
        held, words, said = [], [], []
        for ids, some in _merged(parts):
            of, distinct, firsts = _tokens(some)
            held.append((ids, of, len(distinct), firsts))
            words.append(distinct)
            said += some
        places = deep.Places(said, depth)
        mine, _, where = _vocabulary(words)
        del words, said, some, distinct
        cuts, counts = B.bucket_cuts(mine, n), np.zeros(len(mine), np.int64)
        answers = heard.pop(0, {})
        told = np.empty(sum(packed[0] for _, packed in answers.values()), np.float32)
        at = 0
        for i in sorted(answers):  # buckets are in the order of their contexts
            counted, packed = answers.pop(i)
            counts[cuts[i] : cuts[i + 1]] = counted
            told[at : at + packed[0]] = deep.unpack_logs(packed)
            at += packed[0]
        logs = np.log10(counts + 1.0) - math.log10(tokens + types + 1.0)
        end, told_of, rows = int(where[0]), 1, []
        while held:  # these go before the places take their room
            ids, of, size, firsts = held.pop(0)
            at = where[told_of : told_of + size][of]
            told_of += size
            base = np.concatenate([[0.0], np.cumsum(logs[at])])
            known = np.concatenate([[0], np.cumsum(counts[at] > 0)])
            for ident, a, b in zip(ids, firsts[:-1], firsts[1:]):
                rows.append((ident, held_out(ident, folds, fold), int(b - a) + 1, int(known[b] - known[a]) + int(counts[end] > 0), tokens, float(base[b] - base[a] + logs[end])))
        del of, at, base, known, where, mine, counts, logs
        given_back()
        chance, at = np.zeros(len(places.buf), np.float32), 0
        for _, where_to, keys in places.by_last(deep.SHARE):
            once, of = deep.ranked(keys, np.int32)
            chance[where_to] = told[at : at + len(once)][of]
            at += len(once)
        if at != len(told):
            raise RuntimeError("answers do not fit the questions")
        for row, a, size in zip(rows, places.firsts.tolist(), places.sizes.tolist()):
            yield *row, float(chance[a : a + size].sum(dtype=np.float64)), size - 1

    return conclude


def context_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, depth: int = deep.MOST) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is log10 of the probability that the context tree, learnt from all rows that are not held out, gives to the text's UTF-8 bytes and their end.
    A null text counts as empty: its only token is the end. Repeated rows count each time. A null id is trained on or held out by the CRC of nothing.
    Its texts are read as they are; only the tokens of base_score are lower-cased. Without any training text every bit has one half and N is 0. Words are told
    apart by 128-bit cryptographic digests. depth: bytes of context, at most deep.MOST. An empty table gives an empty result; other columns play no part.
    """
    if not 1 <= depth <= deep.MOST:
        raise ValueError(f"depth must be from 1 to {deep.MOST}")
    spark = docs.sparkSession
    n = partitions(spark)
    rows = B.packed(docs, id_col, text_col, n)
    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
    ddl = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    per_byte = -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)
    low = _splitters(docs, id_col, text_col, depth, n)
    asked = B.gathered(B.first_questions(rows, _ask(n, folds, fold, depth, low), n), n)
    totals = [pickle.loads(r[0]) for r in B.answered(asked, _climb(depth, low)).select("data").collect()]  # two contexts a depth from each bucket
    spine = spark.sparkContext.broadcast(deep.joined([x for t in totals for x in t[2]], depth))
    out = B.concluded(rows, B.answered(asked, _tell(depth, low, spine)), _score(n, folds, fold, depth, sum(t[0] for t in totals), sum(t[1] for t in totals)), schema, ddl)
    return out.withColumn("bits_per_byte", per_byte).drop("n_bytes")
