"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are made text by text. Distinct fingerprints are then joined with themselves: two that differ in at most k bits agree in all but k of
b blocks of bits, so each (choice of blocks, value) is a bucket, and the fingerprints of a bucket form a binary trie over their sorted order, a node being a
range. Pairs of nodes go down together, level by level; a pair adds one where its bits differ and is dropped once it has more than k. Pairs whose
ranges already belong to one component are dropped too: they cannot change a component. A bucket gives back only a spanning forest of its links, so
that no group's pairs are ever written out.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, own, partitions, rows_of, texts, written
from .components import connected_components

BITS = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each run of `width` words joined by one space; fewer words: of the whole sequence; none: no hash."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    h = xxhash.xxh64_intdigest
    return [h(line[s:e], seed) for s, e in zip(starts, ends)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    a = np.array(hashes, U64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(a), 1 << 14):
        ones += np.unpackbits(a[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(a)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, marked: bool = False) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each whole text as a signed long. Null text: empty, fingerprint zero. With marked also mark, a hash of the text."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())] + [("mark", pa.int64())] * marked)

    def run(batches):
        for chunk in rows_of(batches, 4 << 20):
            cols = [pa.array([r[0] for r in chunk], pa.int64()), pa.array(np.array([fingerprint(shingle_hashes(r[1], width, seed)) for r in chunk], U64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([r[2] for r in chunk], pa.int64())] if marked else []), schema=schema)

    rows = texts(docs, id_col, text_col)
    if marked:
        rows = rows.withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, "id long, fp long" + ", mark long" * marked)


def blocks_of(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of so many blocks that cover the 64 bits."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def copies_of(blocks: int, k: int, rows: int, shard_rows: int) -> float:
    """How often each fingerprint goes out, if it has a key for each choice of all but k of the blocks and buckets are cut into shards."""
    bits = BITS * (blocks - k) / blocks
    return math.comb(blocks, k) * max(1.0, rows / 2**bits / shard_rows)


def keys_for(k: int, rows: int, shard_rows: int) -> list[list[tuple[int, int]]]:
    """The blocks that make each key: two fingerprints within k bits agree in all but k blocks at least. More blocks give more and longer keys, so smaller
    buckets; their number is that with the fewest copies for so many fingerprints."""
    blocks = min(range(k + 1, k + 5), key=lambda b: copies_of(b, k, rows, shard_rows))
    return [list(c) for c in itertools.combinations(blocks_of(blocks), blocks - k)]


def _key(parts: list[tuple[int, int]], number: int) -> Column:
    out, at = F.lit(number << 44), 0
    for shift, width in parts:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


class TrieJoin:
    """The self-join of the tries over some sorted, distinct fingerprints of several buckets."""

    #: So many node pairs go down at a time; the others wait on a stack.
    MOST = 1 << 18

    def __init__(self, tops: np.ndarray, fps: np.ndarray, k: int):
        """tops: where each bucket starts, and the end; fps: sorted within a bucket."""
        self.fps, self.k, self.n = fps, k, len(fps)
        self.root = np.arange(self.n)
        self.ones: dict[int, np.ndarray] = {}
        self.tops = tops

    def zeros(self, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the ones of that bit start in each range: there the zeros come first."""
        if bit not in self.ones:
            self.ones[bit] = np.concatenate([[0], np.cumsum((self.fps >> U64(bit)) & U64(1), dtype=np.int64)])
        return hi - (self.ones[bit][hi] - self.ones[bit][lo])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of a[i] and b[i]; afterwards root[] names each component by its smallest member."""
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def run(self) -> np.ndarray:
        lo, hi = self.tops[:-1], self.tops[1:]
        big = hi - lo > 1
        lo, hi = lo[big], hi[big]
        stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
        while stack:
            bit, l1, h1, l2, h2, err = stack.pop()
            if len(l1) > self.MOST:
                half = len(l1) // 2
                stack += [(bit, *(x[half:] for x in (l1, h1, l2, h2, err))), (bit, *(x[:half] for x in (l1, h1, l2, h2, err)))]
                continue
            ends = np.flatnonzero(self.root[1:] != self.root[:-1]) + 1  # ranges of one component
            last = np.append(ends, self.n)[np.searchsorted(ends, l1, "right")]
            one = (self.root[l1] == self.root[l2]) & (last >= h1) & (np.append(ends, self.n)[np.searchsorted(ends, l2, "right")] >= h2)
            l1, h1, l2, h2, err = (x[~one] for x in (l1, h1, l2, h2, err))
            leaves = (h1 - l1 == 1) & (h2 - l2 == 1)
            if leaves.any():
                a, b = l1[leaves], l2[leaves]
                near = np.bitwise_count(self.fps[a] ^ self.fps[b]) <= self.k
                self.link(a[near], b[near])
                l1, h1, l2, h2, err = (x[~leaves] for x in (l1, h1, l2, h2, err))
            if not len(l1) or bit < 0:
                continue
            m1, m2 = self.zeros(bit, l1, h1), self.zeros(bit, l2, h2)
            same = (l1 == l2) & (h1 == h2)
            two = ~same
            down = [
                (l1, m1, l2, m2, err),
                (m1, h1, m2, h2, err),
                (l1, m1, m2, h2, err + 1),
                (m1[two], h1[two], l2[two], m2[two], err[two] + 1),
            ]
            l1, h1, l2, h2, err = (np.concatenate(x) for x in zip(*down))
            stay = (h1 > l1) & (h2 > l2) & (err <= self.k) & ~((l1 == l2) & (h1 - l1 == 1))
            if stay.any():
                stack.append((bit - 1, *(x[stay] for x in (l1, h1, l2, h2, err))))
        return self.root


def _forest(k: int):
    schema = pa.schema([("fp", pa.int64()), ("other", pa.int64())])

    def run(batches):
        cols = [[], [], [], []]
        for batch in batches:
            for into, col in zip(cols, batch.columns):
                into.append(col.to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        bucket, one, two, fps = (np.concatenate(c) for c in cols)
        fps = fps.view(U64)
        order = np.lexsort((fps, two, one, bucket))
        bucket, one, two, fps = bucket[order], one[order], two[order], fps[order]
        new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        root = TrieJoin(np.concatenate([[0], new, [len(fps)]]), fps, k).run()
        # members of a component in order, each linked with the one before: a chain has no hot node
        order = np.argsort(root, kind="stable")
        a, b = order[:-1], order[1:]
        joined = root[a] == root[b]
        a, b = fps[a[joined]].view(np.int64), fps[b[joined]].view(np.int64)
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], schema=schema)

    return run


def linked(distinct: DataFrame, k: int, shard_rows: int = 4000) -> DataFrame:
    """distinct: (fp long), no two equal. Chains (fp, other) that link what lies within k bits, directly or by way of others of a bucket.

    Keys are made of more bits the more fingerprints there are (keys_for). A bucket that still has more than shard_rows of them, because they are alike, is
    cut into shards by hash, and each pair of shards is joined by itself, so no bucket lands in one task.
    """
    n = partitions(distinct.sparkSession)
    keys = F.array(*(_key(parts, i) for i, parts in enumerate(keys_for(k, distinct.count(), shard_rows))))
    rows = distinct.select("fp", F.explode(keys).alias("bucket"))
    sizes = rows.groupBy("bucket").count().where(F.col("count") > shard_rows).select("bucket", F.ceil(F.col("count") / shard_rows).alias("shards"))
    rows = rows.join(written(sizes, "buckets"), "bucket", "left")
    shard = F.pmod(F.xxhash64("fp"), F.col("shards"))
    pairs = F.when(F.col("shards").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1), lambda s: F.struct(F.least(s, shard).alias("one"), F.greatest(s, shard).alias("two")))
    )
    rows = rows.select("fp", "bucket", F.explode(pairs).alias("p")).select("bucket", "p.one", "p.two", "fp")
    return rows.repartition(n, "bucket", "one", "two").mapInArrow(_forest(k), "fp long, other long")


def _rooted(fps: DataFrame, k: int) -> DataFrame:
    """(fp, least, root) of each distinct fingerprint: the smallest id that has it, and the component."""
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    edges = linked(nodes.select("fp"), k).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    roots = connected_components(edges)
    found = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return written(found, "roots")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most k bits).

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Equal fingerprints are one node, so groups of copies
    cost one row. Components that don't settle in 60 rounds are an error. Null ids never name a component unless nothing else can (component_id is then null). Repeated rows share a component.
    """
    fps = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    found = _rooted(fps, k)
    names = written(found.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    of = written(found.select("fp", "root").join(names, "root").select("fp", "component_id"), "members")
    return fps.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4, seed: int = 42) -> DataFrame:
    """docs without near copies, with its columns: of each component the row with the smallest (id, hash of the text) stays, and one row only.

    A null id counts as the largest, a null text as the empty one; ids may repeat. Of rows with one id and one text that with the smallest columns, in
    their order, stays.
    """
    fps = written(fingerprints(docs, id_col, text_col, width, seed, marked=True), "fingerprints")
    found = _rooted(fps, k).select("fp", "root")
    rows = fps.groupBy("fp", "id", "mark").agg(F.count("*").alias("copies")).join(found, "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "copies")).alias("best"))
    o = own(docs)
    stays = written(best.select(F.col("best.id").alias(o("stays")), F.col("best.mark").alias(o("mark")), F.col("best.copies").alias(o("copies"))), "stays")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(o("stays"))) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col(o("mark")))
    if stays.where(F.col(o("copies")) > 1).isEmpty():
        return docs.join(stays, same, "left_semi")
    once = docs.join(stays.where(F.col(o("copies")) == 1), same, "left_semi")
    more = docs.join(stays.where(F.col(o("copies")) > 1), same).groupBy(o("stays"), o("mark")).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(o("row")))
    return once.union(more.select(*(F.col(f"{o('row')}.`{c}`") for c in docs.columns)))
