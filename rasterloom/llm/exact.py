"""Exact deduplication by Patricia-trie owners.

Two rounds. In the first, each task puts the whole texts of its own rows into a compressed radix trie, so that a text leaves a task once,
however many copies the task has. In the second, those distinct texts are dealt out by length and content hash, and each task puts the full
byte strings into a trie again: the terminal node owns the group. No group's rows ever meet in one task, only one representative per task of
the first round does.

A trie that outgrows its memory spills by subtree: from the top down to where no child has over half of all, then the largest subtrees there go to
temporary files of the task (removed at once from the folder, as sort spills are) until half of the memory is free; a chain of texts that each begin the
next is so cut at its middle. Later keys that lead there are appended, and each file is worked off afterwards, one after another, in a trie of its own; one
that is far larger than the memory is dealt into parts by hash first.
"""

from __future__ import annotations

import hashlib
import marshal
import os
import shutil
import struct
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import own, partitions, rows_of, texts, written

#: What a node costs besides the bytes of its label, and a value, roughly.
NODE_BYTES, VALUE_BYTES = 400, 60
#: Copies of a text that a task of the first round gathers in a row; it sends the text once for each so many.
MOST_COPIES = 1 << 16


class Node:
    __slots__ = ("label", "below", "values", "file", "held")

    def __init__(self, label: bytes):
        self.label = label
        self.below: dict[int, Node] = {}
        self.values: list | None = None  # of a terminal node
        self.file = None  # of a spilled subtree


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of a equal those of b from `at` on; by halving, so that long runs compare in C."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Full byte strings in a compressed radix trie; each terminal node holds the values inserted with its string.

    most: a node that has so many values gives them to `full` and starts anew.
    """

    def __init__(self, memory_bytes: int, most: int | None = None):
        self.memory_bytes, self.most, self.bytes, self.root, self.spills = memory_bytes, most, 0, Node(b""), 0
        self.full: list[tuple[bytes, list]] = []
        self.limit, self.deals = memory_bytes, 0

    def insert(self, key: bytes, value) -> None:
        node, at, n = self.root, 0, len(key)
        while True:
            if node.file is not None:
                self._append(node, key, [value])
                return
            if at == n:
                if node.values is None:
                    node.values = []
                node.values.append(value)
                self._grow(VALUE_BYTES)
                if len(node.values) == self.most:
                    self.full.append((key, node.values))
                    self.bytes -= self.most * VALUE_BYTES
                    node.values = []
                return
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:])
                child.values = [value]
                self._grow(n - at + NODE_BYTES + VALUE_BYTES)
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = common_prefix(label, key, at)
            fork = Node(label[:k])
            child.label = label[k:]
            fork.below[label[k]] = child
            node.below[key[at]] = fork
            self.bytes += NODE_BYTES
            node, at = fork, at + k

    def _grow(self, more: int) -> None:
        self.bytes += more
        if self.bytes > self.limit:
            self._spill()
            self.limit = max(self.memory_bytes, self.bytes * 3 // 2)  # what can't spill, such as a path of open nodes, is not gone through again and again

    @staticmethod
    def _append(node: Node, key: bytes, values: list) -> None:
        packed = marshal.dumps(values)
        node.file.write(struct.pack("<QQ", len(key), len(packed)))
        node.file.write(key)
        node.file.write(packed)

    def _sizes(self) -> dict[int, int]:
        """By id() of each node, what it and all below it hold."""
        sizes: dict[int, int] = {}
        for node in reversed(list(self._nodes(self.root))):  # children before their parents
            sizes[id(node)] = len(node.label) + NODE_BYTES + VALUE_BYTES * len(node.values or ()) + sum(sizes[id(x)] for x in node.below.values())
        return sizes

    def _spill(self) -> None:
        """The largest subtrees under the lowest node that has over half of all go to files, until half of the memory is free."""
        sizes = self._sizes()
        self.bytes, node, path = sizes[id(self.root)], self.root, b""
        half = self.bytes // 2
        open_below = lambda: sorted((x for x in node.below.values() if x.file is None), key=lambda x: -sizes[id(x)])
        while (found := open_below()) and sizes[id(found[0])] > half and any(x.file is None for x in found[0].below.values()):
            node = found[0]
            path += node.label
        for old in found:
            if self.bytes <= half:
                break
            new = node.below[old.label[0]] = Node(old.label)
            new.file = tempfile.TemporaryFile()
            for key, values, file in self._walk(old, path):
                if file is not None:
                    file.seek(0)
                    shutil.copyfileobj(file, new.file)
                    file.close()
                elif values:
                    self._append(new, key, values)
            self.bytes -= sizes[id(old)] - NODE_BYTES - len(old.label)
            self.spills += 1

    @staticmethod
    def _nodes(top: Node) -> Iterator[Node]:
        stack = [top]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.below.values())

    @staticmethod
    def _walk(top: Node, path: bytes) -> Iterator[tuple[bytes, list | None, object]]:
        """(string, values, file) of each terminal node and each spilled subtree."""
        stack = [(top, path)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.file is not None or node.values is not None:
                yield key, node.values, node.file
            stack.extend((x, key) for x in node.below.values())

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """Every distinct string with its values, once (or once for each `most` of them); spilled subtrees follow, one trie after another."""
        tries: list[PatriciaTrie] = [self]
        files: list = []
        while tries or files:
            if not tries:
                file, may_deal = files.pop()
                size = file.seek(0, os.SEEK_END)
                if may_deal and size > 4 * self.memory_bytes:
                    files += [(x, x.tell() <= size // 2) for x in self._dealt(file)]  # what doesn't part is copies of few texts: no load for a trie
                    continue
                deeper = PatriciaTrie(self.memory_bytes, self.most)
                for key, values in self._entries(file):
                    for value in values:
                        deeper.insert(key, value)
                    yield from deeper.drained()
                tries.append(deeper)
            trie = tries.pop()
            yield from trie.drained()
            for key, values, file in self._walk(trie.root, b""):
                if file is not None:
                    files.append((file, True))
                elif values:
                    yield key, values
            trie.root = Node(b"")

    @staticmethod
    def _entries(file) -> Iterator[tuple[bytes, list]]:
        file.seek(0)
        while head := file.read(16):
            n, m = struct.unpack("<QQ", head)
            yield file.read(n), marshal.loads(file.read(m))
        file.close()

    def _dealt(self, file, parts: int = 16) -> list:
        """A subtree far too large for a trie in parts by a hash of the string, so that a long chain of texts is not written again for every few of them."""
        out = [Node(b"") for _ in range(parts)]
        for node in out:
            node.file = tempfile.TemporaryFile()
        self.deals += 1
        for key, values in self._entries(file):
            self._append(out[zlib.crc32(key, self.deals) % parts], key, values)
        return [node.file for node in out]

    def drained(self) -> Iterator[tuple[bytes, list]]:
        while self.full:
            yield self.full.pop()


def _better(keep: str):
    """True if the first (id, row) stays rather than the second; a missing id never wins over another, ties go to the smaller row."""
    largest = keep == "max"

    def better(a: tuple, b: tuple) -> bool:
        if a[0] is None or b[0] is None:
            return b[0] is None and (a[0] is not None or a[1] < b[1])
        if a[0] != b[0]:
            return (a[0] > b[0]) == largest
        return a[1] < b[1]

    return better


LOCAL = "rep long, length long, hash long, sha string, text binary, ids array<long>, best long, n long"


def _local(memory_bytes: int, keep: str):
    schema = pa.schema([("rep", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("ids", pa.list_(pa.int64())), ("best", pa.int64()), ("n", pa.int64())])
    better = _better(keep)

    def run(batches):
        trie = PatriciaTrie(memory_bytes, MOST_COPIES)
        out, held, rep = [], 0, TaskContext.get().partitionId() << 40

        def found():
            for chunk in rows_of(batches):
                for doc, text in chunk:
                    trie.insert(text, doc)
                yield from trie.drained()
            yield from trie.terminals()

        for text, ids in found():
            best = (ids[0], 0)
            for i, doc in enumerate(ids):
                if better((doc, i), best):
                    best = (doc, i)
            ids[0], ids[best[1]] = ids[best[1]], ids[0]  # the one that may stay comes first
            sha = hashlib.sha256(text).hexdigest()
            out.append((rep, len(text), int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True), sha, text, ids, best[0], len(ids)))
            rep, held = rep + 1, held + len(text) + 8 * len(ids)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _owners(memory_bytes: int, keep: str):
    schema = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_rep", pa.int64()), ("group_size", pa.int64())])
    better = _better(keep)

    def run(batches):
        trie = PatriciaTrie(memory_bytes)
        for chunk in rows_of(batches):
            for rep, text, best, n in chunk:
                trie.insert(text, (rep, best, n))
        out = []
        for _, found in trie.terminals():
            owner, size = (found[0][1], found[0][0]), 0
            for rep, best, n in found:
                size += n
                if better((best, rep), owner):
                    owner = (best, rep)
            out += [(rep, owner[0], owner[1], size) for rep, _, _ in found]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memory_bytes: int = 96 << 20) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. keep: "min" or "max", the id that stays of equal texts.

    A null text counts as empty, and empty texts form one group. A null id never stays while the group has another. Of rows that repeat both id
    and text exactly one has kept = true. An empty table gives an empty result; other columns of docs, whatever their names, play no part.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is 'min' or 'max', not {keep!r}")
    n = partitions(docs.sparkSession)
    local = written(texts(docs, id_col, text_col).mapInArrow(_local(memory_bytes, keep), LOCAL), "exact")
    dealt = local.select("length", "hash", "rep", "text", "best", "n").repartition(n, "length", "hash").select("rep", "text", "best", "n")
    owners = dealt.mapInArrow(_owners(memory_bytes, keep), "rep long, keep_id long, keep_rep long, group_size long")
    each = local.select("rep", "sha", "ids").join(owners, "rep").select("*", F.posexplode("ids").alias("at", "id"))
    return each.select(F.col("id").alias(id_col), "keep_id", "group_size", ((F.col("at") == 0) & (F.col("rep") == F.col("keep_rep"))).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with their columns: one for each distinct text. Of rows that repeat id and text, one stays."""
    o = own(docs)
    stays = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(f"`{id_col}`").alias(o("id")), F.col("text_sha256").alias(o("sha")))
    tagged = docs.withColumn(o("of"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))
    found = tagged.join(stays, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(o("id"))) & (F.col(o("of")) == F.col(o("sha"))), "left_semi")
    one = F.row_number().over(Window.partitionBy(f"`{id_col}`", o("of")).orderBy(o("of")))
    return found.withColumn(o("one"), one).where(F.col(o("one")) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
