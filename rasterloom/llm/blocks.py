"""Questions that blocks of documents ask about the whole corpus.

Documents are dealt out once into as many blocks as a shuffle has partitions, by a hash of id and text, so a block is the same rows whenever it is made
again. A block reduces what it wants to know to sorted, distinct 64-bit keys and sends each range of them to the bucket of that range; a bucket sees
what all blocks sent and answers each in the order of its keys. So a key costs a few bytes once per block, however often it occurs, and an answer needs
no key at all. Blocks and buckets fill one partition each; both shrink as the session's number of shuffle partitions grows.
"""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, spots, texts, written

MESSAGE = pa.schema([("place", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
MESSAGE_DDL = "place int, bucket int, block int, kind int, data binary"
#: Keys are compared by so many of their leading bits where a mistaken match only costs another look.
SHORT = 48
#: Documents that a task packs at a time, in bytes.
PACKED = 24 << 20


def blocked(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(block, id, text): one block per partition."""
    rows = texts(docs, id_col, text_col)
    block = F.element_at(F.lit(spots(n)), (F.pmod(F.xxhash64("id", "text"), F.lit(n)) + 1).cast("int")).cast("int")
    return rows.select(block.alias("block"), "id", "text").repartition(n, "block")


def packed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(block, data): the same with compressed documents, many to a row, in half as many blocks of twice the size: what blocks ask for more than once goes out less often."""
    m = max(1, n // 2)
    rows = texts(docs, id_col, text_col)
    block = F.element_at(F.lit(spots(n)[:m]), (F.pmod(F.xxhash64("id", "text"), F.lit(m)) + 1).cast("int")).cast("int")
    schema = pa.schema([("block", pa.int32()), ("data", pa.binary())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > PACKED:
                yield from _packed(held, schema)
                held, size = [], 0
        if held:
            yield from _packed(held, schema)

    return rows.select(block.alias("block"), "id", "text").mapInArrow(run, "block int, data binary").repartition(n, "block")


def _packed(held: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    if not len(table):
        return
    block = table["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    block, ids = block[order], table["id"].take(pa.array(order)).to_pylist()
    said = table["text"].cast(pa.large_binary()).combine_chunks()
    said = (said.chunk(0) if isinstance(said, pa.ChunkedArray) else said).take(pa.array(order))
    _, ends, data = said.buffers()
    ends = np.frombuffer(ends, np.int64)[said.offset : said.offset + len(said) + 1]
    data = memoryview(data) if data is not None else b""
    first = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
        some = pa.Codec("zstd", 3).compress(data[ends[a] : ends[b]], asbytes=True)
        out.append(pickle.dumps((ids[a:b], np.diff(ends[a : b + 1]), some), protocol=5))
    yield pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array(out, pa.binary())], schema=schema)


def _documents(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) in chunks, of documents as they are or packed."""
    if "data" not in rows.schema.names:
        yield from chunks(_ids(rows["id"]), _binary(rows["text"]))
        return
    for row in rows["data"]:
        ids, sizes, data = pickle.loads(row.as_py())
        ends = np.cumsum(sizes)
        data = pa.decompress(data, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
        ends = ends.tolist()
        yield ids, [data[a:b] for a, b in zip([0, *ends], ends)]


def bucket_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the keys (64 bits, sorted) of each of n buckets begin, and the end."""
    firsts = np.array([(i << 64) // n for i in range(n)], U64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def pack(keys: np.ndarray) -> tuple:
    """Sorted keys cut to SHORT bits, as differences of 32 bits if these are large enough."""
    short = keys >> U64(64 - SHORT)
    steps = np.diff(short)
    if len(steps) and steps.max() >> U64(32):
        return None, short
    return short[:1], steps.astype(np.uint32)


def unpack(packed: tuple) -> np.ndarray:
    first, steps = packed
    if first is None:
        return steps
    return np.concatenate([first, first[0] + np.cumsum(steps, dtype=U64)]) if len(first) else first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether each is there more than once."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[new], np.diff(np.append(new, len(keys))) > 1


def shorten(keys: np.ndarray) -> np.ndarray:
    return keys >> U64(64 - SHORT) << U64(64 - SHORT)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def chunks(ids: Iterable, said: Iterable[bytes], most: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
    a, b, held = [], [], 0
    for i, t in zip(ids, said):
        if a and held + len(t) > most:
            yield a, b
            a, b, held = [], [], 0
        a.append(i)
        b.append(t)
        held += len(t)
    if a:
        yield a, b


def _binary(col: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    for part in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        part = part.cast(pa.large_binary() if pa.types.is_large_string(part.type) else pa.binary())
        for at in range(0, len(part), 512):
            yield from part.slice(at, 512).to_pylist()


def _ids(col) -> list:
    return col.to_pylist()


def _send(block: int, n: int, places: list[int], made: Iterable[tuple[int, int, object]]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for bucket, kind, data in made:
        data = pickle.dumps(data, protocol=5)
        out.append((places[bucket], bucket, block, kind, data))
        held += len(data)
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), MESSAGE)], schema=MESSAGE)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), MESSAGE)], schema=MESSAGE)


#: (ids, texts as bytes in chunks of documents) and the answers to the block, by kind and bucket.
Ask = Callable[[Iterator[tuple[list, list[bytes]]], dict[int, dict[int, object]]], Iterable[tuple[int, int, object]]]


def first_questions(blocks: DataFrame, ask: Ask, n: int) -> DataFrame:
    """What each block asks before it has any answer: ask gives (bucket, kind, data)."""
    places = spots(n)

    def run(batches):
        at = None
        held: dict[int, list] = {}

        def parts(first):
            nonlocal at
            batch = first
            while batch is not None:
                yield from _documents(batch)
                batch = next(batches, None)
                while batch is not None and not len(batch):
                    batch = next(batches, None)
                if batch is not None and (batch["block"][0].as_py() != at or batch["block"][-1].as_py() != at):
                    raise RuntimeError("a partition holds more than one block")

        batches = iter(batches)
        first = next((b for b in batches if len(b)), None)
        if first is not None:
            at = first["block"][0].as_py()
            yield from _send(at, n, places, ask(parts(first), held))

    return blocks.mapInArrow(run, MESSAGE_DDL)


def _heard(right: pa.Table) -> dict[int, dict[int, object]]:
    out: dict[int, dict[int, object]] = {}
    for kind, bucket, data in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["data"]):
        out.setdefault(kind, {})[bucket] = pickle.loads(data.as_py())
    return out


def next_questions(blocks: DataFrame, answers: DataFrame, ask: Ask, n: int) -> DataFrame:
    """The same with the answers so far at hand."""
    places = spots(n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return MESSAGE.empty_table()
        made = _send(left["block"][0].as_py(), n, places, ask(chunks(_ids(left["id"]), _binary(left["text"])), _heard(right)))
        return pa.Table.from_batches(made, schema=MESSAGE)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, MESSAGE_DDL)


def gathered(questions: DataFrame, n: int) -> DataFrame:
    """The questions as a table, those of a bucket in one file and there in one row group, so that no task reads a part of them: dealt out once however often they are answered."""
    out = written(questions.repartition(n, "place"), "questions", **{"parquet.block.size": (1 << 31) - 1, "maxRecordsPerFile": 0})
    for _ in range(2):  # what was dealt out lies on the executors' disks until the driver has collected its garbage; its listeners hold it a little longer
        time.sleep(0.7)
        gc.collect()
        questions.sparkSession._jvm.System.gc()
    return out


def answered(questions: DataFrame, answer: Callable[[list[tuple[int, object]]], Iterable[tuple[int, int, object]]], n: int | None = None) -> DataFrame:
    """Each bucket sees [(block, data)] of all blocks and gives (block, kind, data) back. Without n the questions are gathered."""

    def run(batches):
        heard: dict[int, list] = {}
        for batch in batches:
            for bucket, block, data in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), batch["data"]):
                heard.setdefault(bucket, []).append((block, data.as_py()))
        for bucket in sorted(heard):
            said = [(block, pickle.loads(data)) for block, data in sorted(heard.pop(bucket))]
            out = [(0, bucket, block, kind, pickle.dumps(data, protocol=5)) for block, kind, data in answer(said)]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 64]), MESSAGE)], schema=MESSAGE)

    return (questions.repartition(n, "place") if n else questions).mapInArrow(run, MESSAGE_DDL)


def concluded(blocks: DataFrame, answers: DataFrame, conclude: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """conclude(chunks of documents, answers) gives rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made, out = [], []
        if len(left):
            for row in conclude(_documents(left), _heard(right)):
                out.append(row)
                if len(out) == 5000:
                    made.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema))
                    out = []
            if out:
                made.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema))
        return pa.Table.from_batches(made, schema=schema)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)
