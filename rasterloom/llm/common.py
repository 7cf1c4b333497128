"""What the operators of this subpackage share: tables, scratch tables, batches of documents and 64-bit hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session; every exchange here follows it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; it goes when the session's driver ends.

    Only where that setting is missing, as in tests on one machine, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/rasterloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended first
        pass


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows as a table in the shared folder: the lineage ends there, and no lost executor brings it back. options: of the writer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Written tables that nothing reads any more go at once, not at the end of the session."""
    for df in tables:
        _remove(df.sparkSession, df.scratch_path)


def own(df: DataFrame) -> Callable[[str], str]:
    """Names for columns of an operator's own that no column of df can clash with."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return lambda name: prefix + name


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id long, text string without nulls) and the columns named in more, whatever else docs holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *(F.col(f"`{m}`").alias(f"x_{m}") for m in more))


def rows_of(batches, chunk_bytes: int = 1 << 19) -> Iterator[list[tuple]]:
    """Rows as tuples, texts as bytes, in chunks of about chunk_bytes of text; a longer text is a chunk of its own."""
    chunk, held = [], 0
    for batch in batches:
        cols = []
        for field, col in zip(batch.schema, batch.columns):
            if field.name == "text":
                col = col.cast(pa.large_binary() if pa.types.is_large_string(field.type) else pa.binary())
            cols.append(col.to_pylist())
        at = batch.schema.get_field_index("text")
        for row in zip(*cols):
            if chunk and held + len(row[at]) > chunk_bytes:
                yield chunk
                chunk, held = [], 0
            chunk.append(row)
            held += len(row[at])
    if chunk:
        yield chunk


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Rolling:
    """Hashes of slices of a sequence from one running sum: sum of value[i] * base**i modulo 2**64, brought back by base**-start.

    base is odd and so has an inverse; values are spread over 64 bits first. mix() goes over the difference, with the slice's length.
    """

    def __init__(self, base: int, seed: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.values = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U64)
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            one = np.ones(1, U64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([one, np.cumprod(np.full(size - 1, self.base, U64))])
                self.down = np.concatenate([one, np.cumprod(np.full(size - 1, self.back, U64))])
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[:-1], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(sums))
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Of every slice of that width."""
        _, down = self.powers(len(sums))
        n = len(sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix((sums[width:] - sums[:n]) * down[:n])


BYTES = Rolling(0x5851F42D4C957F2D, 11)
WORDS = Rolling(0x2545F4914F6CDD1D, 12)


def digests(said: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit cryptographic digest of each: nobody can make two that are equal but for what they are digests of."""
    halves = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in said]), U64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of these bytes start and end."""
    white = np.ones(len(buf) + 2, bool)
    white[1:-1] = IS_WHITE[buf]
    turns = np.flatnonzero(white[1:] != white[:-1])
    return turns[::2], turns[1::2]


class Words:
    """The words of some documents in a row: `of` says which of the `distinct` ones (in Arrow; as a list: `words`) each is, sizes how long it is, firsts where each document's words begin."""

    def __init__(self, said: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(said), np.uint8)
        starts, self.to = word_spans(self.buf)
        self.sizes = self.to - starts
        offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        bare = self.buf[~IS_WHITE[self.buf]]
        found = pa.Array.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(offsets), pa.py_buffer(bare)]).dictionary_encode()
        self.of, self.distinct = found.indices.to_numpy().astype(np.int64), found.dictionary
        self.firsts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in said]))

    @property
    def words(self) -> list[bytes]:
        return self.distinct.to_pylist()

    def joined(self) -> bytes:
        """All words with one space after each, but for the last of all."""
        keep = ~IS_WHITE[self.buf]
        keep[self.to[self.to < len(keep)]] = True  # the white space after a word
        line = self.buf[keep]
        ends = np.cumsum(self.sizes + 1) - 1
        line[ends[ends < len(line)]] = 32
        return line.tobytes()


def paired(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (first, second), how often each is there, and which of them each input is."""
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    where = np.empty(len(f), np.int64)
    where[order] = np.cumsum(new) - 1
    return f[at], s[at], np.diff(np.append(at, len(f))), where


class Recent:
    """A cache of at most twice `most` entries: when the new generation is full it becomes the old one; what is used again moves on."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.new[key] = found
        return found

    def put(self, key, value):
        self.new[key] = value

    def age(self) -> None:
        """Called between documents, never within one."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}


#: A Python worker that has had no task for so many seconds lets go of its model.
IDLE = 2.0
_model: dict = {}
_taken = 0
_lock = threading.RLock()


def only_model(key: tuple, make: Callable):
    """The model of that key, made once per Python worker. A worker holds one at a time: the next stage's takes the place of the last one's."""
    global _taken
    with _lock:
        _taken += 1
        if key not in _model:
            _model.clear()
            _model[key] = make()
        return _model[key]


def _let_go(taken: int) -> None:
    with _lock:
        if _taken != taken or not _model:  # taken again meanwhile
            return
        _model.clear()
        gc.collect()
        given_back()


def given_back() -> None:
    """What was freed in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def kept_at_hand(most: int = 128 << 20) -> None:
    """Up to so many freed bytes stay with this process until given_back(): arrays of a block come and go, and new pages take a tenth of its time."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def _task_over() -> None:
    later = threading.Timer(IDLE, _let_go, (_taken,))
    later.daemon = True
    later.start()


def rested(run: Callable) -> Callable:
    """run, for mapInArrow, with an end: unless its worker soon takes up another task with a model, it lets go of this one.

    Spark deals tasks out to its idle workers in turn, and after stages with several Python steps there are more of them than cores: else each would come to
    hold a model, which none of the running tasks uses.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _task_over()

    return task


# ---------------------------------------------------------------- placing rows


def _murmur_int(value: int, seed: int = 42) -> int:
    """The hash by which Spark deals out an int column."""
    m = 0xFFFFFFFF
    k = (value & m) * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    h = seed ^ (k * 0x1B873593 & m)
    h = (h << 13 | h >> 19) & m
    h = (h * 5 + 0xE6546B64) & m
    h ^= 4
    h ^= h >> 16
    h = h * 0x85EBCA6B & m
    h ^= h >> 13
    h = h * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def spots(n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning over n puts there: buckets with these numbers fill partitions one by one."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < n:
        found.setdefault(_murmur_int(value) % n, value)
        value += 1
    return [found[p] for p in range(n)]
