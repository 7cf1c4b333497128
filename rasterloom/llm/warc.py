"""WARC archives: written and read back, with an index of captures made by an external merge.

Writing is a plain text sink whose line separator is the blank lines that end a record; a record of HTML in UTF-8 is text as a whole. Equal payloads are
stored once: the capture with the largest id is the response, the others are revisits that name it. Reading follows the lengths in the headers, file by
file. The index: each task sorts the captures of its files, a run; splitters from a bounded sample cut every run into slices by range of (URL key,
timestamp, id); each range writes its slices to its task's disk and merges them from there with a loser tree, a batch of each at a time. Ranges in order, rows in order within them: a global order of capture histories, in
which even the captures of one URL may lie in several ranges.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch, spots, written

#: Payloads shorter than this are stored in full each time.
LEAST_BYTES = 1000
#: Records in a file at most; a page of LARGE_BYTES or more goes to files of its own kind, which hold as many as FILE_BYTES allow.
FILE_RECORDS, LARGE_BYTES, FILE_BYTES = 2000, 1 << 16, 1 << 27
#: Runs that are merged at a time.
FAN_IN = 128
#: Captures from which the splitters are taken, about.
SAMPLE_ROWS = 20_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1704067200


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def _urn(ident: Column) -> Column:
    return F.when(ident.isNotNull(), F.concat(F.lit("<urn:page:"), ident.cast("string"), F.lit(">")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None) -> None:
    """One record per row of pages. time: a timestamp column; without one, the id counts seconds from the start of 2024."""
    base = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.regexp_replace(F.col(f"`{url_col}`"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
        (time if time is not None else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)) % F.lit(1 << 31))).alias("time"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    large = base.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "bytes").agg(F.max("id").alias("owner"), F.count("*").alias("n"))
    copies = written(large.where("n > 1").select("digest", "bytes", "owner"), "payloads")
    rows = base.join(copies, ["digest", "bytes"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.lit("<urn:page:none>"))),
        _line("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT))), _line("WARC-Refers-To", F.when(revisit, _urn(F.col("owner")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    largest = base.agg(F.max("bytes")).first()[0] or 0
    kinds = [(rows, FILE_RECORDS)] if largest < LARGE_BYTES else [(rows.where(F.col("bytes") < LARGE_BYTES), FILE_RECORDS), (rows.where(F.col("bytes") >= LARGE_BYTES), max(1, min(FILE_RECORDS, FILE_BYTES // largest)))]
    for some, most in kinds:
        some.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(folder)


def records(content: bytes, name: str = "") -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record of an archive; a broken one is an error."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at} of {name}")
        lines = content[at:head].split(b"\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        start = head + 4
        end = start + int(fields[b"content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} of {name} is cut off")
        yield at, end + 4 - at, fields, content[start:end]
        at = end + 4


def url_key(url: str) -> str:
    """Host from the right, then the path: captures of a site lie together."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url)
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower().partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + slash + path


CAPTURE = [("url_key", pa.string(), "string"), ("timestamp", pa.string(), "string"), ("page_id", pa.int64(), "long"), ("record_type", pa.string(), "string"), ("payload_digest", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("refers_to", pa.int64(), "long"), ("file", pa.string(), "string"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long")]
DDL = ", ".join(f"{n} {d}" for n, _, d in CAPTURE)


def _page(urn: bytes | None) -> int | None:
    said = (urn or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(said) if said and said != b"none" else None


def captures(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in that folder; digests of responses are those of the payload as read. payloads=True adds it."""
    schema = pa.schema([(n, t) for n, t, _ in CAPTURE] + [("payload", pa.binary())] * payloads)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                out, held = [], 0
                for offset, length, fields, block in records(content.as_py(), path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?mi)^content-length: *(\d+)", head)[1])
                    kind = fields[b"warc-type"].decode()
                    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response":
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"the payload at byte {offset} of {path} is not what was written")
                    key = url_key(fields.get(b"warc-target-uri", b"").decode())
                    stamp = re.sub(r"\D", "", fields[b"warc-date"].decode())
                    row = (key, stamp, _page(fields[b"warc-record-id"]), kind, digest, size, _page(fields.get(b"warc-refers-to")), path.rpartition("/")[2], offset, length)
                    out.append(row + ((payload if kind == "response" else None,) if payloads else ()))
                    held += length if payloads else 100
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, DDL + (", payload binary" if payloads else ""))


class LoserTree:
    """k sorted runs of (key, row) as one: each inner node keeps the loser of its match, so the next row costs one match per level."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[self.winner]) is not None:
            yield row
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _key(row) -> tuple:
    """URL key, timestamp, id, place; a missing id comes first."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class Run:
    """Rows in order, on the task's own disk: batches go in, rows with their keys come out, a batch at a time."""

    def __init__(self, schema: pa.Schema):
        self.file = tempfile.TemporaryFile()
        self.out = pa.ipc.new_stream(self.file, schema)

    def add(self, batch: pa.RecordBatch) -> None:
        self.out.write_batch(batch)

    def __iter__(self) -> Iterator[tuple]:
        self.out.close()
        self.file.seek(0)
        for batch in pa.ipc.open_stream(self.file):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield _key(row), row
        self.file.close()


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


class ExternalMerge:
    """Sorted runs one after another, then all of them in order. No more than FAN_IN are open: so many become one run on the next level."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.levels = schema, [[]]

    def begin(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) < FAN_IN:
                break
            run = Run(self.schema)
            for batch in batches_of((row for _, row in LoserTree(runs)), self.schema):
                run.add(batch)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(run)
        self.levels[0].append(Run(self.schema))

    def add(self, batch: pa.RecordBatch) -> None:
        self.levels[0][-1].add(batch)

    def rows(self) -> Iterator[tuple]:
        return (row for _, row in LoserTree([r for runs in self.levels for r in runs]))


def merged_index(found: DataFrame) -> DataFrame:
    """found: captures without payloads. The same rows with (range, position): in this order they are sorted by URL key, timestamp, id and place."""
    spark = found.sparkSession
    n = partitions(spark)
    total = found.count()
    sample = found.select("url_key", "timestamp", "page_id", "file", "offset")
    if total > SAMPLE_ROWS:
        sample = sample.sample(fraction=SAMPLE_ROWS / total, seed=7)
    keys = sorted(_key((r[0], r[1], r[2], *[None] * 4, r[3], r[4])) for r in sample.collect())
    cuts = sorted(set(keys[len(keys) * i // n] for i in range(1, n))) if keys else []
    places = spots(n)
    names = [c for c, _, _ in CAPTURE]
    rows = pa.schema([(c, t) for c, t, _ in CAPTURE])
    sent = pa.schema([("place", pa.int32()), ("range", pa.int32()), ("run", pa.int64()), ("seq", pa.int64()), *rows])

    def cut(batches):
        """A task's captures, sorted by Spark (spilling), are a run: each row gets its range and its place in the run."""
        run, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            of = [bisect_right(cuts, _key(r)) for r in zip(*(c.to_pylist() for c in batch.columns))]
            lead = [pa.array([places[i] for i in of], pa.int32()), pa.array(of, pa.int32()), pa.array([run] * len(of), pa.int64()), pa.array(range(seq, seq + len(of)), pa.int64())]
            seq += len(of)
            yield pa.RecordBatch.from_arrays([*lead, *batch.columns], schema=sent)

    out_schema = pa.schema([("range", pa.int32()), ("position", pa.int64()), *rows])

    def merge(batches):
        """Rows come by range, run and place in the run; each range is merged from its runs."""
        at, merging = None, None
        for batch in batches:
            ranges, runs = batch["range"].to_numpy(), batch["run"].to_numpy()
            turns = [0, *(np.flatnonzero((ranges[1:] != ranges[:-1]) | (runs[1:] != runs[:-1])) + 1).tolist(), len(ranges)]
            for a, b in zip(turns, turns[1:]):
                if b == a:
                    continue
                here = (int(ranges[a]), int(runs[a]))
                if at is None or here[0] != at[0]:
                    if at is not None:
                        yield from numbered(at[0], merging)
                    merging = ExternalMerge(rows)
                if here != at:
                    merging.begin()
                    at = here
                merging.add(pa.RecordBatch.from_arrays([batch[c].slice(a, b - a) for c in names], schema=rows))
        if at is not None:
            yield from numbered(at[0], merging)

    def numbered(number, merging):
        return batches_of(((number, position, *row) for position, row in enumerate(merging.rows())), out_schema, 20_000)

    ddl = ", ".join(f"{c} {d}" for c, _, d in CAPTURE)
    order = [F.col(c).asc_nulls_first() for c in ("url_key", "timestamp", "page_id", "file", "offset")]
    runs = found.select(*names).sortWithinPartitions(*order).mapInArrow(cut, f"place int, range int, run long, seq long, {ddl}")
    return runs.repartition(n, "place").sortWithinPartitions("range", "run", "seq").mapInArrow(merge, f"range int, position long, {ddl}")


def archived(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes pages as archives, reads them back and returns the merged index, a row per page.

    A null html is an empty payload; a null url has an empty key; a null id never owns a payload that another row has too, and reads back as null. Rows
    that repeat an id are records each; of equal payloads those with the owner's id are all responses. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write_archives(pages, folder, **columns)
    return merged_index(written(captures(spark, folder), "captures"))
