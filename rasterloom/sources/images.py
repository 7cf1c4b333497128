"""Where source images come from: files below a root, HTTP origins, object stores."""

from __future__ import annotations

import os
import re
import time
import urllib.error
import urllib.request
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import RowError, classify

#: Statuses after which one more try is made, and the longest key of an object store.
RETRIED = {429, 500, 502, 503, 504}
MAX_KEY = 1024
BUCKET = re.compile(r"^gs://([a-z0-9._-]+)(?:/(.*))?$")


def scheme(base: str | None) -> tuple[str, str | None]:
    """("local" | "http" | "gcs", place); other schemes are refused."""
    if not base:
        return "local", None
    if base.startswith(("http://", "https://")):
        return "http", base.rstrip("/")
    if m := BUCKET.match(base):
        return "gcs", base.rstrip("/")
    raise ValueError(f"unsupported source: {base}")


def files(spark: SparkSession, root: str, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, length, content, error) of all files below the root. The size limit is a filter on the listing, so larger ones are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = found.where(F.col("length") <= max_bytes).select("path", "length", "content", F.lit(None).cast("string").alias("error"))
    large = found.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("SourceTooLarge").alias("error"))
    return small.unionByName(large)


def contained(root: str, key: str) -> str | None:
    """The real path of a key if it lies below the real root."""
    top, path = os.path.realpath(root), os.path.realpath(os.path.join(root, key))
    return path if path == top or path.startswith(top + os.sep) else None


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, max_bytes: int = 64 << 20, timeout: float = 30.0, token: str | None = None, gcs: bool = False) -> bytes:
    """One anonymous or bearer GET: no redirects, a bounded body, one more try after a connection error or, for an object store, a passing status."""
    opener = urllib.request.build_opener(_NoRedirect)
    for last in (False, True):
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with opener.open(request, timeout=timeout) as answer:
                size = answer.headers.get("Content-Length")
                if size and int(size) > max_bytes:
                    raise RowError("SourceTooLarge", "source image too large", f"{size} bytes")
                body = answer.read(max_bytes + 1)
                if len(body) > max_bytes:
                    raise RowError("SourceTooLarge", "source image too large", f"more than {max_bytes} bytes")
                return body
        except urllib.error.HTTPError as e:
            if gcs and not last and e.code in RETRIED:
                time.sleep(0.1)
                continue
            if e.code == 404:
                raise RowError("SourceNotFound", "image not found") from None
            if e.code in (400, 414):
                raise RowError("SourceRejected", "source key rejected by the origin") from None
            if gcs and e.code in (401, 403):
                raise RowError("SourceUnreadable", "source could not be read") from None
            raise RowError("Upstream", "upstream image fetch failed", f"status {e.code}") from None
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise RowError("UpstreamTimeout", "upstream image fetch timed out") from None
            if last:
                raise RowError("Upstream", "upstream image fetch failed", str(e.reason)) from None
            time.sleep(0.1)
        except TimeoutError:
            raise RowError("UpstreamTimeout", "upstream image fetch timed out") from None
    raise AssertionError


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        super().__init__(keys)


class HttpImages(DataSource):
    """format("http_images"): option base, keys (one per line) or keys_file, partitions, max_bytes, timeout. Rows: key, content, kind, message."""

    @classmethod
    def name(cls) -> str:
        return "http_images"

    def schema(self) -> str:
        scheme(self.options.get("base"))
        return "key string, content binary, kind string, message string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.base, self.keys = options["base"].rstrip("/"), [k for k in options.get("keys", "").split("\n") if k]
        self.parts, self.most, self.timeout = int(options.get("partitions", 8)), int(options.get("max_bytes", 64 << 20)), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        groups = [self.keys[i :: self.parts] for i in range(self.parts)]
        return [_Keys(g) for g in groups if g] or [_Keys([])]

    def read(self, partition):
        for key in partition.value:
            try:
                if len(key) - 2 * key.count("%") > MAX_KEY:
                    raise RowError("SourceNotFound", "image not found")
                yield key, fetch(f"{self.base}/{quote(key, safe=chr(126) + '!$&' + chr(39) + '()*+,;=:@/')}", self.most, self.timeout), None, None
            except Exception as e:
                wrong = classify(e, remote=True)
                yield key, None, wrong.kind, wrong.message


def fetched(keys: DataFrame, base: str, key: str = "key", max_bytes: int = 64 << 20, timeout: float = 30.0) -> DataFrame:
    """The same for keys of a table: each task fetches its rows', so the number of partitions bounds the open connections."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                row = next(HttpReader({"base": base, "max_bytes": max_bytes, "timeout": timeout}).read(_Keys([k])))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "content", "kind", "message"), row))], schema=pa.schema([("key", pa.string()), ("content", pa.binary()), ("kind", pa.string()), ("message", pa.string())]))

    return keys.select(F.col(key).cast("string")).mapInArrow(run, "key string, content binary, kind string, message string")
