"""Queries that go through pixel kernels or streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..codecs import jpeg, png
from ..operators import transform
from ..streaming import requests
from . import image_queries as base

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""WITH s AS (SELECT p_partkey, 8 + p_partkey % 57 AS w, 8 + (p_partkey * 7) % 41 AS h, CAST(p_partkey % 256 AS INTEGER) AS r, CAST((p_partkey * 3) % 256 AS INTEGER) AS g, CAST((p_partkey * 5) % 256 AS INTEGER) AS b FROM part)
SELECT p_partkey, CAST(greatest(round(w * least(24.0::DOUBLE / w, 20.0::DOUBLE / h, 1.0)), 1) AS INTEGER) AS out_w, CAST(greatest(round(h * least(24.0::DOUBLE / w, 20.0::DOUBLE / h, 1.0)), 1) AS INTEGER) AS out_h, r, g, b, CAST(NULL AS VARCHAR) AS error FROM s""")
def transform_png(spark, sf_dir):
    """PNGs of one colour each, made, resized in linear light, encoded and read again."""
    k = F.col("p_partkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # one small file would be one task
    rows = base._t(spark, sf_dir, "part").repartition(n, "p_partkey").select(k, (8 + k % 57).cast("int").alias("w"), (8 + (k * 7) % 41).cast("int").alias("h"), *((k * m % 256).cast("int").alias(n) for n, m in (("r", 1), ("g", 3), ("b", 5))))

    def paint(batches):
        for batch in batches:
            out = [png.encode(np.full((h, w, 3), (r, g, b), np.uint8)) for w, h, r, g, b in zip(*(batch[c].to_pylist() for c in ("w", "h", "r", "g", "b")))]
            yield pa.RecordBatch.from_arrays([batch["p_partkey"], pa.array(out, pa.binary())], names=["p_partkey", "content"])

    made = rows.mapInArrow(paint, "p_partkey long, content binary").withColumns({"max_width": F.lit(24), "max_height": F.lit(20), "output": F.lit("png")})
    done = transform.transform(made).select("p_partkey", "result")

    def look(batches):
        for batch in batches:
            out = []
            for key, result in zip(batch["p_partkey"].to_pylist(), batch["result"].to_pylist()):
                pixels = png.decode(result["data"]).reshape(-1, 3) if result["data"] else np.zeros((1, 3), int)
                same = (pixels == pixels[0]).all()
                out.append({"p_partkey": key, "out_w": result["width"], "out_h": result["height"], "r": int(pixels[0, 0]) if same else -1, "g": int(pixels[0, 1]) if same else -1, "b": int(pixels[0, 2]) if same else -1, "error": (result["error"] or {}).get("kind")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("p_partkey", pa.int64()), *((c, pa.int32()) for c in ("out_w", "out_h", "r", "g", "b")), ("error", pa.string())]))

    return done.mapInArrow(look, "p_partkey long, out_w int, out_h int, r int, g int, b int, error string")


@query("""SELECT s_suppkey, CAST(greatest(round(w * least(60.0::DOUBLE / w, 50.0::DOUBLE / h, 1.0)), 1) AS INTEGER) AS out_w, CAST(greatest(round(h * least(60.0::DOUBLE / w, 50.0::DOUBLE / h, 1.0)), 1) AS INTEGER) AS out_h,
true AS near, 'jpeg' AS format, CAST(NULL AS VARCHAR) AS error FROM (SELECT s_suppkey, 96 + s_suppkey % 65 AS w, 64 + (s_suppkey * 7) % 57 AS h FROM supplier)""")
def transform_jpeg(spark, sf_dir):
    """JPEGs of a smooth picture, made, decoded, resized in linear light, encoded (progressive) and read again: sizes, and whether the middle has kept its colour."""
    k = F.col("s_suppkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = base._t(spark, sf_dir, "supplier").repartition(n, "s_suppkey").select(k, (96 + k % 65).cast("int").alias("w"), (64 + (k * 7) % 57).cast("int").alias("h"))

    def picture(key, w, h):
        y, x = np.mgrid[0:h, 0:w]
        return np.stack([255 * x / w, 255 * y / h, np.full((h, w), key % 256)], 2).astype(np.uint8)

    def paint(batches):
        for batch in batches:
            out = [jpeg.encode(picture(*r), 90) for r in zip(*(batch[c].to_pylist() for c in ("s_suppkey", "w", "h")))]
            yield pa.RecordBatch.from_arrays([batch["s_suppkey"], pa.array(out, pa.binary())], names=["s_suppkey", "content"])

    made = rows.mapInArrow(paint, "s_suppkey long, content binary").withColumns({"max_width": F.lit(60), "max_height": F.lit(50), "output": F.lit("jpeg")})
    done = transform.transform(made).select("s_suppkey", "result")

    def look(batches):
        for batch in batches:
            out = []
            for key, result in zip(batch["s_suppkey"].to_pylist(), batch["result"].to_pylist()):
                pixels = jpeg.decode(result["data"]) if result["data"] else np.zeros((1, 1, 3), np.uint8)
                middle = pixels[pixels.shape[0] // 2, pixels.shape[1] // 2].astype(int)
                out.append({"s_suppkey": key, "out_w": result["width"], "out_h": result["height"], "near": bool((abs(middle - [128, 128, key % 256]) <= 16).all()), "format": result["format"], "error": (result["error"] or {}).get("kind")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("s_suppkey", pa.int64()), ("out_w", pa.int32()), ("out_h", pa.int32()), ("near", pa.bool_()), ("format", pa.string()), ("error", pa.string())]))

    return done.mapInArrow(look, "s_suppkey long, out_w int, out_h int, near boolean, format string, error string")


@query(f"WITH {base.LOG} SELECT class, format, count(*) AS requests FROM l GROUP BY 1, 2")
def stream_requests_total(spark, sf_dir):
    """The counters over a stream of the log's files, until all that is there has been read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    name = f"stream_{uuid.uuid4().hex}"
    return requests.drained(requests.totals(base.request_log(stream)), name, f"{root}/{name}")
