"""The image operators as SQL functions: register(spark) makes them known to a session.

    SELECT transform_image(content, 500, 500, 'png', NULL) FROM sources
    SELECT image_probe(content).width FROM sources
    SELECT path, p.* FROM sources, LATERAL explode_pixels(content) p
    SELECT id, icc_assemble(seq, count, data) FROM parts GROUP BY id

All of them take Arrow batches; what goes wrong with a row is in its result, never an error of the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..codecs.containers import icc_from_parts
from ..operators.transform import PROBE, RESULT, RESULT_DDL, Config, _one, decode, look, sniff

PIXELS = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("r", pa.int16()), ("g", pa.int16()), ("b", pa.int16()), ("a", pa.int16())])
PROBE_DDL = "struct<format: string, width: int, height: int, orientation: int, icc_bytes: int, error: string>"
ROWS = 1 << 16


def pixel_batches(content: bytes | None) -> Iterator[pa.RecordBatch]:
    """The stored pixels of an image, row by row; gray as three equal channels, without alpha 255. What can't be decoded has no pixels."""
    try:
        image = decode(content, sniff(content)) if content is not None else np.zeros((0, 0, 3), np.uint8)
    except Exception:
        return
    image = image[..., None] if image.ndim == 2 else image
    if image.shape[2] < 3:
        image = np.concatenate([np.repeat(image[..., :1], 3, axis=2), image[..., 1:]], axis=2)
    height, width, channels = image.shape
    step = max(1, ROWS // max(1, width))
    for at in range(0, height, step):
        part = image[at : at + step].reshape(-1, channels).astype(np.int16)
        y, x = np.divmod(np.arange(len(part), dtype=np.int32), np.int32(width))
        alpha = part[:, 3] if channels == 4 else np.full(len(part), 255, np.int16)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array((y + at).astype(np.int32)), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(3)), pa.array(np.ascontiguousarray(alpha))], schema=PIXELS)


def register(spark: SparkSession, config: Config = Config()) -> None:  # noqa: B008
    """transform_image(content, max_width, max_height, output, quality), image_probe(content), explode_pixels(content), icc_assemble(seq, count, data)."""
    config.validate()

    @F.arrow_udf(RESULT_DDL)
    def transform_image(content: pa.Array, max_width: pa.Array, max_height: pa.Array, output: pa.Array, quality: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (content, max_width, max_height, output, quality)))
        return pa.array([_one(dict(zip(("content", "max_width", "max_height", "output", "quality"), r)), config) for r in rows], RESULT)

    @F.arrow_udf(PROBE_DDL)
    def image_probe(content: pa.Array) -> pa.Array:
        return pa.array([look(c.as_py()) for c in content], PROBE)

    @F.arrow_udf("binary")
    def icc_assemble(seq: pa.Array, count: pa.Array, data: pa.Array) -> bytes:
        return icc_from_parts(list(zip(seq.to_pylist(), count.to_pylist(), data.to_pylist())))

    @F.udtf(returnType="x int, y int, r smallint, g smallint, b smallint, a smallint")
    class ExplodePixels:
        def eval(self, content: bytes):
            for batch in pixel_batches(content):
                yield from zip(*(c.to_pylist() for c in batch.columns))

    spark.udf.register("transform_image", transform_image)
    spark.udf.register("image_probe", image_probe)
    spark.udf.register("icc_assemble", icc_assemble)
    spark.udtf.register("explode_pixels", ExplodePixels)
