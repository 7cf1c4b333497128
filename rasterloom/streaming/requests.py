"""The request metrics over streams: additions that the batch operators allow as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import KEY


def windowed_totals(requests: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts by window, class and format; rows later than `late` are left out."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return requests.withWatermark(ts, late).groupBy(w.alias("w"), "class", "format").agg(F.count("*").alias("requests")).select("w.start", "w.end", "class", "format", "requests")


def sessions(requests: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", ts: str = "ts", by: str = "user_id") -> DataFrame:
    w = F.session_window(ts, gap)
    return requests.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("requests")).select("w.start", "w.end", by, "requests")


def leaders(requests: DataFrame, late: str = "1 minute", ts: str = "ts") -> DataFrame:
    """The first request of each key within the watermark: the ones to work off."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark(KEY)


def totals(requests: DataFrame) -> DataFrame:
    """Running counts by class and format, for complete or update mode."""
    return requests.groupBy("class", "format").agg(F.count("*").alias("requests"))


def arriving_images(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files below a root as a stream of (path, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root).select("path", "length", "content")


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the stream and into a table of that name; the query then ends."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
