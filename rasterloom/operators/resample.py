"""Resampling as relations: a table of Lanczos windows, and joins of pixels with it."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lanczos3(x: Column) -> Column:
    p = x * F.lit(pi)
    inner = F.when(x == 0, 1.0).otherwise(F.try_divide(F.sin(p), p) * F.try_divide(F.sin(p / 3), p / 3))
    return F.when((x >= -3) & (x < 3), inner).otherwise(0.0)


def windows(spark: SparkSession, source: int, target: int) -> DataFrame:
    """(o, i, weight): how much of source place i is in target place o; weights of a place sum to one. At most target * (6 * scale + 2) rows."""
    scale = source / target
    fs = max(scale, 1.0)
    radius = 3.0 * fs
    o = spark.range(target).select(F.col("id").cast("int").alias("o"), ((F.col("id") + 0.5) * scale).alias("centre"))
    taps = o.select("o", "centre", F.explode(F.sequence(F.greatest(F.floor(F.col("centre") - radius), F.lit(0)).cast("int"), (F.least(F.ceil(F.col("centre") + radius), F.lit(source)) - 1).cast("int"))).alias("i"))
    raw = taps.select("o", "i", lanczos3((F.col("i") + 0.5 - F.col("centre")) / fs).alias("w")).where("w <> 0")
    return raw.select("o", "i", (F.col("w") / F.sum("w").over(Window.partitionBy("o"))).alias("weight"))


def resampled(pixels: DataFrame, taps: DataFrame, axis: str, by: list[str], value: str = "v") -> DataFrame:
    """pixels (by, axis, value) along one axis: a broadcast join with the windows, whose size depends on the shape alone, and one sum."""
    joined = pixels.join(F.broadcast(taps), pixels[axis] == taps["i"])
    return joined.groupBy(*by, F.col("o").alias(axis)).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def chroma_upsampled(rows: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """(by, x, value) at twice the width: three parts the sample itself, one part its neighbour to the left or right, the edge its own neighbour."""
    w = Window.partitionBy(*by).orderBy(x)
    v = F.col(value)
    near = rows.withColumns({"prev": F.coalesce(F.lag(value).over(w), v), "next": F.coalesce(F.lead(value).over(w), v)})
    both = F.explode(F.array(F.struct((F.col(x) * 2).alias("x2"), ((3 * v + F.col("prev")) / 4).alias("v2")), F.struct((F.col(x) * 2 + 1).alias("x2"), ((3 * v + F.col("next")) / 4).alias("v2"))))
    return near.select(*by, both.alias("p")).select(*by, F.col("p.x2").alias(x), F.col("p.v2").alias(value))


def oriented(pixels: DataFrame, w: Column, h: Column, orientation: Column) -> DataFrame:
    """Pixels (.., x, y) of a frame of w by h moved to where the orientation 1 to 8 shows them."""
    x, y = F.col("x"), F.col("y")
    fx, fy = w - 1 - x, h - 1 - y
    places = {1: (x, y), 2: (fx, y), 3: (fx, fy), 4: (x, fy), 5: (y, x), 6: (fy, x), 7: (fy, fx), 8: (y, fx)}
    nx, ny = x, y
    for o, (a, b) in places.items():
        nx, ny = F.when(orientation == o, a).otherwise(nx), F.when(orientation == o, b).otherwise(ny)
    return pixels.withColumns({"x": nx.cast("int"), "y": ny.cast("int")})


def icc_chunks(images: DataFrame, profile: str, size: int = 65519) -> DataFrame:
    """A profile as numbered parts: seq from 1, count, data."""
    count = F.ceil(F.length(profile) / size).cast("int")
    parts = images.where(F.length(profile) > 0).withColumn("count", count)
    return parts.withColumn("seq", F.explode(F.sequence(F.lit(1), F.col("count")))).withColumn("data", F.substring(F.col(profile), (F.col("seq") - 1) * size + 1, F.lit(size))).drop(profile)


def icc_reassembled(chunks: DataFrame, by: str) -> DataFrame:
    """(by, profile): parts in order if all agree on their count and each number is there once; else null."""
    return chunks.groupBy(by).agg(
        F.when(
            (F.min("count") == F.max("count")) & (F.count("*") == F.max("count")) & (F.count_distinct("seq") == F.max("count")) & (F.min("seq") == 1) & (F.max("seq") == F.max("count")),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda s: s["data"]), ""),
        ).alias("profile")
    )
