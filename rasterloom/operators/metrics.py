"""Request metrics: dense counters, cumulative histograms, coalescing roles, exposition text, percentiles, deltas.

Every aggregate here has a fixed set of cells, so partial sums leave each task and no row of the log is shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The cells of the counters, and the bounds of the histograms.
CLASSES = ["2xx", "3xx", "4xx", "5xx"]
FORMATS = ["jpeg", "png", "webp", "avif", "source", "none"]
OUTCOMES = ["ok", "not_found", "timeout", "rejected", "error"]
SECONDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
KEY = ["width", "height", "file", "format", "quality"]


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def _grid(df: DataFrame, **axes: list) -> DataFrame:
    out = df.sparkSession.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out.drop("id")


def requests_total(requests: DataFrame) -> DataFrame:
    """requests: class, format. Every cell has a row."""
    counts = requests.groupBy("class", "format").agg(F.count("*").alias("n"))
    grid = _grid(requests, **{"class": CLASSES, "format": FORMATS})
    return grid.join(F.broadcast(counts), ["class", "format"], "left").select("class", "format", F.coalesce("n", F.lit(0)).alias("requests"))


def outcomes_total(fetches: DataFrame) -> DataFrame:
    """fetches: outcome."""
    counts = fetches.groupBy("outcome").agg(F.count("*").alias("n"))
    return _grid(fetches, outcome=OUTCOMES).join(F.broadcast(counts), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("fetches"))


def histogram(df: DataFrame, value: str, bounds: list, by: list[str] = (), scale: int = 1_000_000) -> DataFrame:
    """(by, le, cumulative, count, sum): one row per bound and +Inf; the sum is of values cut to 1/scale. One pass, one partial sum per bound."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*by).agg(*sums, F.count(value).alias("count"), (F.sum(F.floor(F.col(value) * scale)) / scale).alias("sum"))
    cells = F.explode(F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative"))))
    return one.select(*by, cells.alias("c"), "count", "sum").select(*by, "c.le", "c.cumulative", "count", "sum")


def with_roles(requests: DataFrame, window: str = "1 minute", ts: str = "ts", order: str = "req_id") -> DataFrame:
    """requests with role: of requests with one key (nulls are a value of it) within a window, the first leads, the others follow."""
    w = Window.partitionBy(*KEY, F.window(ts, window)).orderBy(ts, order)
    return requests.withColumn("role", F.when(F.row_number().over(w) == 1, "leader").otherwise("follower"))


def roles_total(requests: DataFrame, window: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Only sums: as many leaders as keys per window, the rest follow. A hot key is one row per task."""
    groups = requests.groupBy(*KEY, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    both = groups.agg(F.count("*").alias("leader"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("follower"))
    return both.select(F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("requests")) for r in ("leader", "follower")))).alias("x")).select("x.*")


def exposition(name: str, counters: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Lines of the text format, one per cell."""
    said = F.concat_ws(",", *(F.concat(F.lit(f'{label}="'), F.col(label), F.lit('"')) for label in labels))
    return counters.select(F.concat(F.lit(name + "{"), said, F.lit("} "), F.col(value).cast("string")).alias("line"))


def percentiles(df: DataFrame, by: str, value: str, ps: list[int]) -> DataFrame:
    """Nearest rank: sorted[min(n - 1, n * p div 100)]. Equal values are counted before anything is sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(by).orderBy(value)
    ranked = counts.withColumns({"hi": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(by))})
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    pick = lambda p: F.min(F.when(F.col("hi") > at(p), F.col(value))).alias(f"p{p}")
    return ranked.groupBy(by).agg(F.max("n").alias("n"), *(pick(p) for p in ps))


def deltas(scrapes: DataFrame, by: str, at: str, total: str, count: str) -> DataFrame:
    """Between scrapes: after less before, and the mean over them."""
    w = Window.partitionBy(by).orderBy(at)
    out = scrapes.withColumns({"d_total": F.col(total) - F.lag(total).over(w), "d_count": F.col(count) - F.lag(count).over(w)})
    return out.withColumn("mean", F.try_divide("d_total", "d_count"))


def access_line(req: Column, status: Column, ms: Column, path: Column, err: Column) -> Column:
    return F.concat(F.format_string("req=%d status=%d ms=%.1f path=%s", req, status, ms, path), F.coalesce(F.concat(F.lit(" err="), err), F.lit("")))
