"""Studies of quality per byte: means by quality, bytes to reach a score, ratios to a baseline, best of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivoted(results: DataFrame, by: list[str], quality: str, value: str, qualities: list[int]) -> DataFrame:
    """A column q<quality> of means per named quality: the qualities are given, so no pass is spent on finding them."""
    return results.groupBy(*by).agg(*(F.avg(F.when(F.col(quality) == q, F.col(value))).alias(f"q{q}") for q in qualities))


def bytes_to_score(points: DataFrame, by: list[str], target: float, score: str = "score", size: str = "bytes") -> DataFrame:
    """The size at which the curve through the points, straight in log size, reaches the target; null outside its range."""
    w = Window.partitionBy(*by).orderBy(score, size)
    seg = points.withColumns({"s1": F.lead(score).over(w), "b1": F.lead(size).over(w)})
    share = (F.lit(target) - F.col(score)) / F.nullif(F.col("s1") - F.col(score), F.lit(0.0))
    here = F.exp(F.ln(size) + F.coalesce(share, F.lit(0.0)) * (F.ln("b1") - F.ln(size)))
    return seg.groupBy(*by).agg(F.min(F.when((F.col(score) <= target) & (F.col("s1") >= target), here)).alias("bytes_at_score"))


def score_at_bytes(points: DataFrame, by: list[str], at: str, score: str = "score", size: str = "bytes") -> DataFrame:
    """The score at the size in column `at`, straight between neighbours; null outside."""
    w = Window.partitionBy(*by).orderBy(size, score)
    seg = points.withColumns({"s1": F.lead(score).over(w), "b1": F.lead(size).over(w)})
    share = (F.col(at) - F.col(size)) / F.nullif(F.col("b1") - F.col(size), F.lit(0.0))
    here = F.col(score) + F.coalesce(share, F.lit(0.0)) * (F.col("s1") - F.col(score))
    return seg.groupBy(*by).agg(F.min(F.when((F.col(size) <= F.col(at)) & (F.col("b1") >= F.col(at)), here)).alias("score_at_bytes"))


def geo_mean_ratio(values: DataFrame, item: str, service: str, value: str, baseline: str) -> DataFrame:
    """Per service: exp(mean(ln(value / baseline's value))) - 1 over the items that both have."""
    base = values.where(F.col(service) == baseline).select(item, F.col(value).alias("base"))
    both = values.join(base, item)
    return both.groupBy(service).agg((F.exp(F.avg(F.ln(F.col(value) / F.col("base")))) - 1).alias("ratio"), F.count("*").alias("n"))


def best_of(runs: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """The least of each item's runs, averaged over the group."""
    least = runs.groupBy(group, item).agg(F.min(value).alias("least"))
    return least.groupBy(group).agg(F.avg("least").alias("mean_of_least"), F.count("*").alias("items"))


def default_pick(cells: DataFrame, by: list[str], k: str, margin: str, score: str, least_margin: float) -> DataFrame:
    """Best cell, the smallest k with the margin, and what that costs in score."""
    out = cells.groupBy(*by).agg(
        F.max_by(k, F.struct(score, k)).alias("best_k"), F.max(score).alias("best_score"), F.min(F.when(F.col(margin) >= least_margin, F.struct(k, score))).alias("pick")
    )
    return out.select(*by, "best_k", "best_score", F.col(f"pick.{k}").alias("default_k"), (F.col("best_score") - F.col(f"pick.{score}")).alias("loss"))
