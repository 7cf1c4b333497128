"""Identical requests are worked off once: the distinct keys are, and the results go back to every request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import KEY


def unused(*tables: DataFrame) -> Callable[[str], str]:
    """Names that no column of these tables has."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for df in tables for c in df.columns):
        prefix += "_"
    return lambda name: prefix + name


def distinct_flights(requests: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key; nulls are a value of it, so a request without a format never shares with one that names it."""
    return requests.groupBy(*key).agg(F.count("*").alias("requests"))


def shared(requests: DataFrame, results: DataFrame, key: list[str] = KEY) -> DataFrame:
    """requests with the results of their key. A hot key's requests may be split by adaptive execution: results has one row per key."""
    own = unused(requests, results)
    right = results.select(*(F.col(c).alias(own(c)) if c in key else F.col(c) for c in results.columns))
    on = [F.col(c).eqNullSafe(F.col(own(c))) for c in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return requests.join(right, cond, "left").drop(*map(own, key))


def with_sources(requests: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Requests with their source, or with an error where there is none."""
    there = unused(requests, sources)("there")
    found = requests.join(sources.withColumn(there, F.lit(True)), key, "left")
    error = F.when(F.col(there).isNull(), F.struct(F.lit("SourceNotFound").alias("kind"), F.lit("image not found").alias("message"), F.lit(None).cast("string").alias("detail")))
    return found.withColumn("error", error).drop(there)
