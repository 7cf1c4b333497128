"""A corpus from raw documents: what is worth reading, each text once, near copies once, in the wanted mixture, as tokens.

Stages take (spark, docs, sf_dir) and return rows with the columns of documents; the last returns the tokenised documents. Each works on all rows that the
stage before it kept. Rows stay as they are or go: a null text counts as empty, a null id is a value like any other, other columns play no part whatever their names, and an empty
table gives an empty one. Nothing here can be said in one SQL statement (trie joins, raking, merges of pieces), so ORACLE_SQL is None and the tests hold the
stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import table, written
from rasterloom.llm.exact import exact_filter
from rasterloom.llm.mixing import mixing_sample
from rasterloom.llm.pieces import round_trip
from rasterloom.llm.quality import quality_filter
from rasterloom.llm.queries import BUDGET, PIECES, RANKS, TARGETS
from rasterloom.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, empty ones and such of under 50 words among them; a null language is judged by the text's script; repeated rows stay or go alike."""
    return quality_filter(docs, PIECES, RANKS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the largest id; a null id only where no other has the text. Of rows that repeat id and text one stays."""
    return exact_filter(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest id; a null id counts as the largest, and by the text's hash where ids are equal or null."""
    return simhash_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of the tokens, as far as the tokens there are allow; null categories count as "other", rows with one id are drawn alike."""
    return mixing_sample(docs, TARGETS, BUDGET)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids, digest of the text that they decode to, and the ids; a null text has the end id alone."""
    return round_trip(docs, PIECES, whole=True).drop("decoded")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixing), ("SentencePiece", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
