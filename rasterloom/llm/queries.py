"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import repeated_passages
from .common import table
from .ctw import context_tree_scores
from .exact import exact_dedup
from .factors import earlier_copies
from .lines import line_components
from .mixing import Targets, mixing_weights
from .pieces import round_trip
from .quality import quality_rules
from .simhash import simhash_components
from .warc import archived


PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: The mixture: half of the tokens English, a fifth from the largest source, few very short texts; four fifths of all tokens.
TARGETS = Targets(source={"src0": 0.2}, language={"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, topic={"note": 0.05, "article": 0.55, "chapter": 0.4})
BUDGET = 0.8


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=4, k=4, seed=42)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_weights(table(spark, sf_dir, "documents"), TARGETS, BUDGET).drop("text", "n_chars")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), PIECES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"), width=5, threshold=0.8)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), PIECES, RANKS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"), folds=7, fold=2, depth=8)


def op9_fixed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), width=35)


def op10_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earlier_copies(table(spark, sf_dir, "documents"), width=50)


def base_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the quality rules SQL can say."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the language model's scores SQL can say."""
    found = context_tree_scores(table(spark, sf_dir, "documents"), folds=7, fold=2, depth=1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_sentencepiece, op4_simhash_near_dedup, op5_line_dedup, op6_quality_rules, op7_warc, op8_context_tree, op9_fixed_anchors, op10_previous_factors, base_text_counts, base_word_scores)}

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM o
    """,
    "op9_fixed_anchors": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        win AS (SELECT rid, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM words WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
        again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS times FROM win WHERE n = 35) WHERE times > 1),
        marked AS (SELECT words.rid, words.i, word, count(again.i) OVER (PARTITION BY words.rid ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
          FROM words LEFT JOIN again ON again.rid = words.rid AND again.i = words.i),
        k AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
    """,
    "op10_previous_factors": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        piece AS (SELECT rid, doc_id, k, substr(h, 2000 * k + 1, 2098) AS p FROM (SELECT rid, doc_id, h, unnest(range(0, strlen(h) // 2000 + 1)) AS k FROM d)),
        w AS (SELECT rid, doc_id, 1000 * k + j AS i, substr(p, 2 * j + 1, 100) AS s FROM (SELECT rid, doc_id, k, p, unnest(range(0, least(1000, strlen(p) // 2 - 49))) AS j FROM piece)),
        f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
        hit AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS step FROM w JOIN f USING (s) WHERE least < doc_id),
        island AS (SELECT rid, i, count(*) FILTER (step IS NULL OR step > 50) OVER (PARTITION BY rid ORDER BY i) AS g FROM hit),
        span AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM island GROUP BY rid, g),
        part AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM span),
        k AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM part JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
    """,
    "base_text_counts": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        win AS (SELECT rid, i, word, lead(word, 1) OVER f AS b, lead(word, 2) OVER f AS c FROM words WINDOW f AS (PARTITION BY rid ORDER BY i)),
        again AS (SELECT rid, i, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, b, c) > 1 AS twice FROM win),
        hit AS (SELECT rid, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM again),
        r AS (SELECT rid, count(*) FILTER (inside) AS n FROM hit GROUP BY rid),
        l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
          coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
    """,
    "base_word_scores": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
          xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295) % 7 = 2 AS held_out
          FROM documents),
        t AS (SELECT rid, held_out, unnest(list_append(w, NULL)) AS word FROM d),
        c AS (SELECT word, count(*) FILTER (NOT held_out) AS n FROM t GROUP BY word),
        total AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS v FROM c)
        SELECT doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c.n > 0) AS n_known, any_value(total.n) AS train_tokens,
          round(sum(log10(c.n + 1) - log10(total.n + total.v + 1)), 4) AS base_score
        FROM t JOIN d USING (rid) JOIN c ON c.word IS NOT DISTINCT FROM t.word, total GROUP BY rid, doc_id
    """,
}
