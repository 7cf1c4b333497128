"""Quality rules by tokeniser fertility.

What public tokenizers make of a text says whether it is written in the language that it claims: running text of a language has a narrow range of
characters per token, hardly any byte pieces and a certain spread of tokens; mojibake, keys, tables of symbols and text that repeats itself do not.
A text's tokens are those of its words, each with one space before it, so white space has no say and a word's tokens can be kept and used again.
A verdict needs enough tokens: a text with fewer than `least_tokens` is judged by the base rules alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame

from .common import WHITE, Recent, Words, only_model, rested, rows_of, texts
from .deep import ranked, tallied

SYMBOLS = b"#*$%&|<>"
#: The split pattern of the rank files (fixed value).
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Band:
    """What a text of a language or script may have; outside, it is rejected."""

    least_chars_per_token: float
    most_chars_per_token: float
    most_byte_share: float
    least_entropy: float  # bits per token


#: By language, of both vocabularies' mean fertility. Wide on purpose: a document goes only if it is far from the language's own range.
BANDS = {
    "en": Band(2.2, 7.0, 0.10, 3.0),
    "de": Band(2.2, 7.0, 0.10, 3.0),
    "fr": Band(2.0, 7.0, 0.10, 3.0),
    "es": Band(2.0, 7.0, 0.10, 3.0),
}
#: For other languages, by the script of most letters.
SCRIPT_BANDS = {
    "latin": Band(1.3, 8.0, 0.15, 3.0),
    "cyrillic": Band(0.8, 7.0, 0.15, 3.0),
    "greek": Band(0.5, 6.0, 0.40, 3.0),
    "arabic": Band(0.5, 6.0, 0.40, 3.0),
    "hebrew": Band(0.5, 6.0, 0.40, 3.0),
    "cjk": Band(0.25, 4.0, 0.90, 2.5),
    "other": Band(0.15, 8.0, 1.0, 2.0),
}
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("cjk", 0x3040, 0x9FFF), ("cjk", 0xAC00, 0xD7AF)]
LETTERS = re.compile(r"[^\W\d_]")


def script_of(text: str) -> str:
    """The script of most letters; "other" if there are none."""
    points = np.array([ord(c) for c in LETTERS.findall(text)], np.int64)
    counts: dict[str, int] = {}
    for name, a, b in SCRIPTS:
        counts[name] = counts.get(name, 0) + int(((points >= a) & (points <= b)).sum())
    best = max(counts, key=counts.get)
    return best if counts[best] * 2 > len(points) else "other"


class Fertility:
    """Tokens of words under a piece vocabulary with byte fallback and a byte-level rank vocabulary."""

    def __init__(self, piece_path: str, rank_path: str, cache: int = 150_000):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rank_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.rank_bytes[i] = len(b)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.words = Recent(cache)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: their ids under the pieces one after another, how many each has, how many tokens each has under the ranks."""
        found = list(map(self.words.get, words))
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            said = [words[i].decode("utf-8", "replace") for i in new]
            ids = self.pieces.encode(said, num_threads=1)
            ends = (4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1] // 4).tobytes()
            for i, a, b, more in zip(new, [0, *ends], ends, self.ranked(said)):
                found[i] = flat[a:b], more
                self.words.put(words[i], found[i])
        flat, more = zip(*found) if found else ((), ())
        sizes = np.fromiter(map(len, flat), np.int64, len(flat)) // 4
        return np.frombuffer(b"".join(flat), np.int32), sizes, np.array(more, np.int64)

    def ranked(self, words: list[str]) -> list[int]:
        """How many rank tokens each word has: no token goes over a space that starts a word, so one call does for all."""
        ends = np.cumsum(self.rank_bytes[self.ranks.encode_ordinary(" " + " ".join(words))])
        bounds = np.cumsum([len(w.encode()) + 1 for w in words])
        upto = np.searchsorted(ends, bounds, "right")
        return np.diff(upto, prepend=0).tolist()


def loaded(piece_path: str, rank_path: str) -> Fertility:
    return only_model(("fertility", piece_path, rank_path), lambda: Fertility(piece_path, rank_path))


def repeated_words(of: np.ndarray, doc: np.ndarray, n: int, width: int = 3) -> np.ndarray:
    """By document, words in windows of that width that are there twice or more in it, first ones included. of: which word each is, doc: of which of the n documents."""
    wins = len(of) - width + 1
    if wins < 1:
        return np.zeros(n, np.int64)
    small, key = int(of.max()) + 1, of[:wins].astype(np.int64)
    for i in range(1, width):
        _, key = ranked(key * small + of[i : wins + i])
    whole = np.flatnonzero(doc[:wins] == doc[width - 1 :])
    _, key = ranked(key[whole] * n + doc[whole])
    again = whole[np.bincount(key)[key] > 1] if len(whole) else whole
    hit = np.zeros(len(of), bool)
    for i in range(width):
        hit[again + i] = True
    return np.bincount(doc[hit], minlength=n)


def entropies(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By document, of its tokens' distribution, in bits. ids: of all documents, one after another; sizes: how many each has."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    once, counts = tallied(doc << 32 | ids)
    spent = np.bincount(once >> 32, counts * np.log2(counts), len(sizes))
    least = np.maximum(sizes, 1)
    return np.where(sizes > 0, np.log2(least) - spent / least, 0.0)


COLUMNS = [
    ("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"), ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"), ("n_tokens", pa.int64(), "long"), ("chars_per_token", pa.float64(), "double"), ("byte_share", pa.float64(), "double"), ("token_entropy", pa.float64(), "double"), ("kept", pa.bool_(), "boolean"),
]


def measured(said: list[bytes], langs: list, model: Fertility, bands: dict, least_tokens: int) -> list[tuple]:
    """What COLUMNS names of each of some documents. Words are looked up once for all of them, and counted in arrays."""
    words = Words(said)
    n_words = np.diff(np.append(words.firsts[: len(said)], len(words.of)))
    doc = np.repeat(np.arange(len(said)), n_words)
    flat, sizes, more = model.tokens(words.words)
    model.words.age()
    each = sizes[words.of]
    starts = (np.cumsum(sizes) - sizes)[words.of]
    ids = flat[np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    n_tokens = np.bincount(doc, each, len(said)).astype(np.int64)
    n_bytes = np.bincount(np.repeat(np.arange(len(said)), n_tokens)[model.is_byte[ids]], minlength=len(said))
    columns = n_words, repeated_words(words.of, doc, len(said)), n_tokens, n_bytes, np.bincount(doc, more[words.of], len(said)).astype(np.int64), entropies(ids, n_tokens)
    out = []
    for text, lang, n, repeats, tokens, odd, ranked_tokens, spread in zip(said, langs, *(c.tolist() for c in columns)):
        word_chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, WHITE)))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        failed = n < 50 or 100 * repeats > 50 * n
        per = 2.0 * (word_chars + n) / (tokens + ranked_tokens) if tokens + ranked_tokens else 0.0
        share = odd / tokens if tokens else 0.0
        kept = not failed
        if kept and tokens >= least_tokens:
            band = bands.get(lang) or SCRIPT_BANDS[script_of(text.decode("utf-8", "replace"))]
            kept = band.least_chars_per_token <= per <= band.most_chars_per_token and share <= band.most_byte_share and spread >= band.least_entropy
        out.append((n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, tokens, per, share, spread, kept))
    return out


def quality_rules(docs: DataFrame, piece_path: str, rank_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict | None = None, least_tokens: int = 50) -> DataFrame:
    """One row per row of docs: id, the base counts, base_failed, the measures of the tokenizers, kept.

    A null text counts as empty: no words, base_failed. A null or unknown language is judged by the band of the text's main script. Ties and repeated rows
    have the same verdict each. Other columns of docs play no part.
    """
    bands = BANDS if bands is None else bands
    schema = pa.schema([(id_col, pa.int64()), *((a, b) for a, b, _ in COLUMNS)])

    def run(batches):
        model = loaded(piece_path, rank_path)
        for chunk in rows_of(batches, 4 << 20):
            docs, said, *langs = zip(*chunk)
            out = [(doc, *row) for doc, row in zip(docs, measured(said, langs[0] if langs else [None] * len(said), model, bands, least_tokens))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    chosen = texts(docs, id_col, text_col, *([lang_col] if lang_col else []))
    return chosen.mapInArrow(rested(run), f"`{id_col}` long, " + ", ".join(f"{a} {c}" for a, _, c in COLUMNS))


def slices(said: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, nulls as empty ones, about so many bytes at a time, and where they begin."""
    held, size, at = [], 0, 0
    for text in (said.cast(pa.large_binary()) if pa.types.is_large_string(said.type) else said.cast(pa.binary())).to_pylist():
        text = text or b""
        if held and size + len(text) > most:
            yield at, held
            at += len(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def quality_filter(docs: DataFrame, piece_path: str, rank_path: str, text_col: str = "text", lang_col: str | None = "lang", bands: dict | None = None, least_tokens: int = 50) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, judged where they stand: no shuffle. Rows that repeat stay or go alike."""
    bands = BANDS if bands is None else bands

    def run(batches):
        model = loaded(piece_path, rank_path)
        for batch in batches:
            langs = batch[lang_col].to_pylist() if lang_col else [None] * len(batch)
            keep = []
            for at, said in slices(batch[text_col]):
                keep += [row[-1] for row in measured(said, langs[at : at + len(said)], model, bands, least_tokens)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rested(run), docs.schema)
