"""SentencePiece encoding and decoding, exact for merge-type models, by backtracking instead of merging.

A text splits into segments (white space marks, then what is not one) that no piece crosses. A segment is encoded so: an Aho-Corasick automaton finds
every piece in it; from the left the longest one is taken, if it is compatible with the token before, that is, if merging the two tokens' characters
again, by score, gives just these two; otherwise the next shorter piece is tried, and when none is left the position is marked as failed in a bit field
and the token before it is shortened. Merges within a valid encoding never cross its tokens, in their pair no more than in the whole, so a sequence
whose neighbours are all compatible is what merging the whole would give, and it is the only one.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import Recent, only_model, rested, texts

SPACE = "▁"
SEGMENT = re.compile(" +[^ ]*")
#: Characters after which results go out: what a task holds does not grow with the number of rows in a batch.
CHARS = 1 << 21


class MergePieces:
    """The vocabulary of a merge-type model with byte fallback, and the encoder over it."""

    def __init__(self, model_path: str, cache: int = 250_000):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size, self.unknown, self.end = model.get_piece_size(), model.unk_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(self.size) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.control = {i for i in range(self.size) if model.is_control(i)}
        self.special = {*self.byte_of, *self.control, self.unknown}
        plain = [i for i in range(self.size) if i not in self.special]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space after another character: its segments can't be told apart")
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.found = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:  # a character alone is always a candidate, with a piece or without
                self.found.add_word(piece, len(piece) - 1)
        self.found.make_automaton()
        self.pairs, self.segments = Recent(cache), Recent(cache)

    def merged(self, text: str) -> list[str]:
        """The plain rule, for a token or two: merge the pair with the best score, the leftmost of equals, until none is a piece."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: str, token: str) -> bool:
        key = (before, token)
        found = self.pairs.get(key)
        if found is None:
            found = self.merged(before + token) == ([before, token] if before else [token])
            self.pairs.put(key, found)
        return found

    def tokens(self, segment: str) -> list[str]:
        n = len(segment)
        longer: list[list[int]] = [[0] for _ in range(n)]  # by start: lengths of pieces there, less one, from short to long
        for end, more in self.found.iter(segment):
            longer[end - more].append(more)
        failed = bytearray((n >> 3) + 1)
        pairs, compatible = self.pairs.new, self.compatible
        stack: list[tuple[int, int, str]] = []
        at, choice, before = 0, len(longer[0]) - 1, ""
        while True:
            end = at + longer[at][choice] + 1
            token = segment[at:end]
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs.get((before, token))
                if fits if fits is not None else compatible(before, token):
                    stack.append((at, choice, before))
                    if end == n:
                        break
                    at, choice, before = end, len(longer[end]) - 1, token
                    continue
            while not choice:
                failed[at >> 3] |= 1 << (at & 7)
                at, choice, before = stack.pop()
            choice -= 1
        starts = [s[0] for s in stack]
        return [segment[a:b] for a, b in zip(starts, [*starts[1:], n])]

    def segment_ids(self, segment: str) -> list[int]:
        tokens = self.tokens(segment.replace(" ", SPACE))
        out = [self.ids.get(t) for t in tokens]
        if None in out:
            out = [i for t, i in zip(tokens, out) for i in ([self.byte_ids[b] for b in t.encode()] if i is None else (i,))]
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        return SEGMENT.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        """Without an end id."""
        return [i for s in self.split(text) for i in self.segment_ids(s)]

    def decode_part(self, ids: list[int]) -> str:
        """Pieces in a row, marks as spaces, runs of byte pieces as UTF-8."""
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        out = self.decode_part(ids)
        return out[1:] if out.startswith(" ") else out

    def known(self, segment: str) -> tuple[str, str, int]:
        """(ids in decimal, each after a space; decoded text; count) of a segment, from the cache if it is there."""
        found = self.segments.get(segment)
        if found is None:
            ids = self.segment_ids(segment)
            decoded = self.decode_part(ids)
            found = ("".join([f" {i}" for i in ids]), segment if decoded == segment else decoded, len(ids))
            if len(segment) <= 64:
                self.segments.put(segment, found)
        return found


def loaded(model_path: str) -> MergePieces:
    return only_model(("pieces", model_path), lambda: MergePieces(model_path))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Encodes each whole text with an end id, decodes the ids, and returns (id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs.

    whole=True adds the results themselves: ids array<int> and decoded string. A null text counts as empty: its only id is the end id, and it decodes to
    the empty string. Repeated rows are encoded each for itself; the order of rows and other columns play no part.
    """
    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    names = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if whole:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        names += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        model, sha = loaded(model_path), hashlib.sha256
        end = str(model.end)
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch["id"].to_pylist(), batch["text"]):
                text = text.as_py()
                new, known = model.segments.new, model.known
                found = [new.get(s) or known(s) for s in model.split(text)]
                ids = "".join([f[0] for f in found])
                decoded = "".join([f[1] for f in found])
                if decoded[:1] == " ":
                    decoded = decoded[1:]
                ids = ids[1:] + " " + end if ids else end
                row = (doc, sum([f[2] for f in found]) + 1, sha(ids.encode()).hexdigest(), sha(decoded.encode()).hexdigest())
                if whole:
                    row += (np.fromstring(ids, np.int32, sep=" "), decoded)
                out.append(row)
                held += len(text)
                model.segments.age()
                model.pairs.age()
                if held > CHARS or len(out) == 2000:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    return texts(docs, id_col, text_col).mapInArrow(rested(run), names)
