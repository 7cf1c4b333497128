"""Fuzzy line deduplication by MinHash.

Lines are normalised (lower case, runs of white space as one space) and equal ones fall together first. A line's set is that of its character shingles.
Bands are the smallest few hashes of a part of the hash space, of one seed or several, always as many as the band is long: two sets share a band as often
as so many MinHashes agree. Which seeds and parts serve is chosen by the size of the set alone, and a Jaccard similarity of 0.8 bounds how far two sizes are
apart, so overlapping classes give every similar pair a class in common. Sets of a few shingles have exact keys instead. Within a band's bucket each line
is first compared with the one before it, a chain and not all pairs; what the exact Jaccard similarity confirms is joined by distributed union-find.
Buckets that still hold several components then compare lines across components, those outside the bucket's largest component with the rest. A parity
sketch of each set bounds the difference of two sets from below, so it passes over pairs without losing one. One line of each component stays: the first by document id and line number.

Hashing and comparing shingles run in Arrow batches, everything else in DataFrame operations: see README for the figures of native forms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, partitions, texts, written
from .components import connected_components

#: Sets of fewer distinct shingles have exact keys.
FEW = 8
#: Classes of sets by their number of distinct shingles, ends included; neighbours overlap by the factor that a similarity of 0.8 allows.
SMALL, MIDDLE, LARGE = (FEW, 80), (64, 320), (256, 1 << 62)
#: Hashes of a band. Small sets have BANDS bands of MinHashes, middle ones three seeds of four parts, large ones fourteen parts of one seed.
HASHES, HASHES_LARGE = 6, 7
BANDS, SEEDED, PARTS, PARTS_LARGE = 12, 3, 4, 14
#: Bits of a hash that are sorted below the number of its line.
LOW = 44
#: Words of 64 bits in the parity sketch of a set.
SKETCH = 16
#: Bits of the filter by which lines that no candidate is are left out of a join: 4 MB at any size, less use beyond some ten million candidates.
FILTER = 25
_random = np.random.default_rng(21)
CHARS = _random.integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
SEEDS = _random.integers(0, 1 << 63, BANDS * HASHES, dtype=U64) * U64(2) + U64(1)


# ---------------------------------------------------------------- lines


def normalised(said: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines with a word of some texts: in lower case, runs of white space as one space, none at the ends; which text each is of, and its number there."""
    try:
        low = pc.utf8_lower(said.cast(pa.large_string()))
    except pa.ArrowInvalid:  # not UTF-8
        low = pc.utf8_lower(pa.array([x.decode("utf-8", "replace") for x in said.to_pylist()], pa.large_string()))
    odd = pc.match_substring(low, "  ")
    for c in "\t\v\f\r":
        odd = pc.or_(odd, pc.match_substring(low, c))
    if pc.any(odd).as_py():
        low = pc.if_else(odd, pc.replace_substring_regex(low, "[ \t\v\f\r]+", " "), low)
    parts = pc.split_pattern(low, "\n")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    norms = pc.utf8_trim(pc.list_flatten(parts), " ")
    keep = pc.greater(pc.binary_length(norms), 0)
    kept = keep.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return norms.filter(keep), of[kept], number[kept].astype(np.int32)


def numbered_lines(docs: DataFrame, id_col: str, text_col: str, whole: bool = True) -> DataFrame:
    """(id, line_no, key, norm) of every line with a word, key being 128 bits of norm; whole=False: without norm."""
    schema = pa.schema([("id", pa.int64()), ("line_no", pa.int32()), ("key", pa.binary())] + [("norm", pa.string())] * whole)

    def run(batches):
        for batch in batches:
            for ids, said in text_slices(batch):
                norms, of, number = normalised(said)
                for at in range(0, len(norms), 20_000):
                    some = norms.slice(at, 20_000)
                    cols = [ids.take(pa.array(of[at : at + 20_000])), pa.array(number[at : at + 20_000]), pa.array(list(map(xxhash.xxh3_128_digest, some.cast(pa.large_binary()).to_pylist())), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols + [some.cast(pa.string())] * whole, schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, line_no int, key binary" + ", norm string" * whole)


def text_slices(batch: pa.RecordBatch, most: int = 4 << 20):
    """(ids, texts as binary) of a batch, of about so many bytes at a time."""
    said = batch["text"].cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary())
    ends = np.cumsum(pc.binary_length(said).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(said):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch["id"].slice(at, to - at), said.slice(at, to - at)
        at = to


# ---------------------------------------------------------------- sets and bands


class Sets:
    """The sets of some lines, as sorted distinct numbers (line, hash) of 64 bits."""

    def __init__(self, norms: list[str], width: int):
        points = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        ends = np.cumsum([len(x) for x in norms], dtype=np.int64)
        self.n, n = len(norms), max(0, len(points) - width + 1)
        within = np.ones(n + width, bool)
        for j in range(1, width):  # no shingle goes over a line's end
            within[ends[ends >= j] - j] = False
        with np.errstate(over="ignore"):
            hashes = points[:n] * CHARS[0]
            for j in range(1, width):
                hashes += points[j : n + j] * CHARS[j]
            hashes ^= hashes >> U64(32)
            hashes *= CHARS[-1]
        hashes >>= U64(64 - LOW)
        hashes |= np.repeat(np.arange(self.n, dtype=U64) << U64(LOW), np.diff(ends, prepend=0))[:n]
        keys = hashes[within[:n]]
        keys.sort()
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        self.keys = keys[new]
        self.line = (self.keys >> U64(LOW)).astype(np.int64)
        self.m = np.bincount(self.line, minlength=self.n)

    def of(self, size: tuple[int, int]) -> np.ndarray:
        """The numbers of the lines whose sets have such a size."""
        return self.keys[((self.m >= size[0]) & (self.m <= size[1]))[self.line]]

    def sketches(self) -> np.ndarray:
        """Per line SKETCH words whose bits are the parities of the shingles that fall on them."""
        bit = (self.keys >> U64(3)) & U64(64 * SKETCH - 1)
        place = self.line * (64 * SKETCH) + bit.astype(np.int64)
        odd = np.bincount(place, minlength=self.n * 64 * SKETCH) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64).reshape(self.n, SKETCH)


def reseeded(keys: np.ndarray, seed: int) -> np.ndarray:
    """The same sets under another hash, sorted again."""
    low = U64((1 << LOW) - 1)
    with np.errstate(over="ignore"):
        out = keys >> U64(LOW) << U64(LOW) | mix((keys & low) * SEEDS[seed]) >> U64(64 - LOW)
    out.sort()
    return out


def folded(columns: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """One number of 64 bits for a label and some hashes."""
    out = mix(label.astype(U64) + U64(1))
    with np.errstate(over="ignore"):
        for c in columns:
            out = mix(out * U64(0x9E3779B97F4A7C15) + c)
    return out


def part_bands(keys: np.ndarray, parts: int, size: int, label: int) -> tuple[np.ndarray, np.ndarray]:
    """(bands, lines): the `size` smallest hashes of each of so many parts of the hash space, where a set has as many there."""
    low, line = keys & U64((1 << LOW) - 1), keys >> U64(LOW)
    part = line * U64(parts) + (low * U64(parts) >> U64(LOW))
    first = np.flatnonzero(np.diff(part, prepend=~part[:1]) != 0)
    first = first[np.diff(np.append(first, len(part))) >= size]
    name = part[first] - line[first] * U64(parts) + U64(label << 8)
    return folded([low[first + j] for j in range(size)], name), line[first].astype(np.int64)


def min_bands(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, lines): BANDS times HASHES MinHashes."""
    line = keys >> U64(LOW)
    first = np.flatnonzero(np.diff(line, prepend=~line[:1]) != 0)
    low = keys & U64((1 << LOW) - 1)
    bands, lines = [], []
    for b in range(BANDS if len(first) else 0):
        with np.errstate(over="ignore"):
            least = [np.minimum.reduceat(mix(low * SEEDS[b * HASHES + j]), first) for j in range(HASHES)]
        bands.append(folded(least, np.full(len(first), 1024 + b)))
        lines.append(line[first].astype(np.int64))
    return (np.concatenate(bands), np.concatenate(lines)) if bands else (np.zeros(0, U64), np.zeros(0, np.int64))


def few_keys(norm: str, width: int, threshold: float, most: int) -> list[tuple[int, int]]:
    """(key, kind) of a small set: kind 1 the set itself; kind 2 itself less one shingle, if it then is still similar."""
    whole = sorted({norm[i : i + width] for i in range(len(norm) - width + 1)})
    if not 1 <= len(whole) <= most:
        return []
    key = lambda parts: xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"), 2)
    less = len(whole) > 1 and len(whole) - 1 >= threshold * len(whole)
    return [(key(whole), 1)] + [(key(whole[:i] + whole[i + 1 :]), 2) for i in range(len(whole) if less else 0)]


def bands_of(norms: list[str], width: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bands, kinds, lines) of some lines; kind 0 are bands of MinHashes."""
    sets = Sets(norms, width)
    found = [part_bands(sets.of(LARGE), PARTS_LARGE, HASHES_LARGE, 0), min_bands(sets.of(SMALL))]
    middle = sets.of(MIDDLE)
    found += [part_bands(reseeded(middle, s), PARTS, HASHES, 1 + s) for s in range(SEEDED)]
    most = int((FEW - 1) / threshold)
    keys, kinds, lines = [], [], []
    for i in np.flatnonzero((sets.m >= 1) & (sets.m <= most)).tolist():
        for key, kind in few_keys(norms[i], width, threshold, most):
            keys.append(key)
            kinds.append(kind)
            lines.append(i)
    count = sum(len(b) for b, _ in found)
    bands = np.concatenate([b for b, _ in found] + [np.array(keys, U64)])
    return bands, np.concatenate([np.zeros(count, np.int8), np.array(kinds, np.int8)]), np.concatenate([x for _, x in found] + [np.array(lines, np.int64)])


def _norms(batches, chars: int = 1 << 18):
    """(node numbers, lines) in chunks of about so many characters."""
    nodes, norms, held = [], [], 0
    for batch in batches:
        for node, norm in zip(batch["node"].to_pylist(), batch["norm"].to_pylist()):
            nodes.append(node)
            norms.append(norm)
            held += len(norm)
            if held >= chars:
                yield np.array(nodes, np.int64), norms
                nodes, norms, held = [], [], 0
    if nodes:
        yield np.array(nodes, np.int64), norms


def band_rows(nodes: DataFrame, width: int, threshold: float = 0.8, hot: dict[int, int] | None = None) -> DataFrame:
    """(band, part, kind, node) of (node, norm). hot: into how many parts some bands are dealt by a hash of the line; all others are one part, 0."""
    schema = pa.schema([("band", pa.int64()), ("part", pa.int16()), ("kind", pa.int8()), ("node", pa.int64())])
    names = np.array(sorted(hot or ()), np.int64)
    salts = np.array([hot[x] for x in names.tolist()], np.int64) if hot else names

    def run(batches):
        for node, norms in _norms(batches):
            bands, kinds, lines = bands_of(norms, width, threshold)
            bands, node = bands.view(np.int64), node[lines]
            part = np.zeros(len(bands), np.int16)
            if len(names):
                at = np.minimum(np.searchsorted(names, bands), len(names) - 1)
                split = names[at] == bands
                part[split] = 1 + mix(node[split].astype(U64)) % salts[at[split]].astype(U64)
            for at in range(0, len(bands), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (bands, part, kinds, node)], schema=schema)

    return nodes.select("node", "norm").mapInArrow(run, "band long, part short, kind byte, node long")


def sketched(nodes: DataFrame, width: int) -> DataFrame:
    """(node, m, s0 ...): the size of the set and its parity sketch."""
    names = [f"s{i}" for i in range(SKETCH)]
    schema = pa.schema([("node", pa.int64()), ("m", pa.int64()), *((x, pa.int64()) for x in names)])

    def run(batches):
        for node, norms in _norms(batches):
            sets = Sets(norms, width)
            sketches = sets.sketches().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets.m), *(pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH))], schema=schema)

    return nodes.select("node", "norm").mapInArrow(run, "node long, m long, " + ", ".join(f"{x} long" for x in names))


def may_fit(a: str, b: str, threshold: float) -> Column:
    """False only where two sets can't be similar: of two sets with that Jaccard similarity the difference has at most this share of both, and each bit in
    which the sketches differ is one element of the difference at least."""
    differ = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    share = (1 - threshold) / (1 + threshold)
    return differ <= (F.col(f"{a}m") + F.col(f"{b}m")) * F.lit(share) + F.lit(1e-6)


def alike(pairs: list[tuple[int, int]], norms: list[str], width: int, threshold: float) -> np.ndarray:
    """Which pairs of lines, by their places in norms, have sets whose Jaccard similarity reaches the threshold.

    Common shingles are counted by their hashes. Where two shingles of one hash could turn the verdict, the shingles themselves decide.
    """
    sets = Sets(norms, width)
    low = sets.keys & U64((1 << LOW) - 1)
    firsts = np.cumsum(sets.m) - sets.m
    one, two = np.array(pairs, np.int64).reshape(-1, 2).T
    both = np.zeros(len(one), np.int64)
    ends = np.cumsum(sets.m[one] + sets.m[two])
    at = 0
    while at < len(one):  # some pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), "right")))
        keys = []
        for of in (one[at:to], two[at:to]):
            size = sets.m[of]
            where = np.repeat(firsts[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            keys.append(np.repeat(np.arange(to - at, dtype=U64) << U64(LOW), size) | low[where])
        keys = np.concatenate(keys)
        keys.sort()
        both[at:to] = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> U64(LOW)).astype(np.int64), minlength=to - at)
        at = to
    short = both - threshold * (sets.m[one] + sets.m[two] - both)
    keep = short >= 0
    for i in np.flatnonzero(np.abs(short) <= 4).tolist():
        a, b = ({norms[k][p : p + width] for p in range(len(norms[k]) - width + 1)} for k in (one[i], two[i]))
        keep[i] = len(a & b) >= threshold * len(a | b)
    return keep


def similar(pairs: DataFrame, nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of (a, b) those whose sets' exact Jaccard similarity reaches the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            places: dict[int, int] = {}
            norms, found, held, begin = [], [], 0, 0
            for i, (x, y) in enumerate(zip(batch["x"].to_pylist(), batch["y"].to_pylist())):
                for node, norm in ((a[i], x), (b[i], y)):
                    if node not in places:
                        places[node] = len(norms)
                        norms.append(norm)
                        held += len(norm)
                found.append((places[a[i]], places[b[i]]))
                if held > 1 << 18 or i == len(a) - 1:
                    keep = pa.array(alike(found, norms, width, threshold), pa.bool_())
                    yield pa.RecordBatch.from_arrays([batch["a"].slice(begin, len(found)), batch["b"].slice(begin, len(found))], schema=schema).filter(keep)
                    places, norms, found, held, begin = {}, [], [], 0, i + 1

    one = nodes.select(F.col("node").alias("a"), F.col("norm").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("norm").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def with_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of nodes whose number is in wanted. A filter of a fixed size takes most others out before the join, and none of these."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER))
    maps = wanted.select(F.shiftright(place, 15).alias("map"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(1 << (FILTER - 3), np.uint8)
    for number, held in maps.collect():  # 2**(FILTER - 15) maps of 4 KiB at most
        bits[number << 12 : (number + 1) << 12] = np.frombuffer(held, np.uint8)

    def run(batches):
        for batch in batches:
            at = batch["place"].to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 > 0)).drop_columns(["place"])

    some = nodes.withColumn("place", place).mapInArrow(run, nodes.schema)
    return some.join(wanted, "node", "left_semi")


def hot_bands(nodes: DataFrame, width: int, threshold: float, share: int = 64, least: int = 16) -> dict[int, int]:
    """Bands that would make a partition uneven, found in a sample of the lines, and into how many parts to deal them.

    A band counts from a sixteenth of a partition's rows on, so there are at most sixteen for each partition.
    """
    some = band_rows(nodes.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0), width, threshold).groupBy("band").count().where(F.col("count") >= least)
    large = max(1, nodes.count() * BANDS // (16 * partitions(nodes.sparkSession)))
    found = some.select("band", F.ceil(F.col("count") * share / large).alias("salts")).where("salts > 1")
    return {r[0]: min(int(r[1]), 1 << 14) for r in found.collect()}


CHAIN = pa.schema([("band", pa.int64()), ("part", pa.int16()), ("kind", pa.int8()), ("node", pa.int64()), ("prev", pa.int64()), ("whole", pa.int64())])


def _chain(by_part: bool):
    """Rows in order of their buckets: each with the one before it in its bucket, and the one that stands for an exact key. Lines alone in a bucket go, but
    if the bucket is a part of a hot one."""

    def run(batches):
        last = None  # of what came before, not yet said: it may be alone
        for batch in batches:
            if not len(batch):
                continue
            band, part, kind, node = (batch[i].to_numpy(zero_copy_only=False) for i in range(4))
            prev, whole = np.full(len(node), -1), np.full(len(node), -1)
            if last is not None:
                band, part, kind, node, prev, whole = (np.concatenate([x, y]) for x, y in zip(last, (band, part, kind, node, prev, whole)))
            same = np.zeros(len(band) + 1, bool)
            same[1:-1] = band[1:] == band[:-1]
            if by_part:
                same[1:-1] &= part[1:] == part[:-1]
            going = np.flatnonzero(same[:-1])
            prev[going] = node[going - 1]
            first = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(band))))
            stands = np.where((kind == 1) & ~same[:-1] & (prev < 0), node, -1)
            if last is not None:
                stands[0] = whole[0]
            whole = stands[first]
            keep = same[:-1] | same[1:] | (prev >= 0) | ((part > 0) if by_part else False)
            keep[-1] = False
            last = [x[-1:] for x in (band, part, kind, node, prev, whole)]
            yield from _chained(band, part, kind, node, prev, whole, keep)
        if last is not None:
            yield from _chained(*last, (last[4] >= 0) | ((last[1] > 0) if by_part else False))

    return run


def _chained(band, part, kind, node, prev, whole, keep):
    band, part, kind, node, prev, whole = (x[keep] for x in (band, part, kind, node, prev, whole))
    for at in range(0, len(band), 50_000):
        to = at + 50_000
        yield pa.RecordBatch.from_arrays(
            [pa.array(band[at:to]), pa.array(part[at:to]), pa.array(kind[at:to]), pa.array(node[at:to]), pa.array(prev[at:to], mask=prev[at:to] < 0), pa.array(whole[at:to], mask=whole[at:to] < 0)], schema=CHAIN
        )


def chains(nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(band, kind, node, prev, whole): buckets of more than one line; prev is the line before in the bucket, whole the one that stands for an exact key.

    A bucket's rows stand together in a partition, sorted (spilling), and go by one after another. A hot bucket is chained in parts, and then the first
    lines of its parts.
    """
    n, ddl = partitions(nodes.sparkSession), "band long, part short, kind byte, node long, prev long, whole long"
    hot = hot_bands(nodes, width, threshold)
    rows = band_rows(nodes, width, threshold, hot).repartition(n, "band", "part").sortWithinPartitions("band", "part", "kind", "node")
    found = rows.mapInArrow(_chain(True), ddl)
    if not hot:
        return written(found.drop("part"), "chains")
    found = written(found, "chains")
    alone = F.col("prev").isNull() & (F.col("part") > 0)
    heads = found.where(alone).select("band", F.lit(0).cast("short").alias("part"), "kind", "node").repartition(n, "band").sortWithinPartitions("band", "kind", "node")
    return found.where(~alone).unionByName(heads.mapInArrow(_chain(False), ddl)).drop("part")


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), component (a number), component_size (lines, copies included), kept.

    Lines are in one component if a chain of lines joins them whose shingle sets have a Jaccard similarity of at least threshold (0.8 or more) each; lines
    of fewer characters than a shingle match equal ones only. Sets of under FEW shingles are matched exactly, others by bands that find a pair at 0.8 with
    a probability of about 0.96, and more similar ones almost surely.
    A null text has no lines; lines without a word are left alone and have no row; an empty table gives an empty result. Of a component the line with the
    smallest (id, line_no) stays; a null id counts as the largest; rows that repeat an id and its text repeat its lines, and then the copies that stand at
    the kept place all count as it. Other columns of docs, whatever their names, play no part. Components that don't settle in 60 rounds are an error.
    """
    if not 0.8 <= threshold <= 1 or width > len(CHARS):
        raise ValueError("classes of sizes and keys of small sets are made for similarities of 0.8 or more")
    place = (F.coalesce(F.col("id"), F.lit((1 << 63) - 1)).cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(38,0)")
    lines = numbered_lines(docs, id_col, text_col)
    nodes = lines.groupBy("norm", "key").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "first", "copies", "norm"), "lines")
    chained = chains(nodes, width, threshold)
    several = chained.where("kind = 0")
    # a key is all that makes a small set: each is compared with the one line that stands for its set, or for itself less a shingle
    shorts = chained.where("kind > 0 and whole <> node").select(F.col("node").alias("a"), F.col("whole").alias("b"))
    pairs = written(several.where("prev <> node").select(F.greatest("node", "prev").alias("a"), F.least("node", "prev").alias("b")).union(shorts).distinct(), "pairs")
    there = several.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    candidates = written(with_nodes(nodes.select("node", "norm"), written(there, "wanted")), "candidates")
    links = written(similar(pairs, candidates, width, threshold), "links")
    roots = written(connected_components(links), "roots")
    # across the components that a bucket still holds
    labelled = several.select("band", "node").distinct().join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    labelled = written(labelled, "labelled")
    parts = labelled.groupBy("band", "root").count().groupBy("band").agg(F.max_by("root", "count").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    mixed = labelled.join(parts.select("band", "most"), "band")
    sketches = sketched(candidates.join(mixed.select("node").distinct(), "node", "left_semi"), width)
    mixed = written(mixed.join(sketches, "node"), "mixed")
    named = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("node", "root", "m", *(f"s{i}" for i in range(SKETCH)))]
    left = mixed.where("root <> most").select("band", *named("a_"))
    right = mixed.select("band", "most", *named("b_"))
    fits = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("most")) | (F.col("a_node") < F.col("b_node"))) & may_fit("a_", "b_", threshold)
    across = left.join(right, "band").where(fits).select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b")).distinct()
    more = written(similar(across.join(pairs, ["a", "b"], "left_anti"), candidates, width, threshold), "more")
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    # of lines that no other is like, the node itself is the component
    named = nodes.select("node", "key", "first", "copies").join(roots, "node", "left").select(F.coalesce("root", "node").alias("component"), "key", "first", "copies", F.col("root").isNotNull().alias("joined"))
    named = written(named, "named")
    best = named.where("joined").groupBy("component").agg(F.min("first").alias("stays"), F.sum("copies").alias("size"))
    member = named.join(best, "component", "left").select("key", "component", F.coalesce("size", "copies").alias("component_size"), F.coalesce("stays", "first").alias("stays"))
    each = numbered_lines(docs, id_col, text_col, whole=False).select("id", "line_no", "key", place.alias("place")).join(member, "key")
    return each.select(F.col("id").alias(id_col), "line_no", "component", "component_size", (F.col("place") == F.col("stays")).alias("kept"))
