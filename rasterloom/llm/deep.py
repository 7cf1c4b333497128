"""Context trees deeper than a driver can hold, cut into ranges over the cluster.

A context of up to 8 bytes is a 64-bit number with its last byte foremost, so that in order of these numbers every subtree is one range. Blocks of
documents send their distinct (context, byte) to buckets, which are ranges by sampled splitters: no frequent context lands in one task. A bucket works
out its subtrees from the leaves up; only contexts that reach over its ends, at most two a depth, are open: their counts go to the driver, which joins them and
gives back how their depths mix. With that each bucket tells each block the probability of each (context, byte) that it asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from .common import U64, mix

#: Most bytes of context.
MOST = 8
EDGE = 255
ALL = (1 << 64) - 1
#: About so many places are sorted at a time.
SHARE = 1 << 17


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, from x + 8 down."""
    shift = np.zeros_like(x)
    y = x.astype(float).copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The natural log of the estimate's probability of such a sequence of bits."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


SMALL = kt(*np.meshgrid(np.arange(128.0), np.arange(128.0), indexing="ij")).ravel()


def kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """kt of whole numbers, the small ones from a table."""
    out = SMALL[np.minimum(zeros, 127) << 7 | np.minimum(ones, 127)]
    big = np.flatnonzero((zeros | ones) > 127)
    out[big] = kt(zeros[big].astype(float), ones[big].astype(float))
    return out


def mixture(own: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the mean of both, and the share that the first has in it; both come as logs."""
    apart = own - product
    less = np.exp(-np.abs(apart))
    mixed = np.maximum(own, product) + np.log((1 + less) / 2)
    return mixed, np.where(apart >= 0, 1.0, less) / (1 + less)


def ranked(values: np.ndarray, index: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and which of them each is."""
    order = np.argsort(values)
    found = values[order]
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    of = np.empty(len(found), index)
    of[order] = np.cumsum(new, dtype=index) - index(1)
    return found[new], of


def tallied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and how often each is there."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return values[first], np.diff(np.append(first, len(values)))


def mask(depth: int) -> np.uint64:
    return U64(ALL << (64 - 8 * depth) & ALL)


class Places:
    """The places of some documents, their ends included: each has a context and a byte that follows it."""

    def __init__(self, said: list[bytes], depth: int):
        edge = bytes([EDGE])
        self.depth = depth
        self.data = b"".join([x for t in said for x in (edge * MOST, t, edge)])
        self.buf = np.frombuffer(self.data, np.uint8)
        self.wide = np.ndarray((max(0, len(self.buf) - 7),), "<u8", self.data, strides=(1,))  # the eight bytes from each on, the last one foremost
        self.sizes = np.array([len(t) + 1 for t in said], np.int64)
        self.firsts = np.cumsum(self.sizes + MOST) - self.sizes  # of each document

    def contexts(self, at: np.ndarray) -> np.ndarray:
        found = self.wide[at - MOST]
        return found if self.depth == MOST else found & mask(self.depth)

    def by_last(self, most: int | None = None):
        """In the order of their contexts, places that have one last byte: it, which they are, and of each the other bytes with the byte that follows, as one number.

        most: those of a frequent last byte come in several parts of about so many, so that what is sorted stays small; places of one context are in one part.
        """
        last = self.buf[:-1]  # of the place after it
        sizes = np.zeros(256, np.int64)
        for at in range(0, len(last), 1 << 20):
            sizes += np.bincount(last[at : at + (1 << 20)], minlength=256)
        share = ((np.cumsum(sizes) - sizes) * 8 // max(1, int(sizes.sum()))).astype(np.uint8)  # values in at most eight shares, for no index of all places is held at once
        of = share[last]
        for j in range(MOST):
            edge = self.firsts - 2 - j
            of[edge[edge >= 0]] = 255  # no place comes next
        index = np.int32 if len(self.buf) < 1 << 31 else np.int64
        pairs = np.ndarray((max(0, len(self.buf) - 1),), "<u2", self.data, strides=(1,))  # the last two bytes of the place two on
        for k in np.unique(share[sizes > 0]).tolist():
            at = np.flatnonzero(of == k).astype(index)
            if not len(at):
                continue
            sort_by = last[at] if most is None or self.depth == 1 else pairs[at - index(1)]
            order = np.argsort(sort_by, kind="stable")  # of so few bits: a radix sort
            at, sort_by = at[order] + index(1), sort_by[order]
            del order
            shift, begin = 8 * (sort_by.itemsize - 1), 0
            ends = np.append(np.flatnonzero(sort_by[1:] != sort_by[:-1]) + 1, len(at))
            values = (sort_by[ends - 1] >> shift).tolist()
            for end, v, then in zip(ends.tolist(), values, [*values[1:], None]):
                if v != then or end - begin >= most:
                    yield v, at[begin:end], self.keys(at[begin:end])
                    begin = end

    def keys(self, at: np.ndarray) -> np.ndarray:
        found = self.contexts(at)
        found <<= U64(8)
        found |= self.buf[at]
        return found


def entries(contexts: np.ndarray, byte: np.ndarray, count: np.ndarray | None = None):
    """Distinct contexts in order; distinct (rank of the context, byte) in order, as codes, with their counts; which of these each place is."""
    low = contexts.min() if len(contexts) else U64(0)
    if len(contexts) and contexts.max() - low < U64(1 << 56):  # both are one number: sorted once
        found, back = ranked(contexts - low << U64(8) | byte)
        short = found >> U64(8)
        new = np.ones(len(found), bool)
        np.not_equal(short[1:], short[:-1], out=new[1:])
        once, code = short[new] + low, np.cumsum(new) - 1 << 8 | (found & U64(255)).astype(np.int64)
    else:
        once, of = ranked(contexts)
        code, back = ranked(of << 8 | byte)
    return once, code, np.bincount(back, count, len(code)).astype(np.int64), back.astype(np.int32)


def split(v: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and bytes of such numbers."""
    return keys >> U64(8) | U64(v << 56), (keys & U64(255)).astype(np.uint8)


def pack(contexts: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple:
    """Distinct contexts as differences in planes of bytes, then how many bytes follow each, these, and their counts."""
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(contexts)), bool), contexts[1:] != contexts[:-1]]))
    once = contexts[new]
    step = once.copy()
    step[1:] ^= once[:-1]
    sizes = np.diff(np.append(new, len(contexts))) - 1
    data = b"".join([np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), sizes.astype(np.uint8).tobytes(), byte.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes()])
    return len(once), len(byte), pa.compress(data, codec="zstd", asbytes=True), count[count >= 255]


def unpack(packed: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, byte and count of each entry."""
    n, m, data, big = packed
    data = np.frombuffer(pa.decompress(data, decompressed_size=9 * n + 2 * m, codec="zstd", asbytes=True), np.uint8)
    once = np.bitwise_xor.accumulate(np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view(U64).ravel()) if n else np.zeros(0, U64)
    count = data[9 * n + m :].astype(np.int64)
    count[count == 255] = big
    return np.repeat(once, data[8 * n : 9 * n].astype(np.int64) + 1), data[9 * n : 9 * n + m], count


def pack_keys(keys: np.ndarray) -> tuple:
    """Sorted numbers of 64 bits as differences in planes of bytes."""
    step = keys.copy()
    step[1:] ^= keys[:-1]
    return len(keys), pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack_keys(packed: tuple) -> np.ndarray:
    n, data = packed
    data = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.bitwise_xor.accumulate(np.ascontiguousarray(data.reshape(8, n).T).view(U64).ravel()) if n else np.zeros(0, U64)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(counts.max())) if len(counts) else counts


def pack_logs(logs: np.ndarray) -> tuple:
    """Numbers of 32 bits in planes of bytes."""
    return len(logs), pa.compress(np.ascontiguousarray(logs.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpack_logs(packed: tuple) -> np.ndarray:
    n, data = packed
    data = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view(np.float32).ravel()


def sampled(said: list[bytes], depth: int, most: int = 64, salt: int = 0, step: int = 8) -> np.ndarray:
    """Some of the distinct contexts of some documents, others for another salt."""
    found = Places(said, depth)
    at = np.arange(MOST + int(salt) % step, len(found.buf), step)
    of = np.searchsorted(found.firsts, at, "right") - 1
    once, _ = tallied(found.contexts(at[at < (found.firsts + found.sizes)[of]]))
    return once[np.argsort(mix(once ^ U64(salt)))[:most]]


def between(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of whole numbers from each first to the next, by one running sum."""
    upto = np.cumsum(count)[np.append(first[1:], len(count)) - 1]
    upto[1:] -= upto[:-1].copy()
    return upto


class Subtrees:
    """The part of the tree in a range of contexts, low to high, both included."""

    def __init__(self, once: np.ndarray, code: np.ndarray, count: np.ndarray, depth: int, low: int, high: int):
        self.depth = depth
        self.levels = [None] * depth + [(once, code, count, None)]
        self.open = [None] * (depth + 1)
        for d in range(depth, -1, -1):
            once, code, count, _ = self.levels[d]
            self.open[d] = (once < U64(low)) | ((once | ~mask(d)) > U64(high))
            if d:
                short = once & mask(d - 1)
                new = np.concatenate([[True], short[1:] != short[:-1]])
                up = (np.cumsum(new) - 1)[code >> 8] << 8 | code & 255
                fewer, of = ranked(up)
                self.levels[d] = once, code, count, of.astype(np.int32)
                self.levels[d - 1] = short[new], fewer, np.bincount(of, count, len(fewer)).astype(np.int64), None

    def _nodes(self, bit: int) -> list[tuple]:
        """By depth: (which node each code is of, first code of each, zeros, ones, parents)."""
        out = []
        for once, code, count, up in self.levels:
            key = code >> (8 - bit)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            of, first = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new).astype(np.int32)
            both = between(count, first)
            ones = between(count * (code >> (7 - bit) & 1), first)
            out.append((of, first, both - ones, ones, out[-1][0][up[first]] if out else None))
        return out

    def _label(self, d: int, bit: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which nodes are open, and of these the context and the bits so far with a one in front."""
        once, code, _, _ = self.levels[d]
        at = np.flatnonzero(self.open[d][code[first] >> 8])
        mine = code[first[at]]
        return at, once[mine >> 8], 1 << bit | (mine & 255) >> (8 - bit)

    def _shares(self, nodes: list[tuple], bit: int):
        """From the leaves up: (depth, log of own estimate, sum of the closed children's logs or None, the share of the own estimate)."""
        below = None
        for d in range(self.depth, -1, -1):
            _, first, zeros, ones, parents = nodes[d]
            own = kt_of(zeros, ones)
            product, mixed, share = None, own, np.ones(len(own))
            if below is not None:
                product = np.bincount(*below, len(own))
                mixed, share = mixture(own, product)
            yield d, product, share
            if d:
                shut = ~self.open[d][self.levels[d][1][first] >> 8]
                below = parents[shut], mixed[shut]

    def opened(self) -> list[tuple]:
        """By depth and bit what the driver must know of open nodes: (depth, contexts, nodes, zeros, ones, product)."""
        out = []
        for bit in range(8):
            nodes = self._nodes(bit)
            for d, product, _ in self._shares(nodes, bit):
                at, contexts, label = self._label(d, bit, nodes[d][1])
                if len(at):
                    out.append((d, contexts, label, nodes[d][2][at], nodes[d][3][at], product[at]))
        return out

    def logs(self, spine: dict) -> np.ndarray:
        """log10 of the probability of each code's byte in its context."""
        out = np.ones(len(self.levels[-1][1]))
        for bit in range(8):
            nodes = self._nodes(bit)
            share = {d: s for d, _, s in self._shares(nodes, bit)}
            reach, sure = np.ones(len(nodes[0][1])), np.zeros(len(nodes[0][1]))
            for d in range(self.depth + 1):
                _, first, zeros, ones, parents = nodes[d]
                chance = (ones + 0.5) / (zeros + ones + 1)
                at, contexts, label = self._label(d, bit, first)
                if len(at):
                    share[d][at], chance[at] = looked_up(spine[d], contexts, label)
                if d:
                    reach, sure = (reach * (1 - share[d - 1]))[parents], sure[parents]
                sure = sure + reach * share[d] * chance
            one = (self.levels[-1][1] >> (7 - bit) & 1).astype(bool)
            sure = sure[nodes[-1][0]]
            out *= np.where(one, sure, 1 - sure)  # of eight bits, none so small that the product could vanish
        return np.log10(out)


def looked_up(level: tuple, contexts: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    once, code, share, chance = level
    at = np.searchsorted(code, np.searchsorted(once, contexts) << 8 | label)
    return share[at], chance[at]


def summed(found: list[tuple]) -> list[tuple]:
    """Open nodes of several ranges as one entry a depth: (depth, contexts, nodes, zeros, ones, product), each node once."""
    out = []
    for d in sorted({f[0] for f in found}):
        contexts, label, zeros, ones, product = (np.concatenate(c) for c in zip(*(f[1:] for f in found if f[0] == d)))
        once, of = ranked(contexts)
        code, of = ranked(of << 8 | label)
        zeros, ones = (np.bincount(of, x, len(code)).astype(np.int64) for x in (zeros, ones))
        out.append((d, once[code >> 8], code & 255, zeros, ones, np.bincount(of, product, len(code))))
    return out


def joined(found: list[tuple], depth: int) -> dict[int, tuple]:
    """Open nodes of all buckets together: by depth (contexts, codes, shares, chances of a one)."""
    out, below = {}, None
    for d, contexts, label, zeros, ones, product in reversed(summed(found)):
        once, of = ranked(contexts)
        code = of << 8 | label  # in order already
        if below is not None:
            contexts, label, mixed = below
            at = np.searchsorted(code, np.searchsorted(once, contexts & mask(d)) << 8 | label)
            product += np.bincount(at, mixed, len(code))
        mixed, share = mixture(kt_of(zeros, ones), product)
        out[d] = once, code, share, (ones + 0.5) / (zeros + ones + 1)
        below = once[code >> 8], code & 255, mixed
    return out
