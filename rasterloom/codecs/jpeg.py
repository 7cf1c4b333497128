"""JPEG: sequential and progressive decoding, at eighths of the size too, and both ways of encoding, with Huffman tables made for the picture.

Transforms, colour and entropy coding are numpy over all blocks at once; only reading entropy-coded bits goes code by code.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

from ..errors import undecodable
from ..kernels.raster import cmyk_to_rgb
from .containers import app2_parts, jpeg_segments

#: The zigzag order, and the quantisation tables of the standard for luma and chroma.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]


# ---------------------------------------------------------------- reading


class Bits:
    """Bits of one stretch between restart markers, stuffed zeros taken out."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.held = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            more = self.data[self.at : self.at + 6]
            self.at += 6
            if len(more) < 6:
                if self.at > len(self.data) + 64:
                    raise undecodable("JPEG is cut off")
                more = more.ljust(6, b"\0")
            self.held = (self.held & ((1 << self.have) - 1)) << 48 | int.from_bytes(more, "big")
            self.have += 48

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.have < n:
            self.fill(n)
        self.have -= n
        return self.held >> self.have & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: list) -> int:
        if self.have < 16:
            self.fill(16)
        found = table[self.held >> (self.have - 16) & 0xFFFF]
        if found is None:
            raise undecodable("JPEG code is invalid")
        self.have -= found[0]
        return found[1]


def _lookup(counts: bytes, values: bytes) -> list:
    """By the next 16 bits: (length, value)."""
    table: list = [None] * 65536
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - length)
            if (code + 1) * span > 65536 or at >= len(values):
                raise undecodable("JPEG Huffman table is invalid")
            table[code * span : (code + 1) * span] = [(length, values[at])] * span
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table, self.last = ident, h, v, table, 0

    def frame(self, rows: int, cols: int, progressive: bool) -> None:
        self.rows, self.cols = rows, cols
        self.blocks = [[[0] * 64 for _ in range(cols)] for _ in range(rows)] if progressive else None
        self.places, self.values = [], []

    def coefficients(self) -> np.ndarray:
        """(rows, cols, 64), in zigzag order."""
        if self.blocks is not None:
            return np.array(self.blocks, np.float64)
        out = np.zeros(self.rows * self.cols * 64)
        out[self.places] = self.values
        return out.reshape(self.rows, self.cols, 64)


def _sequential(bits_of: list[bytes], comps: list, frame: dict, restart: int) -> None:
    """A sequential scan: what is not zero goes to its component's places and values."""
    single = len(comps) == 1
    if single:
        c = comps[0]
        across, down = -(-(-(-frame["width"] * c.h // frame["hmax"])) // 8), -(-(-(-frame["height"] * c.v // frame["vmax"])) // 8)
        units = [[(c, 64 * (y * c.cols + x))] for y in range(down) for x in range(across)]
    else:
        offsets = [(c, v, h) for c in comps for v in range(c.v) for h in range(c.h)]
        units = ([(c, 64 * ((y * c.v + v) * c.cols + x * c.h + h)) for c, v, h in offsets] for y in range(frame["mcus_y"]) for x in range(frame["mcus_x"]))
    masks = [(1 << n) - 1 for n in range(17)]
    part, data, at, have, held = -1, b"", 0, 0, 0
    for n, unit in enumerate(units):
        if n == 0 or restart and n % restart == 0:
            part += 1
            if part >= len(bits_of):
                raise undecodable("JPEG restart marker is missing")
            data, at, have, held = bits_of[part].replace(b"\xff\x00", b"\xff") + bytes(64), 0, 0, 0
            for c in comps:
                c.last = 0
        for c, base in unit:
            places, values = c.places, c.values
            dc, ac, k = c.dc, c.ac, 0
            while k < 64:
                if have < 32:
                    held = (held & 0xFFFFFFFF) << 48 | int.from_bytes(data[at : at + 6], "big")
                    at += 6
                    have += 48
                length, said = (ac if k else dc)[held >> (have - 16) & 0xFFFF]
                have -= length
                size = said & 15
                if size or not k:
                    k += said >> 4
                    if k > 63:
                        raise undecodable("JPEG block is too long")
                    have -= size
                    value = held >> have & masks[size]
                    if size and not value >> (size - 1):
                        value -= masks[size]
                    if not k:
                        c.last = value = c.last + value
                    if value:
                        places.append(base + k)
                        values.append(value)
                    k += 1
                elif said == 0xF0:
                    k += 16
                else:
                    break
        if at > len(data):
            raise undecodable("JPEG is cut off")


def _scan(bits_of: list[bytes], comps: list, frame: dict, spectral: tuple, restart: int) -> None:
    ss, se, ah, al = spectral
    if not frame["progressive"]:
        _sequential(bits_of, comps, frame, restart)
        return
    single = len(comps) == 1
    if single:
        c = comps[0]
        across, down = -(-(-(-frame["width"] * c.h // frame["hmax"])) // 8), -(-(-(-frame["height"] * c.v // frame["vmax"])) // 8)
        units = [(y, x) for y in range(down) for x in range(across)]
    else:
        units = [(y, x) for y in range(frame["mcus_y"]) for x in range(frame["mcus_x"])]
    part = 0
    bits, eob = Bits(bits_of[0]), 0
    for n, (y, x) in enumerate(units):
        if restart and n and n % restart == 0:
            part += 1
            if part >= len(bits_of):
                raise undecodable("JPEG restart marker is missing")
            bits, eob = Bits(bits_of[part]), 0
            for c in comps:
                c.last = 0
        for c in comps:
            for v in range(1 if single else c.v):
                for h in range(1 if single else c.h):
                    block = c.blocks[y if single else y * c.v + v][x if single else x * c.h + h]
                    if ss == 0:
                        if ah == 0:
                            c.last += bits.signed(bits.symbol(c.dc))
                            block[0] = c.last << al
                        elif bits.read(1):
                            block[0] |= 1 << al
                    elif ah == 0:
                        eob = _first(bits, c, block, ss, se, al, eob)
                    else:
                        eob = _refine(bits, c, block, ss, se, al, eob)


def _first(bits: Bits, c, block: list, ss: int, se: int, al: int, eob: int) -> int:
    if eob:
        return eob - 1
    k = ss
    while k <= se:
        s = bits.symbol(c.ac)
        run, size = s >> 4, s & 15
        if size:
            k += run
            if k > 63:
                raise undecodable("JPEG block is too long")
            block[k] = bits.signed(size) << al if size else 0
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) + bits.read(run) - 1
    return 0


def _refine(bits: Bits, c, block: list, ss: int, se: int, al: int, eob: int) -> int:
    one = 1 << al

    def better(k: int) -> None:
        if bits.read(1) and not abs(block[k]) & one:
            block[k] += one if block[k] > 0 else -one

    k = ss
    if not eob:
        while k <= se:
            s = bits.symbol(c.ac)
            run, size = s >> 4, s & 15
            value = 0
            if size:
                value = one if bits.read(1) else -one
            elif run < 15:
                eob = (1 << run) + bits.read(run)
                break
            while k <= se:
                if block[k]:
                    better(k)
                elif run:
                    run -= 1
                else:
                    if value:
                        block[k] = value
                    k += 1
                    break
                k += 1
    if eob:
        while k <= se:
            if block[k]:
                better(k)
            k += 1
        eob -= 1
    return eob


def _split_scan(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded stretches from `at`, and where the next marker is."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[start:])
            return parts, len(data)
        nxt = data[at + 1]
        if nxt == 0:
            at += 2
        elif 0xD0 <= nxt <= 0xD7:
            parts.append(data[start:at])
            at += 2
            start = at
        elif nxt == 0xFF:
            at += 1
        else:
            parts.append(data[start:at])
            return parts, at


def decode(data: bytes, eighths: int = 8) -> np.ndarray:
    """RGB of 8 bits: of gray, YCbCr, RGB, CMYK or YCCK. eighths: of the size, from the low frequencies of each block alone; axes are rounded up."""
    quant, dc, ac, frame, restart, adobe = {}, {}, {}, None, 0, None
    at = 0
    prefix = b""
    while at < len(data):
        last = None
        for marker, body, end in jpeg_segments(prefix + data[at:]):
            last = marker
            if marker == 0xDB:
                while body:
                    wide, ident = body[0] >> 4, body[0] & 15
                    size = 128 if wide else 64
                    if len(body) < size + 1:
                        raise undecodable("JPEG quantisation table is cut off")
                    quant[ident] = np.frombuffer(body[1 : size + 1], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[size + 1 :]
            elif marker == 0xC4:
                while len(body) >= 17:
                    n = sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1, 0xC2):
                if body[0] != 8 or frame:
                    raise undecodable("JPEG frame is not supported")
                h, w, n = struct.unpack(">HHB", body[1:6])
                comps = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if n not in (1, 3, 4) or not w or not h or any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in comps):
                    raise undecodable("JPEG colour space is not supported")
                hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
                frame = {"width": w, "height": h, "comps": comps, "hmax": hmax, "vmax": vmax, "mcus_x": -(-w // (8 * hmax)), "mcus_y": -(-h // (8 * vmax)), "progressive": marker == 0xC2}
                for c in comps:
                    c.frame(frame["mcus_y"] * c.v, frame["mcus_x"] * c.h, frame["progressive"])
            elif 0xC3 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise undecodable("JPEG process is not supported")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
                adobe = body[11]
            elif marker == 0xDA:
                if frame is None:
                    raise undecodable("JPEG scan without a frame")
                named = {c.id: c for c in frame["comps"]}
                chosen = []
                for i in range(body[0]):
                    c = named.get(body[1 + 2 * i])
                    if c is None:
                        raise undecodable("JPEG scan names an unknown component")
                    tables = body[2 + 2 * i]
                    c.dc, c.ac, c.last = dc.get(tables >> 4, []), ac.get(tables & 15, []), 0
                    chosen.append(c)
                ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
                parts, stop = _split_scan(data, at + end - len(prefix))
                try:
                    _scan(parts, chosen, frame, (ss, se, a >> 4, a & 15), restart)
                except (IndexError, AttributeError, TypeError) as e:
                    raise undecodable("JPEG scan is invalid") from e
                at, prefix = stop, b"\xff\xd8"
                break
        if last != 0xDA:
            break
    if frame is None:
        raise undecodable("JPEG has no picture")
    return _picture(frame, quant, adobe, eighths)


def basis(n: int) -> np.ndarray:
    """The cosine transform of n points, a row for each frequency."""
    at = np.arange(n)
    return np.where(at[:, None] == 0, np.sqrt(1 / n), np.sqrt(2 / n) * np.cos((2 * at[None, :] + 1) * at[:, None] * np.pi / (2 * n)))


def _both(blocks: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """matrix applied to rows and columns of (n, k, k) blocks, as two large products."""
    n, k, _ = blocks.shape
    half = (blocks.reshape(-1, k) @ matrix).reshape(n, k, -1).transpose(0, 2, 1)
    return (np.ascontiguousarray(half).reshape(-1, k) @ matrix).reshape(n, matrix.shape[1], -1).transpose(0, 2, 1)


def _picture(frame: dict, quant: dict, adobe: int | None, eighths: int = 8) -> np.ndarray:
    planes, back = [], np.argsort(ZIGZAG)
    w, h = -(-frame["width"] * eighths // 8), -(-frame["height"] * eighths // 8)
    for c in frame["comps"]:
        if c.table not in quant:
            raise undecodable("JPEG quantisation table is missing")
        blocks = (c.coefficients() * quant[c.table])[..., back].reshape(-1, 8, 8)[:, :eighths, :eighths]
        pixels = _both(np.ascontiguousarray(blocks) * (eighths / 8), basis(eighths)).reshape(c.rows, c.cols, eighths, eighths).transpose(0, 2, 1, 3).reshape(c.rows * eighths, -1)
        plane = np.clip(np.floor(pixels + 128.5), 0, 255)
        ch, cw = -(-h * c.v // frame["vmax"]), -(-w * c.h // frame["hmax"])
        planes.append(_upsampled(plane[:ch, :cw], h, w, frame["vmax"] // c.v, frame["hmax"] // c.h))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=2)
    transform = adobe if adobe is not None else (1 if len(planes) == 3 else 0)
    if len(planes) == 3 and adobe is None and [c.id for c in frame["comps"]] == [82, 71, 66]:
        transform = 0
    image = np.stack(planes, 2)
    if transform:
        y, cb, cr = (image[..., i] for i in range(3))
        cb, cr = cb - 128, cr - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        image = np.concatenate([rgb, image[..., 3:]], 2)
    image = np.clip(np.floor(image + 0.5), 0, 255).astype(np.uint8)
    if len(planes) == 3:
        return image
    if adobe is None:
        image = 255 - image
    return cmyk_to_rgb(image)


def _upsampled(plane: np.ndarray, h: int, w: int, v: int, x: int) -> np.ndarray:
    for axis, factor, size in ((0, v, h), (1, x, w)):
        if factor == 2:
            p = np.moveaxis(plane, axis, 0)
            prev, after = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
            out = np.empty((2 * len(p), *p.shape[1:]))
            out[::2], out[1::2] = (3 * p + prev) / 4, (3 * p + after) / 4
            plane = np.moveaxis(out, 0, axis)
        elif factor > 1:
            plane = np.repeat(plane, factor, axis)
        plane = np.take(plane, range(min(size, plane.shape[axis])), axis)
    return plane


# ---------------------------------------------------------------- writing


def _lengths(freq: Counter) -> tuple[bytes, bytes]:
    """Counts by length and values of a Huffman code of at most 16 bits that leaves the code of all ones free."""
    import heapq

    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(freq.items()))] + [(0, 1 << 20, [-1])]
    heapq.heapify(heap)
    size: Counter = Counter({s: 0 for s in [*freq, -1]})
    tie = 1 << 21
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            size[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    counts = Counter(size.values())
    for length in range(max(counts), 16, -1):
        while counts[length] > 0:
            shorter = length - 2
            while not counts[shorter]:
                shorter -= 1
            counts[length] -= 2
            counts[length - 1] += 1
            counts[shorter + 1] += 2
            counts[shorter] -= 1
    longest = max(n for n, c in counts.items() if c)
    counts[longest] -= 1
    order = sorted((s for s in size if s >= 0), key=lambda s: (size[s], s))
    return bytes(counts[i] for i in range(1, 17)), bytes(order)


def _codes(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def scaled_table(base: list[int], quality: float) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((np.array(base) * scale + 50) / 100), 1, 255).astype(np.int64)


def _blocks(plane: np.ndarray, table: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Quantised coefficients in zigzag order of (rows, cols) blocks."""
    p = np.pad(plane, ((0, rows * 8 - plane.shape[0]), (0, cols * 8 - plane.shape[1])), mode="edge") - 128.0
    blocks = np.ascontiguousarray(p.reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3)).reshape(-1, 8, 8)
    coeff = _both(blocks, basis(8).T).reshape(rows, cols, 64)
    return np.round(coeff / table).astype(np.int64)[..., ZIGZAG]


def _widths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits each value takes, and these bits."""
    size = np.frexp(np.abs(values).astype(float))[1].astype(np.int64)
    return size, np.where(values >= 0, values, values + (1 << size) - 1)


class Scan:
    """Codes of a scan in order: (table, symbol, bits, how many). blocks: (n, 64) in the order of the scan; of: the table of each; lo, hi: its frequencies."""

    def __init__(self, blocks: np.ndarray, of: np.ndarray, comp: np.ndarray, lo: int, hi: int):
        place, table, symbol, bits, size = [], [], [], [], []

        def add(at, t, s, b, n):
            for into, x in zip((place, table, symbol, bits, size), (at, t, s, b, n)):
                into.append(np.broadcast_to(x, at.shape))

        n = np.arange(len(blocks))
        if lo == 0:
            diff = blocks[:, 0].copy()
            for c in np.unique(comp):
                mine = np.flatnonzero(comp == c)
                diff[mine] = np.diff(blocks[mine, 0], prepend=0)
            width, said = _widths(diff)
            add(n * 1024, 2 * of, width, said, width)
        if hi > 0:
            first = max(lo, 1)
            b, k = np.nonzero(blocks[:, first : hi + 1])
            k += first
            before = np.concatenate([[0], k[:-1]]) if len(k) else k
            fresh = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
            run = k - np.where(fresh, first - 1, before) - 1
            width, said = _widths(blocks[b, k])
            at = b * 1024 + k * 8 + 4
            add(at, 2 * of[b] + 1, (run & 15) << 4 | width, said, width)
            for long in range(1, 4):  # runs of sixteen zeros before it
                some = run >= 16 * long
                add(at[some] - long, 2 * of[b[some]] + 1, 0xF0, 0, 0)
            last = np.full(len(blocks), first - 1)
            np.maximum.at(last, b, k)
            short = n[last < hi]
            add(short * 1024 + 1023, 2 * of[short] + 1, 0, 0, 0)
        order = np.argsort(np.concatenate(place), kind="stable")
        self.table, self.symbol, self.bits, self.size = (np.concatenate(x).astype(np.int64)[order] for x in (table, symbol, bits, size))

    def tables(self) -> dict[int, tuple[bytes, bytes]]:
        """By number (twice the class, one more for all but means): the code lengths and symbols that suit the scan."""
        out = {}
        for t in np.unique(self.table).tolist():
            times = np.bincount(self.symbol[self.table == t], minlength=256)
            out[t] = _lengths(Counter({s: int(times[s]) for s in np.flatnonzero(times).tolist()}))
        return out

    def coded(self, tables: dict[int, tuple[bytes, bytes]]) -> bytes:
        code, length = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
        for t, made in tables.items():
            for s, (c, n) in _codes(*made).items():
                code[t, s], length[t, s] = c, n
        value = code[self.table, self.symbol] << self.size | self.bits
        long = length[self.table, self.symbol] + self.size
        ends = np.cumsum(long)
        total = int(ends[-1]) if len(ends) else 0
        bits = np.ones(total + -total % 8, np.uint8)
        step = 1 << 18
        for at in range(0, len(long), step):  # some codes at a time: each bit takes a few bytes here
            n, v, e = long[at : at + step], value[at : at + step], ends[at : at + step]
            which = np.repeat(np.arange(len(n)), n)
            start = int(e[0] - n[0])
            left = e[which] - (start + np.arange(len(which))) - 1
            bits[start : start + len(which)] = v[which] >> left & 1
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


#: The frequencies of the scans of a progressive picture after that of the means.
SPECTRA = [(1, 5), (6, 63)]


def encode(rgb: np.ndarray, quality: float = 80, icc: bytes | None = None, subsample: bool | None = None, progressive: bool = False) -> bytes:
    """YCbCr, 4:2:0 below quality 90 unless told otherwise; progressive: means first, then low and high frequencies of each component."""
    quality = min(100.0, max(1.0, float(quality)))
    half = quality < 90 if subsample is None else subsample
    h, w, _ = rgb.shape
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    if half:
        pad = lambda p: np.pad(p, ((0, h % 2), (0, w % 2)), mode="edge")
        planes[1:] = [pad(p).reshape((h + 1) // 2, 2, (w + 1) // 2, 2).mean((1, 3)) for p in planes[1:]]
    f = 2 if half else 1
    mx, my = -(-w // (8 * f)), -(-h // (8 * f))
    tables = [scaled_table(LUMA, quality), scaled_table(CHROMA, quality)]
    grids = [_blocks(planes[0], tables[0], my * f, mx * f), _blocks(planes[1], tables[1], my, mx), _blocks(planes[2], tables[1], my, mx)]
    # in units of f * f blocks of luma and one of each chroma
    units = [grids[0].reshape(my, f, mx, f, 64).transpose(0, 2, 1, 3, 4).reshape(my * mx, f * f, 64), *(x.reshape(my * mx, 1, 64) for x in grids[1:])]
    comp = np.tile(np.repeat(np.arange(3), [f * f, 1, 1]), my * mx)
    together = np.concatenate(units, axis=1).reshape(-1, 64)
    scans = [([0, 1, 2], 0, 0 if progressive else 63, Scan(together, np.minimum(comp, 1), comp, 0, 0 if progressive else 63))]
    for i, grid in enumerate(grids) if progressive else ():
        shape = planes[i].shape
        mine = grid[: -(-shape[0] // 8), : -(-shape[1] // 8)].reshape(-1, 64)
        for lo, hi in SPECTRA:
            scans.append(([i], lo, hi, Scan(mine, np.full(len(mine), min(i, 1)), np.full(len(mine), i), lo, hi)))
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xE2, p) for p in app2_parts(icc)] if icc else []
    out += [segment(0xDB, bytes([i]) + t[ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(tables)]
    out.append(segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, f << 4 | f, 0, 2, 0x11, 1, 3, 0x11, 1])))
    for comps, lo, hi, scan in scans:
        made = scan.tables()
        out += [segment(0xC4, bytes([(t & 1) << 4 | t >> 1]) + lengths + symbols) for t, (lengths, symbols) in made.items()]
        named = b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in comps)
        out += [segment(0xDA, bytes([len(comps)]) + named + bytes([lo, hi, 0])), scan.coded(made)]
    return b"".join(out) + b"\xff\xd9"
