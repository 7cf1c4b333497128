"""PNG, read and written whole."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import undecodable
from ..kernels.raster import expand_gray

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Adam7: first column, first row, column step, row step of each pass (fixed values).
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: zlib level and whether filters are tried, by effort.
EFFORT = {"fastest": (1, False), "fast": (3, True), "balanced": (6, True), "high": (9, True)}


def chunks(data: bytes):
    """(type, payload) up to IEND."""
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            raise undecodable("PNG is cut off")
        yield kind, data[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return
        at += 12 + size


def header(data: bytes) -> dict:
    if not data.startswith(SIGNATURE) or len(data) < 33 or data[12:16] != b"IHDR":
        raise undecodable("not a PNG")
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or not w or not h:
        raise undecodable("PNG header is invalid")
    return {"width": w, "height": h, "depth": depth, "colour": colour, "interlaced": bool(interlaced)}


def metadata(data: bytes) -> dict:
    """exif and icc, of chunks before the pixels only."""
    found: dict = {"exif": None, "icc": None}
    for kind, body in chunks(data):
        if kind == b"IDAT":
            break
        if kind == b"eXIf":
            found["exif"] = body
        elif kind == b"iCCP":
            _, _, rest = body.partition(b"\0")
            try:
                found["icc"] = zlib.decompress(rest[1:])
            except zlib.error:
                found["icc"] = None
    return found


def _unfiltered(raw: bytes, at: int, w: int, h: int, bits: int) -> tuple[np.ndarray, int]:
    """Rows of one pass as bytes, and where the next one starts."""
    line, unit = (w * bits + 7) // 8, max(1, bits // 8)
    if at + h * (line + 1) > len(raw):
        raise undecodable("PNG has too few pixels")
    rows = np.frombuffer(raw, np.uint8, h * (line + 1), at).reshape(h, line + 1)
    out = np.zeros((h, line), np.uint8)
    above = np.zeros(line, np.uint8)
    for y in range(h):
        kind, x = rows[y, 0], rows[y, 1:]
        if kind == 0:
            here = x.copy()
        elif kind == 1:
            pad = np.zeros(-(-line // unit) * unit, np.uint8)
            pad[:line] = x
            here = np.cumsum(pad.reshape(-1, unit), axis=0, dtype=np.uint8).reshape(-1)[:line]
        elif kind == 2:
            here = x + above
        elif kind in (3, 4):
            a, b, here = bytearray(unit) + bytearray(line), bytes(unit) + above.tobytes(), x.tolist()
            if kind == 3:
                for i in range(line):
                    a[i + unit] = (here[i] + ((a[i] + b[i + unit]) >> 1)) & 255
            else:
                for i in range(line):
                    left, up, corner = a[i], b[i + unit], b[i]
                    p, q, r = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    a[i + unit] = (here[i] + (left if p <= q and p <= r else up if q <= r else corner)) & 255
            here = np.frombuffer(bytes(a[unit:]), np.uint8)
        else:
            raise undecodable("PNG filter is unknown")
        out[y] = above = here
    return out, at + h * (line + 1)


def _samples(rows: np.ndarray, w: int, depth: int, per: int) -> np.ndarray:
    """(h, w, per) samples, those under 8 bits as they are, those of 16 cut to 8."""
    h = len(rows)
    if depth == 16:
        return rows.reshape(h, w, per, 2)[..., 0], rows.reshape(h, w, per, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        out = rows.reshape(h, w, per)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        out = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]
    return out, out


def decode(data: bytes) -> np.ndarray:
    """RGB or RGBA of 8 bits."""
    head = header(data)
    w, h, depth, colour = head["width"], head["height"], head["depth"], head["colour"]
    palette = transparent = None
    packed = []
    for kind, body in chunks(data):
        if kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            transparent = body
        elif kind == b"IDAT":
            packed.append(body)
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise undecodable("PNG pixels are damaged") from e
    per = SAMPLES[colour]
    full, exact = np.zeros((h, w, per), np.uint8), np.zeros((h, w, per), np.uint16)
    at = 0
    for x0, y0, dx, dy in PASSES if head["interlaced"] else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            rows, at = _unfiltered(raw, at, pw, ph, per * depth)
            full[y0::dy, x0::dx], exact[y0::dy, x0::dx] = _samples(rows, pw, depth, per)
    if colour == 3:
        if palette is None or full.max(initial=0) >= len(palette):
            raise undecodable("PNG palette is missing or too short")
        rgb = palette[full[..., 0]]
        if transparent is None:
            return rgb
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(transparent)] = np.frombuffer(transparent[:256], np.uint8)
        return np.concatenate([rgb, alpha[full]], axis=2)
    if depth < 8:
        full = (full.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour in (0, 2) and transparent is not None and len(transparent) >= 2 * per:
        key = np.frombuffer(transparent[: 2 * per], ">u2")
        alpha = np.where((exact == key).all(axis=2), 0, 255).astype(np.uint8)[..., None]
        full = np.concatenate([full, alpha], axis=2)
    return expand_gray(full)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(image: np.ndarray, tried: bool) -> bytes:
    """Rows with none, or of none, left, up, average and Paeth the one with the least sum of differences."""
    h, w, unit = image.shape
    x = image.reshape(h, -1)
    if not tried:
        return np.concatenate([np.zeros((h, 1), np.uint8), x], axis=1).tobytes()
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, unit:], up[1:], corner[1:, unit:] = x[:, :-unit], x[:-1], x[:-1, :-unit]
    a, b, c = left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)
    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    paeth = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c)).astype(np.uint8)
    every = np.stack([x, x - left, x - up, x - ((a + b) >> 1).astype(np.uint8), x - paeth])
    best = np.abs(every.view(np.int8).astype(np.int32)).sum(2).argmin(0)
    return np.concatenate([best[:, None].astype(np.uint8), every[best, np.arange(h)]], axis=1).tobytes()


def encode(image: np.ndarray, icc: bytes | None = None, effort: str = "fast", palette: np.ndarray | None = None) -> bytes:
    """RGB or RGBA; with a palette, image is (h, w) of indices."""
    level, tried = EFFORT[effort]
    h, w = image.shape[:2]
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3 if palette is not None else 2 if image.shape[2] == 3 else 6, 0, 0, 0))]
    if icc:
        out.append(_chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc)))
    if palette is not None:
        out.append(_chunk(b"PLTE", palette.tobytes()))
        image, tried = image[..., None], False
    out += [_chunk(b"IDAT", zlib.compress(_filtered(np.ascontiguousarray(image), tried), level)), _chunk(b"IEND", b"")]
    return b"".join(out)
