"""Metadata and containers: TIFF orientation, JPEG segments, RIFF, ISO base media files. Bytes only, no pixels."""

from __future__ import annotations

import struct

from ..errors import undecodable
from ..kernels.raster import orientation_of

#: Limits of what is looked at.
MAX_IFD_ENTRIES = 512
MAX_SCAN = 1 << 20
MAX_ICC = 4 << 20
APP2_PART = 65519


def tiff_orientation(data: bytes) -> int | None:
    """Tag 0x0112 of the first directory, if it is one SHORT of 1 to 8; of a longer directory the first MAX_IFD_ENTRIES entries are looked at."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        return None
    count = struct.unpack(order + "H", data[at : at + 2])[0]
    for i in range(min(count, MAX_IFD_ENTRIES)):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            return None
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if tag == 0x0112:
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if kind == 3 and n == 1 and 1 <= value <= 8 else None
    return None


def exif_orientation(payload: bytes | None, prefixed: bool = False) -> int | None:
    """prefixed: the Exif header must be there, as in JPEG; elsewhere it may be."""
    if payload is None:
        return None
    if payload.startswith(b"Exif\0\0"):
        return tiff_orientation(payload[6:])
    return None if prefixed else tiff_orientation(payload)


def icc_from_parts(parts: list[tuple[int, int, bytes]]) -> bytes | None:
    """The profile of (number from 1, count, data) if all agree and none is missing or twice; any fault spoils it."""
    if not parts:
        return None
    count = parts[0][1]
    if any(n != count for _, n, _ in parts) or sorted(i for i, _, _ in parts) != list(range(1, count + 1)):
        return None
    out = b"".join(d for _, _, d in sorted(parts))
    return out if len(out) <= MAX_ICC else None


def jpeg_segments(data: bytes, most: int | None = None):
    """(marker, payload, place after it) up to the first scan; fill bytes and stand-alone markers are passed over."""
    if data[:2] != b"\xff\xd8":
        raise undecodable("not a JPEG")
    at, end = 2, len(data) if most is None else min(len(data), most)
    while at + 2 <= end:
        if data[at] != 0xFF:
            return
        while at + 1 < end and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1] if at + 1 < len(data) else 0xD9
        at += 2
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if marker == 0xD9 or at + 2 > end:
            return
        size = struct.unpack(">H", data[at : at + 2])[0]
        if size < 2 or at + size > end:
            return
        yield marker, data[at + 2 : at + size], at + size
        if marker == 0xDA:
            return
        at += size


def jpeg_metadata(data: bytes) -> dict:
    """orientation, icc, progressive, width, height, components, adobe of the header; the first Exif segment counts."""
    out: dict = {"orientation": None, "icc": None, "progressive": False, "width": None, "height": None, "components": None, "adobe": None}
    exif_seen, parts, broken = False, [], False
    for marker, body, _ in jpeg_segments(data, MAX_SCAN):
        if marker == 0xE1 and body.startswith(b"Exif\0\0") and not exif_seen:
            exif_seen, out["orientation"] = True, exif_orientation(body, True)
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0") and len(body) >= 14:
            parts.append((body[12], body[13], body[14:]))
        elif marker == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
            out["adobe"] = body[11]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            out["progressive"] = marker == 0xC2
            out["height"], out["width"], out["components"] = struct.unpack(">HHB", body[1:6])
    out["icc"] = None if broken else icc_from_parts(parts)
    return out


def app2_parts(icc: bytes) -> list[bytes]:
    count = -(-len(icc) // APP2_PART)
    return [b"ICC_PROFILE\0" + bytes([i + 1, count]) + icc[i * APP2_PART : (i + 1) * APP2_PART] for i in range(count)] if count <= 255 else []


# ---------------------------------------------------------------- RIFF


def riff_chunks(data: bytes):
    """(name, payload) of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise undecodable("not a WebP")
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack("<4sI", data[at : at + 8])
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def webp_header(data: bytes) -> dict:
    """width, height, alpha, animated."""
    for name, body in riff_chunks(data):
        if name == b"VP8X" and len(body) >= 10:
            return {"width": 1 + int.from_bytes(body[4:7], "little"), "height": 1 + int.from_bytes(body[7:10], "little"), "alpha": bool(body[0] & 0x10), "animated": bool(body[0] & 2)}
        if name == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
            bits = int.from_bytes(body[1:5], "little")
            return {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF), "alpha": bool(bits >> 28 & 1), "animated": False}
        if name == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", body[6:10])
            return {"width": w & 0x3FFF, "height": h & 0x3FFF, "alpha": False, "animated": False}
        break
    raise undecodable("WebP header is invalid")


def webp_metadata(data: bytes) -> dict:
    found = dict(riff_chunks(data))
    return {"exif": found.get(b"EXIF"), "icc": found.get(b"ICCP")}


def webp_first_frame(data: bytes) -> bytes | None:
    """The bitstream of an animation's first frame, if it covers the canvas and stands at its corner."""
    head = webp_header(data)
    for name, body in riff_chunks(data):
        if name == b"ANMF" and len(body) >= 16:
            x, y, w, h = (int.from_bytes(body[i : i + 3], "little") for i in (0, 3, 6, 9))
            return body[16:] if (x, y, w + 1, h + 1) == (0, 0, head["width"], head["height"]) else None
    return None


def webp_with_icc(data: bytes, icc: bytes) -> bytes:
    """The same picture in an extended container with a profile."""
    head = webp_header(data)
    rest = [(n, b) for n, b in riff_chunks(data) if n not in (b"VP8X", b"ICCP")]
    flags = 0x20 | (0x10 if head["alpha"] else 0) | (2 if head["animated"] else 0)
    canvas = bytes([flags, 0, 0, 0]) + (head["width"] - 1).to_bytes(3, "little") + (head["height"] - 1).to_bytes(3, "little")
    body = b"WEBP" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for n, b in [(b"VP8X", canvas), (b"ICCP", icc), *rest])
    return b"RIFF" + struct.pack("<I", len(body)) + body


# ---------------------------------------------------------------- ISO base media


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """(type, body start, body end): sizes of 32 or 64 bits, or up to the end."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _find(data: bytes, path: list[bytes], start: int = 0, end: int | None = None) -> tuple[int, int] | None:
    for kind, a, b in boxes(data, start, end):
        if kind == path[0]:
            if kind == b"meta":
                a += 4
            return (a, b) if len(path) == 1 else _find(data, path[1:], a, b)
    return None


def avif_items(data: bytes) -> dict:
    """primary item, its properties as (type, body) in order, and where items lie."""
    if data[4:8] != b"ftyp":
        raise undecodable("not an AVIF")
    meta = _find(data, [b"meta"])
    if meta is None:
        raise undecodable("AVIF has no metadata")
    at = _find(data, [b"pitm"], *meta)
    if at is None:
        raise undecodable("AVIF has no primary item")
    primary = int.from_bytes(data[at[0] + 4 : at[0] + (6 if data[at[0]] == 0 else 8)], "big")
    ipco, ipma = _find(data, [b"iprp", b"ipco"], *meta), _find(data, [b"iprp", b"ipma"], *meta)
    properties = [(k, data[a:b]) for k, a, b in list(boxes(data, *ipco))[:1024]] if ipco else []
    mine = []
    if ipma:
        a, b = ipma
        version, wide = data[a], data[a + 3] & 1
        count, a = int.from_bytes(data[a + 4 : a + 8], "big"), a + 8
        for _ in range(min(count, 64)):
            n = 2 if version < 1 else 4
            item, links = int.from_bytes(data[a : a + n], "big"), data[a + n]
            a += n + 1
            for _ in range(links):
                index = int.from_bytes(data[a : a + 1 + wide], "big") & (0x7FFF if wide else 0x7F)
                a += 1 + wide
                if item == primary and 1 <= index <= len(properties):
                    mine.append(properties[index - 1])
            if a > b:
                break
    return {"primary": primary, "properties": mine, "sequence": data[8:12] == b"avis" or b"avis" in data[16 : int.from_bytes(data[:4], "big")]}


def avif_header(data: bytes) -> dict:
    """width, height, orientation, icc."""
    out: dict = {"width": None, "height": None, "orientation": 1, "icc": None}
    angle, mirror = 0, None
    mirrored_first = False
    for kind, body in avif_items(data)["properties"]:
        if kind == b"ispe" and len(body) >= 12:
            out["width"], out["height"] = struct.unpack(">II", body[4:12])
        elif kind == b"irot" and body:
            angle = body[0] & 3
            mirrored_first = mirror is not None
        elif kind == b"imir" and body:
            mirror = body[0] & 1
        elif kind == b"colr" and body[:4] in (b"prof", b"ricc"):
            out["icc"] = body[4:] if len(body) - 4 <= MAX_ICC else None
    if out["width"] is None:
        raise undecodable("AVIF has no size")
    out["orientation"] = orientation_of((4 - angle) & 3 if mirrored_first else angle, mirror)
    return out
