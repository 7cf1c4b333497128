"""The image transformation: bytes in, bytes out, one row each; what goes wrong is a value of the row.

Plans are columns where the source's header can be read natively; pixels go through numpy in Arrow batches of a bounded number of bytes. Identical
requests should be coalesced first (operators.coalesce), and large sources spread by their estimated cost (spread()).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import containers, jpeg, png
from ..errors import RowError, classify, undecodable
from ..kernels import raster

UNBOUNDED = 4294967295


@dataclass(frozen=True)
class Config:
    """Engine options with their defaults; validate() is strict, lenient() falls back to the defaults."""

    resize: str = "linear"
    auto_rotate: bool = True
    icc: bool = True
    flatten_bg: tuple[int, int, int] = (255, 255, 255)
    png_effort: str | None = None
    png_quantize: bool = False
    png_quantize_colors: int = 256
    quality: float = 80.0
    webp_quality: float = 75.0
    avif_quality: int = 55
    avif_alpha_quality: int | None = None
    max_source_bytes: int = 64 << 20
    max_src_pixels: int = 64_000_000
    max_decoded_bytes: int | None = None
    log_decoded_bytes_above: int | None = None
    dct_margin: float | None = None
    jpeg_progressive: bool = True
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    RANGES = {  # noqa: RUF012
        "resize": {"linear", "srgb"}, "png_effort": {None, *png.EFFORT}, "png_quantize_colors": (2, 256), "quality": (1, 100), "webp_quality": (0, 100), "avif_quality": (0, 100),
        "avif_alpha_quality": (0, 100), "max_source_bytes": (1, 1 << 62), "max_src_pixels": (1, 1 << 62), "max_decoded_bytes": (1 << 20, 1 << 62), "log_decoded_bytes_above": (1, 1 << 62), "dct_margin": (1.0, 8.0),
    }

    def faults(self) -> list[str]:
        out = []
        for name, allowed in self.RANGES.items():
            value = getattr(self, name)
            if isinstance(allowed, set):
                if value not in allowed:
                    out.append(f"{name}: {value!r} is not one of {sorted(map(str, allowed))}")
            elif value is not None and not (isinstance(value, (int, float)) and not isinstance(value, bool) and allowed[0] <= value <= allowed[1]):
                out.append(f"{name}: {value!r} is not within {allowed[0]}..{allowed[1]}")
        return out

    def validate(self) -> Config:
        if faults := self.faults():
            raise ValueError("; ".join(faults))
        return self

    @classmethod
    def lenient(cls, **options) -> Config:
        """Values out of range are as if they had not been given."""
        known = {k: v for k, v in options.items() if k in cls.__dataclass_fields__}
        bad = {f.split(":")[0] for f in cls(**known).faults()}
        return cls(**{k: v for k, v in known.items() if k not in bad})


def parse_colour(said: str) -> tuple[int, int, int] | None:
    """RRGGBB, with or without a mark before it."""
    said = said.removeprefix("#")
    try:
        return tuple(bytes.fromhex(said)) if len(said) == 6 else None
    except ValueError:
        return None


def sniff(content: bytes) -> str:
    if len(content) >= 12:
        if content.startswith(b"\xff\xd8"):
            return "jpeg"
        if content.startswith(png.SIGNATURE):
            return "png"
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            return "webp"
        if content[4:12] in (b"ftypavif", b"ftypavis"):
            return "avif"
    raise undecodable("unrecognised image format")


def probe(content: bytes) -> dict:
    """format, stored width and height, orientation, icc, and what the cost needs; no pixels."""
    fmt = sniff(content)
    out = {"format": fmt, "orientation": 1, "icc": None, "channels": 3, "progressive": False, "components": 3}
    if fmt == "png":
        head, meta = png.header(content), png.metadata(content)
        out |= {"width": head["width"], "height": head["height"], "icc": meta["icc"], "orientation": containers.exif_orientation(meta["exif"]) or 1, "channels": 4 if head["colour"] in (3, 4, 6) else 3}
    elif fmt == "jpeg":
        meta = containers.jpeg_metadata(content)
        if meta["width"] is None:
            raise undecodable("JPEG has no frame header")
        out |= {"width": meta["width"], "height": meta["height"], "icc": meta["icc"], "orientation": meta["orientation"] or 1, "progressive": meta["progressive"], "components": meta["components"], "channels": 4 if meta["components"] == 4 else 3}
    elif fmt == "webp":
        head, meta = containers.webp_header(content), containers.webp_metadata(content)
        out |= {"width": head["width"], "height": head["height"], "icc": meta["icc"], "orientation": containers.exif_orientation(meta["exif"]) or 1, "channels": 4 if head["alpha"] else 3}
    else:
        head = containers.avif_header(content)
        out |= {"width": head["width"], "height": head["height"], "icc": head["icc"], "orientation": head["orientation"], "channels": 4}
    return out


def fit(w: int, h: int, box_w: int, box_h: int) -> tuple[int, int]:
    scale = min(box_w / w, box_h / h, 1.0)
    return tuple(max(1, int(np.floor(d * scale + 0.5))) for d in (w, h))


def estimate(found: dict, out_w: int, out_h: int, held: int, linear: bool) -> dict:
    full = found["width"] * found["height"] * found["channels"]
    return {
        "staged": full, "resize_input": 2 * full if linear else 0, "output": 3 * out_w * out_h * found["channels"],
        "whole_source": 2 * found["width"] * found["height"] * found["components"] if found["progressive"] else 0,
        "compressed": held if found["format"] == "jpeg" else 2 * held,
    }


#: Formats that an encoder is there for.
WRITTEN = ("jpeg", "png")


def eighths(w: int, h: int, dst_w: int, dst_h: int, margin: float | None) -> int:
    """At how many eighths of its size a JPEG is decoded: the fewest that still reach margin times the target; without a margin all."""
    enough = lambda k, src, dst: -(-src * k // 8) >= min(math.ceil(dst * margin), src)
    return 8 if margin is None else next((k for k in range(1, 8) if enough(k, w, dst_w) and enough(k, h, dst_h)), 8)


def decode(content: bytes, fmt: str, scale: int = 8) -> np.ndarray:
    if fmt == "png":
        return png.decode(content)
    if fmt == "jpeg":
        return jpeg.decode(content, scale)
    raise undecodable(f"{fmt} support is not enabled")


def encode(image: np.ndarray, fmt: str, config: Config, quality: float | None = None, icc: bytes | None = None) -> bytes:
    if fmt == "jpeg":
        return jpeg.encode(raster.flatten(image, config.flatten_bg), config.quality if quality is None else quality, icc, progressive=config.jpeg_progressive)
    if fmt == "png":
        quantize = config.png_quantize and raster.opaque(image)
        effort = config.png_effort or ("balanced" if config.png_quantize else "fast")
        if quantize:
            palette, indices = raster.quantized(image[..., :3], config.png_quantize_colors)
            return png.encode(indices, icc, effort, palette)
        return png.encode(image, icc, effort)
    raise undecodable(f"{fmt} support is not enabled")


def process(content: bytes, max_width: int = 0, max_height: int = 0, output: str | None = None, quality: float | None = None, config: Config = Config()) -> dict:  # noqa: B008
    """One image. Zero axes have no bound; without an output format the source's own is kept. Raises RowError. note: the terms of an estimate above log_decoded_bytes_above."""
    if len(content) > config.max_source_bytes:
        raise RowError("SourceTooLarge", "source image too large", f"{len(content)} bytes")
    found = probe(content)
    fmt = output or found["format"]
    box = [d or UNBOUNDED for d in (max_width, max_height)]
    if fmt == "webp":
        box = [min(d, 16383) for d in box]
    orientation = found["orientation"] if config.auto_rotate else 1
    shown = (found["height"], found["width"]) if orientation >= 5 else (found["width"], found["height"])
    out_w, out_h = fit(*shown, *box)
    if found["width"] * found["height"] > config.max_src_pixels:
        raise RowError("SourceTooLarge", "source image too large", f"{found['width']}x{found['height']} pixels")
    terms = estimate(found, out_w, out_h, len(content), config.resize == "linear")
    if config.max_decoded_bytes is not None and sum(terms.values()) > config.max_decoded_bytes:
        raise RowError("SourceTooLarge", "source image too large", " ".join(f"{k}={v}" for k, v in terms.items()))
    if fmt not in WRITTEN:  # before any pixel is touched
        raise undecodable(f"{fmt} support is not enabled")
    stored = (out_h, out_w) if orientation >= 5 else (out_w, out_h)
    image = decode(content, found["format"], eighths(found["width"], found["height"], *stored, config.dct_margin))
    icc = found["icc"] if config.icc and found["channels"] != 4 or config.icc and found["format"] == "png" else None
    try:
        image = raster.orient(raster.resize(image, *stored, linear=config.resize == "linear"), orientation)
        data = encode(image, fmt, config, quality, icc)
    except RowError:
        raise
    except Exception as e:  # the source was read: what fails now is the engine's own fault
        raise RowError("Internal", "internal image-processing error", repr(e)) from e
    over = config.log_decoded_bytes_above
    note = " ".join(f"{k}={v}" for k, v in terms.items()) if over is not None and sum(terms.values()) > over else None
    return {"format": fmt, "width": out_w, "height": out_h, "orientation": orientation, "cost": terms, "data": data, "note": note, "error": None}


COST = pa.struct([(n, pa.int64()) for n in ("staged", "resize_input", "output", "whole_source", "compressed")])
RESULT = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("cost", COST), ("data", pa.binary()), ("note", pa.string()), ("error", pa.struct([("kind", pa.string()), ("message", pa.string()), ("detail", pa.string())]))])
RESULT_DDL = "struct<format: string, width: int, height: int, orientation: int, cost: struct<staged: long, resize_input: long, output: long, whole_source: long, compressed: long>, data: binary, note: string, error: struct<kind: string, message: string, detail: string>>"
BLANK = {"format": None, "width": None, "height": None, "orientation": None, "cost": None, "data": None, "note": None}


def _one(row: dict, config: Config) -> dict:
    try:
        if row.get("content") is None:
            raise RowError("SourceNotFound", "image not found")
        return process(row["content"], row.get("max_width") or 0, row.get("max_height") or 0, row.get("output"), row.get("quality"), config)
    except Exception as e:  # whatever a decoder does is this row's error
        return BLANK | {"error": classify(e).as_dict()}


def transform(df: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """df (content and, if there, max_width, max_height, output, quality) with a column `result`; content is dropped, every other column stays."""
    config.validate()
    kept = [c for c in df.columns if c != "content"]
    used = [c for c in ("content", "max_width", "max_height", "output", "quality") if c in df.columns]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 8):  # a few images at a time
                part = batch.slice(at, 8)
                out = [_one(r, config) for r in part.select(used).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(out, RESULT)], names=[*kept, "result"])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"result {RESULT_DDL}"])
    return df.mapInArrow(run, schema)


PROBE = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("icc_bytes", pa.int32()), ("error", pa.string())])


def look(content: bytes | None) -> dict:
    """What probe() finds, or the error."""
    try:
        p = probe(content or b"")
        return {"format": p["format"], "width": p["width"], "height": p["height"], "orientation": p["orientation"], "icc_bytes": len(p["icc"] or b""), "error": None}
    except Exception as e:
        return {"error": classify(e).message}


def probed(df: DataFrame) -> DataFrame:
    """df with a column `probe`: format, stored size, orientation, size of the profile, or an error; content is dropped."""
    kept = [c for c in df.columns if c != "content"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array([look(c.as_py()) for c in batch["content"]], PROBE)], names=[*kept, "probe"])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + ["probe struct<format: string, width: int, height: int, orientation: int, icc_bytes: int, error: string>"])
    return df.mapInArrow(run, schema)


def spread(df: DataFrame, n: int, length: str = "length") -> DataFrame:
    """Rows dealt out at random within classes of source size, so that no partition gets all the large ones."""
    return df.repartition(n, F.floor(F.log2(F.col(length) + 1)), F.floor(F.rand(7) * n))
