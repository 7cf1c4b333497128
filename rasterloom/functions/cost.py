"""The memory that a transformation is expected to take, and the limits on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The defaults of the limits.
MAX_SRC_PIXELS = 64_000_000
MAX_SOURCE_BYTES = 64 << 20
MAX_ICC_BYTES = 4 << 20
MAX_SCAN_BYTES = 1 << 20
LARGEST = (1 << 63) - 1
DECODED_BOUNDS = [1 << i for i in range(20, 33)]


def saturating(*factors: Column) -> Column:
    """A product that stops at the largest long."""
    out = factors[0].cast("decimal(19,0)")
    for f in factors[1:]:
        out = F.least((out * f.cast("decimal(10,0)")).cast("decimal(38,0)"), F.lit(LARGEST).cast("decimal(38,0)")).cast("decimal(19,0)")
    return out.cast("long")


def channels(fmt: Column, color: Column) -> Column:
    """color: gray, graya, rgb, rgba, palette or cmyk."""
    four = ((fmt == "png") & color.isin("rgba", "graya", "palette")) | ((fmt == "webp") & color.isin("rgba", "graya")) | (fmt == "avif") | ((fmt == "jpeg") & (color == "cmyk"))
    return F.when(four, 4).otherwise(3)


def terms(w: Column, h: Column, ch: Column, out_w: Column, out_h: Column, *, linear: Column, progressive: Column, components: Column, srcbuf: Column, held: Column, fmt: Column) -> dict[str, Column]:
    """staged, resize_input, output, whole_source, compressed."""
    full = saturating(w, h, ch)
    return {
        "staged": full,
        "resize_input": F.when(linear, saturating(w, h, ch, F.lit(2))).otherwise(F.lit(0).cast("long")),
        "output": saturating(out_w, out_h, ch, F.lit(3)),
        "whole_source": F.when(progressive, saturating(w, h, components, F.lit(2))).otherwise(F.lit(0).cast("long")),
        "compressed": F.when(fmt == "jpeg", held).otherwise(srcbuf + held).cast("long"),
    }


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0).cast("decimal(38,0)")
    for c in parts.values():
        out = out + c.cast("decimal(20,0)")
    return F.least(out, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def too_many_pixels(w: Column, h: Column, cap: int = MAX_SRC_PIXELS) -> Column:
    return saturating(w, h) > cap


def report(parts: dict[str, Column], sum_: Column, cap: Column) -> Column:
    """Names all five terms and the limit."""
    said = [F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in parts.items()]
    return F.concat_ws(" ", F.concat(F.lit("estimate="), sum_.cast("string")), F.concat(F.lit("limit="), cap.cast("string")), *said)
