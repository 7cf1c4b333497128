"""Colour arithmetic on columns of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_linear(s: Column) -> Column:
    """sRGB 0..255 to linear light 0..65535."""
    v = s / 255.0
    return F.floor(F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))) * 65535 + 0.5).cast("long")


def from_linear(v: Column) -> Column:
    """Linear light 0..65535 to sRGB 0..255."""
    l = v / 65535.0  # noqa: E741
    return F.floor(F.when(l <= 0.0031308, l * 12.92).otherwise(1.055 * F.pow(l, F.lit(1 / 2.4)) - 0.055) * 255 + 0.5).cast("long")


def div(a: Column, b) -> Column:
    """Integer division of numbers that are not negative."""
    return F.floor(a / b).cast("long") if not isinstance(b, int) else ((a - a % b) / b).cast("long")


def flattened(c: Column, a: Column, background: Column) -> Column:
    """A sample under alpha a over a background, composed in linear light."""
    mixed = div(to_linear(c) * a + to_linear(background) * (255 - a) + 127, 255)
    return from_linear(mixed)


def premultiplied(c: Column, a: Column) -> Column:
    return div(c * a + 127, 255)


def unpremultiplied(c: Column, a: Column) -> Column:
    """Nothing under alpha 0."""
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(F.least(F.floor(F.try_divide(c * 255, a)), F.lit(255)).cast("long"))


def cmyk_naive(c: Column, k: Column) -> Column:
    """A channel of inverted samples."""
    return div(c * k + 127, 255)


def luma10(r: Column, g: Column, b: Column) -> Column:
    return div((1225 * r + 2404 * g + 467 * b) * 1023 + 522240, 1044480)


def chroma10(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Cb and Cr of mean samples 0..255, full range, 10 bits, before rounding."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = (b - y) / 1.772, (r - y) / 1.402
    return tuple(F.greatest(F.least(F.floor(v / 255.0 * 1023 + 512 + 0.5), F.lit(1023)), F.lit(0)).cast("long") for v in (cb, cr))


def yuv_to_rgb(y: Column, cb: Column, cr: Column, kr: float = 0.299, kb: float = 0.114) -> tuple[Column, Column, Column]:
    """8 bits of 10-bit full-range samples."""
    yf, u, v = y / 1023.0, (cb - 512) / 1023.0, (cr - 512) / 1023.0
    r, b = yf + 2 * (1 - kr) * v, yf + 2 * (1 - kb) * u
    g = (yf - kr * r - kb * b) / (1 - kr - kb)
    return tuple(F.greatest(F.least(F.floor(x * 255 + 0.5), F.lit(255)), F.lit(0)).cast("long") for x in (r, g, b))


def quality_to_qp(q: Column) -> Column:
    return div((100 - q) * 63 + 50, 100)


def alpha10(a: Column) -> Column:
    return div(a * 1023 + 128, 255)
