"""Where a source of some size ends up in a box: fits, decode scales, ceilings; all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNBOUNDED = 4294967295
MOST_DIM = 8192
WEBP_DIM = 16383


def bounded(dim: Column) -> Column:
    """A zero axis has no bound."""
    return F.when(dim == 0, F.lit(UNBOUNDED)).otherwise(dim.cast("long"))


def valid_dims(width: Column, height: Column) -> Column:
    return ~(((width == 0) & (height == 0)) | (width > MOST_DIM) | (height > MOST_DIM))


def ceiling(box: Column, fmt: Column) -> Column:
    """WebP holds 16383 per axis."""
    return F.when(fmt == "webp", F.least(box, F.lit(WEBP_DIM).cast("long"))).otherwise(box)


def fit(w: Column, h: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    """Within the box, never larger, at least one pixel; halves round away from zero."""
    scale = F.least(box_w.cast("double") / w, box_h.cast("double") / h, F.lit(1.0))
    return tuple(F.greatest(F.round(d * scale), F.lit(1.0)).cast("long") for d in (w, h))


def swaps(orientation: Column) -> Column:
    return orientation >= 5


def display(w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    return F.when(swaps(orientation), h).otherwise(w), F.when(swaps(orientation), w).otherwise(h)


def oriented_fit(w: Column, h: Column, orientation: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    """The shown frame is what fits; the target comes back in stored axes."""
    shown = fit(*display(w, h, orientation), box_w, box_h)
    return display(*shown, orientation)


def larger_fit(w: Column, h: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    """The larger of the fits as stored and turned, in stored axes; ties: as stored."""
    a, b = fit(w, h, box_w, box_h), fit(h, w, box_w, box_h)
    stored = a[0] * a[1] >= b[0] * b[1]
    return F.when(stored, a[0]).otherwise(b[1]), F.when(stored, a[1]).otherwise(b[0])


def dct_numerator(w: Column, h: Column, dst_w: Column, dst_h: Column, margin: Column) -> Column:
    """Eighths at which a JPEG is decoded: the fewest that still reach margin times the target, or all; no margin: all."""

    def enough(k):
        def axis(src, dst):
            size = F.ceil(src * k / 8.0)
            return (size >= F.ceil(dst * margin)) | (size >= src)

        return axis(w, dst_w) & axis(h, dst_h)

    return F.when(margin.isNull(), 8).otherwise(F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(8)), enough)), F.lit(8)))


def webp_scale(w: Column, h: Column, dst_w: Column, dst_h: Column, margin: Column) -> tuple[Column, Column]:
    need = F.ceil(dst_w * margin)
    scaled = need < w
    return (
        F.when(scaled, F.greatest(need, dst_w)).otherwise(w).cast("long"),
        F.when(scaled, F.greatest(F.round(h * need.cast("double") / w), dst_h.cast("double"))).otherwise(h).cast("long"),
    )
