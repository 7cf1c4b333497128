"""Pixel work on numpy arrays of (height, width, channels): resampling, light, alpha, colour, orientation, palettes. No Spark here."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(64)
def weights(source: int, target: int) -> np.ndarray:
    """(target, source) Lanczos windows, each row summing to one, in 32 bits like the sums that use them."""
    scale = source / target
    fs = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    at = np.arange(source)
    x = (at[None, :] + 0.5 - centre[:, None]) / fs
    w = np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    inside = (at[None, :] >= np.floor(centre - 3 * fs)[:, None]) & (at[None, :] < np.ceil(centre + 3 * fs)[:, None])
    w = np.where(inside, w, 0.0)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def resample(image: np.ndarray, width: int, height: int, most: float) -> np.ndarray:
    """Both axes, horizontal first; rounds half up and clamps to 0..most. Work is by windows, not by the whole of a line."""
    out = _along(image.astype(np.float32), width, 1)
    out = _along(out, height, 0)
    return np.clip(np.floor(out + 0.5), 0, most)


def _along(image: np.ndarray, target: int, axis: int) -> np.ndarray:
    source = image.shape[axis]
    if source == target:
        return image
    w = weights(source, target)
    moved = np.moveaxis(image, axis, 0)
    shape = moved.shape[1:]
    flat = np.ascontiguousarray(moved.reshape(source, -1))
    out = np.empty((target, flat.shape[1]), np.float32)
    step = max(1, 256 * target // max(source, 1))  # rows whose windows overlap share a product over their part of the source
    for a in range(0, target, step):
        b = min(target, a + step)
        there = np.flatnonzero(w[a:b].any(0))
        lo, hi = there[0], there[-1] + 1
        out[a:b] = w[a:b, lo:hi] @ flat[lo:hi]
    return np.moveaxis(out.reshape(target, *shape), 0, axis)


_S = np.arange(256) / 255.0
TO_LINEAR = np.floor(np.where(_S <= 0.04045, _S / 12.92, ((_S + 0.055) / 1.055) ** 2.4) * 65535 + 0.5).astype(np.uint16)
_L = np.arange(65536) / 65535.0
FROM_LINEAR = np.floor(np.where(_L <= 0.0031308, _L * 12.92, 1.055 * _L ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int, linear: bool = True) -> np.ndarray:
    """RGB or RGBA of 8 bits; in linear light or as stored; colours are weighted by alpha. The same size is the same pixels."""
    h, w, channels = image.shape
    if (w, h) == (width, height):
        return image.copy()
    alpha = image[..., 3:].astype(np.uint32)
    if linear:
        colour = TO_LINEAR[image[..., :3]].astype(np.uint32)
        if channels == 3:
            return FROM_LINEAR[resample(colour, width, height, 65535).astype(np.uint16)]
        both = np.concatenate([colour * (alpha * 257) // 65535, alpha * 257], axis=2)
        out = resample(both, width, height, 65535)
        a = out[..., 3:]
        colour = np.where(a > 0, np.clip(np.floor(out[..., :3] * 65535 / np.maximum(a, 1)), 0, 65535), 0)
        return np.concatenate([FROM_LINEAR[colour.astype(np.uint16)], (a // 257).astype(np.uint8)], axis=2)
    if channels == 3:
        return resample(image, width, height, 255).astype(np.uint8)
    both = np.concatenate([(image[..., :3].astype(np.uint32) * alpha + 127) // 255, alpha], axis=2)
    out = resample(both, width, height, 255).astype(np.uint32)
    a = out[..., 3:]
    colour = np.where(a > 0, np.minimum(out[..., :3] * 255 // np.maximum(a, 1), 255), 0)
    return np.concatenate([colour, a], axis=2).astype(np.uint8)


def flatten(image: np.ndarray, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """RGBA over a background, composed in linear light."""
    if image.shape[2] == 3:
        return image
    a = image[..., 3:].astype(np.uint32)
    back = TO_LINEAR[np.array(background, np.uint8)].astype(np.uint32)
    mixed = (TO_LINEAR[image[..., :3]].astype(np.uint32) * a + back * (255 - a) + 127) // 255
    return FROM_LINEAR[mixed]


def opaque(image: np.ndarray) -> bool:
    return image.shape[2] == 3 or bool((image[..., 3] == 255).all())


def expand_gray(image: np.ndarray) -> np.ndarray:
    """1 or 2 channels to 3 or 4."""
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    if image.shape[2] == 2:
        return np.concatenate([np.repeat(image[..., :1], 3, axis=2), image[..., 1:]], axis=2)
    return image


def cmyk_to_rgb(image: np.ndarray) -> np.ndarray:
    """Inverted samples: each colour times black."""
    k = image[..., 3:].astype(np.uint32)
    return ((image[..., :3].astype(np.uint32) * k + 127) // 255).astype(np.uint8)


def orient(image: np.ndarray, orientation: int) -> np.ndarray:
    """The stored frame as it is to be seen."""
    if orientation in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    flips = {1: (), 2: (1,), 3: (0, 1), 4: (0,), 5: (), 6: (1,), 7: (0, 1), 8: (0,)}[orientation]
    return np.ascontiguousarray(np.flip(image, flips))


def orientation_of(angle: int, mirror: int | None) -> int:
    """Of quarter turns against the clock and, after them, a mirror: 0 about the horizontal axis, 1 about the vertical one."""
    turn = {0: 1, 1: 8, 2: 3, 3: 6}[angle]
    return {None: turn, 1: {1: 2, 8: 7, 3: 4, 6: 5}[turn], 0: {1: 4, 8: 5, 3: 2, 6: 7}[turn]}[mirror]


# ---------------------------------------------------------------- luma and chroma


def to_yuv420(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full-range BT.601 planes of 10 bits, chroma of the mean of the pixels that a block has."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    y = ((1225 * r + 2404 * g + 467 * b) * 1023 + 522240) // 1044480
    h, w = y.shape
    pad = np.pad(rgb[..., :3].astype(float), ((0, h % 2), (0, w % 2), (0, 0)), constant_values=np.nan)
    mean = np.nanmean(pad.reshape((h + 1) // 2, 2, (w + 1) // 2, 2, 3), axis=(1, 3))
    luma = mean @ np.array([0.299, 0.587, 0.114])
    chroma = [np.clip(np.floor(d / 255 * 1023 + 512.5), 0, 1023) for d in ((mean[..., 2] - luma) / 1.772, (mean[..., 0] - luma) / 1.402)]
    return y.astype(np.uint16), chroma[0].astype(np.uint16), chroma[1].astype(np.uint16)


#: Kr and Kb by the code of the matrix; others count as BT.601.
MATRICES = {1: (0.2126, 0.0722), 9: (0.2627, 0.0593)}


def _twice(plane: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Twice the samples along an axis, three parts near and one part the next one outwards."""
    p = np.moveaxis(plane.astype(float), axis, 0)
    prev, after = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
    out = np.empty((2 * len(p), *p.shape[1:]))
    out[::2], out[1::2] = (3 * p + prev) / 4, (3 * p + after) / 4
    return np.moveaxis(out[:n], 0, axis)


def from_yuv(y: np.ndarray, cb: np.ndarray | None, cr: np.ndarray | None, depth: int = 10, matrix: int = 6, full: bool = True) -> np.ndarray:
    """RGB of 8 bits from planes of any sampling; without chroma, gray; matrix 0 is G, B, R."""
    top = (1 << depth) - 1
    unit = 1 << (depth - 8)
    yf = y / top if full else (y - 16.0 * unit) / (219 * unit)
    if cb is None:
        rgb = np.stack([yf] * 3, axis=2)
    else:
        h, w = y.shape
        planes = []
        for c in (cb, cr):
            c = _twice(c, h, 0) if c.shape[0] < h else c
            planes.append(_twice(c, w, 1) if c.shape[1] < w else c)
        if matrix == 0:
            u, v = ((c / top if full else (c - 16.0 * unit) / (219 * unit)) for c in planes)
            rgb = np.stack([v, yf, u], axis=2)
        else:
            kr, kb = MATRICES.get(matrix, (0.299, 0.114))
            half = 1 << (depth - 1)
            u, v = ((c - half) / (top if full else 224.0 * unit) for c in planes)
            r, b = yf + 2 * (1 - kr) * v, yf + 2 * (1 - kb) * u
            rgb = np.stack([r, (yf - kr * r - kb * b) / (1 - kr - kb), b], axis=2)
    return np.clip(np.floor(rgb * 255 + 0.5), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- palettes


def quantized(rgb: np.ndarray, colours: int, dither: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(palette, indices): boxes of a colour histogram of 5 bits per channel, cut where the variance falls most, then error diffusion."""
    colours = min(256, max(2, colours))
    flat = rgb.reshape(-1, 3)
    cell = (flat[:, 0].astype(np.int64) >> 3) << 10 | (flat[:, 1].astype(np.int64) >> 3) << 5 | flat[:, 2] >> 3
    n = np.bincount(cell, minlength=32768).astype(float)
    sums = [np.bincount(cell, flat[:, i], 32768) for i in range(3)]
    used = np.flatnonzero(n)
    n, mean = n[used], np.stack([s[used] for s in sums], 1) / n[used][:, None]
    boxes = [np.arange(len(used))]

    def best_cut(box):
        best = (0.0, None)
        if len(box) < 2:
            return best
        for axis in range(3):
            order = box[np.argsort(mean[box, axis], kind="stable")]
            w, m = np.cumsum(n[order]), np.cumsum(n[order][:, None] * mean[order], axis=0)
            left, right = w[:-1], w[-1] - w[:-1]
            gain = (m[:-1] ** 2).sum(1) / left + ((m[-1] - m[:-1]) ** 2).sum(1) / right - (m[-1] ** 2).sum() / w[-1]
            at = int(np.argmax(gain))
            if gain[at] > best[0] + 1e-9:
                best = (float(gain[at]), (order[: at + 1], order[at + 1 :]))
        return best

    cuts = [best_cut(boxes[0])]
    while len(boxes) < colours:
        i = max(range(len(boxes)), key=lambda j: cuts[j][0])
        if cuts[i][1] is None:
            break
        a, b = cuts[i][1]
        boxes[i], cuts[i] = a, best_cut(a)
        boxes.append(b)
        cuts.append(best_cut(b))
    palette = np.stack([np.floor((n[b][:, None] * mean[b]).sum(0) / n[b].sum() + 0.5) for b in boxes])
    grid = np.stack(np.meshgrid(*[np.arange(32) * 8 + 4] * 3, indexing="ij"), -1).reshape(-1, 3)
    nearest = np.empty(32768, np.int64)
    for a in range(0, 32768, 4096):
        nearest[a : a + 4096] = ((grid[a : a + 4096, None] - palette[None]) ** 2).sum(2).argmin(1)
    if not dither:
        return palette.astype(np.uint8), ((flat[:, None].astype(float) - palette[None]) ** 2).sum(2).argmin(1).reshape(rgb.shape[:2]).astype(np.uint8) if flat.size < 3_000_000 else nearest[cell].reshape(rgb.shape[:2]).astype(np.uint8)
    h, w, _ = rgb.shape
    out = np.zeros((h, w), np.uint8)
    below = np.zeros((w + 2, 3))
    pal = palette.tolist()
    for y in range(h):
        row, here = rgb[y].astype(float) + below[1:-1], np.zeros(3)
        below = np.zeros((w + 2, 3))
        line, right = row.tolist(), [0.0, 0.0, 0.0]
        for x in range(w):
            p = [min(255.0, max(0.0, line[x][i] + right[i])) for i in range(3)]
            k = nearest[int(p[0]) >> 3 << 10 | int(p[1]) >> 3 << 5 | int(p[2]) >> 3]
            out[y, x] = k
            e = [p[i] - pal[k][i] for i in range(3)]
            right = [v * 7 / 16 for v in e]
            for i in range(3):
                below[x, i] += e[i] * 3 / 16
                below[x + 1, i] += e[i] * 5 / 16
                below[x + 2, i] += e[i] / 16
    return palette.astype(np.uint8), out
