"""Operations on row-major maps held as array columns.

Every expression takes the array with its height and width and stays in the JVM; no map
is exploded and nothing is shuffled. ``numpy_stencil`` does the windowed ones in Arrow
batches, which is faster for large windows and gives the same values.

Borders reflect half-sample symmetrically: d c b a | a b c d | d c b a.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let, total


def _grid(n: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), f)


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("int")


def reflect(i: Column, n: Column) -> Column:
    """The place inside 0..n-1 that a place outside reflects to."""
    turn = F.pmod(i, 2 * n)
    return F.when(turn < n, turn).otherwise(2 * n - 1 - turn)


def resize_nearest(data: Column, h: Column, w: Column, to_h: int, to_w: int) -> Column:
    return _grid(F.lit(to_h * to_w), lambda p: F.get(data, _div(_div(p, to_w) * h, to_h) * w + _div((p % to_w) * w, to_w)))


def resize_bilinear(data: Column, h: Column, w: Column, to_h: int, to_w: int) -> Column:
    """Half-pixel centres, coordinates clamped to the map."""

    def at(p: Column) -> Column:
        y = F.greatest(F.lit(0.0), F.least((_div(p, to_w) + 0.5) * h / to_h - 0.5, h - 1.0))
        x = F.greatest(F.lit(0.0), F.least((p % to_w + 0.5) * w / to_w - 0.5, w - 1.0))
        y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
        y1, x1 = F.least(y0 + 1, h - 1), F.least(x0 + 1, w - 1)
        fy, fx = y - y0, x - x0
        top = F.get(data, y0 * w + x0) * (1 - fx) + F.get(data, y0 * w + x1) * fx
        low = F.get(data, y1 * w + x0) * (1 - fx) + F.get(data, y1 * w + x1) * fx
        return top * (1 - fy) + low * fy

    return _grid(F.lit(to_h * to_w), at)


def _along(data: Column, h: Column, w: Column, offsets: list[int], weights: list[float], rows: bool) -> Column:
    """A weighted sum over reflected neighbours down the columns (``rows``) or along the rows."""

    def at(p: Column) -> Column:
        r, c = _div(p, w), p % w
        terms = [F.get(data, (reflect(r + o, h) * w + c) if rows else (r * w + reflect(c + o, w))) * k for o, k in zip(offsets, weights, strict=True)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return _grid(h * w, at)


def _both(data: Column, h: Column, w: Column, offsets: list[int], weights: list[float]) -> Column:
    return let(let(data, lambda d: _along(d, h, w, offsets, weights, True)), lambda d: _along(d, h, w, offsets, weights, False))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> tuple[list[int], list[float]]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    return list(range(-radius, radius + 1)), [x / sum(raw) for x in raw]


def _window(size: int) -> list[int]:
    return list(range(-(size // 2), size - size // 2))


def gaussian(data: Column, h: Column, w: Column, sigma: float = 1.5) -> Column:
    """Gaussian smoothing, unchanged for sigma <= 0."""
    return data if sigma <= 0 else _both(data, h, w, *gaussian_weights(sigma))


def window_mean(data: Column, h: Column, w: Column, size: int = 7) -> Column:
    return _both(data, h, w, _window(size), [1.0 / size] * size)


def window_std(data: Column, h: Column, w: Column, size: int = 7) -> Column:
    centre = window_mean(data, h, w, size)
    square = window_mean(F.transform(data, lambda x: x * x), h, w, size)
    return F.zip_with(square, centre, lambda s, m: F.sqrt(F.greatest(s - m * m, F.lit(0.0))))


def window_max(data: Column, h: Column, w: Column, size: int = 7) -> Column:
    def along(values: Column, rows: bool) -> Column:
        def at(p: Column) -> Column:
            r, c = _div(p, w), p % w
            return F.greatest(*[F.get(values, (reflect(r + o, h) * w + c) if rows else (r * w + reflect(c + o, w))) for o in _window(size)])

        return _grid(h * w, at)

    return let(let(data, lambda d: along(d, True)), lambda d: along(d, False))


def gradient(data: Column, h: Column, w: Column) -> Column:
    """Magnitude of the two Sobel responses."""
    steps, blur = ([-1, 1], [-1.0, 1.0]), ([-1, 0, 1], [1.0, 2.0, 1.0])
    down = let(let(data, lambda d: _along(d, h, w, *steps, True)), lambda d: _along(d, h, w, *blur, False))
    across = let(let(data, lambda d: _along(d, h, w, *steps, False)), lambda d: _along(d, h, w, *blur, True))
    return F.zip_with(down, across, lambda a, b: F.sqrt(a * a + b * b))


def laplacian(data: Column, h: Column, w: Column) -> Column:
    second = ([-1, 0, 1], [1.0, -2.0, 1.0])
    return F.zip_with(_along(data, h, w, *second, True), _along(data, h, w, *second, False), lambda a, b: a + b)


def numpy_stencil(kind: str, size: float):
    """A vectorised function (data, h, w) -> data for ``gaussian`` (sigma, unchanged for 0), ``mean``, ``max`` or ``std`` (window size), ``gradient`` or ``laplacian``."""
    if kind == "gaussian":
        offsets, weights = gaussian_weights(size) if size > 0 else ([0], [1.0])
    else:
        offsets = _window(int(size)) or [0]
        weights = [1.0 / len(offsets)] * len(offsets)

    def along(x: np.ndarray, axis: int, offsets: list[int], combine) -> np.ndarray:
        n = x.shape[axis]
        places = [np.mod(np.arange(n) + o, 2 * n) for o in offsets]
        return combine([np.take(x, np.where(p < n, p, 2 * n - 1 - p), axis) for p in places])

    def summed(x: np.ndarray, axis: int, offsets: list[int], weights: list[float]) -> np.ndarray:
        return along(x, axis, offsets, lambda parts: sum(k * p for k, p in zip(weights, parts, strict=True)))

    def smooth(x: np.ndarray) -> np.ndarray:
        return summed(summed(x, 0, offsets, weights), 1, offsets, weights)

    def one(data: np.ndarray, h: int, w: int) -> np.ndarray:
        m = np.asarray(data, dtype=float).reshape(h, w)
        if kind == "max":
            return along(along(m, 0, offsets, np.maximum.reduce), 1, offsets, np.maximum.reduce).ravel()
        if kind == "std":
            return np.sqrt(np.maximum(smooth(m * m) - smooth(m) ** 2, 0)).ravel()
        if kind == "gradient":
            slopes = [summed(summed(m, axis, [-1, 1], [-1.0, 1.0]), 1 - axis, [-1, 0, 1], [1.0, 2.0, 1.0]) for axis in (0, 1)]
            return np.sqrt(slopes[0] ** 2 + slopes[1] ** 2).ravel()
        if kind == "laplacian":
            return sum(summed(m, axis, [-1, 0, 1], [1.0, -2.0, 1.0]) for axis in (0, 1)).ravel()
        return smooth(m).ravel()

    @F.pandas_udf("array<double>")
    def stencil(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else one(d, int(a), int(b)) for d, a, b in zip(data, h, w, strict=True)], dtype=object)

    return stencil


def flip_rows(data: Column, h: Column, w: Column) -> Column:
    """The map upside down."""
    return _grid(h * w, lambda p: F.get(data, (h - 1 - _div(p, w)) * w + p % w))


def flip_columns(data: Column, h: Column, w: Column) -> Column:
    """The map mirrored left to right."""
    return _grid(h * w, lambda p: F.get(data, _div(p, w) * w + (w - 1 - p % w)))


def rotate(data: Column, h: Column, w: Column, quarters: int) -> Column:
    """The map turned counter-clockwise by quarter turns."""
    quarters %= 4
    if quarters == 0:
        return data
    if quarters == 2:
        return F.reverse(data)
    if quarters == 1:  # out[r, c] = in[c, w - 1 - r], h x w becomes w x h
        return _grid(h * w, lambda p: F.get(data, (p % h) * w + (w - 1 - _div(p, h))))
    return _grid(h * w, lambda p: F.get(data, (h - 1 - p % h) * w + _div(p, h)))


TTA = {"none": [(0, False)], "hflip": [(0, False), (0, True)], "vflip": [(0, False), (2, True)], "hvflip": [(0, False), (0, True), (2, True)], "d4": [(q, f) for q in range(4) for f in (False, True)]}


def _with(f, *more):
    return lambda d: f(d, *more)


def tta(data: Column, h: Column, w: Column, mode: str, scorer) -> Column:
    """The mean over a mode's transforms of the scores, each turned back; ``scorer(data, h, w)`` gives a map of the same shape.

    A transform is a mirror image (optional) after quarter turns; two quarter turns and a mirror image turn the map upside down.
    """
    if mode not in TTA:
        raise ValueError(f"unknown mode {mode}; known: {sorted(TTA)}")
    passes = []
    for quarters, mirrored in TTA[mode]:
        th, tw = (w, h) if quarters % 2 else (h, w)
        seen = let(data, _with(rotate, h, w, quarters))
        seen = let(seen, _with(flip_columns, th, tw)) if mirrored else seen
        scored = let(seen, _with(scorer, th, tw))
        back = let(scored, _with(flip_columns, th, tw)) if mirrored else scored
        passes.append(let(back, _with(rotate, th, tw, -quarters % 4)))
    out = passes[0]
    for p in passes[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return F.transform(out, lambda x: x / len(passes))


def average_pool(data: Column, h: Column, w: Column, size: int = 3) -> Column:
    """Mean of each pixel's window with zeros beyond the border, which count."""
    reach = range(-(size // 2), size // 2 + 1)

    def at(p: Column) -> Column:
        r, c = _div(p, w), p % w
        out = F.lit(0.0)
        for a in reach:
            for b in reach:
                inside = (r + a >= 0) & (r + a < h) & (c + b >= 0) & (c + b < w)
                out = out + F.when(inside, F.get(data, (r + a) * w + c + b)).otherwise(0.0)
        return out / (size * size)

    return _grid(h * w, at)


def patchify(layers: list[Column], h: Column, w: Column, size: int = 3) -> Column:
    """An array of unit vectors, one for each pixel: the pooled value of every layer (maps of one shape)."""
    from tessera.functions.arrays import unit

    pooled = F.arrays_zip(*[average_pool(m, h, w, size).alias(f"l{i}") for i, m in enumerate(layers)])
    return F.transform(pooled, lambda x: unit(F.array(*[x[f"l{i}"] for i in range(len(layers))])))


def valid_windows(data: Column, h: Column, w: Column, size: int) -> Column:
    """Means of all whole windows, stride one: a map of (h - size + 1) x (w - size + 1)."""

    def at(p: Column) -> Column:
        r, c = _div(p, w - size + 1), p % (w - size + 1)
        terms = [F.get(data, (r + a) * w + c + b) for a in range(size) for b in range(size)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out / (size * size)

    return _grid((h - size + 1) * (w - size + 1), at)


def pool_blocks(data: Column, h: Column, w: Column, rows: int, columns: int) -> Column:
    """Adaptive average pooling to ``rows`` x ``columns`` cells."""

    def cell(p: Column) -> Column:
        r, c = _div(p, columns), p % columns
        top, low = _div(r * h, rows), F.ceil((r + 1) * h / rows).cast("int")
        left, right = _div(c * w, columns), F.ceil((c + 1) * w / columns).cast("int")
        inside = F.flatten(F.transform(F.sequence(top, low - 1), lambda y: F.slice(data, y * w + left + 1, right - left)))
        return total(inside) / F.size(inside)

    return _grid(F.lit(rows * columns), cell)
