"""Connected regions of a score map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def label_regions(hot: np.ndarray) -> np.ndarray:
    """4-connected regions of a boolean map, numbered from 1; 0 is background.

    Labels spread as minima along rows and columns until nothing changes, with pointer
    jumps, so the rounds grow with the logarithm of a region's extent.
    """
    h, w = hot.shape
    if not hot.size:
        return np.zeros((h, w), dtype=np.int64)
    far = h * w
    root = np.where(hot, np.arange(far).reshape(h, w), far)
    while True:
        least = root.copy()
        least[1:] = np.minimum(least[1:], root[:-1])
        least[:-1] = np.minimum(least[:-1], root[1:])
        least[:, 1:] = np.minimum(least[:, 1:], root[:, :-1])
        least[:, :-1] = np.minimum(least[:, :-1], root[:, 1:])
        least[~hot] = far
        table = np.append(np.arange(far), far)
        np.minimum.at(table, root[hot], least[hot])
        while True:
            jumped = table[table]
            if (jumped == table).all():
                break
            table = jumped
        new = table[least]
        if (new == root).all():
            break
        root = new
    out = np.zeros((h, w), dtype=np.int64)
    if hot.any():
        out[hot] = np.unique(root[hot], return_inverse=True)[1] + 1
    return out


def suppress_small(data: np.ndarray, h: int, w: int, min_size: int, pct: float = 99.0, fill: float = 0.0) -> np.ndarray:
    """A map whose hot regions (at or above its own percentile) of at most ``min_size`` pixels are filled."""
    data = np.asarray(data, dtype=float)
    if min_size <= 0 or not data.size:
        return data
    grid = data.reshape(h, w).copy()
    labels = label_regions(grid >= np.percentile(grid, pct))
    sizes = np.bincount(labels.ravel())
    small = sizes <= min_size
    small[0] = False
    grid[small[labels]] = fill
    return grid.ravel()


def suppress_small_components(data: Column, h: Column, w: Column, min_size: int, pct: float = 99.0, fill: float = 0.0) -> Column:
    """``suppress_small`` over Arrow batches."""

    @F.pandas_udf("array<double>")
    def cleaned(maps: pd.Series, hs: pd.Series, ws: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else suppress_small(m, int(a), int(b), min_size, pct, fill) for m, a, b in zip(maps, hs, ws, strict=True)], dtype=object)

    return cleaned(data, h, w)


def parse_sizes(spec: str, families: list[str], default: int = 6) -> dict[str, int]:
    """Least sizes by family: ``"6"`` for all, or ``"a=8,b=4"`` with 0 (nothing goes) for those not named; an empty text gives the default to all."""
    text = (spec or "").strip()
    if "=" not in text:
        if text and not text.lstrip("+-").isdigit():
            raise ValueError(f"{spec!r} is neither a whole number nor family=size pairs")
        return dict.fromkeys(families, int(text) if text else default)
    pairs = {name.strip(): int(size) for name, _, size in (item.partition("=") for item in text.split(",") if item.strip())}
    if pairs.keys() - set(families):
        raise ValueError(f"unknown families {sorted(pairs.keys() - set(families))}; known: {families}")
    return dict.fromkeys(families, 0) | pairs
