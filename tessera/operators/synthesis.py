"""Synthetic defects: noise, masks, corruption and pastes, seeded by row.

Every generator takes a NumPy generator; ``row_generator`` derives one from a row's key,
so results do not depend on partitioning. Blends are plain expressions (``blend``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import FALLBACK_FAMILIES


def row_generator(key, seed: int = 0) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def blend(image: Column, mask: Column, texture: Column, beta: Column | float) -> Column:
    """(1 - beta m) x + beta m t at each pixel."""
    both = F.arrays_zip(image.alias("x"), mask.alias("m"), texture.alias("t"))
    return F.transform(both, lambda p: (1 - beta * p["m"]) * p["x"] + beta * p["m"] * p["t"])


def ellipse(r: Column, c: Column, centre_r: float, centre_c: float, radius_r: float, radius_c: float, angle: float = 0.0) -> Column:
    """Whether a cell lies in an ellipse turned by ``angle``."""
    y, x = r - centre_r, c - centre_c
    u, v = x * float(np.cos(angle)) + y * float(np.sin(angle)), y * float(np.cos(angle)) - x * float(np.sin(angle))
    return (u * u) / (radius_c * radius_c) + (v * v) / (radius_r * radius_r) <= 1


def perlin(h: int, w: int, rows: int, columns: int, rng: np.random.Generator) -> np.ndarray:
    """Gradient noise on a lattice of ``rows`` x ``columns`` cells, with quintic fades, scaled by sqrt(2)."""
    angle = rng.uniform(0, 2 * np.pi, (rows + 1, columns + 1))
    y, x = np.arange(h) * rows / h, np.arange(w) * columns / w
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]

    def corner(dy: int, dx: int) -> np.ndarray:
        a = angle[np.ix_(y0 + dy, x0 + dx)]
        return np.cos(a) * (fx - dx) + np.sin(a) * (fy - dy)

    def fade(t: np.ndarray) -> np.ndarray:
        return t**3 * (t * (6 * t - 15) + 10)

    sx, sy = fade(fx), fade(fy)
    top = corner(0, 0) * (1 - sx) + corner(0, 1) * sx
    low = corner(1, 0) * (1 - sx) + corner(1, 1) * sx
    return np.sqrt(2) * (top * (1 - sy) + low * sy)


def fractal(h: int, w: int, cells: int, octaves: int, rng: np.random.Generator, persistence: float = 0.5) -> np.ndarray:
    return sum(persistence**k * perlin(h, w, cells * 2**k, cells * 2**k, rng) for k in range(octaves))


#: Octaves of each of the two scales of a noise mask.
OCTAVES = 3


def perlin_mask(h: int, w: int, rng: np.random.Generator) -> np.ndarray:
    """A 0/1 mask: a coarse and a fine scale of fractal noise in equal parts, above their 60th to 85th percentile, turned by quarters half of the time."""
    noise = sum(fractal(h, w, int(rng.choice(cells)), OCTAVES, rng) for cells in ((2, 4, 8), (8, 16))) / 2
    mask = (noise > np.percentile(noise, rng.uniform(60, 85))).astype(np.int8)
    return np.rot90(mask, int(rng.integers(1, 4))).copy() if h == w and rng.random() < 0.5 else mask


def _cubic(n: int, to: int) -> np.ndarray:
    """The matrix that brings ``n`` values to ``to`` by cubic convolution, the outer values on the outer places."""
    at = np.linspace(0, n - 1, to)
    low = np.floor(at).astype(int)
    out = np.zeros((to, n))
    for tap in range(-1, 3):
        d = np.abs(at - (low + tap))
        near, far = 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * (d**3 - 5 * d**2 + 8 * d - 4)
        np.add.at(out, (np.arange(to), np.clip(low + tap, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
    return out


def lattice_noise(batch: int, h: int, w: int, rng: np.random.Generator, octaves: int = 4) -> np.ndarray:
    """``batch`` noise maps at once: random lattices of 2, 4, 8, ... cells, brought to size and added up with halving weight."""
    total = np.zeros((batch, h, w))
    for k in range(octaves):
        cells = 2 ** (k + 1)
        lattice = rng.random((batch, cells + 1, cells + 1)) * 2 - 1
        total += 0.5**k * (_cubic(cells + 1, h) @ lattice @ _cubic(cells + 1, w).T)
    return total


def texture(h: int, w: int, rng: np.random.Generator, channels: int | None = None) -> np.ndarray:
    """A flat tone or a gradient of two tones, with a little noise; with ``channels`` a colour each and a last axis."""
    tones = rng.random((2, channels or 1))
    ramp = np.zeros((h, w))
    if rng.random() < 0.5:
        ramp[:] = np.linspace(0, 1, w) if rng.random() < 0.5 else np.linspace(0, 1, h)[:, None]
    out = tones[0] * (1 - ramp[..., None]) + tones[1] * ramp[..., None]
    out = np.clip(out + rng.normal(0, 0.03, out.shape), 0, 1)
    return out if channels else out[..., 0]


def blobs(h: int, w: int, rng: np.random.Generator, count: tuple[int, int] = (1, 3)) -> np.ndarray:
    """A 0/1 mask of one to three upright ellipses anywhere, 3 to 15 per cent of the sides in radius."""
    rr, cc = np.mgrid[0:h, 0:w]
    mask = np.zeros((h, w), dtype=np.int8)
    for _ in range(int(rng.integers(count[0], count[1] + 1))):
        cy, cx, ry, rx = rng.integers(0, h), rng.integers(0, w), h * rng.uniform(0.03, 0.15), w * rng.uniform(0.03, 0.15)
        mask |= (((rr - cy) / ry) ** 2 + ((cc - cx) / rx) ** 2 <= 1).astype(np.int8)
    return mask


def other_classes(images: DataFrame, cls, n: int = 256, seed: int = 0, key: str = "image_id") -> DataFrame:
    """At most ``n`` normal training images of all classes but ``cls``, drawn by hash: the pool that foreign textures come from."""
    pool = images.where((F.col("cls") != F.lit(cls)) & (F.col("split") == "train_good"))
    return pool.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


class TexturePool:
    """Images of one size to draw textures from; an empty pool gives noise."""

    def __init__(self, pool: DataFrame, h: int, w: int, data: str = "data"):
        rows = pool.select("h", "w", data).collect()  # bounded by ``other_classes``
        self.shape = h, w
        self.images = [_fit(np.asarray(r[data], dtype=float).reshape(r["h"], r["w"], -1), h, w) for r in rows]

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        """A pool image with its channels 0.7 to 1.3 times as bright, mirrored and turned upside down at random: (h, w, channels)."""
        if not self.images:
            return rng.random((*self.shape, 1))
        image = self.images[int(rng.integers(len(self.images)))]
        image = np.clip(image * rng.uniform(0.7, 1.3, image.shape[2]), 0, 1)
        image = image[:, ::-1] if rng.random() < 0.5 else image
        return image[::-1] if rng.random() < 0.5 else image


def _fit(image: np.ndarray, h: int, w: int) -> np.ndarray:
    from tessera.operators.scoring import stretch

    return np.einsum("yr,rck,xc->yxk", stretch(image.shape[0], h), image, stretch(image.shape[1], w))


def corruption(image: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """An image with a texture blended in under a noise mask, and the mask."""
    mask = perlin_mask(*image.shape, rng)
    beta = rng.uniform(0.15, 1.0)
    return (1 - beta * mask) * image + beta * mask * texture(*image.shape, rng), mask


def cut_paste(image: np.ndarray, rng: np.random.Generator, area=(0.02, 0.15), aspect=(0.3, 3.3), jitter: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """A rectangle of the image, jittered in brightness, pasted elsewhere; and the mask of the paste."""
    h, w = image.shape
    size, ratio = rng.uniform(*area) * h * w, np.exp(rng.uniform(*np.log(aspect)))
    ph, pw = int(np.clip(round((size * ratio) ** 0.5), 1, h)), int(np.clip(round((size / ratio) ** 0.5), 1, w))
    y, x, ty, tx = (int(rng.integers(0, n + 1)) for n in (h - ph, w - pw, h - ph, w - pw))
    out, mask = image.copy(), np.zeros((h, w), dtype=np.int8)
    out[ty : ty + ph, tx : tx + pw] = np.clip(image[y : y + ph, x : x + pw] * rng.uniform(1 - jitter, 1 + jitter), 0, 1)
    mask[ty : ty + ph, tx : tx + pw] = 1
    return out, mask


def scar(image: np.ndarray, rng: np.random.Generator, width=(10, 25), height=(2, 16), jitter: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """A thin strip, turned by up to 45 degrees and pasted without its padding; a strip that does not fit leaves the image as it is."""
    h, w = image.shape
    sw, sh = int(rng.integers(width[0], width[1] + 1)), int(rng.integers(height[0], height[1] + 1))
    mask = np.zeros((h, w), dtype=np.int8)
    if sw > w or sh > h:
        return image, mask
    y, x = int(rng.integers(0, h - sh + 1)), int(rng.integers(0, w - sw + 1))
    strip = np.clip(image[y : y + sh, x : x + sw] * rng.uniform(1 - jitter, 1 + jitter), 0, 1)
    angle = np.deg2rad(rng.uniform(-45, 45))
    cy, cx = rng.uniform(0, h), rng.uniform(0, w)
    rr, cc = np.mgrid[0:h, 0:w]
    u = (cc - cx) * np.cos(angle) + (rr - cy) * np.sin(angle) + sw / 2
    v = (rr - cy) * np.cos(angle) - (cc - cx) * np.sin(angle) + sh / 2
    inside = (u >= 0) & (u < sw) & (v >= 0) & (v < sh)
    out = image.copy()
    out[inside] = strip[v[inside].astype(int), u[inside].astype(int)]
    mask[inside] = 1
    return out, mask


def _disks(h: int, w: int, rng: np.random.Generator, count: tuple[int, int], radius: tuple[float, float]) -> np.ndarray:
    rr, cc = np.mgrid[0:h, 0:w]
    mask = np.zeros((h, w), dtype=bool)
    for _ in range(int(rng.integers(*count))):
        cy, cx, r = rng.uniform(0, h), rng.uniform(0, w), rng.uniform(*radius) * min(h, w)
        mask |= (rr - cy) ** 2 + (cc - cx) ** 2 <= r * r
    return mask


def _path(h: int, w: int, rng: np.random.Generator, steps: int, turn: float, thick: float) -> np.ndarray:
    """A walk across the grid with random turns, drawn with some thickness."""
    rr, cc = np.mgrid[0:h, 0:w]
    mask = np.zeros((h, w), dtype=bool)
    y, x, angle = rng.uniform(0, h), rng.uniform(0, w), rng.uniform(0, 2 * np.pi)
    for _ in range(steps):
        mask |= (rr - y) ** 2 + (cc - x) ** 2 <= thick * thick
        angle += rng.normal(0, turn)
        y, x = y + np.sin(angle), x + np.cos(angle)
    return mask


def _blob(h: int, w: int, rng: np.random.Generator, radius: tuple[float, float]) -> np.ndarray:
    rr, cc = np.mgrid[0:h, 0:w]
    cy, cx = rng.uniform(0.2, 0.8) * h, rng.uniform(0.2, 0.8) * w
    ry, rx = (max(1.0, rng.uniform(*radius) * n) for n in (h, w))
    t = rng.uniform(0, np.pi)
    u, v = (cc - cx) * np.cos(t) + (rr - cy) * np.sin(t), (rr - cy) * np.cos(t) - (cc - cx) * np.sin(t)
    return (u / rx) ** 2 + (v / ry) ** 2 <= 1


#: Each family's shape: (h, w, rng) -> boolean mask.
SHAPES = {
    "scratch": lambda h, w, g: _path(h, w, g, max(h, w) // 2, 0.05, max(0.7, 0.01 * min(h, w))),
    "crack": lambda h, w, g: _path(h, w, g, max(h, w) // 2, 0.6, max(0.7, 0.008 * min(h, w))),
    "dent": lambda h, w, g: _blob(h, w, g, (0.06, 0.18)),
    "bulge": lambda h, w, g: _blob(h, w, g, (0.06, 0.18)),
    "stain": lambda h, w, g: _blob(h, w, g, (0.1, 0.25)) & (perlin(h, w, 4, 4, g) > -0.2),
    "fragment": lambda h, w, g: _blob(h, w, g, (0.08, 0.2)) & (perlin(h, w, 4, 4, g) > 0),
    "mold": lambda h, w, g: _disks(h, w, g, (6, 20), (0.01, 0.05)),
    "contamination": lambda h, w, g: _disks(h, w, g, (3, 10), (0.01, 0.04)),
}

#: Each family's paint: (image, soft mask, rng) -> image.
PAINTS = {
    "scratch": lambda x, m, g: x * (1 - m) + m * g.choice([0.1, 0.9]),
    "crack": lambda x, m, g: x * (1 - m) + m * g.uniform(0, 0.2),
    "dent": lambda x, m, g: x * (1 - m * g.uniform(0.2, 0.5)),
    "bulge": lambda x, m, g: x + (1 - x) * m * g.uniform(0.2, 0.5),
    "stain": lambda x, m, g: x * (1 - 0.6 * m) + 0.6 * m * x * g.uniform(0.3, 0.7),
    "fragment": lambda x, m, g: x * (1 - m) + m * np.clip(g.uniform(0.2, 0.8) + g.normal(0, 0.1, x.shape), 0, 1),
    "mold": lambda x, m, g: x * (1 - 0.8 * m) + 0.8 * m * np.clip(0.7 + g.normal(0, 0.1, x.shape), 0, 1),
    "contamination": lambda x, m, g: x * (1 - m) + m * g.uniform(0, 0.3),
}


def inject(image: np.ndarray, families: list[str], rng: np.random.Generator, count=(1, 3), least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """One to three defects of the families painted over each other, and the union of their masks; tiny shapes are left out."""
    out, union = image.copy(), np.zeros(image.shape, dtype=np.int8)
    for _ in range(int(rng.integers(count[0], count[1] + 1))):
        family = families[int(rng.integers(len(families)))]
        mask = SHAPES[family](*image.shape, rng)
        if mask.sum() < least:
            continue
        out = np.clip(PAINTS[family](out, mask.astype(float), rng), 0, 1)
        union |= mask.astype(np.int8)
    return out, union


def defect_families(known: list[str] | None, fallback: tuple[str, ...] = FALLBACK_FAMILIES) -> list[str]:
    """The families to draw from: the known ones that have a shape, all of them if none has, the fallback without any."""
    if not known:
        return list(fallback)
    return [f for f in known if f in SHAPES] or list(SHAPES)


def synthesise(images: DataFrame, kind: str, key: str = "image_id", seed: int = 0, families: list[str] | None = None) -> DataFrame:
    """``key, h, w, clean, corrupt, mask`` for each image; ``kind`` is corruption, cutpaste, scar or defects."""
    makers = {"corruption": corruption, "cutpaste": cut_paste, "scar": scar, "defects": lambda x, g: inject(x, defect_families(families), g)}
    if kind not in makers:
        raise ValueError(f"unknown kind {kind}; known: {sorted(makers)}")
    maker = makers[kind]

    def make(batches):
        for rows in batches:
            out = []
            for k, h, w, data in zip(rows[key], rows["h"], rows["w"], rows["data"], strict=True):
                image = np.asarray(data, dtype=float).reshape(int(h), int(w))
                made, mask = maker(image, row_generator(k, seed))
                out.append((k, h, w, image.ravel(), made.ravel(), mask.ravel().astype(np.int32)))
            yield pd.DataFrame(out, columns=[key, "h", "w", "clean", "corrupt", "mask"])

    kinds = dict(images.dtypes)
    return images.select(key, "h", "w", "data").mapInPandas(make, f"{key} {kinds[key]}, h int, w int, clean array<double>, corrupt array<double>, mask array<int>")
