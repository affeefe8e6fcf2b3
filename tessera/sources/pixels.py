"""Image files into pixel arrays: a decoder for PNG, BMP and PNM files, resizing, and masks.

Files are read by Spark's ``binaryFile`` reader and decoded in Arrow batches, one file at
a time. Other formats need a ``decode`` of the caller's: bytes to an array (height, width,
channels) of whole numbers 0 to 255.

Defined results: a file that is missing or can't be decoded gives null pixels and the
reason in ``error``; an image without a mask has a mask of zeros.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per-channel mean and deviation that pretrained backbones expect, and the weights of grey.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
GREY = (0.299, 0.587, 0.114)
# Fixed values of the PNG format: channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: np.ndarray, rows: int, step: int) -> np.ndarray:
    """Rows of a PNG, each of which begins with the number of its filter."""
    lines = raw.reshape(rows, -1)
    out = np.zeros((rows, lines.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(out.shape[1], dtype=np.uint8)
    for k, line in enumerate(lines):
        kind, x = line[0], line[1:]
        if kind == 0:
            out[k] = x
        elif kind == 1:
            out[k] = np.add.accumulate(x.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[k] = x + above
        elif kind in (3, 4):
            out[k] = _left_to_right(x.reshape(-1, step).astype(int), above.reshape(-1, step).astype(int), kind).ravel()
        else:
            raise ValueError(f"filter {kind} is not known")
        above = out[k]
    return out


def _left_to_right(x: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """The two filters that look at the pixel before: the mean, and the nearest of three neighbours."""
    out = np.zeros_like(x)
    left, corner = np.zeros(x.shape[1], dtype=int), np.zeros(x.shape[1], dtype=int)
    for i in range(len(x)):
        up = above[i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            base = left + up - corner
            a, b, c = abs(base - left), abs(base - up), abs(base - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[i] = left = (x[i] + guess) % 256
        corner = up
    return out


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, header = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None:
        raise ValueError("the header is missing")
    w, h, bits, colour, _, _, laced = header
    if bits not in (8, 16) or laced or colour not in CHANNELS:
        raise ValueError(f"{bits} bits, colour type {colour}, interlace {laced} are not known")
    step = CHANNELS[colour] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)
    pixels = _unfilter(raw[: h * (w * step + 1)], h, step).reshape(h, w, step)
    pixels = pixels[..., ::2] if bits == 16 else pixels
    if colour == 3:
        pixels = palette[pixels[..., 0]]
    return pixels[..., :-1] if colour in (4, 6) else pixels


def _bmp(data: bytes) -> np.ndarray:
    offset, _, w, h, _, bits, scheme = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (24, 32) or scheme:
        raise ValueError(f"{bits} bits, compression {scheme} are not known")
    step, line = bits // 8, (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=abs(h) * line, offset=offset).reshape(abs(h), line)
    pixels = rows[:, : w * step].reshape(abs(h), w, step)[..., 2::-1]
    return pixels[::-1] if h > 0 else pixels


def _pnm(data: bytes) -> np.ndarray:
    found = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not found or int(found[4]) > 255:
        raise ValueError("this PNM file is not known")
    w, h, channels = int(found[2]), int(found[3]), 3 if found[1] == b"6" else 1
    return np.frombuffer(data, dtype=np.uint8, count=w * h * channels, offset=found.end()).reshape(h, w, channels)


def decode_image(data: bytes) -> np.ndarray:
    """The pixels of a PNG, BMP or binary PNM file: (height, width, 1 or 3), 0 to 255."""
    readers = {b"\x89PNG\r\n\x1a\n": _png, b"BM": _bmp, b"P5": _pnm, b"P6": _pnm}
    for magic, read in readers.items():
        if data.startswith(magic):
            return read(data)
    raise ValueError("the format is not known")


def spread(n: int, to: int) -> np.ndarray:
    """The matrix that brings ``n`` pixels to ``to``: triangles as wide as the step, so that shrinking averages."""
    scale = n / to
    reach = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale - 0.5
    weights = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / reach)
    return weights / weights.sum(1, keepdims=True)


def prepared(pixels: np.ndarray, size: int, normalise: bool = True) -> np.ndarray:
    """Pixels as (3, size, size) in [0, 1], or in deviations from the backbones' mean."""
    colour = (pixels if pixels.shape[2] == 3 else pixels[..., :1].repeat(3, axis=2)) / 255.0
    fitted = np.einsum("yr,rck,xc->kyx", spread(colour.shape[0], size), colour, spread(colour.shape[1], size))
    return (fitted - np.array(MEAN)[:, None, None]) / np.array(DEVIATION)[:, None, None] if normalise else fitted


def prepared_mask(pixels: np.ndarray, size: int, threshold: int = 127) -> np.ndarray:
    """0/1 of (size, size): grey above the threshold, brought to size by nearest neighbour so that no label is a fraction."""
    grey = pixels @ np.array(GREY) if pixels.shape[2] == 3 else pixels[..., 0].astype(float)
    y, x = (((np.arange(size) + 0.5) * n / size).astype(int) for n in grey.shape)
    return (np.floor(grey[np.ix_(y, x)] + 0.5) > threshold).astype(np.int8)


LOADED = "h int, w int, data array<float>, mask array<tinyint>, error string"


def load(images: DataFrame, size: int, masks: bool = True, normalise: bool = True, decode: Callable[[bytes], np.ndarray] = decode_image) -> DataFrame:
    """``images`` (with ``path`` and ``mask_path``) with the columns of ``LOADED``: pixels by channel, row and column, and the mask.

    The files' contents are joined by path, so listing and decoding are Spark's and no task
    holds more than a batch of files.
    """
    spark = images.sparkSession
    paths = [r[0] for r in images.select(F.regexp_replace("path", "/[^/]*$", "")).union(images.where("mask_path is not null").select(F.regexp_replace("mask_path", "/[^/]*$", ""))).distinct().collect()]  # folders
    if not paths:
        return images.select("*", *[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in LOADED.split(", ")])
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("_file"), "content")
    held = images.join(files.withColumnsRenamed({"_file": "path", "content": "_image"}), "path", "left")
    masked = files.withColumnsRenamed({"_file": "mask_path", "content": "_mask"})
    held = held.join(masked, "mask_path", "left") if masks else held.withColumn("_mask", F.lit(None).cast("binary"))

    def one(image: bytes | None, mask: bytes | None, named: bool) -> tuple:
        try:
            if image is None:
                raise ValueError("the file is missing")
            if named and mask is None:
                raise ValueError("the mask is missing")
            data = prepared(decode(bytes(image)), size, normalise).astype(np.float32).ravel()
            flat = prepared_mask(decode(bytes(mask)), size).ravel() if mask is not None else np.zeros(size * size, dtype=np.int8)
        except (ValueError, IndexError, struct.error, zlib.error) as why:
            return None, None, None, None, str(why)
        return size, size, data, flat, None

    @F.pandas_udf(f"struct<{LOADED.replace(' ', ':').replace(',:', ',')}>")
    def decoded(image: pd.Series, mask: pd.Series, named: pd.Series) -> pd.DataFrame:
        rows = [one(a, b, c) for a, b, c in zip(image, mask, named, strict=True)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in LOADED.split(", ")]).astype({"h": "Int32", "w": "Int32"})

    wanted = F.col("mask_path").isNotNull() if masks else F.lit(False)
    return held.withColumn("_loaded", decoded("_image", "_mask", wanted)).select(*images.columns, "_loaded.*")


def in_batches(loaded: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, batch: int = 8, key: str = "path") -> DataFrame:
    """``f(images, masks, keys)`` over batches of at most ``batch`` loaded images; keys say which row each image is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for top in range(0, len(rows), batch):
                part = rows.iloc[top : top + batch]
                h, w = int(part["h"].iloc[0]), int(part["w"].iloc[0])
                yield f(np.stack(part["data"].to_numpy()).reshape(len(part), 3, h, w), np.stack(part["mask"].to_numpy()).reshape(len(part), h, w), part[key].to_numpy())

    return loaded.where("error is null").select(key, "h", "w", "data", "mask").mapInPandas(run, schema)
