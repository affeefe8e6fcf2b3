"""TIFF media columns: write, walk and decode image files, one row per page.

The reader walks the chain of image directories in either byte order and decodes
strips and tiles that are stored raw, PackBits, LZW or deflate, with or without the
horizontal predictor, for 8- and 16-bit samples in chunky or planar order. A file
that is cut short, loops or names an unknown scheme (predictor 3, 64-bit offsets) gives
its pages so far and the reason in ``error``; nothing is raised on the executors.

Defined results: a null or empty file gives no page from ``pages_of`` and one row
with ``page`` null from ``read_pages``. Repeated rows give repeated results. Every
other column of the input, whatever its name, is left alone because only the named
columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
RAW, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257


class Page(NamedTuple):
    """One decoded image: ``samples`` has the shape (height, width, samples per pixel)."""

    width: int
    height: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray


class TiffError(ValueError):
    """The file breaks the format or uses a scheme that is not known."""


# ---- PackBits -------------------------------------------------------------


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals of up to 128 bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return b""
    cuts = np.flatnonzero(np.diff(data)) + 1
    starts = np.concatenate(([0], cuts))
    lengths = np.diff(np.append(starts, len(data)))
    out, literal_from = bytearray(), 0

    def literals(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = raw[k : min(b, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3):
        a, n = int(starts[k]), int(lengths[k])
        literals(literal_from, a)
        literal_from = a + n
        while n:
            take = min(n, 128)
            if take == 1:
                out += bytes((0, raw[a]))
            else:
                out += bytes((257 - take, raw[a]))
            n -= take
    literals(literal_from, len(raw))
    return bytes(out)


def packbits_decode(coded: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(coded)
    while len(out) < size and at < end:
        head = coded[at]
        if head < 128:
            out += coded[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += coded[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


# ---- LZW (most significant bit first, early change of width) --------------


def lzw_encode(raw: bytes) -> bytes:
    codes: list[int] = [CLEAR]
    table: dict[int, int] = {}
    free, prefix = 258, -1
    add = codes.append
    for byte in raw:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        add(prefix)
        if free == 4094:
            add(CLEAR)
            table.clear()
            free = 258
        else:
            table[key] = free
            free += 1
        prefix = byte
    if prefix >= 0:
        add(prefix)
    add(END)
    return _pack_codes(np.array(codes, dtype=np.int64))


def _code_widths(codes: np.ndarray) -> np.ndarray:
    """Bits of each code: the reader's table grows by one for each code but the first after a clear."""
    at = np.arange(len(codes))
    since = at - np.maximum.accumulate(np.where(codes == CLEAR, at, -1))
    size = np.maximum(256 + since, 258)
    widths = 9 + (size >= 511).astype(np.int64) + (size >= 1023) + (size >= 2047)
    clear = np.flatnonzero(codes == CLEAR)
    for k in clear[clear > 0]:
        size_before = 257 + int(since[k - 1])
        widths[k] = 9 + (size_before >= 511) + (size_before >= 1023) + (size_before >= 2047)
    widths[:1] = 9
    return widths


def _pack_codes(codes: np.ndarray) -> bytes:
    widths = _code_widths(codes)
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]), dtype=np.uint8)
    for k in range(12):
        use = widths > k
        bits[ends[use] - 1 - k] = (codes[use] >> k) & 1
    return np.packbits(bits).tobytes()


def lzw_decode(coded: bytes, size: int) -> bytes:
    singles = [bytes((k,)) for k in range(256)] + [b"", b""]
    table: list[bytes] = singles[:]
    out: list[bytes] = []
    made, width, last = 0, 9, b""
    held, have = 0, 0
    full = 511
    add, grow = out.append, table.append
    for byte in coded:
        held = (held << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = (held >> have) & ((1 << width) - 1)
        if code == CLEAR:
            table = singles[:]
            grow = table.append
            width, full, last = 9, 511, b""
            continue
        if code == END:
            break
        if not last:
            if code > 255:
                raise TiffError("an LZW strip begins with an unknown code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("an LZW strip holds an unknown code")
            grow(last + entry[:1])
            if len(table) >= full and width < 12:
                width += 1
                full = (1 << width) - 1
        add(entry)
        made += len(entry)
        last = entry
        if made >= size:
            break
    return b"".join(out)


# ---- blocks ---------------------------------------------------------------


def _squeeze(raw: bytes, scheme: int) -> bytes:
    if scheme == RAW:
        return raw
    if scheme == DEFLATE:
        return zlib.compress(raw, 4)
    if scheme == PACKBITS:
        return packbits_encode(raw)
    if scheme == LZW:
        return lzw_encode(raw)
    raise TiffError(f"compression {scheme} is not written here")


def _stretch(coded: bytes, scheme: int, size: int) -> bytes:
    if scheme == RAW:
        raw = coded
    elif scheme in (DEFLATE, DEFLATE_OLD):
        try:
            raw = zlib.decompressobj().decompress(coded, size) if size else b""
        except zlib.error as why:
            raise TiffError(f"a deflate block is broken: {why}") from why
    elif scheme == PACKBITS:
        raw = packbits_decode(coded, size)
    elif scheme == LZW:
        raw = lzw_decode(coded, size)
    else:
        raise TiffError(f"compression {scheme} is not known")
    if len(raw) < size:
        raise TiffError("a strip or tile holds too few bytes")
    return raw[:size]


# ---- writing --------------------------------------------------------------


def encode(payload: bytes, *, width: int = 64, page_rows: int = 1024, strip_rows: int = 128, tile: int = 64, scheme: int = DEFLATE, predictor: int = 2, tiled: bool = False) -> bytes:
    """A little-endian grey TIFF whose 8-bit samples are ``payload``, cut into pages of at most ``page_rows`` rows.

    ``payload`` must be a positive multiple of ``width`` long; ``tile`` a multiple of 16.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        blocks = []
        if tiled:
            across, down = -(-width // tile), -(-len(page) // tile)
            padded = np.zeros((down * tile, across * tile), dtype=np.uint8)
            padded[: len(page), :width] = page
            parts = [padded[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile] for r in range(down) for c in range(across)]
        else:
            parts = [page[r : r + strip_rows] for r in range(0, len(page), strip_rows)]
        for part in parts:
            if predictor == 2:
                part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
            blocks.append(_squeeze(part.tobytes(), scheme))
        at = []
        for block in blocks:
            at.append(len(out))
            out += block + b"\0" * (len(block) % 2)
        sizes = [len(b) for b in blocks]
        fields = [(WIDTH, 3, [width]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1])]
        if not tiled:
            fields += [(STRIP_OFFSETS, 4, at), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, sizes)]
        else:
            fields += [(SAMPLES, 3, [1])]
        fields += [(PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tiled:
            fields += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, at), (TILE_COUNTS, 4, sizes)]
        entries = []
        for tag, kind, values in fields:
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                place = struct.pack("<I", len(out))
                out += body
            else:
                place = body.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---- reading --------------------------------------------------------------


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for k in range(count):
            tag, kind, n, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            size = FIELD_BYTES.get(kind, 0) * n
            place = at + 2 + 12 * k + 8
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size > len(data):
                raise TiffError("a field points past the end of the file")
            if kind in (1, 3, 4):
                fields[tag] = struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    except struct.error as why:
        raise TiffError("a directory is cut short") from why
    return fields, following


def _page(data: bytes, fields: dict[int, tuple], order: str) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in fields and fields[tag]:
            return fields[tag][0]
        if default is None:
            raise TiffError(f"field {tag} is missing")
        return default

    width, height, scheme, predictor = one(WIDTH), one(HEIGHT), one(COMPRESSION, RAW), one(PREDICTOR, 1)
    depth, planar = one(SAMPLES, 1), one(PLANAR, 1)
    bits = set(fields.get(BITS, (1,)))
    if bits not in ({8}, {16}):
        raise TiffError(f"samples of {sorted(bits)} bits are not known")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not known")
    if not width or not height or not depth:
        raise TiffError("the image has no samples")
    wide = bits == {16}
    kind = np.dtype(np.uint16).newbyteorder(order) if wide else np.dtype(np.uint8)
    tiled = TILE_OFFSETS in fields
    block_w, block_h = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, sizes = (fields.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if not block_w or not block_h:
        raise TiffError("a block has no samples")
    across, down = -(-width // block_w), -(-height // block_h)
    planes, inner = (depth, 1) if planar == 2 else (1, depth)
    if len(offsets) < across * down * planes or len(sizes) < across * down * planes:
        raise TiffError("blocks are missing")
    if width * height * depth * kind.itemsize > max(1 << 16, len(data) * 4096):
        raise TiffError("the image claims more samples than the file can hold")
    samples = np.empty((height, width, depth), dtype=kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, inside = divmod(k, across * down)
        row, column = divmod(inside, across)
        rows = block_h if tiled else min(block_h, height - row * block_h)
        if offsets[k] + sizes[k] > len(data):
            raise TiffError("a block reaches past the end of the file")
        raw = _stretch(data[offsets[k] : offsets[k] + sizes[k]], scheme, rows * block_w * inner * kind.itemsize)
        block = np.frombuffer(raw, dtype=kind).reshape(rows, block_w, inner).astype(samples.dtype)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=samples.dtype)
        y, x = row * block_h, column * block_w
        into = samples[y : y + rows, x : x + block_w, plane : plane + 1] if planar == 2 else samples[y : y + rows, x : x + block_w]
        into[:] = block[: into.shape[0], : into.shape[1]]
    return Page(width, height, scheme, predictor, tiled, samples)


def pages_of(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories; raises ``TiffError`` where the file breaks off."""
    if not data:
        return
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("this is no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        fields, following = _fields(data, at, order)
        yield _page(data, fields, order)
        at = following


PAGES = "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, samples binary, error string"


def _page_rows(data: bytes | None) -> list[dict]:
    rows, error = [], None
    try:
        for k, p in enumerate(pages_of(data or b"")):
            rows.append({"page": k, "width": p.width, "height": p.height, "samples_per_pixel": p.samples.shape[2], "bits": 8 * p.samples.itemsize, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "samples": p.samples.tobytes(), "error": None})
    except TiffError as why:
        error = str(why)
    if error or not rows:
        rows.append(dict.fromkeys(("page", "width", "height", "samples_per_pixel", "bits", "compression", "predictor", "tiled", "samples")) | {"error": error})
    return rows


def read_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page of each file: ``key`` and the columns of ``PAGES``; native byte order in ``samples``.

    A null or empty file gives one row with ``page`` null; a broken file gives its good
    pages and then a row with ``page`` null and ``error`` set.
    """

    @F.pandas_udf(f"array<struct<{PAGES.replace(' ', ':').replace(',:', ',')}>>")
    def decoded(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: _page_rows(None if c is None else bytes(c)))

    return files.select(F.col(key), F.explode(decoded(F.col(content))).alias("_page")).select(F.col(key), "_page.*")


# ---- text payloads --------------------------------------------------------

#: How a payload is stored is drawn by its checksum, so that every scheme carries a share of texts of every length.
LAYOUTS = (
    {"scheme": DEFLATE, "predictor": 2, "tiled": False},
    {"scheme": DEFLATE, "predictor": 1, "tiled": True},
    {"scheme": PACKBITS, "predictor": 1, "tiled": False},
    {"scheme": LZW, "predictor": 1, "tiled": False},
)
ROUND_TRIP = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def pad(raw: bytes, unit: int = 64) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``unit``."""
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def feature_of(pages: list[Page]) -> str:
    """Page sizes and grey-level statistics: mean, variance (6 places), distinct levels, mean step along rows."""
    counts = sum(np.bincount(p.samples.ravel(), minlength=256) for p in pages)
    total = int(counts.sum())
    levels = np.arange(256)
    mean = int((counts * levels).sum()) / total
    variance = int((counts * levels * levels).sum()) / total - mean * mean
    steps = sum(int(np.abs(np.diff(p.samples.astype(np.int16), axis=1)).sum()) for p in pages)
    size = "+".join(dict.fromkeys(f"{p.width}x{p.height}" for p in pages))
    return f"pages={len(pages)};size={size};mean={mean:.6f};var={variance:.6f};levels={int((counts > 0).sum())};step={steps / total:.6f}"


def round_trip(text: str | None) -> tuple:
    """Store a text as a TIFF, read the file back and describe what was read (the fields of ``ROUND_TRIP``)."""
    raw = (text or "").encode()
    payload = pad(raw)
    media = encode(payload, **LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)])
    pages = list(pages_of(media))
    back = b"".join(p.samples.tobytes() for p in pages)
    return (len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha256(media).hexdigest(), feature_of(pages), len(pages))


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the fields of ``ROUND_TRIP`` for every row (null text: empty)."""
    names = [f.split()[0] for f in ROUND_TRIP.split(", ")]

    @F.pandas_udf(f"struct<{ROUND_TRIP.replace(' ', ':').replace(',:', ',')}>")
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([round_trip(t) for t in texts], columns=names)

    return docs.select(F.col(key), digests(F.col(text)).alias("_media")).select(F.col(key), "_media.*")
