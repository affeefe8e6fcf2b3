"""The q8rle text codec for 8-bit maps, as SQL expressions.

A payload is ``q8rle H W v n v n ...``: runs of equal values down the columns of an
H x W map. Maps are row-major arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let

MAGIC = "q8rle"


def quantise(data: Column) -> Column:
    """Scores in [0, 1] as whole numbers 0-255, rounded half to even in single precision and clipped."""
    return F.transform(data, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((x.cast("float") * F.lit(255.0).cast("float")).cast("double")).cast("int"))))


def encode(data: Column, h: Column, w: Column) -> Column:
    """The payload of a row-major array of whole numbers; an array whose size is not h * w raises."""
    header = F.concat_ws(" ", F.lit(MAGIC), h.cast("string"), w.cast("string"))
    down = let(data, lambda d: F.transform(F.sequence(F.lit(0), F.greatest(h * w - 1, F.lit(0))), lambda p: F.get(d, (p % h) * w + F.floor(p / h).cast("int"))))

    def runs(d: Column) -> Column:
        """Each run's value and length, from the places where runs begin (no array grows, so a map of many runs takes linear time)."""
        begins = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (F.get(d, i) != F.get(d, i - 1)))
        return let(begins, lambda at: F.transform(at, lambda p, k: F.concat_ws(" ", F.get(d, p), F.coalesce(F.get(at, k + 1), F.size(d)) - p)))

    body = let(down, runs)
    wrong = F.raise_error(F.lit("a map's size must be its height times its width"))
    full = F.concat_ws(" ", header, F.array_join(body, " "))
    return F.when(F.size(data) != h * w, wrong.cast("string")).when(h * w == 0, header).otherwise(full)


def _parts(payload: Column, f) -> Column:
    """``f(parts, numbers, body)`` of a payload, each of which is made once: its fields, those after the magic word as numbers, and those after the shape."""

    def numbers(parts: Column) -> Column:
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("int"))

    return let(F.split(payload, " "), lambda parts: let(numbers(parts), lambda held: let(F.slice(held, 3, F.greatest(F.size(held) - 2, F.lit(0))), lambda body: f(parts, held, body))))


def _problem(parts: Column, numbers: Column, body: Column) -> Column:
    h, w = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    values, runs = F.filter(body, lambda x, i: i % 2 == 0), F.filter(body, lambda x, i: i % 2 == 1)
    covered = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        F.when(parts.isNull() | (F.size(parts) < 3), "short")
        .when(F.get(parts, F.lit(0)) != MAGIC, "magic")
        .when(h.isNull() | w.isNull() | (h < 0) | (w < 0), "shape")
        .when(F.size(body) % 2 == 1, "odd body")
        .when(F.exists(body, lambda x: x.isNull()), "not a number")
        .when(F.exists(values, lambda x: (x < 0) | (x > 255)), "value")
        .when(F.exists(runs, lambda x: x < 0), "run")
        .when((F.size(body) > 0) & (covered != h.cast("long") * w), "coverage")
    )


def problem(payload: Column) -> Column:
    """Why a payload can't be decoded, or null."""
    return F.when(payload.isNull(), "short").otherwise(_parts(payload, _problem))


def shape(payload: Column) -> tuple[Column, Column]:
    """Height and width from the header."""
    parts = F.split(payload, " ")
    return F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("int")


def decode(payload: Column, on_error: str = "raise") -> Column:
    """The row-major array of a payload; a payload with a problem raises, or gives null with ``on_error="null"``."""

    def unrolled(numbers: Column, body: Column) -> Column:
        h, w = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        runs = F.flatten(F.transform(F.filter(body, lambda x, i: i % 2 == 0), lambda v, i: F.array_repeat(v, F.get(body, 2 * i + 1))))
        flat = F.when(F.size(body) == 0, F.array_repeat(F.lit(0), h * w)).otherwise(runs)
        across = let(flat, lambda f: F.transform(F.sequence(F.lit(0), h * w - 1), lambda p: F.get(f, (p % w) * h + F.floor(p / w).cast("int"))))
        return F.when(h * w > 0, across).otherwise(F.array().cast("array<int>"))

    def rows(parts: Column, numbers: Column, body: Column) -> Column:
        def or_else(why: Column) -> Column:
            fine = F.when(why.isNull(), unrolled(numbers, body))
            return fine if on_error == "null" else fine.otherwise(F.raise_error(F.concat(F.lit("bad payload: "), F.coalesce(why, F.lit("")))).cast("array<int>"))

        return let(_problem(parts, numbers, body), or_else)

    missing = F.lit(None).cast("array<int>") if on_error == "null" else F.raise_error(F.lit("bad payload: short")).cast("array<int>")
    return F.when(payload.isNull(), missing).otherwise(_parts(payload, rows))


def dequantise(values: Column) -> Column:
    return F.transform(values, lambda x: x / 255.0)
