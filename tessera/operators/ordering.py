"""Ranks and running totals that also scale without groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.store import keep, tasks


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null, as groups have it."""
    return left.eqNullSafe(right)


def beside(df: DataFrame, table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with the other columns of ``table``, which has one row for each group; a group may be null."""
    if not by:
        return df.crossJoin(F.broadcast(table))
    named = table.withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)})
    on = [same(df[c], named[f"_by_{i}"]) for i, c in enumerate(by)]
    return df.join(named, on, "inner").drop(*[f"_by_{i}" for i in range(len(by))])


def running_totals(df: DataFrame, by: tuple[str, ...], order: list[Column], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with running sums in a total order: ``sums`` maps new columns to the columns that are added up.

    ``order`` holds plain expressions; ``descending`` turns all of them round. The rows are
    range-dealt over tasks by group and order, added up inside each range, and shifted by
    the totals of the same group in the ranges before, so no task gets a whole group, or
    all rows without groups. The order must be total, or ties fall in any order.
    """
    keys = [f"_order{k}" for k in range(len(order))]  # named: expressions bound to df do not resolve in the written table
    df = df.withColumns(dict(zip(keys, order, strict=True)))
    order = [F.col(k).desc() if descending else F.col(k) for k in keys]
    ranged = keep(df.repartitionByRange(tasks(df.sparkSession), *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(old).alias(f"_all_{new}") for new, old in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a group
    shifts = totals.select("_range", *by, *[F.sum(f"_all_{new}").over(before).alias(f"_all_{new}") for new in sums], F.row_number().over(Window.partitionBy(*by).orderBy("_range")).alias("_nth"))
    shifts = shifts.where("_nth > 1").drop("_nth")  # a range has at most one group that began in an earlier one, so this is no longer than the ranges
    shifts = shifts.withColumnsRenamed({"_range": "_in"} | {c: f"_by_{i}" for i, c in enumerate(by)})
    on = [ranged["_range"] == shifts["_in"], *[same(ranged[c], shifts[f"_by_{i}"]) for i, c in enumerate(by)]]
    shifted = ranged.join(F.broadcast(shifts), on, "left").drop("_in", *[f"_by_{i}" for i in range(len(by))])
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {new: F.sum(old).over(inside) + F.coalesce(F.col(f"_all_{new}"), F.lit(0)) for new, old in sums.items()}
    return shifted.withColumns(added).drop("_range", *keys, *[f"_all_{new}" for new in sums])


def percentiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """``by`` and ``p0, p1, ...``: linearly interpolated percentiles of each group; nulls take no part.

    Exact by default: equal values are counted first, the counts are put in order over
    ranges, and each share is read off where its place falls, so no task holds a group's
    values. With ``accuracy`` they are Spark's approximate percentiles (no interpolation).
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if accuracy is not None:
        held = rows.groupBy(*by).agg(F.percentile_approx("_v", F.array(*[F.lit(x) for x in shares]), accuracy).alias("_p"))
        return held.select(*by, *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(len(shares))])
    tied = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = beside(running_totals(tied, by, [F.col("_v")], {"_upto": "_c"}), rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v")))

    places = [(F.col("_n") - 1) * F.lit(float(x)) for x in shares]
    found = [c for i, x in enumerate(places) for c in (at(F.floor(x)).alias(f"_lo{i}"), at(F.ceil(x)).alias(f"_hi{i}"), F.max(x - F.floor(x)).alias(f"_at{i}"))]
    held = placed.groupBy(*by).agg(*found)
    return held.select(*by, *[F.when(F.col(f"_at{i}") > 0, (1 - F.col(f"_at{i}")) * F.col(f"_lo{i}") + F.col(f"_at{i}") * F.col(f"_hi{i}")).otherwise(F.col(f"_lo{i}")).alias(f"p{i}") for i in range(len(shares))])


SCOPES = ("none", "global", "per_class", "per_class_view", "per_image")


def rank_normalise(df: DataFrame, value: str, order: list[str], scope: str, ties: str = "stable", method: str | None = None, cls: str = "cls", view: str = "view", image: str = "image_id") -> DataFrame:
    """``df`` with ``rank``: places 0 to 1 by value, (place - 1) / (n - 1) and 0 for a single row.

    ``scope`` says within what rows are ranked. Ties go by ``order`` (a key of the rows),
    or share their mean place with ``ties="average"``. ``none`` copies the value.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope}; known: {SCOPES}")
    if ties not in ("stable", "average"):
        raise ValueError(f"unknown ties {ties}")
    if scope == "none":
        return df.withColumn("rank", F.col(value).cast("double"))
    groups = {"global": (), "per_class": (cls,), "per_class_view": (cls, view), "per_image": (image,)}[scope]
    groups = ((method,) if method else ()) + groups
    missing = [g for g in groups if g not in df.columns]
    if missing:
        raise ValueError(f"scope {scope} needs the columns {missing}")
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    if ties == "average":
        tied = df.groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        summed = running_totals(tied, groups, [F.col("_v")], {"_upto": "_c"}).withColumn("_place", F.col("_upto") - (F.col("_c") - 1) / 2).drop("_upto", "_c")
        placed = _at_ties(df, beside(summed, counts, groups), groups, value)
    elif scope == "per_image":  # one image's pixels fit a task
        ordered = Window.partitionBy(*groups).orderBy(F.col(value), *map(F.col, order))
        placed = df.withColumns({"_place": F.row_number().over(ordered).cast("double"), "_n": F.count(F.lit(1)).over(Window.partitionBy(*groups))})
    else:
        placed = running_totals(df.withColumn("_one", F.lit(1)), groups, [F.col(value), *map(F.col, order)], {"_place": "_one"}).drop("_one")
        placed = beside(placed, counts, groups)
    return placed.withColumn("rank", F.when(F.col("_n") > 1, (F.col("_place") - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_place", "_n")


def _at_ties(df: DataFrame, places: DataFrame, groups: tuple[str, ...], value: str) -> DataFrame:
    """``df`` with the mean place of its value in its group; the values are joined, so that a frequent one is a skewed join and not a window."""
    named = places.withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(groups)})
    on = [*[same(df[c], named[f"_by_{i}"]) for i, c in enumerate(groups)], same(df[value], named["_v"])]
    return df.join(named, on, "inner").drop("_v", *[f"_by_{i}" for i in range(len(groups))])


def ecdf(df: DataFrame, value: str, reference: DataFrame, reference_value: str, key: str) -> DataFrame:
    """``df`` with ``ecdf``: the share of reference values below the row's value (0 against an empty reference)."""
    n = reference.count()
    marked = df.select(*df.columns, F.lit(0).alias("_ref"), F.lit(1).alias("_side"))
    points = reference.groupBy(F.col(reference_value).alias(value)).agg(F.count(F.lit(1)).alias("_ref"))
    points = points.select(*[F.col(value) if c == value else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.col("_ref"), F.lit(2).alias("_side"))
    both = marked.unionByName(points)  # a row stands before the reference values that equal it
    summed = running_totals(both, (), [F.col(value), F.col("_side"), F.col(key)], {"_below": "_ref"})
    return summed.where("_side = 1").withColumn("ecdf", F.col("_below") / F.lit(max(n, 1))).drop("_ref", "_side", "_below")


def calibration(df: DataFrame, value: str, low: float = 0.01, high: float = 0.995, by: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """Percentiles ``lo`` and ``hi`` for each group (as ``percentiles`` gives them); ``hi`` is raised to ``lo + 1e-6`` where it is no larger."""
    out = percentiles(df, value, [low, high], by, accuracy)
    return out.select(*by, F.col("p0").alias("lo"), F.when(F.col("p1") > F.col("p0"), F.col("p1")).otherwise(F.col("p0") + 1e-6).alias("hi"))


def normalised(value: Column, lo: Column, hi: Column, clip: bool = True) -> Column:
    """(value - lo) / (hi - lo), clipped to [0, 1] unless told otherwise."""
    scaled = (value - lo) / F.greatest(hi - lo, F.lit(1e-9))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)) if clip else scaled


def apply_view_norm(df: DataFrame, value: str, stats: DataFrame, view: str = "view", image: str = "image_id") -> DataFrame:
    """``df`` with ``normalised`` by its view's bounds (unclipped); a view without bounds goes by its image's least and largest value."""
    whole = Window.partitionBy(image)
    joined = df.withColumn("_view", F.coalesce(F.col(view), F.lit(0))).join(F.broadcast(stats.select(F.col(view).alias("_view"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))), "_view", "left")
    lo, hi = F.coalesce("_lo", F.min(value).over(whole)), F.coalesce("_hi", F.max(value).over(whole))
    return joined.withColumn("normalised", normalised(F.col(value), lo, hi, clip=False)).drop("_view", "_lo", "_hi")
