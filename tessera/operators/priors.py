"""Where defects of a class stand, and checks of a submission."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import codec
from tessera.functions.raster import gaussian, resize_bilinear
from tessera.operators.ordering import running_totals

#: The side of the zero heat map of a class without a prior.
NO_PRIOR = 128


def spatial_priors(masks: DataFrame, sigma: float = 3.0, cls: str = "cls") -> DataFrame:
    """``cls, h, w, coverage, heat``: the mean mask of each class, smoothed and divided by its peak.

    ``masks`` has ``cls, h, w, mask`` on one grid for a class. Pixels are averaged by an
    aggregation over positions, so a class of any size never meets in one task.
    """
    long = masks.select(cls, "h", "w", F.posexplode("mask").alias("_p", "_x"))
    mean = long.groupBy(cls, "h", "w", "_p").agg(F.avg((F.col("_x") > 0).cast("double")).alias("_m"))
    dense = mean.groupBy(cls, "h", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("_mean"))
    smooth = dense.select(cls, "h", "w", A.mean(F.col("_mean")).alias("coverage"), gaussian(F.col("_mean"), F.col("h"), F.col("w"), sigma).alias("_s"))
    scaled = A.let(F.array_max("_s"), lambda peak: F.when(peak > 0, F.transform("_s", lambda x: x / peak)).otherwise(F.col("_s")))
    return smooth.select(cls, "h", "w", "coverage", scaled.alias("heat"))


def write_priors(priors: DataFrame, path: str) -> None:
    """Write what ``spatial_priors`` gives, with each class's centre bias, as Parquet."""
    bias = centre_bias(F.col("heat"), F.col("h"), F.col("w"))
    priors.withColumn("centre_bias", bias).write.mode("overwrite").parquet(path)


def load_priors(spark: SparkSession, path: str | None, classes: list, cls: str = "cls") -> DataFrame:
    """``cls, h, w, heat`` for every one of ``classes``, clipped to [0, 1].

    A class that the table lacks, or all of them where there is no table, has a zero heat
    map, so that a feature made from it is there and does nothing.
    """
    wanted = spark.createDataFrame([(c,) for c in classes], f"{cls} {'string' if any(isinstance(c, str) for c in classes) else 'long'}")
    zero = F.array_repeat(F.lit(0.0), NO_PRIOR * NO_PRIOR)
    try:
        held = spark.read.parquet(path) if path else None
    except AnalysisException:  # no such folder
        held = None
    if held is None:
        return wanted.select(cls, F.lit(NO_PRIOR).alias("h"), F.lit(NO_PRIOR).alias("w"), zero.alias("heat"))
    joined = wanted.join(held.select(cls, "h", "w", "heat"), cls, "left")
    clipped = F.transform("heat", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return joined.select(cls, F.coalesce("h", F.lit(NO_PRIOR)).alias("h"), F.coalesce("w", F.lit(NO_PRIOR)).alias("w"), F.coalesce(clipped, zero).alias("heat"))


def write_view_stats(stats: DataFrame, path: str) -> None:
    """Write ``view, lo, hi`` (as ``ordering.calibration`` by view gives them) as Parquet."""
    stats.select("view", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).write.mode("overwrite").parquet(path)


def load_view_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("view", "lo", "hi")


def centre_bias(heat: Column, h: Column, w: Column) -> Column:
    """The share of a heat map's mass in its middle half; 0 without mass."""

    def middle(x: Column, p: Column) -> Column:
        r, c = F.floor(p / w), p % w
        top, left = F.floor(h / 4), F.floor(w / 4)
        low, right = F.floor(3 * h / 4), F.floor(3 * w / 4)
        return F.when((r >= top) & (r < low) & (c >= left) & (c < right), x).otherwise(0.0)

    mass = A.total(heat)
    return F.when(mass > 0, A.total(F.transform(heat, middle)) / mass).otherwise(0.0)


def with_prior(images: DataFrame, priors: DataFrame, h: int, w: int, cls: str = "cls") -> DataFrame:
    """``images`` with ``prior``, the class's heat on an h x w grid clipped to [0, 1], zero without one."""
    fitted = priors.select(cls, F.transform(resize_bilinear(F.col("heat"), F.col("h"), F.col("w"), h, w), lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).alias("_heat"))
    return images.join(fitted, cls, "left").withColumn("prior", F.coalesce("_heat", F.array_repeat(F.lit(0.0), h * w))).drop("_heat")


def apply_prior(data: Column, prior: Column, weight: float = 0.5) -> Column:
    return F.zip_with(data, prior, lambda s, p: (1 - weight) * s + weight * p)


def every_nth(rows: DataFrame, n: int, order: str) -> DataFrame:
    """A systematic sample: every (count / n)-th row in order, ``n`` at most."""
    step = max(1, rows.count() // n)
    if step > 1:
        placed = running_totals(rows.withColumn("_one", F.lit(1)), (), [F.col(order)], {"_nth": "_one"})
        rows = placed.where((F.col("_nth") - 1) % step == 0).drop("_one", "_nth")
    return rows.orderBy(order).limit(n)


def check_submission(rows: DataFrame, classes: DataFrame | None = None, sample: int = 400) -> DataFrame:
    """``level, message``: mixed shapes, saturated or bright maps and uneven classes in a sample of a submission (``ID, Label``).

    ``classes`` (``ID, cls``) allows the comparison of classes, which is left out if a class is unknown.
    """
    spark = rows.sparkSession
    seen = every_nth(rows, sample, "ID")
    h, w = codec.shape(F.col("Label"))
    maps = seen.select("ID", h.alias("h"), w.alias("w"), codec.decode(F.col("Label")).alias("v"))

    def share(test) -> Column:
        return F.size(F.filter("v", test)) / F.size("v")

    maps = maps.select("ID", "h", "w", share(lambda x: x == 255).alias("full"), share(lambda x: x > 127).alias("bright"), A.median(F.transform("v", lambda x: x.cast("double"))).alias("middle"))
    shapes, full, bright = maps.agg(F.count_distinct("h", "w"), F.avg("full"), F.avg("bright")).first()
    found = []
    if shapes > 1:
        found.append(("error", f"{shapes} different shapes"))
    if (full or 0) > 0.02:
        found.append(("warning", f"{full:.1%} of the pixels are saturated"))
    if (bright or 0) > 0.25:
        found.append(("warning", f"{bright:.1%} of the pixels are above one half"))
    if classes is not None:
        joined = maps.join(classes, "ID", "left")
        if joined.where("cls is null").isEmpty():
            least, most = joined.groupBy("cls").agg(F.median("middle").alias("m")).agg(F.min("m"), F.max("m")).first()
            if least is not None and most / 255 / max(least / 255, 1e-6) > 5:
                found.append(("warning", "the classes' medians differ more than fivefold"))
    return spark.createDataFrame(found, "level string, message string")
