"""Average precision and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import beside, running_totals


def average_precision(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group: ``n``, ``n_positive`` and tie-grouped average precision (0.0 without positives).

    Rows of equal score count as one threshold, so their order never matters. Rows with a
    null score or label take no part. Scores are aggregated before they are ordered;
    without groups the order is cut into ranges with running offsets instead of being
    sent to one task.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    tied = rows.groupBy(*by, F.col(score).alias("_score")).agg(F.sum((F.col(label) > 0).cast("long")).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    summed = running_totals(tied, by, [F.col("_score")], {"_tp_to": "_tp", "_n_to": "_n"}, descending=True)
    area = F.sum(F.col("_tp") * F.col("_tp_to") / F.col("_n_to"))
    out = summed.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_tp"), F.lit(0)).alias("n_positive"), area.alias("_area"))
    return out.select(*by, "n", "n_positive", F.when(F.col("n_positive") > 0, F.col("_area") / F.col("n_positive")).otherwise(0.0).alias("ap"))


def ap_summary(per_image: DataFrame, cls: str = "cls", kind: str = "anomaly_type", ap: str = "ap") -> DataFrame:
    """Per class and anomaly type: number of images and mean, population deviation, least and largest AP."""
    return per_image.groupBy(cls, kind).agg(
        F.count(F.lit(1)).alias("n_views"), F.avg(ap).alias("ap_mean"), F.stddev_pop(ap).alias("ap_std"), F.min(ap).alias("ap_min"), F.max(ap).alias("ap_max")
    )


def class_means(summary: DataFrame, cls: str = "cls") -> DataFrame:
    """A class's AP is the mean of its types' means."""
    return summary.groupBy(cls).agg(F.avg("ap_mean").alias("ap"))


def overall(class_ap: DataFrame, ap: str = "ap") -> DataFrame:
    """The mean over classes, skipping NaN."""
    return class_ap.agg(F.avg(F.when(~F.isnan(ap), F.col(ap))).alias("ap"))


def term_statistics(df: DataFrame, terms: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation (plus 1e-9) of each term over normal images."""
    wanted: list[Column] = []
    for t in terms:
        wanted += [F.avg(t).alias(f"{t}_mean"), (F.stddev_pop(t) + F.lit(1e-9)).alias(f"{t}_std")]
    return df.groupBy(*by).agg(*wanted)


def hard_mean(df: DataFrame, value: str, share: float, key: str) -> DataFrame:
    """The mean of the largest ``max(int(share * n), 1)`` values; equal values are counted first, so ``key`` never decides."""
    tied = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n = tied.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    k = max(int(share * n), 1)
    summed = running_totals(tied, (), [F.col("_v")], {"_upto": "_c"}, descending=True)
    taken = F.least(F.col("_c"), F.greatest(F.lit(0), k - (F.col("_upto") - F.col("_c"))))
    return summed.select("_v", taken.alias("_t")).where("_t > 0").agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("k"), (F.sum(F.col("_v") * F.col("_t")) / F.sum("_t")).alias("hard_mean"))


def order_statistic(df: DataFrame, value: str, pct: float, by: tuple[str, ...], key: str) -> DataFrame:
    """For each group, the value at place n - k in ascending order, k = clamp(round(n (100 - pct) / 100), 1, n - 1); no interpolation.

    Nulls stand first. Equal values are counted first, so ``key`` never decides.
    """
    tied = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = beside(running_totals(tied, by, [F.col("_v")], {"_upto": "_c"}), df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    k = F.greatest(F.lit(1), F.least(F.rint(F.col("_n") * (100.0 - pct) / 100.0).cast("long"), F.col("_n") - 1))
    at = F.greatest(F.lit(0), F.col("_n") - k)
    return placed.where((F.col("_upto") - F.col("_c") <= at) & (at < F.col("_upto"))).select(*by, F.col("_v").alias("picked"))


def top_k(df: DataFrame, value: str, k: int, by: tuple[str, ...], key: str) -> DataFrame:
    """The ``k`` largest rows of each group with their rank; ties by ``key``."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
