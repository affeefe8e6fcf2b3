"""Several methods' predictions on the images they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.raster import resize_nearest


def align(methods: dict[str, DataFrame], on: str, value: str, order: str | None = None) -> DataFrame:
    """``on`` and one column for each method, for the keys that every method has.

    One union and one aggregation instead of a join for each method. Of a method's repeated
    keys the last by the column ``order`` stands, or the largest value without one: rows of
    a table have no order of their own.
    """
    if not methods:
        raise ValueError("there is nothing to align")
    stacked = None
    for name, df in methods.items():
        at = F.col(order) if order else F.lit(0)
        part = df.select(F.col(on), F.lit(name).alias("_method"), F.col(value).alias("_value"), at.alias("_at"))
        stacked = part if stacked is None else stacked.unionByName(part)

    def one(name: str) -> Column:
        own = F.when(F.col("_method") == name, F.col("_value"))
        return F.max_by(own, F.when(F.col("_method") == name, F.col("_at"))) if order else F.max(own)

    picked = [one(name).alias(name) for name in methods]
    held = [F.max(F.when(F.col("_method") == name, 1)).alias(f"_has{i}") for i, name in enumerate(methods)]
    out = stacked.where(F.col(on).isNotNull()).groupBy(on).agg(*picked, *held)
    every = F.lit(True)
    for i in range(len(methods)):
        every = every & F.col(f"_has{i}").isNotNull()
    return out.where(every).select(on, *methods)


def align_report(methods: dict[str, DataFrame], on: str) -> DataFrame:
    """``method, n, n_shared``: how many keys each method has, and how many are shared by all."""
    stacked = None
    for name, df in methods.items():
        part = df.where(F.col(on).isNotNull()).select(F.col(on), F.lit(name).alias("method")).distinct()
        stacked = part if stacked is None else stacked.unionByName(part)
    seen = stacked.groupBy(on).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("method").alias("_m"))
    return seen.select(F.explode("_m").alias("method"), (F.col("_n") == len(methods)).cast("long").alias("_s")).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("n_shared"))


def one_shape(maps: DataFrame, to_h: int, to_w: int) -> DataFrame:
    """``maps`` resized to one grid by nearest neighbour where they differ."""
    same = (F.col("h") == to_h) & (F.col("w") == to_w)
    moved = F.when(same, F.col("data")).otherwise(resize_nearest(F.col("data"), F.col("h"), F.col("w"), to_h, to_w))
    return maps.withColumns({"data": moved, "h": F.lit(to_h), "w": F.lit(to_w)})


def with_class(rows: DataFrame, lookup: DataFrame, key: str, cls: str, default: str | None = None) -> DataFrame:
    """``rows`` with their class from ``lookup``; without a default, a row without a class raises."""
    joined = rows.join(lookup.select(key, F.col(cls).alias("_cls")), key, "left")
    missing = F.lit(default) if default is not None else F.raise_error(F.lit("a row has no class")).cast("string")
    return joined.withColumn(cls, F.when(F.col("_cls").isNotNull(), F.col("_cls").cast("string")).otherwise(missing)).drop("_cls")


def class_scores(rows: DataFrame, models: dict, cls: str, methods: str) -> DataFrame:
    """``rows`` with ``score`` from their class's model (a function of the methods' column); others get the mean of the methods."""
    from tessera.functions.arrays import mean

    out = mean(F.col(methods))
    for name, model in models.items():
        out = F.when(F.col(cls) == F.lit(name), model(F.col(methods))).otherwise(out)
    return rows.withColumn("score", out)
