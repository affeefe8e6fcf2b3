"""Rule-based fusion of several methods' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.ordering import rank_normalise

RULES = ("mean", "geometric", "max", "median", "rank_mean")


def shares(weights: list[float] | None, n: int, rule: str) -> list[float]:
    """Weights that add up to one; max and median take none."""
    if weights is None:
        return [1.0 / n] * n
    if rule in ("max", "median"):
        raise ValueError(f"{rule} takes no weights")
    if len(weights) != n:
        raise ValueError(f"{n} methods need {n} weights")
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    return [w / sum(weights) for w in weights]


def fused(methods: Column, n: int, rule: str, weights: list[float] | None = None) -> Column:
    """One score from an array of ``n`` methods' scores, for every rule but ``rank_mean``."""
    if rule not in RULES or rule == "rank_mean":
        raise ValueError(f"unknown rule {rule}; known: {RULES}")
    share = F.array(*[F.lit(w) for w in shares(weights, n, rule)])
    if rule == "mean":
        return A.dot(methods, share)
    if rule == "geometric":
        return F.exp(A.dot(F.transform(methods, lambda x: F.ln(F.greatest(x, F.lit(1e-8)))), share))
    return F.array_max(methods) if rule == "max" else A.median(methods)


def fuse(df: DataFrame, methods: str, n: int, rule: str, order: list[str], weights: list[float] | None = None) -> DataFrame:
    """``df`` with ``fused``. ``rank_mean`` ranks each method over all rows (ties by ``order``), then takes the weighted mean."""
    if rule != "rank_mean":
        return df.withColumn("fused", fused(F.col(methods), n, rule, weights))
    long = df.select(*order, F.posexplode(methods).alias("_method", "_score"))
    ranked = rank_normalise(long, "_score", order, "global", method="_method")
    share = F.array(*[F.lit(w) for w in shares(weights, n, rule)])
    mean = ranked.groupBy(*order).agg(F.sum(F.col("rank") * F.get(share, F.col("_method"))).alias("fused"))
    return df.join(mean, order)
