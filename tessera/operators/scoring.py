"""Closed-form detector scores over given features, and the losses of trained ones.

Networks are trained elsewhere and arrive as feature columns; see
``tessera.plans.detectors`` for the plug-in interface.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A


def z_score(value: Column, mean: Column | float, deviation: Column | float) -> Column:
    return (value - mean) / deviation


def residual(a: Column, b: Column) -> Column:
    """Mean squared difference of two feature vectors."""
    return A.squared_distance(a, b) / F.size(a)


def student_teacher(teacher: Column, student: Column, decoder: Column, stats: dict[str, tuple[float, float]]) -> Column:
    """Mean of the z-scored errors of student against teacher and student against autoencoder."""
    return (z_score(residual(teacher, student), *stats["student"]) + z_score(residual(student, decoder), *stats["autoencoder"])) / 2.0


def flow_nll(latent: Column, log_det: Column) -> Column:
    """Negative log likelihood of a flow, without its constant."""
    return 0.5 * A.dot(latent, latent) - log_det


def coupling(x: np.ndarray, scale_and_shift, clamp: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """An affine coupling: the second half is scaled by exp(2 tanh(s / 2)) and shifted; gives the output and log determinant."""
    half = x.shape[1] // 2
    s, t = scale_and_shift(x[:, :half])
    s = clamp * np.tanh(s / clamp)
    return np.concatenate([x[:, :half], x[:, half:] * np.exp(s) + t], axis=1), s.sum(1)


def cosine_layers(teacher: list[Column], student: list[Column], mode: str = "mul") -> Column:
    """1 - cosine for each layer, multiplied or added up."""
    if mode not in ("mul", "sum"):
        raise ValueError(f"unknown mode {mode}")
    maps = [1 - A.cosine(t, s) for t, s in zip(teacher, student, strict=True)]
    out = maps[0]
    for m in maps[1:]:
        out = out * m if mode == "mul" else out + m
    return out


def zero_shot(image: Column, normal: Column, anomalous: Column, temperature: float = 100.0) -> Column:
    """The anomalous share of a two-way softmax over cosine similarities."""
    return 1 / (1 + F.exp(temperature * (A.cosine(image, normal) - A.cosine(image, anomalous))))


def text_embedding(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Normalise, average and normalise again the prompt embeddings of each group."""
    long = df.select(by, F.posexplode(A.unit(A.as_double(F.col(vector)))).alias("_i", "_x"))
    mean = long.groupBy(by, "_i").agg(F.avg("_x").alias("_x"))
    rows = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_v"))
    return rows.select(by, A.unit(F.col("_v")).alias("embedding"))


def anomalous_channel(logits: Column) -> Column:
    """The share of the second of two channels in their softmax."""
    return 1 / (1 + F.exp(F.get(logits, F.lit(0)) - F.get(logits, F.lit(1))))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def level_mean(logits: Column) -> Column:
    """The mean of the sigmoids over an array of levels (of transparency)."""
    return A.mean(F.transform(logits, sigmoid))


def image_windows(grid: np.ndarray, size: int) -> np.ndarray:
    """Means of all whole windows of ``size`` x ``size`` cells of a grid of vectors, at length one: (h', w', d)."""
    sums = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1, grid.shape[2]))
    sums[1:, 1:] = grid.cumsum(0).cumsum(1)
    means = (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2
    return means / np.maximum(np.linalg.norm(means, axis=2, keepdims=True), 1e-12)


def stretch(n: int, to: int) -> np.ndarray:
    """The matrix that brings ``n`` values to ``to`` bilinearly, with half-pixel centres."""
    at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((to, n))
    out[np.arange(to), low] += 1 - (at - low)
    out[np.arange(to), np.minimum(low + 1, n - 1)] += at - low
    return out


def window_scores(grid: np.ndarray, sizes: tuple[int, ...], normal: np.ndarray, anomalous: np.ndarray, references: dict[int, np.ndarray], alpha: float = 0.5, temperature: float = 100.0) -> np.ndarray:
    """A grid of scores from windows of several sizes: the anomalous share against two text vectors, mixed with the distance to the nearest reference window.

    ``references`` has a matrix of normal windows for each size; a size without one goes by
    the texts alone. Each size's scores are brought to the grid bilinearly and averaged;
    a window that is larger than the grid is left out.
    """
    total, used = np.zeros(grid.shape[:2]), 0
    for size in sizes:
        if size > min(grid.shape[:2]):
            continue
        windows = image_windows(grid, size)
        score = 1 / (1 + np.exp(np.clip(temperature * (windows @ normal - windows @ anomalous), -700, 700)))
        if references.get(size) is not None and len(references[size]):
            nearest = np.concatenate([(part @ references[size].T).max(1) for part in np.array_split(windows.reshape(-1, windows.shape[2]), max(1, windows[..., 0].size // 4096))])
            score = alpha * score + (1 - alpha) * (1 - nearest.reshape(score.shape))
        total += stretch(score.shape[0], grid.shape[0]) @ score @ stretch(score.shape[1], grid.shape[1]).T
        used += 1
    return total / max(used, 1)


def ssim_loss(x: np.ndarray, y: np.ndarray, window: int = 11, sigma: float = 1.5) -> float:
    """1 - mean structural similarity of two maps in [0, 1], under a Gaussian window with zeros beyond the border."""
    offsets = np.arange(window) - window // 2
    weights = np.exp(-(offsets**2) / (2 * sigma * sigma))
    weights /= weights.sum()

    def blur(m: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            m = np.apply_along_axis(np.convolve, axis, np.pad(m, [(window // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)]), weights, "valid")
        return m

    mx, my = blur(x), blur(y)
    vx, vy = (np.maximum(blur(a * a) - m * m, 1e-8) for a, m in ((x, mx), (y, my)))
    both = blur(x * y) - mx * my
    return float(1 - np.mean((2 * mx * my + 1e-4) * (2 * both + 9e-4) / np.maximum((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4), 1e-8)))


def contrastive_loss(distances: Column, k_attract: int = 3, k_repel: int = 3, radius_sq: float = 1e-5, alpha: float = 1e-3) -> Column:
    """Attraction of the nearest squared distances into the radius, repulsion of the next beyond it."""
    ordered = F.sort_array(distances)
    near = F.transform(F.slice(ordered, 1, k_attract), lambda d: F.greatest(d - radius_sq, F.lit(0.0)))
    far = F.transform(F.slice(ordered, k_attract + 1, k_repel), lambda d: F.greatest(radius_sq + alpha - d, F.lit(0.0)))
    return A.mean(near) + F.when(F.size(far) > 0, A.mean(far)).otherwise(0.0)


def focal_loss(p: Column, label: Column, gamma: float = 2.0, alpha: float = 0.5) -> Column:
    right = F.when(label > 0, p).otherwise(1 - p)
    weight = F.when(label > 0, F.lit(alpha)).otherwise(1 - alpha)
    return -weight * F.pow(1 - right, F.lit(gamma)) * F.ln(F.greatest(right, F.lit(1e-8)))


def dice_loss(df: DataFrame, p: str, label: str, by: tuple[str, ...], smooth: float = 1.0) -> DataFrame:
    both, one, two = F.sum(F.col(p) * F.col(label)), F.sum(p), F.sum(label)
    return df.groupBy(*by).agg((1 - (2 * both + smooth) / (one + two + smooth)).alias("dice_loss"))


def mixture_log_density(vector: Column, weights: np.ndarray, means: np.ndarray, precisions: np.ndarray) -> Column:
    """Log density under a Gaussian mixture with diagonal precisions, by log-sum-exp, inside the JVM."""
    terms = []
    for w, m, p in zip(weights, means, precisions, strict=True):
        base = math.log(w) + 0.5 * float(np.log(p).sum()) - 0.5 * len(m) * math.log(2 * math.pi)
        centre, scale = (F.array(*[F.lit(float(x)) for x in a]) for a in (m, p))
        gap = F.zip_with(F.zip_with(vector, centre, lambda x, c: (x - c) * (x - c)), scale, lambda d, s: d * s)
        terms.append(F.lit(base) - 0.5 * A.total(gap))
    held = F.array(*terms)
    most = F.array_max(held)
    return most + F.ln(A.total(F.transform(held, lambda t: F.exp(t - most))))


def mixture_log_density_full(rows: np.ndarray, weights: np.ndarray, means: np.ndarray, cholesky: np.ndarray) -> np.ndarray:
    """Log density with full precisions P = C C^T given by their factors C (x is projected as x C)."""
    out = []
    for w, m, c in zip(weights, means, cholesky, strict=True):
        gap = (rows - m) @ c
        out.append(math.log(w) + np.log(np.diag(c)).sum() - 0.5 * rows.shape[1] * math.log(2 * math.pi) - 0.5 * (gap**2).sum(1))
    held = np.stack(out)
    most = held.max(0)
    return most + np.log(np.exp(held - most).sum(0))


def fit_mixture(rows: np.ndarray, components: int = 30, concentration: float = 0.01, steps: int = 200, ridge: float = 1e-6, seed: int = 0, floor: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A variational Dirichlet-process mixture with diagonal covariances: weights, means and precisions.

    Stick-breaking weights with a Gamma-like concentration, k-means++ starts; components
    with a weight of at most ``floor`` are dropped (the others are not rescaled).
    ``rows`` is a bounded sample on the driver.
    """
    rng = np.random.default_rng(seed)
    rows = np.asarray(rows, dtype=float)
    components = min(components, len(rows))
    centres = [rows[rng.integers(len(rows))]]
    for _ in range(components - 1):
        gap = np.min([((rows - c) ** 2).sum(1) for c in centres], axis=0)
        total = gap.sum()
        centres.append(rows[rng.choice(len(rows), p=gap / total)] if total > 0 else rows[rng.integers(len(rows))])
    means = np.array(centres)
    variance = np.tile(rows.var(0) + ridge, (components, 1))
    log_weights = np.full(components, -math.log(components))
    bound = -np.inf
    for _ in range(steps):
        logs = log_weights - 0.5 * (np.log(2 * math.pi * variance).sum(1) + (((rows[:, None, :] - means) ** 2) / variance).sum(2)) if len(rows) * components * rows.shape[1] < 5e7 else np.stack([log_weights[k] - 0.5 * (np.log(2 * math.pi * variance[k]).sum() + (((rows - means[k]) ** 2) / variance[k]).sum(1)) for k in range(components)], axis=1)
        most = logs.max(1, keepdims=True)
        share = np.exp(logs - most)
        norm = share.sum(1, keepdims=True)
        share /= norm
        held = share.sum(0) + 1e-12
        order = np.argsort(-held)
        share, held = share[:, order], held[order]
        means = (share.T @ rows) / held[:, None]
        variance = np.maximum((share.T @ rows**2) / held[:, None] - means**2, 0) + ridge
        after = np.concatenate((np.cumsum(held[::-1])[::-1][1:], [0.0]))
        a, b = 1 + held, concentration + after
        digamma_a, digamma_b, digamma_ab = (_digamma(x) for x in (a, b, a + b))
        log_weights = digamma_a - digamma_ab + np.concatenate(([0.0], np.cumsum((digamma_b - digamma_ab)[:-1])))
        now = float((most + np.log(norm)).mean())
        if abs(now - bound) < 1e-3:
            break
        bound = now
    weights = np.exp(log_weights)
    weights /= weights.sum()
    use = weights > floor
    return weights[use], means[use], 1 / variance[use]


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x += 1
    inverse = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252))


def neighbour_mask(spark, h: int, w: int, radius: int) -> DataFrame:
    """``query, target, allowed`` for all cells of an h x w grid: cells within the Chebyshev radius are forbidden.

    Raises if the radius leaves some cell without an allowed one.
    """
    if radius > max(h // 2, w // 2) - 1:
        raise ValueError("the radius forbids every cell to some cell")
    cells = spark.range(h * w)
    pairs = cells.select(F.col("id").alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h * w - 1).cast("long"))).alias("target"))
    gap = F.greatest(F.abs(F.floor(F.col("query") / w) - F.floor(F.col("target") / w)), F.abs(F.col("query") % w - F.col("target") % w))
    return pairs.withColumn("allowed", gap > radius)


def gradient_ascent(features: np.ndarray, weights: np.ndarray, epsilon: float = 0.05, steps: int = 4) -> np.ndarray:
    """Sign-gradient steps towards a larger linear logit, clamped to an epsilon box."""
    moved = np.zeros_like(features)
    for _ in range(steps):
        moved = np.clip(moved + 2.5 * epsilon / steps * np.sign(weights), -epsilon, epsilon)
    return features + moved


def score_batches(df: DataFrame, model, vector: str, out: str = "score") -> DataFrame:
    """Plug a trained scorer in: ``model(matrix) -> scores`` is run over Arrow batches."""

    @F.pandas_udf("double")
    def scored(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model(np.stack(vectors.to_numpy()).astype(float)), dtype=float) if len(vectors) else [], dtype=float)

    return df.withColumn(out, scored(F.col(vector)))
