"""Folds by document id, bounded samples of labelled rows, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder -1, in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, class_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole labelled documents, at most ``per_class`` ids of each class, chosen by a hash of their id: ``key, _text, _label``.

    Of these, in the order of the hash, as many are used as ``class_bytes`` of text hold.
    Both bounds are parameters, so the broadcast of the chosen ids and whatever is fitted
    on the texts stay as small at any size of the corpus. Ids with a null label, or with
    both labels, are left out; of documents that share an id all are used.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable)
    known = known.groupBy(key).agg(F.min(label).alias("_label"), F.max(label).alias("_most")).where("_label = _most").drop("_most")
    order = F.xxhash64(F.lit("labelled"), F.col(key))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(order, key).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sizes = texts.select(key, F.octet_length("_text").alias("_size")).join(F.broadcast(chosen), key).groupBy(key, "_label").agg(F.sum("_size").alias("_size"))
    upto = Window.partitionBy("_label").orderBy(order, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # per_class rows at most
    fits = sizes.withColumn("_upto", F.sum("_size").over(upto)).where(F.col("_upto") <= class_bytes).select(key, "_label")
    return texts.join(F.broadcast(fits), key)


class Logistic:
    """Ridge logistic regression on standardised columns and their products, fitted by Newton steps."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 50, products: bool = True, share: float | None = None):
        """``share``: the positives' share of the population, where the rows were sampled by class."""
        self.products = products
        self.shift = 0.0
        if share is not None and 0 < share < 1 and 0 < np.mean(labels) < 1:
            self.shift = float(np.log(share / (1 - share)) - np.log(np.mean(labels) / (1 - np.mean(labels))))
        rows = np.asarray(rows, dtype=float).reshape(len(labels), -1)
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-9
        design = self._design(rows)
        self.weights = np.zeros(design.shape[1])
        loss = self._loss(design, labels, self.weights, ridge)
        for _ in range(steps):
            p = self._sigmoid(design @ self.weights)
            slope = design.T @ (p - labels) / len(labels) + ridge * self.weights
            curve = (design * (p * (1 - p))[:, None]).T @ design / len(labels) + ridge * np.eye(len(slope))
            change, stride = np.linalg.solve(curve, slope), 1.0
            while (new := self._loss(design, labels, self.weights - stride * change, ridge)) > loss and stride > 1e-6:
                stride /= 2  # a full step overshoots where classes are almost apart
            self.weights -= stride * change
            loss = new
            if np.abs(stride * change).max() < 1e-7:
                break

    @staticmethod
    def _loss(design: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float) -> float:
        z = design @ weights
        return float(np.mean(np.logaddexp(0, z) - labels * z) + ridge / 2 * (weights**2).sum())

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def _design(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        columns = [np.ones(len(z)), *z.T]
        if self.products:
            columns += [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.column_stack(columns)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(np.asarray(rows, dtype=float).reshape(-1, len(self.mean))) @ self.weights + self.shift)
