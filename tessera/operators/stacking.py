"""Grouped cross-validation, learned stacking and calibration of probabilities."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import running_totals

MODES = {"loao": "anomaly_type", "sample": "sample_id"}


def folds(df: DataFrame, mode: str, columns: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``fold``: one for each anomaly type (``loao``) or each object (``sample``), numbered in order of their names."""
    column = (MODES | (columns or {})).get(mode)
    if mode not in MODES or column is None:
        raise ValueError(f"unknown mode {mode}; known: {sorted(MODES)}")
    named = df.select(F.col(column).cast("string").alias("_b")).where("_b is not null").distinct().withColumn("_one", F.lit(1))
    numbers = running_totals(named, (), [F.col("_b")], {"_nth": "_one"}).select("_b", (F.col("_nth") - 1).cast("int").alias("fold"))
    return df.withColumn("_b", F.col(column).cast("string")).join(numbers, "_b").drop("_b")


def hashed(key: str) -> Column:
    """A fixed order that looks random, the same in any SQL engine."""
    return F.md5(F.col(key).cast("string").cast("binary"))


def subsample(df: DataFrame, label: str, image: str, key: str, neg_per_pos: int = 30) -> DataFrame:
    """Each image's positives and at most ``neg_per_pos`` negatives for each of them, by hash; images without positives give none."""
    order = Window.partitionBy(image, "_pos").orderBy(hashed(key), key)
    marked = df.withColumn("_pos", (F.col(label) > 0).cast("int"))
    placed = marked.withColumns({"_n": F.row_number().over(order), "_p": F.sum("_pos").over(Window.partitionBy(image))})
    return placed.where("_pos = 1 OR _n <= _p * %d" % neg_per_pos).where("_p > 0").drop("_pos", "_n", "_p")


def stratified(df: DataFrame, label: str, key: str, max_rows: int = 2_000_000) -> DataFrame:
    """All positives, and negatives by hash up to ``max_rows`` rows in all."""
    n, positive = df.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(label) > 0).cast("long")), F.lit(0))).first()
    if n <= max_rows:
        return df
    room = max(max_rows - positive, 0)
    negative = df.where(~(F.col(label) > 0)).orderBy(hashed(key), key).limit(room)
    return df.where(F.col(label) > 0).unionByName(negative)


class Estimator:
    """A binary classifier over feature columns: ``fit(df)``, then ``predict(df)`` adds ``prediction`` in [0, 1]."""

    def __init__(self, features: list[str], label: str = "label", **params):
        self.features, self.label, self.params, self.model = list(features), label, self.defaults() | params, None

    @classmethod
    def defaults(cls) -> dict:
        return {}

    @classmethod
    def space(cls, rng: random.Random) -> dict:
        """One random draw of parameters."""
        return {}

    def stages(self) -> list:
        raise NotImplementedError

    def weights(self, n: int, positive: int) -> Column:
        return F.lit(1.0)

    def fit(self, df: DataFrame) -> Estimator:
        labelled = df.withColumn("_label", (F.col(self.label) > 0).cast("double"))
        n, positive = labelled.agg(F.count(F.lit(1)), F.sum("_label")).first()
        if not positive or positive == n:
            raise ValueError("training needs both classes")
        weighted = labelled.withColumn("_weight", self.weights(int(n), int(positive)))
        assembler = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="error")
        self.model = Pipeline(stages=[assembler, *self.stages()]).fit(weighted)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.select(*df.columns, vector_to_array(F.col("_probability"))[1].alias("prediction"))


class LogisticEstimator(Estimator):
    """Standardised, class-balanced elastic-net logistic regression."""

    @classmethod
    def defaults(cls) -> dict:
        return {"c": 1.0, "l1_ratio": 0.0, "max_iter": 1000}

    @classmethod
    def space(cls, rng: random.Random) -> dict:
        return {"c": 10 ** rng.uniform(-3, 2), "l1_ratio": rng.uniform(0, 1)}

    def weights(self, n: int, positive: int) -> Column:
        self.total = n
        return F.when(F.col("_label") > 0, n / (2.0 * positive)).otherwise(n / (2.0 * (n - positive)))

    def stages(self) -> list:
        p = self.params
        return [
            StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True),
            LogisticRegression(featuresCol="_scaled", labelCol="_label", weightCol="_weight", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class", elasticNetParam=p["l1_ratio"], regParam=1 / (p["c"] * self.total), maxIter=p["max_iter"], standardization=False),
        ]

    def importance(self) -> dict[str, float]:
        return dict(zip(self.features, (abs(float(x)) for x in self.model.stages[-1].coefficients), strict=True))


class BoostedTrees(Estimator):
    """Gradient-boosted trees, positives weighted by the class ratio."""

    @classmethod
    def defaults(cls) -> dict:
        return {"trees": 40, "depth": 5, "step": 0.1, "subsample": 0.8, "columns": "0.8", "least": 5, "seed": 0}

    @classmethod
    def space(cls, rng: random.Random) -> dict:
        return {"trees": rng.randrange(20, 80, 10), "depth": rng.randrange(3, 8), "step": 10 ** rng.uniform(-2, -0.5), "subsample": rng.uniform(0.6, 1.0)}

    def weights(self, n: int, positive: int) -> Column:
        return F.when(F.col("_label") > 0, (n - positive) / positive).otherwise(1.0)

    def stages(self) -> list:
        p = self.params
        return [GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_class", maxIter=p["trees"], maxDepth=p["depth"], stepSize=p["step"], subsamplingRate=p["subsample"], featureSubsetStrategy=p["columns"], minInstancesPerNode=p["least"], seed=p["seed"])]

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.select(*df.columns, vector_to_array(F.col("probability"))[1].alias("prediction"))

    def importance(self) -> dict[str, float]:
        return dict(zip(self.features, (float(x) for x in self.model.stages[-1].featureImportances.toArray()), strict=True))


ESTIMATORS = {"logreg": LogisticEstimator, "gbt": BoostedTrees}


def build_estimator(name: str, features: list[str], label: str = "label", **params) -> Estimator:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](features, label, **params)


def out_of_fold(df: DataFrame, make, image: str, key: str, label: str = "label", neg_per_pos: int = 30) -> DataFrame:
    """``df`` with ``prediction`` by a model that never saw the row's fold; a fold without trainable rows gets null.

    ``make()`` gives an untrained estimator. There is a model for each fold, fitted on
    the subsampled complement, and every held-out row is predicted.
    """
    numbers = sorted(r["fold"] for r in df.select("fold").distinct().collect())
    out = None
    for k in numbers:
        held, rest = df.where(F.col("fold") == k), subsample(df.where(F.col("fold") != k), label, image, key, neg_per_pos)
        try:
            part = make().fit(rest).predict(held)
        except ValueError:
            part = held.withColumn("prediction", F.lit(None).cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def pooled_cv_score(predicted: DataFrame, label: str = "label") -> float:
    """Pooled average precision of the predicted rows; NaN without any."""
    from tessera.operators.metrics import average_precision

    row = average_precision(predicted.where("prediction is not null"), "prediction", label).first()
    return float(row["ap"]) if row and row["n"] else float("nan")


def tune(df: DataFrame, name: str, features: list[str], image: str, key: str, trials: int, seed: int = 0, label: str = "label") -> tuple[dict, float]:
    """The best of seeded random draws (and the defaults) by pooled out-of-fold average precision."""
    rng, best = random.Random(seed), ({}, float("-inf"))
    for t in range(trials + 1):
        params = ESTIMATORS[name].space(rng) if t else {}
        score = pooled_cv_score(out_of_fold(df, lambda p=params: build_estimator(name, features, label, **p), image, key, label), label)
        if score > best[1]:
            best = (params, score)
    return best


class Calibrator:
    """A monotone map from predictions to probabilities: ``none``, ``isotonic`` or ``platt``."""

    def __init__(self, method: str, model=None):
        self.method, self.model = method, model

    def apply(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with ``calibrated``; NaN and null pass through ``none`` only."""
        if self.method == "none":
            return df.withColumn("calibrated", F.col(prediction))
        if self.method == "isotonic":
            out = self.model.transform(df.withColumn("_x", F.col(prediction).cast("double")))
            return out.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_iso")))).drop("_x", "_iso")
        slope, offset = float(self.model.coefficients[0]), float(self.model.intercept)
        return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col(prediction)))))


def fit_calibrator(df: DataFrame, method: str, label: str = "label", prediction: str = "prediction", key: str | None = None, max_rows: int = 2_000_000) -> Calibrator:
    """Fit on all positives and a bounded share of negatives; labels of one class fall back to ``none``."""
    if method not in ("none", "isotonic", "platt"):
        raise ValueError(f"unknown method {method}")
    rows = df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    if method == "none" or rows.select((F.col(label) > 0).alias("y")).distinct().count() < 2:
        return Calibrator("none")
    if key is not None:
        rows = stratified(rows, label, key, max_rows)
    rows = rows.select((F.col(label) > 0).cast("double").alias("_y"), F.col(prediction).cast("double").alias("_x"))
    if method == "isotonic":
        return Calibrator(method, IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_iso").fit(rows))
    vectors = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(rows)
    return Calibrator(method, LogisticRegression(featuresCol="_v", labelCol="_y", tol=1e-12, maxIter=500).fit(vectors))
