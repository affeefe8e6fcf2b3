"""Runs: fit and score detectors class by class, evaluate, write predictions, and stack several runs."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.text import config_digest, make_run_id, parse_view
from tessera.operators import features, metrics, stacking
from tessera.operators.alignment import with_class
from tessera.operators.components import suppress_small_components
from tessera.operators.ordering import SCOPES, rank_normalise
from tessera.operators.priors import load_priors, with_prior
from tessera.plans.detectors import Detector
from tessera.sources.predictions import submission, write_ledger_row, write_predictions, write_submission
from tessera.store import keep


@dataclass
class RunResult:
    run_id: str
    per_type: DataFrame
    per_class: DataFrame
    predictions: DataFrame
    pooled: dict[str, float] = field(default_factory=dict)

    @property
    def pooled_ap(self) -> float:
        """The mean of the classes' pooled average precisions."""
        return sum(self.pooled.values()) / len(self.pooled) if self.pooled else float("nan")


def to_maps(scored: DataFrame, value: str = "score") -> DataFrame:
    """``image_id, cls, anomaly_type, view, split, h, w, data, mask`` from scored patches (``pos`` row-major, ``label`` 0/1)."""
    keys = ["image_id", "cls", "anomaly_type", "view", "split", "h", "w"]
    cells = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"), "label")))  # one image's patches
    rows = scored.groupBy(*keys).agg(cells.alias("_c"))
    return rows.select(*keys, F.transform("_c", lambda x: x["v"]).alias("data"), F.transform("_c", lambda x: x["label"]).alias("mask"))


def run_experiment(patches: DataFrame, make, tag: str = "", slug: str = "run", out_dir: str | None = None, smooth=None) -> RunResult:
    """Fit ``make()`` on each class's ``train_good`` patches, score the rest, and evaluate where there are labels.

    ``patches``: ``patch_id, image_id, cls, split, anomaly_type, view, h, w, pos, embedding, label``.
    With ``out_dir`` the run's predictions, evaluation table, submission of its test images
    and a row of the ledger are written there.
    """
    began = time.time()
    probe: Detector = make()
    run_id = make_run_id(slug, probe.config.fingerprint(), tag, time.strftime("%Y%m%d-%H%M%S"))
    maps = None
    for cls in [r["cls"] for r in patches.select("cls").distinct().orderBy("cls").collect()]:
        own = patches.where(F.col("cls") == cls)
        scored = make().fit(own.where("split = 'train_good'")).score(own.where("split <> 'train_good'"))
        maps = to_maps(scored) if maps is None else maps.unionByName(to_maps(scored))
    if smooth is not None:
        maps = maps.withColumn("data", smooth(F.col("data"), F.col("h"), F.col("w")))
    maps = keep(maps, "maps")  # scored once, read by everything below
    pixels = A.each(maps.where("split = 'train_anomaly'"), ["image_id", "cls", "anomaly_type"], F.arrays_zip("data", "mask"), "_p", "_x")
    pixels = pixels.select("image_id", "cls", "anomaly_type", F.col("_x.data").alias("score"), F.col("_x.mask").alias("label"))
    each = metrics.average_precision(pixels, "score", "label", ("cls", "anomaly_type", "image_id"))
    per_type = keep(metrics.ap_summary(each), "per-type")
    pooled = {r["cls"]: r["ap"] for r in metrics.average_precision(pixels, "score", "label", ("cls",)).collect()}
    result = RunResult(run_id, per_type, metrics.class_means(per_type), maps, pooled)
    if out_dir:
        write_predictions(maps.withColumn("run_id", F.lit(run_id)), f"{out_dir}/predictions", with_masks=False)
        write_eval(per_type, f"{out_dir}/local_eval")
        tests = maps.where("split = 'test'")
        if not tests.isEmpty():
            write_submission(submission(tests), f"{out_dir}/submission.csv", zip_it=True)
        row = {"run_id": run_id, "tag": tag, "timestamp": time.strftime("%Y-%m-%d %H:%M:%S")} | {f"AP_{r['cls']}": f"{r['ap']:.4f}" for r in result.per_class.collect()}
        write_ledger_row(patches.sparkSession, f"{out_dir}/ledger", row | {"AP_pooled": f"{result.pooled_ap:.4f}", "runtime_min": f"{(time.time() - began) / 60:.1f}"})
    return result


# The columns of an evaluation table.
EVAL_COLUMNS = ("class", "anomaly_type", "n_views", "ap_mean", "ap_std", "ap_min", "ap_max")


def write_eval(per_type: DataFrame, path: str) -> None:
    """``ap_summary``'s rows as CSV, in order of class and type."""
    named = per_type.withColumnRenamed("cls", "class").select(*EVAL_COLUMNS)
    named.orderBy("class", "anomaly_type").coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each class and type


def write_config(path: str, run_id: str, fields: dict) -> None:
    Path(path).mkdir(parents=True, exist_ok=True)
    (Path(path) / "config.json").write_text(json.dumps({"run_id": run_id, "digest": config_digest(fields)} | fields, indent=2, default=str, sort_keys=True))


@dataclass(frozen=True)
class StackerConfig:
    """All fields change the result, and all are hashed."""

    runs: tuple[str, ...]
    estimator: str = "gbt"
    features: features.FeatureConfig = features.FeatureConfig()
    scope: str = "per_class"
    test_scope: str = "per_class"
    cv_mode: str = "loao"
    neg_per_pos: int = 30
    calibrate: str = "isotonic"
    tune_trials: int = 0
    min_component_size: int = 0
    seed: int = 0

    def __post_init__(self):
        if len(self.runs) < 2:
            raise ValueError("stacking needs at least two runs")
        known = {"estimator": stacking.ESTIMATORS, "cv_mode": stacking.MODES, "scope": SCOPES, "test_scope": SCOPES}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"unknown {name} {getattr(self, name)}; known: {sorted(values)}")

    def fingerprint(self) -> dict:
        return {k: (v.__dict__ if isinstance(v, features.FeatureConfig) else v) for k, v in self.__dict__.items()}


@dataclass
class StackResult:
    run_id: str
    ap: dict[str, float]
    predictions: DataFrame
    fused: DataFrame | None = None
    submission: str | None = None

    @property
    def overall(self) -> float:
        return sum(self.ap.values()) / len(self.ap) if self.ap else float("nan")


def ranked_maps(images: DataFrame, methods: list[str], scope: str) -> DataFrame:
    """``images`` with the ranks of all methods' pixels, 0 to 1 within ``scope``, in place of their scores.

    Within an image ranks are made on the map. Wider scopes rank pixels of all images of
    the scope, method by method, over ranges (no task gets a class), and put them together
    again image by image.
    """
    if scope == "none":
        return images
    if scope == "per_image":
        return images.withColumns({m: features.image_rank(F.col(m)) for m in methods})
    long = A.each(images, ["image_id", "cls", "view"], F.arrays_zip(*methods), "_p", "_x")
    long = long.select("image_id", "cls", "view", "_p", F.posexplode(F.array(*[F.col(f"_x.{m}") for m in methods])).alias("_method", "_score"))
    ranked = rank_normalise(long, "_score", ["image_id", "_p"], scope, method="_method")
    dense = ranked.groupBy("image_id", "_method").agg(_in_order("_p", "rank").alias("_m"))  # one image's pixels
    wide = dense.groupBy("image_id").agg(*[F.max(F.when(F.col("_method") == i, F.col("_m"))).alias(m) for i, m in enumerate(methods)])
    return images.drop(*methods).join(wide, "image_id")


def _in_order(place: str, value: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda s: s[value])


def pixel_table(images: DataFrame, methods: list[str], classes: list, config: features.FeatureConfig, priors: DataFrame | None, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The feature rows of ranked maps, with the classes' heat maps as a feature where the configuration asks for them; and the features' names."""
    with_heat = config.spatial_prior
    if with_heat:
        shape = images.select("h", "w").first()
        heat = priors if priors is not None else load_priors(images.sparkSession, None, classes)
        images = with_prior(images, heat, shape["h"], shape["w"]) if shape else images.withColumn("prior", F.array().cast("array<double>"))
    table = features.featurize(images, methods, classes, config, keys, prior="prior" if with_heat else None)
    return table, features.feature_names(len(methods), classes, config, prior=with_heat)


def run_stacker(
    images: DataFrame, methods: list[str], config: StackerConfig, params: dict | None = None, priors: DataFrame | None = None, tests: DataFrame | None = None, lookup: DataFrame | None = None, out_dir: str | None = None, zip_it: bool = True
) -> StackResult:
    """Stack aligned maps class by class: ranks, features, out-of-fold predictions, calibration, pooled average precision, and the fused test images.

    ``images``: ``image_id, cls, view, h, w, anomaly_type, sample_id, mask`` and one array
    column for each method; ``priors`` as ``load_priors`` gives them. Classes without
    positives get no model. ``tests`` (``image_id, h, w`` and the methods, as
    ``predictions.test_scores`` gives them) are fused by the models of all validation rows;
    ``lookup`` (``image_id, cls``) says their classes. With ``out_dir`` the configuration,
    the submission and a row of the ledger are written.
    """
    began, spark = time.time(), images.sparkSession
    run_id = make_run_id(f"stack-{config.estimator}", config.fingerprint(), "", time.strftime("%Y%m%d-%H%M%S"))
    every = [r["cls"] for r in images.select("cls").distinct().orderBy("cls").collect()]
    classes = [r["cls"] for r in images.where(F.exists("mask", lambda m: m > 0)).select("cls").distinct().orderBy("cls").collect()]
    ranked = keep(ranked_maps(images, methods, config.scope), "ranked")
    matrix, names = pixel_table(ranked, methods, every, config.features, priors, ("image_id", "anomaly_type", "sample_id"))
    labels = A.each(images, ["image_id", "cls", "w"], F.col("mask"), "_p", "label").select("image_id", "cls", F.floor(F.col("_p") / F.col("w")).cast("int").alias("r"), (F.col("_p") % F.col("w")).alias("c"), "label")
    table = keep(matrix.join(labels, ["image_id", "r", "c"]).withColumn("key", F.xxhash64("image_id", "r", "c")), "stack-rows") if classes else None
    out, ap, models = None, {}, {}
    for cls in classes:
        own = stacking.folds(table.where(F.col("cls") == cls), config.cv_mode)
        best = params if params is not None else (stacking.tune(own, config.estimator, names, "image_id", "key", config.tune_trials, config.seed)[0] if config.tune_trials else {})
        predicted = stacking.out_of_fold(own, lambda b=best: stacking.build_estimator(config.estimator, names, **b), "image_id", "key", neg_per_pos=config.neg_per_pos)
        predicted = keep(predicted.select("image_id", "cls", "r", "c", "key", "label", "prediction"), "out-of-fold")
        ap[cls] = stacking.pooled_cv_score(predicted)
        calibrator = stacking.fit_calibrator(predicted, config.calibrate, key="key")
        if tests is not None:
            models[cls] = stacking.build_estimator(config.estimator, names, **best).fit(own), calibrator
        held = calibrator.apply(predicted).select("image_id", "cls", "r", "c", "label", "prediction", "calibrated")
        out = held if out is None else out.unionByName(held)
    if out is None:
        out = spark.createDataFrame([], "image_id long, cls string, r int, c int, label int, prediction double, calibrated double")
    result = StackResult(run_id, ap, out)
    if tests is not None:
        result.fused = fuse_tests(tests, methods, every, models, config, priors, lookup)
    if out_dir:
        if result.fused is not None:
            result.submission = write_submission(submission(result.fused, calibrate=False), f"{out_dir}/submission.csv", zip_it=zip_it)
        row = {"run_id": run_id, "timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "estimator": config.estimator, "n_methods": len(methods), "methods": "|".join(config.runs), "val_scope": config.scope, "cv_mode": config.cv_mode, "calibrate": config.calibrate}
        row |= {f"AP_{cls}": f"{x:.4f}" for cls, x in sorted(ap.items())} | {"AP_overall": f"{result.overall:.4f}", "runtime_min": f"{(time.time() - began) / 60:.1f}", "submission_path": result.submission}
        write_ledger_row(spark, f"{out_dir}/stack_ledger", row)
    return result


def fuse_tests(tests: DataFrame, methods: list[str], classes: list, models: dict, config: StackerConfig, priors: DataFrame | None = None, lookup: DataFrame | None = None) -> DataFrame:
    """``image_id, h, w, data``: every test image's calibrated map by its class's model; of a class without one, the mean of its ranked methods."""
    _, view = parse_view(F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    named = tests.withColumn("view", F.coalesce(view, F.lit(-1)))
    named = with_class(named, lookup, "image_id", "cls", default=str(classes[0])) if lookup is not None else named.withColumn("cls", F.lit(classes[0]))
    ranked = keep(ranked_maps(named, methods, config.test_scope), "ranked-tests")
    average = F.transform(F.arrays_zip(*methods), lambda x: sum((x[m] for m in methods[1:]), x[methods[0]]) / len(methods))
    fused = ranked.where(~F.col("cls").isin(list(models))).select("image_id", "h", "w", average.alias("data"))
    for cls, (model, calibrator) in models.items():
        own = ranked.where(F.col("cls") == cls)
        matrix, _ = pixel_table(own, methods, classes, config.features, priors, ("image_id", "h", "w"))
        scored = calibrator.apply(model.predict(matrix)).withColumn("_p", F.col("r") * F.col("w") + F.col("c"))
        fused = fused.unionByName(scored.groupBy("image_id", "h", "w").agg(_in_order("_p", "calibrated").alias("data")))
    if config.min_component_size > 0:
        fused = fused.withColumn("data", suppress_small_components(F.col("data"), F.col("h"), F.col("w"), config.min_component_size))
    return fused
