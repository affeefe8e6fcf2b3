import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import cli, detectors, experiment, registry


@pytest.fixture(scope="module")
def patches(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for cls in ("a", "b"):
        for image in range(10):
            split = "train_good" if image < 4 else "train_anomaly" if image < 8 else "test"
            for pos in range(16):
                bad = split == "train_anomaly" and pos < 4
                rows.append((n, f"{cls}{image}", cls, split, f"t{image % 2}" if split == "train_anomaly" else None, image % 3, 4, 4, pos, (rng.normal(size=6) * 0.3 + (5 * (pos % 2) if bad else 1)).tolist(), int(bad)))
                n += 1
    return spark.createDataFrame(rows, "patch_id long, image_id string, cls string, split string, anomaly_type string, view int, h int, w int, pos int, embedding array<double>, label int")


@pytest.mark.parametrize("name,settings", [("memory_bank", {"coreset_frac": 0.2, "metric": "l2", "projection_dim": 6}), ("foreground_bank", {}), ("mixture_density", {"max_components": 4, "pca_dim": 4, "max_iter": 20})])
def test_detectors_rank_planted_defects(patches, name, settings):
    fitted = detectors.from_settings(name, settings).fit(patches.where("split = 'train_good'"))
    scored = fitted.score(patches.where("split = 'train_anomaly'"))
    bad, good = (scored.where(f"label = {k}").agg(F.avg("score")).first()[0] for k in (1, 0))
    assert scored.count() == 128 and bad > good


def test_plug_in_and_registry(patches):
    scored = detectors.PlugIn(lambda x: lambda y: np.abs(y - x.mean(0)).sum(1)).fit(patches.where("split = 'train_good'")).score(patches)
    assert scored.where("score >= 0").count() == patches.count()
    with pytest.raises(KeyError):
        detectors.get_detector("nope")
    assert len(detectors.BACKBONES) == 21 and len(detectors.list_detectors()) == 14
    with pytest.raises(ValueError):
        detectors.from_settings("memory_bank", {"nope": 1})
    with pytest.raises(ValueError):
        detectors.DetectorConfig(tta="nope")
    assert detectors.backbone("dinov2_vits14_reg")["channels"][0] == 384
    with pytest.raises(ValueError):
        detectors.validate_input_size("dinov2_vits14", 100)


def test_experiment_and_stack(spark, patches, tmp_path):
    run = experiment.run_experiment(patches, lambda: detectors.from_settings("memory_bank", {"metric": "l2", "projection_dim": 6}), out_dir=str(tmp_path))
    assert run.per_type.count() == 4 and 0.5 < run.pooled_ap <= 1
    other = experiment.run_experiment(patches, lambda: detectors.from_settings("foreground_bank", {}))
    maps = run.predictions.where("split = 'train_anomaly'").withColumnRenamed("data", "m0").join(other.predictions.select("image_id", F.col("data").alias("m1")), "image_id")
    images = maps.withColumn("sample_id", F.col("image_id"))
    config = experiment.StackerConfig(runs=("x", "y"), estimator="logreg", features=experiment.features.FeatureConfig(gaussian_sigmas=(), window_sizes=(), cross_consensus=False, spatial_prior=False))
    stacked = experiment.run_stacker(images, ["m0", "m1"], config)
    assert set(stacked.ap) == {"a", "b"} and stacked.predictions.where("calibrated between 0 and 1").count() == 128
    with pytest.raises(ValueError):
        experiment.StackerConfig(runs=("x",))


def test_detectors_over_given_outputs(spark, patches):
    flat = patches.limit(40).select("patch_id", "embedding", (F.col("patch_id") / 10).alias("logit"))
    vector = F.col("embedding")
    rows = flat.withColumns({"student": F.transform(vector, lambda x: x * 0.9), "decoder": F.transform(vector, lambda x: x + 0.1), "reconstruction": F.transform(vector, lambda x: x * 0.5), "latent": vector, "log_det": F.col("logit"), "logits": F.array(F.lit(0.0), F.col("logit")), "level_logits": F.array("logit", "logit")})
    rows = rows.withColumns({"teacher_layers": F.array("embedding", "student"), "student_layers": F.array("decoder", "embedding")})
    for name, z_scored in (("student_teacher", True), ("flow", True), ("reconstruction_transformer", True), ("distillation", False), ("corruption_discriminator", False), ("adversarial_discriminator", False), ("transparency_diffusion", False), ("text_synthesis", False)):
        got = detectors.from_settings(name, {}).fit(rows).score(rows).select("logit", "score").collect()
        scores = np.array([r["score"] for r in got])
        assert len(got) == 40 and np.isfinite(scores).all()
        if z_scored:
            assert abs(scores.mean()) < 1e-6
        elif name != "distillation":
            assert np.allclose(scores, [1 / (1 + np.exp(-r["logit"])) for r in got])


def test_windows_against_texts_and_references(patches):
    normal, anomalous = np.ones(6), np.array([1.0, -1, 1, -1, 1, -1])
    found = detectors.TextImageWindows(detectors.WindowConfig(window_sizes=(1, 2, 9), temperature=10.0, n_references=3), normal, anomalous).fit(patches.where("split = 'train_good'")).score(patches)
    assert found.count() == patches.count()
    shown = {r["label"]: r["s"] for r in found.groupBy("label").agg(F.avg("score").alias("s")).collect()}
    assert shown[1] > shown[0]
    grid = np.random.default_rng(0).normal(size=(4, 5, 3))
    window = grid[1:3, 2:4].mean((0, 1))
    assert np.allclose(detectors.scoring.image_windows(grid, 2)[1, 2], window / np.linalg.norm(window))
    same = np.random.default_rng(1).random((16, 16))
    assert abs(detectors.scoring.ssim_loss(same, same)) < 1e-9 < detectors.scoring.ssim_loss(same, 1 - same)


def test_stacked_tests_become_a_submission(spark, patches, tmp_path):
    from tessera.operators.priors import spatial_priors
    from tessera.sources import predictions

    runs = {}
    for name, settings in (("memory_bank", {"metric": "l2", "projection_dim": 6}), ("foreground_bank", {})):
        run = experiment.run_experiment(patches, lambda n=name, s=settings: detectors.from_settings(n, s), out_dir=f"{tmp_path}/{name}")
        runs[name] = run.predictions
        assert (tmp_path / name / "submission.csv").is_file() and (tmp_path / name / "submission.zip").is_file()
    maps = runs["memory_bank"].where("split = 'train_anomaly'").withColumnRenamed("data", "m0").join(runs["foreground_bank"].select("image_id", F.col("data").alias("m1")), "image_id").withColumn("sample_id", F.col("image_id"))
    maps = maps.withColumn("mask", F.when(F.col("cls") == "b", F.array_repeat(F.lit(0), 16)).otherwise(F.col("mask")))  # b has no positives, so no model
    tests = predictions.test_scores(spark, {"m0": f"{tmp_path}/memory_bank/submission.zip", "m1": f"{tmp_path}/foreground_bank/submission.csv"})
    assert tests.count() == 4 and tests.first()["h"] == predictions.SIDE
    tests = tests.select("image_id", F.lit(4).alias("h"), F.lit(4).alias("w"), *[F.slice(m, 1, 16).alias(m) for m in ("m0", "m1")])
    lookup = patches.select("image_id", "cls").distinct()
    config = experiment.StackerConfig(runs=("x", "y"), estimator="logreg", features=experiment.features.FeatureConfig(gaussian_sigmas=(1.0,), window_sizes=(3,)), min_component_size=1)
    done = experiment.run_stacker(maps, ["m0", "m1"], config, params={"max_iter": 10}, priors=spatial_priors(maps.select("cls", "h", "w", "mask"), 0.5), tests=tests, lookup=lookup, out_dir=str(tmp_path))
    assert set(done.ap) == {"a"} and 0 < done.overall <= 1
    fused = {r["image_id"]: r["data"] for r in done.fused.collect()}
    assert set(fused) == {"a8", "a9", "b8", "b9"} and all(len(v) == 16 and 0 <= min(v) and max(v) <= 1 for v in fused.values())
    assert done.submission.endswith("submission.zip") and predictions.read_submission(spark, done.submission).count() == 4
    assert predictions.read_ledger(spark, f"{tmp_path}/stack_ledger").first()["AP_a"] == f"{done.ap['a']:.4f}"


def test_ranks_of_maps_equal_ranks_of_pixels(spark):
    rng = np.random.default_rng(0)
    images = spark.createDataFrame([(k, k % 2, 0, 2, 2, rng.normal(size=4).tolist(), rng.integers(0, 2, 4).astype(float).tolist()) for k in range(6)], "image_id int, cls int, view int, h int, w int, m0 array<double>, m1 array<double>")
    for scope in ("global", "per_class", "per_image"):
        got = {r["image_id"]: (r["m0"], r["m1"]) for r in experiment.ranked_maps(images, ["m0", "m1"], scope).collect()}
        rows = images.collect()
        for m in (0, 1):
            groups = {}
            for r in rows:
                key = {"global": 0, "per_class": r["cls"], "per_image": r["image_id"]}[scope]
                groups.setdefault(key, []).extend((v, r["image_id"], p) for p, v in enumerate(r[f"m{m}"]))
            for held in groups.values():
                for place, (_, image, p) in enumerate(sorted(held)):
                    assert got[image][m][p] == pytest.approx(place / (len(held) - 1))


def test_settings_precedence():
    assert cli.merged({"a": 1, "b": None}, {"a": 2, "b": 3}, {"c": 4}) == {"a": 1, "b": 3, "c": 4}
    assert cli.main(["list"]) == 0


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
