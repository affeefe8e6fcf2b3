import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import alignment, priors, retrieval, scoring, stacking
from tessera.plans import tables
from tessera.sources import images, predictions


def test_view_names(spark):
    names = ["sample_view03.png", "class_01_good00_view00.png", "no_view_here.png", "odd_view12.jpeg"]
    base, view = T.parse_view(F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "n string").select(base, view).collect()]
    assert got == [("sample", 3), ("class_01_good00", 0), ("no_view_here", None), ("odd", 12)]


def test_tree_scan(spark, tmp_path):
    for name in ("class_01/train/good/a_view00.png", "class_01/train/dent/b.png", "class_01/ground_truth_train/dent/b.bmp", "class_01/test/x/y/c_view01.JPG", "class_01/train/good/notes.txt"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    rows = {r["stem"]: r for r in images.scan_dataset(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a_view00", "b", "c_view01"}
    assert rows["b"]["has_mask"] and rows["b"]["anomaly_type"] == "dent" and rows["b"]["view"] is None
    assert rows["a_view00"]["split"] == "train_good" and rows["c_view01"]["view"] == 1 and not rows["c_view01"]["has_mask"]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        images.scan_dataset(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        images.only_classes(images.scan_dataset(spark, str(tmp_path)), ["class_99"])


def test_digests_do_not_depend_on_order():
    assert T.config_digest({"a": 1, "b": (1, 2)}) == T.config_digest({"b": [1, 2], "a": 1.0})
    assert T.config_digest({"a": 1}) != T.config_digest({"a": 2})
    assert T.make_run_id("slug", {"a": 1}, "x", "now").rsplit("_", 1)[1] == T.make_run_id("slug", {"a": 1}, "y", "now").rsplit("_", 1)[1]


def test_keywords_and_prompts(spark):
    df = spark.createDataFrame([("nut", "A Crack and a rough edge"), ("nut", "An anomaly is present."), ("nut", None)], "o string, d string")
    assert df.select(T.keywords(F.col("d")).alias("k")).first()["k"] == ["a crack", "rough edges"]
    assert df.select(T.families(F.col("d")).alias("k")).collect()[2]["k"] == []
    prompts = {r["prompt"] for r in T.description_prompts(df, "o", "d").collect()}
    assert len(prompts) == 2 + 2 * 3 and "a nut showing rough edges" in prompts
    assert T.state_prompts(df.select("o").distinct(), "o", T.NORMAL_STATES).count() == 60


def test_ledger_widens(spark):
    out = predictions.append_ledger(spark.createDataFrame([("r1", "0.5")], "run_id string, AP string"), spark.createDataFrame([("r2", "0.6", "0.7")], "run_id string, AP string, AP_class_09 string"))
    assert {tuple(r) for r in out.collect()} == {("r1", "0.5", ""), ("r2", "0.6", "0.7")}


def test_submission_round_trip(spark, tmp_path):
    maps = spark.createDataFrame([("a", 2, 2, [0.0, 0.5, 1.0, 0.25]), ("b", 2, 2, [1.0] * 4)], "image_id string, h int, w int, data array<double>")
    rows = predictions.submission(maps, calibrate=False, side=2)
    predictions.write_submission(rows, str(tmp_path / "s"))
    back = {r["ID"]: r["data"] for r in predictions.submission_maps(predictions.read_submission(spark, str(tmp_path / "s"))).collect()}
    assert np.allclose(back["a"], [0.0, 0.5, 1.0, 0.25], atol=1 / 510 + 1e-9) and set(back["b"]) == {1.0}
    assert [r["ID"] for r in predictions.submission_maps(rows, spark.createDataFrame([("b",)], "ID string")).collect()] == ["b"]
    with pytest.raises(ValueError):
        predictions.submission(maps.unionByName(maps))


def test_predictions_at_rest(spark, tmp_path):
    schema = "image_id string, run_id string, split string, cls string, anomaly_type string, view int, h int, w int, data array<double>, mask array<int>"
    rows = [("i", "r", "local", "c", None, None, 1, 2, [float("nan"), 1.0], [0, 9]), ("j", "r", "local", "c", "t", 3, 1, 2, [0.0, 1.0], [0, 0])]
    predictions.write_predictions(spark.createDataFrame(rows, schema), str(tmp_path / "p"), with_masks=True)
    got = {r["image_id"]: r for r in predictions.read_predictions(spark, str(tmp_path / "p"), "r", "local").collect()}
    assert got["i"]["view"] == -1 and got["i"]["anomaly_type"] == "unknown" and got["i"]["data"] == [1.0, 1.0] and got["i"]["mask"] == [0, 1]
    with pytest.raises(ValueError):
        predictions.write_predictions(spark.createDataFrame([], schema), str(tmp_path / "q"))
    with pytest.raises(PySparkException):
        predictions.write_predictions(spark.createDataFrame([rows[0][:-1] + (None,)], schema), str(tmp_path / "r"), with_masks=True)


def test_alignment_keeps_shared_keys(spark):
    a, b = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k int, v double"), spark.createDataFrame([(2, 0.5), (3, 0.6)], "k int, v double")
    assert [tuple(r) for r in alignment.align({"a": a, "b": b}, "k", "v").collect()] == [(2, 0.2, 0.5)]
    assert {r["method"]: (r["n"], r["n_shared"]) for r in alignment.align_report({"a": a, "b": b}, "k").collect()} == {"a": (2, 1), "b": (2, 1)}
    with pytest.raises(PySparkException):
        alignment.with_class(a, spark.createDataFrame([(1, "x")], "k int, cls string"), "k", "cls").collect()


def vectors(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k", [1, 3, 100])
def test_bank_distances_equal_brute_force_in_both_forms(spark, metric, k, monkeypatch):
    df = vectors(spark)
    bank, asked = df.where("vec_id < 20"), df.where("vec_id >= 20")
    b, q = (np.array([r["embedding"] for r in x.orderBy("vec_id").collect()]) for x in (bank, asked))
    if metric == "cosine":
        d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    else:
        d = ((q[:, None] - b) ** 2).sum(2)
    want = np.sort(d, axis=1)[:, : min(k, 20)].mean(1)
    got = [r["distance"] for r in retrieval.bank_distances(asked, bank, k, metric).orderBy("vec_id").collect()]
    assert np.allclose(got, want)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    got = [r["distance"] for r in retrieval.bank_distances(asked, bank, k, metric).orderBy("vec_id").collect()]
    assert np.allclose(got, want)
    assert retrieval.bank_distances(asked, bank.limit(0), k, metric).where("distance is null").count() == 40


def test_coreset_is_greedy(spark):
    df = vectors(spark, 25)
    m = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    chosen, gap = [0], ((m - m[0]) ** 2).sum(1)
    while len(chosen) < 6:
        gap[chosen] = -1
        nxt = int(np.argmax(gap))
        chosen.append(nxt)
        gap = np.minimum(gap, ((m - m[nxt]) ** 2).sum(1))
    got = [r["vec_id"] for r in retrieval.coreset(df, 6, 1, "vec_id", "embedding").orderBy("turn").collect()]
    assert got == chosen


def test_components_explain_variance_and_foreground_ignores_sign(spark):
    df = vectors(spark, 80)
    m = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    centre, directions, share = retrieval.principal_components(df, 3, width=8)
    values = np.linalg.eigvalsh(np.cov(m.T, bias=True))[::-1]
    assert np.allclose(centre, m.mean(0)) and np.allclose(share, values[:3] / values.sum())
    pc = np.abs((m - m.mean(0)) @ directions[0])
    kept = {r["vec_id"] for r in retrieval.foreground(df, 75.0, width=8).collect()}
    assert kept == set(np.flatnonzero(pc >= np.percentile(pc, 25)).tolist())


def test_mixture_scores_and_fit():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(-3, 0.5, (150, 3)), rng.normal(3, 0.5, (150, 3))])
    weights, means, precisions = scoring.fit_mixture(rows, 6, steps=100)
    assert sorted(np.round(means[np.argsort(-weights)[:2], 0]).tolist()) == [-3.0, 3.0]
    full = scoring.mixture_log_density_full(rows[:5], weights, means, np.array([np.diag(np.sqrt(p)) for p in precisions]))
    by_hand = [np.log(sum(w * np.prod(np.sqrt(p / (2 * np.pi)) * np.exp(-0.5 * p * (x - m) ** 2)) for w, m, p in zip(weights, means, precisions, strict=True))) for x in rows[:5]]
    assert np.allclose(full, by_hand)


def test_coupling_and_ascent():
    x = np.random.default_rng(0).normal(size=(4, 6))
    y, log_det = scoring.coupling(x, lambda h: (h * 3, h - 1))
    assert np.allclose(y[:, :3], x[:, :3]) and np.allclose(log_det, (2 * np.tanh(x[:, :3] * 3 / 2)).sum(1))
    w = np.array([1.0, -2.0, 0.0, 1.0, 1.0, 1.0])
    assert ((scoring.gradient_ascent(x, w) - x) @ w > 0).all()


def test_neighbour_mask_bounds(spark):
    with pytest.raises(ValueError):
        scoring.neighbour_mask(spark, 4, 4, 2)


def test_cross_validation_predicts_every_row(spark):
    rng = np.random.default_rng(0)
    rows = []
    for image in range(6):
        for p in range(60):
            y = int(rng.random() < 0.2)
            rows.append((image * 60 + p, image, f"t{image % 3}", f"s{image % 3}", y, float(y + rng.normal(0, 0.4)), float(rng.normal())))
    df = spark.createDataFrame(rows, "k long, image int, anomaly_type string, sample_id string, label int, signal double, noise double")
    folded = stacking.folds(df, "loao")
    out = stacking.out_of_fold(folded, lambda: stacking.build_estimator("logreg", ["signal", "noise"]), "image", "k")
    assert out.where("prediction is not null").count() == 360
    assert stacking.pooled_cv_score(out) > 1.5 * 0.2
    with pytest.raises(ValueError):
        stacking.folds(df, "nope")
    trees = stacking.build_estimator("gbt", ["signal", "noise"], trees=4, depth=3).fit(df)
    assert set(trees.importance()) == {"signal", "noise"} and trees.predict(df).where("prediction between 0 and 1").count() == 360


def test_subsample_and_stratified(spark):
    df = spark.createDataFrame([(i, i // 50, int(i % 25 == 0 and i < 100)) for i in range(200)], "k long, image int, label int")
    out = stacking.subsample(df, "label", "image", "k", 3)
    assert out.groupBy("image").count().count() == 2 and out.count() == 2 * (2 + 6)
    cut = stacking.stratified(df, "label", "k", 20)
    assert cut.count() == 20 and cut.where("label = 1").count() == 4


def test_calibration_is_monotone_and_falls_back(spark):
    rng = np.random.default_rng(0)
    p = rng.random(2000)
    df = spark.createDataFrame([(i, float(x), int(rng.random() < x / 2)) for i, x in enumerate(p)], "k long, prediction double, label int")
    for method in ("isotonic", "platt"):
        got = stacking.fit_calibrator(df, method).apply(df).orderBy("prediction").select("calibrated").collect()
        values = [r[0] for r in got]
        assert all(a <= b + 1e-12 for a, b in zip(values, values[1:], strict=False)) and 0 <= values[0] <= values[-1] <= 1
    assert stacking.fit_calibrator(df.withColumn("label", F.lit(0)), "isotonic").method == "none"


def test_submission_checks(spark):
    good = spark.createDataFrame([(str(i), f"q8rle 2 2 {i} 4") for i in range(10)], "ID string, Label string")
    assert priors.check_submission(good).count() == 0
    bad = good.unionByName(spark.createDataFrame([("z", "q8rle 1 1 255 1")], "ID string, Label string"))
    assert {r["level"] for r in priors.check_submission(bad).collect()} == {"error", "warning"}


def test_description_prompts_take_whole_texts(spark, tmp_path):
    start = "x" * 50
    docs = spark.createDataFrame([("en", f"{start} a password"), ("en", f"{start} zzz")], "lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["prompt"] for r in tables.q_description_prompts(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 2 + 2 * 3 and f"a photo of a defective en: {start} zzz" in got and "a en showing third" in got


def test_mixture_fit_takes_more_than_400_whole_vectors(spark, small, tmp_path, monkeypatch):
    seen, fit = [], scoring.fit_mixture
    monkeypatch.setattr(scoring, "fit_mixture", lambda rows, *a, **b: (seen.append(rows.shape), fit(rows, *a, **b))[1])
    assert tables.q_mixture_fit(spark, small).where("log_density is not null").count() > 1
    assert seen == [(500, 64)]


def test_bank_queries_score_every_row_against_the_other_normal_rows(spark, small, monkeypatch):
    rows = sorted(tables.vectors(spark, small).collect())
    m, normal = np.array([r["embedding"] for r in rows]), np.array([r["label"] == 0 for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - m @ m.T
    d[:, ~normal] = np.inf
    np.fill_diagonal(d, np.inf)
    for query, k in ((tables.QUERIES["knn_bank_k3"], 3), (tables.QUERIES["stream_bank"], 1)):
        got = {r["vec_id"]: r["distance"] for r in query(spark, small).collect()}
        assert np.allclose([got[r["vec_id"]] for r in rows], np.sort(d, axis=1)[:, :k].mean(1), atol=1e-5)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    got = {r["vec_id"]: r["distance"] for r in tables.QUERIES["knn_bank_k1"](spark, small).collect()}
    assert np.allclose([got[r["vec_id"]] for r in rows], d.min(1), atol=1e-5)
