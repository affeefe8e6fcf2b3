import numpy as np
import pytest

from tessera.operators.metrics import average_precision, hard_mean, order_statistic
from tessera.operators.ordering import calibration, ecdf, rank_normalise, running_totals


def ap(spark, scores, labels):
    rows = [(float(s), int(y)) for s, y in zip(scores, labels, strict=True)]
    return average_precision(spark.createDataFrame(rows, "score double, label int"), "score", "label").first()["ap"]


def reference(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    out, before = 0.0, 0.0
    for t in sorted(set(scores.tolist()), reverse=True):
        hit = scores >= t
        recall = labels[hit].sum() / labels.sum()
        out += (recall - before) * labels[hit].mean()
        before = recall
    return out


def test_perfect_ranking(spark):
    assert ap(spark, [0.9, 0.8, 0.1, 0.0], [1, 1, 0, 0]) == 1.0


def test_no_positives_and_no_rows(spark):
    assert ap(spark, [0.5, 0.2], [0, 0]) == 0.0
    assert ap(spark, [], []) == 0.0


def test_ties_and_increasing_maps(spark):
    rng = np.random.default_rng(0)
    scores, labels = rng.integers(0, 12, 300) / 10, (rng.random(300) < 0.2).astype(int)
    want = reference(scores, labels)
    assert ap(spark, scores, labels) == pytest.approx(want)
    assert ap(spark, np.exp(scores) * 3 - 1, labels) == pytest.approx(want)


def test_groups_agree_with_single_runs(spark):
    rows = [("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.1, 1), ("b", 0.9, 0)]
    got = {r["g"]: r["ap"] for r in average_precision(spark.createDataFrame(rows, "g string, score double, label int"), "score", "label", ("g",)).collect()}
    assert got == {"a": 1.0, "b": 0.5}


def test_ranks(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 3.0), (3, 9.0)], "i int, v double")
    got = {r["i"]: r["rank"] for r in rank_normalise(df, "v", ["i"], "global").collect()}
    assert got == {0: 2 / 3, 1: 0.0, 2: 1 / 3, 3: 1.0}
    tied = spark.createDataFrame([(0, 2.0), (1, 2.0), (2, 2.0), (3, 1.0)], "i int, v double")
    got = {r["i"]: r["rank"] for r in rank_normalise(tied, "v", ["i"], "global").collect()}
    assert got[3] == 0.0 and [got[i] for i in range(3)] == [1 / 3, 2 / 3, 1.0]
    shared = {r["i"]: r["rank"] for r in rank_normalise(tied, "v", ["i"], "global", ties="average").collect()}
    assert shared[0] == shared[1] == shared[2] == pytest.approx(2 / 3)


def test_rank_scopes(spark):
    rows = [(k, i, k % 2, 0.1 if k % 2 else 10.0) for k in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id int, p int, cls int, v double")
    whole = {(r["image_id"], r["p"]): r["rank"] for r in rank_normalise(df, "v", ["image_id", "p"], "global").collect()}
    assert max(v for (k, _), v in whole.items() if k % 2) < min(v for (k, _), v in whole.items() if k % 2 == 0)
    with pytest.raises(ValueError):
        rank_normalise(df, "v", ["p"], "per_class_view")
    with pytest.raises(ValueError):
        rank_normalise(df, "v", ["p"], "sideways")


def test_running_totals_without_groups_equal_the_window(spark):
    df = spark.range(500).selectExpr("id", "pmod(hash(id), 50) AS v")
    got = {r["id"]: r["s"] for r in running_totals(df, (), [df["v"], df["id"]], {"s": "v"}).collect()}
    total = 0
    for r in df.orderBy("v", "id").collect():
        total += r["v"]
        assert got[r["id"]] == total


def test_ecdf_counts_strictly_below(spark):
    reference_rows = spark.createDataFrame([(float(i),) for i in range(100)], "r double")
    df = spark.createDataFrame([(0, 50.0), (1, -1.0), (2, 1000.0)], "i int, v double")
    assert {r["i"]: r["ecdf"] for r in ecdf(df, "v", reference_rows, "r", "i").collect()} == {0: 0.5, 1: 0.0, 2: 1.0}
    assert {r["ecdf"] for r in ecdf(df, "v", reference_rows.limit(0), "r", "i").collect()} == {0.0}


def test_calibration_of_a_constant(spark):
    row = calibration(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").first()
    assert row["lo"] == 3.0 and row["hi"] > row["lo"]


def test_order_statistic_and_hard_mean(spark):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(10)], "i int, g string, v double")
    assert order_statistic(df, "v", 90.0, ("g",), "i").first()["picked"] == 9.0
    assert hard_mean(df, "v", 0.2, "i").first()["hard_mean"] == 8.5
