import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import raster as R
from tessera.operators import features, fusion, priors, synthesis
from tessera.operators.components import label_regions, parse_sizes, suppress_small
from tessera.sources.predictions import sanitised


@pytest.fixture(scope="module")
def grid(spark):
    data = np.random.default_rng(3).normal(size=(6, 9))
    return data, spark.createDataFrame([(data.ravel().tolist(), 6, 9)], "d array<double>, h int, w int")


def take(df, column):
    return np.array(df.select(column.alias("x")).first()["x"])


def test_native_and_arrow_stencils_agree(grid):
    _, df = grid
    for kind, size, native in (("mean", 5, R.window_mean), ("max", 3, R.window_max), ("std", 7, R.window_std), ("gaussian", 1.5, R.gaussian)):
        a, b = take(df, native(F.col("d"), F.col("h"), F.col("w"), size)), take(df, R.numpy_stencil(kind, size)(F.col("d"), F.col("h"), F.col("w")))
        assert np.allclose(a, b), kind


def test_gaussian_keeps_shape_and_lowers_variance(grid):
    data, df = grid
    assert np.allclose(take(df, R.gaussian(F.col("d"), F.col("h"), F.col("w"), 0)), data.ravel())
    smooth = take(df, R.gaussian(F.col("d"), F.col("h"), F.col("w"), 2.0))
    assert smooth.shape == (54,) and smooth.var() < data.var()


def test_rotations_and_mirrors_invert(grid):
    data, df = grid
    for q in range(4):
        h, w = (F.col("w"), F.col("h")) if q % 2 else (F.col("h"), F.col("w"))
        turned = R.rotate(F.col("d"), F.col("h"), F.col("w"), q)
        assert np.allclose(take(df, turned), np.rot90(data, q).ravel())
        back = df.select(turned.alias("d"), h.alias("h"), w.alias("w"))
        assert np.allclose(take(back, R.rotate(F.col("d"), F.col("h"), F.col("w"), -q % 4)), data.ravel())
    assert np.allclose(take(df, R.flip_columns(F.col("d"), F.col("h"), F.col("w"))), data[:, ::-1].ravel())
    assert np.allclose(take(df, R.flip_rows(F.col("d"), F.col("h"), F.col("w"))), data[::-1].ravel())


@pytest.mark.parametrize("mode,passes", [("none", 1), ("hflip", 2), ("vflip", 2), ("hvflip", 3), ("d4", 8)])
def test_tta_of_an_equivariant_scorer_changes_nothing(grid, mode, passes):
    data, df = grid
    assert len(R.TTA[mode]) == passes
    assert np.allclose(take(df, R.tta(F.col("d"), F.col("h"), F.col("w"), mode, lambda d, h, w: F.transform(d, lambda x: x * 2))), 2 * data.ravel())


def test_nearest_keeps_a_binary_mask_binary(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.0, 0.0], 2, 2)], "d array<double>, h int, w int")
    assert set(take(df, R.resize_nearest(F.col("d"), F.col("h"), F.col("w"), 5, 7))) == {0.0, 1.0}


def test_bilinear_keeps_a_constant_and_the_same_size(grid, spark):
    data, df = grid
    assert np.allclose(take(df, R.resize_bilinear(F.col("d"), F.col("h"), F.col("w"), 6, 9)), data.ravel())


def test_non_finite_pixels(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([nan, 1.0, inf, 0.0],), ([-inf, 2.0, 5.0, nan],), ([nan, inf],), ([-5.0, 1000.0],)]
    got = [r["x"] for r in spark.createDataFrame(rows, "d array<double>").select(sanitised(F.col("d")).alias("x")).collect()]
    assert got == [[0.0, 1.0, 1.0, 0.0], [2.0, 2.0, 5.0, 2.0], [0.0, 0.0], [-5.0, 1000.0]]


def flood(hot):
    labels, n = np.zeros(hot.shape, dtype=int), 0
    for r, c in np.argwhere(hot):
        if labels[r, c]:
            continue
        n += 1
        stack = [(r, c)]
        while stack:
            y, x = stack.pop()
            if 0 <= y < hot.shape[0] and 0 <= x < hot.shape[1] and hot[y, x] and not labels[y, x]:
                labels[y, x] = n
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return labels


def test_regions_equal_a_flood_fill():
    for seed in range(20):
        hot = np.random.default_rng(seed).random((13, 17)) < 0.55
        a, b = label_regions(hot), flood(hot)
        assert (a > 0).tolist() == (b > 0).tolist()
        assert len(set(zip(a.ravel(), b.ravel(), strict=True))) == len(set(b.ravel().tolist()))
    snake = np.zeros((9, 9), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert label_regions(snake).max() == 1


def test_small_regions_are_filled():
    data = np.zeros((8, 8))
    data[0, 0] = data[4:7, 4:7] = 1.0
    out = suppress_small(data.ravel(), 8, 8, 1, 90.0).reshape(8, 8)
    assert out[0, 0] == 0 and out[5, 5] == 1
    assert (suppress_small(data.ravel(), 8, 8, 0) == data.ravel()).all()


def test_size_specs():
    assert parse_sizes("6", ["a", "b"]) == {"a": 6, "b": 6}
    assert parse_sizes("a=8,b=4", ["a", "b"]) == {"a": 8, "b": 4}
    with pytest.raises(ValueError):
        parse_sizes("z=1", ["a"])


def test_feature_names_match_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 4, 4, i % 2, i, *[rng.random(16).tolist() for _ in range(3)]) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id int, h int, w int, cls int, view int, a array<double>, b array<double>, c array<double>")
    config = features.FeatureConfig(gaussian_sigmas=(1.0,), window_sizes=(3,), window_max=True, window_std=True, gradient=True, laplacian=True, image_aggregates=("imgmax", "imgp99", "imgmean", "imgstd"))
    out = features.featurize(df, ["a", "b", "c"], [0, 1], config)
    assert out.columns[3:] == features.feature_names(3, [0, 1], config)
    assert len(set(out.columns)) == len(out.columns)
    alone = features.featurize(df.where("image_id = 1"), ["a", "b", "c"], [0, 1], config)
    both = out.where("image_id = 1").orderBy("r", "c").collect()
    assert both == alone.orderBy("r", "c").collect()
    single = features.feature_names(1, [0, 1], config)
    assert not any(n.startswith("x") for n in single)
    assert len(features.feature_names(4, list("abcdefgh"), prior=True)) == 6 * 4 + 9 + 5 + 8 + 5
    with pytest.raises(ValueError):
        features.FeatureConfig(image_aggregates=("nope",))


def test_fusion_rules(spark):
    df = spark.createDataFrame([(0, [0.2, 0.8])], "i int, m array<double>")

    def one(rule, weights=None, data=df):
        return fusion.fuse(data, "m", 2, rule, ["i"], weights).first()["fused"]

    assert one("mean") == pytest.approx(0.5) and one("max") == 0.8 and one("median") == pytest.approx(0.5)
    assert one("mean", [3, 1], spark.createDataFrame([(0, [0.0, 1.0])], "i int, m array<double>")) == pytest.approx(0.25)
    for bad in ((("max"), [1, 1]), ("mean", [1]), ("mean", [-1, 2]), ("nope", None)):
        with pytest.raises(ValueError):
            one(*bad)


def test_prior_of_masks(spark):
    masks = spark.createDataFrame([("a", 4, 4, [0] * 5 + [1] + [0] * 10), ("a", 4, 4, [0] * 16), ("b", 4, 4, [0] * 16)], "cls string, h int, w int, mask array<int>")
    got = {r["cls"]: r for r in priors.spatial_priors(masks, 0.0).collect()}
    assert max(got["a"]["heat"]) == 1.0 and got["a"]["coverage"] == pytest.approx(1 / 32) and max(got["b"]["heat"]) == 0.0


def test_synthesis_is_seeded_and_paints_inside_its_mask():
    image = np.full((32, 32), 0.5)
    for maker in (synthesis.corruption, synthesis.cut_paste, synthesis.scar, lambda x, g: synthesis.inject(x, list(synthesis.SHAPES), g)):
        a, mask = maker(image, synthesis.row_generator("k", 1))
        b, _ = maker(image, synthesis.row_generator("k", 1))
        assert (a == b).all() and a.min() >= 0 and a.max() <= 1
        assert ((a != image) <= (mask > 0)).all()
    thin, mask = synthesis.scar(np.zeros((4, 4)), synthesis.row_generator(0))
    assert not mask.any() and not thin.any()
    noise = synthesis.fractal(32, 32, 4, 3, synthesis.row_generator(0))
    assert noise.shape == (32, 32) and noise.std() > 0
    assert synthesis.defect_families(None) and synthesis.defect_families(["nope"]) == list(synthesis.SHAPES)
