"""Queries over the ``embeddings`` table read as 8 x 8 score maps, with their SQL.

A vector of 64 values is a row-major map; the class is ``label`` and the view
``vec_id % 5``. Three methods are the values, their sizes, and the next row's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import codec
from tessera.functions import raster as R
from tessera.operators import features, fusion, ordering, priors, synthesis
from tessera.operators.components import suppress_small_components
from tessera.sources.predictions import sanitised

PX = """px AS (
  SELECT vec_id AS image_id, label AS cls, vec_id % 5 AS view, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST(i AS INTEGER) AS p,
         CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM embeddings, range(64) t(i))"""
ME = """next_of AS MATERIALIZED (SELECT vec_id AS id, label, embedding AS e, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS following FROM embeddings),
  both_of AS MATERIALIZED (SELECT a.id, a.label, a.e, b.e AS f FROM next_of a JOIN next_of b ON b.id = a.following),
  me AS MATERIALIZED (
  SELECT id AS image_id, label AS cls, id % 5 AS view, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST(i AS INTEGER) AS p,
         CAST(e[i + 1] AS DOUBLE) AS m0, abs(CAST(e[i + 1] AS DOUBLE)) AS m1, CAST(f[i + 1] AS DOUBLE) AS m2
  FROM both_of, range(64) t(i))"""


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("image_id"), F.col("label").alias("cls"), (F.col("vec_id") % 5).alias("view"), F.lit(8).alias("h"), F.lit(8).alias("w"), A.as_double(F.col("embedding")).alias("data"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps with ``m0, m1, m2``; the last row's neighbour is row 0."""
    rows = maps(spark, sf_dir)
    n = rows.count()
    following = rows.select(F.pmod(F.col("image_id") - 1, F.lit(n)).alias("image_id"), F.col("data").alias("m2"))
    return rows.join(following, "image_id").select("*", F.col("data").alias("m0"), F.transform("data", lambda x: F.abs(x)).alias("m1")).select("image_id", "cls", "view", "h", "w", "m0", "m1", "m2")


def pixels(df: DataFrame, data: Column, *keys: str, width: int = 8, digits: int = 6) -> DataFrame:
    """``keys, r, c, v`` of a map expression."""
    long = A.each(df, list(keys), data, "_p", "_v")
    value = F.round("_v", digits) if digits else F.col("_v")
    return long.select(*keys, F.floor(F.col("_p") / width).cast("int").alias("r"), (F.col("_p") % width).alias("c"), value.alias("v"))


def _on_maps(f) -> callable:
    return lambda spark, d: pixels(maps(spark, d), f(F.col("data")), "image_id")


def _refl(e: str) -> str:
    m = f"((({e}) % 16 + 16) % 16)"
    return f"CASE WHEN {m} < 8 THEN {m} ELSE 15 - {m} END"


def _pass(source: str, name: str, offsets, weights, rows: bool) -> str:
    table = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in zip(offsets, weights, strict=True))
    at = f"b.c = a.c AND b.r = {_refl('a.r + k.o')}" if rows else f"b.r = a.r AND b.c = {_refl('a.c + k.o')}"
    return f"{name} AS (SELECT a.image_id, a.r, a.c, sum(b.v * k.w) AS v FROM {source} a CROSS JOIN (VALUES {table}) k(o, w) JOIN {source} b ON b.image_id = a.image_id AND {at} GROUP BY a.image_id, a.r, a.c)"


def _separable(offsets, weights) -> str:
    return f"WITH {PX}, {_pass('px', 'down', offsets, weights, True)}, {_pass('down', 'both_', offsets, weights, False)} SELECT image_id, r, c, round(v, 6) AS v FROM both_"


_SEVEN = list(range(-3, 4))
_BLUR, _STEP, _SECOND = ([-1, 0, 1], [1.0, 2.0, 1.0]), ([-1, 1], [-1.0, 1.0]), ([-1, 0, 1], [1.0, -2.0, 1.0])


def _bilinear_sql(n: int) -> str:
    return f"""WITH {PX}, grid AS (
      SELECT CAST(i // {n} AS INTEGER) AS r, CAST(i % {n} AS INTEGER) AS c,
             greatest(0.0::DOUBLE, least((i // {n} + 0.5::DOUBLE) * 8 / {n} - 0.5::DOUBLE, 7.0::DOUBLE)) AS y, greatest(0.0::DOUBLE, least((i % {n} + 0.5::DOUBLE) * 8 / {n} - 0.5::DOUBLE, 7.0::DOUBLE)) AS x FROM range({n * n}) t(i)),
    spot AS (SELECT r, c, CAST(floor(y) AS INTEGER) AS y0, CAST(floor(x) AS INTEGER) AS x0, y - floor(y) AS fy, x - floor(x) AS fx FROM grid),
    w AS (
      SELECT r, c, y0 AS sr, x0 AS sc, (1 - fy) * (1 - fx) AS k FROM spot UNION ALL SELECT r, c, y0, least(x0 + 1, 7), (1 - fy) * fx FROM spot
      UNION ALL SELECT r, c, least(y0 + 1, 7), x0, fy * (1 - fx) FROM spot UNION ALL SELECT r, c, least(y0 + 1, 7), least(x0 + 1, 7), fy * fx FROM spot)
    SELECT p.image_id, w.r, w.c, round(sum(p.v * w.k), 6) AS v FROM w JOIN px p ON p.r = w.sr AND p.c = w.sc GROUP BY p.image_id, w.r, w.c"""


def _rank(scope: str):
    def run(spark, d):
        df = maps(spark, d)
        long = pixels(df, F.col("data"), "image_id", "cls", "view", digits=0)
        out = ordering.rank_normalise(long, "v", ["image_id", "r", "c"], scope)
        return out.select("image_id", "r", "c", F.round("rank", 9).alias("rank"))

    return run


def _rank_sql(groups: str) -> str:
    over = f"PARTITION BY {groups}" if groups else ""
    return f"WITH {PX}, k AS (SELECT image_id, r, c, row_number() OVER ({over} ORDER BY v, image_id, r, c) AS place, count(*) OVER ({over}) AS n FROM px) SELECT image_id, r, c, round(CASE WHEN n > 1 THEN (place - 1)::DOUBLE / (n - 1) ELSE 0 END, 9) AS rank FROM k"


def _tta(mode: str):
    def scorer(data: Column, h: Column, w: Column) -> Column:
        return F.transform(data, lambda x, p: x + 0.1 * F.floor(p / w))

    return lambda spark, d: pixels(maps(spark, d), R.tta(F.col("data"), F.lit(8), F.lit(8), mode, scorer), "image_id")


def q_cross_method(spark, d):
    held = features.FeatureConfig()
    long = A.each(methods(spark, d), ["image_id"], F.arrays_zip("m0", "m1", "m2"), "_p", "_x")
    at = F.array("_x.m0", "_x.m1", "_x.m2")
    columns = [F.round(x, 5).alias(n) for n, x in features.cross_method(held, at, 3) if n in ("x_mean", "x_max", "x_min", "x_std", "x_range")]
    return long.select("image_id", F.col("_p").alias("p"), *columns)


def q_consensus(spark, d):
    """Consensus counts over per-image ranks, so that the bounds of 0.99 and 0.95 mean something."""
    held = features.FeatureConfig(cross_stats=False, cross_cv=False, min_top_k=0)
    ranked = A.each(methods(spark, d), ["image_id"], F.arrays_zip(*[features.image_rank(F.col(m)).alias(m) for m in ("m0", "m1", "m2")]), "_p", "_x")
    return ranked.select("image_id", F.col("_p").alias("p"), *[x.cast("long").alias(n) for n, x in features.cross_method(held, F.array("_x.m0", "_x.m1", "_x.m2"), 3)])


def q_min_top_k(spark, d):
    long = A.each(methods(spark, d), ["image_id"], F.arrays_zip("m0", "m1", "m2"), "_p", "_x")
    at = F.array("_x.m0", "_x.m1", "_x.m2")
    return long.select("image_id", F.col("_p").alias("p"), A.largest(at, 3).alias("xc_min_top3"), A.largest(at, 2).alias("xc_min_top2"), F.round(A.deviation(at) / (A.mean(at) + 1e-6), 4).alias("xc_cv")).where(F.abs(A.mean(F.array("xc_min_top3", "xc_min_top2"))) > 0.01)


FEATURES = features.FeatureConfig(gaussian_sigmas=(1.0,), window_sizes=(3,), spatial_prior=False, views=(0, 1, 2, 3, 4))


def q_featurize(spark, d):
    out = features.featurize(methods(spark, d), ["m0", "m1", "m2"], list(range(10)), FEATURES)
    return out.select("image_id", "r", "c", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in out.columns if c not in ("image_id", "r", "c", "xc_cv")])


def _featurize_sql() -> str:
    gauss = R.gaussian_weights(1.0)
    three = ([-1, 0, 1], [1 / 3] * 3)
    parts, joins, cols = [PX, ME], [], []
    for i in range(3):
        parts.append(f"s{i} AS (SELECT image_id, r, c, p, m{i} AS v FROM me)")
        parts += [_pass(f"s{i}", f"gd{i}", *gauss, True), _pass(f"gd{i}", f"g{i}", *gauss, False), _pass(f"s{i}", f"wd{i}", *three, True), _pass(f"wd{i}", f"w{i}", *three, False)]
        parts.append(f"a{i} AS (SELECT image_id, quantile_cont(v, 0.99) AS p99, stddev_pop(v) AS sd FROM s{i} GROUP BY image_id)")
        parts.append(f"k{i} AS (SELECT image_id, r, c, (row_number() OVER (PARTITION BY image_id ORDER BY v, p) - 1)::DOUBLE / 63 AS rank FROM s{i})")
        joins += [f"JOIN g{i} USING (image_id, r, c) JOIN w{i} USING (image_id, r, c) JOIN a{i} USING (image_id) JOIN k{i} USING (image_id, r, c)"]
        cols += [f"round(m{i}, 4) AS m{i}_raw", f"round(k{i}.rank, 4) AS m{i}_rank", f"round(g{i}.v, 4) AS m{i}_g1", f"round(w{i}.v, 4) AS m{i}_mean3", f"round(a{i}.p99, 4) AS m{i}_imgp99", f"round(a{i}.sd, 4) AS m{i}_imgstd"]
    mean = "((m0 + m1 + m2) / 3)"
    cols += [f"round({mean}, 4) AS x_mean", "round(greatest(m0, m1, m2), 4) AS x_max", "round(least(m0, m1, m2), 4) AS x_min"]
    cols += [f"round(sqrt(((m0 - {mean}) ** 2 + (m1 - {mean}) ** 2 + (m2 - {mean}) ** 2) / 3), 4) AS x_std", "round(greatest(m0, m1, m2) - least(m0, m1, m2), 4) AS x_range"]
    cols += [f"CAST((m0 >= {b})::INT + (m1 >= {b})::INT + (m2 >= {b})::INT AS DOUBLE) AS xc_top{n}pct" for n, b in ((1, 0.99), (5, 0.95))]
    cols += ["round(least(m0, m1, m2), 4) AS xc_min_top3", "round(c / 7.0::DOUBLE, 4) AS s_x", "round(r / 7.0::DOUBLE, 4) AS s_y"]
    cols += ["round(sqrt((c / 7.0::DOUBLE - 0.5) ** 2 + (r / 7.0::DOUBLE - 0.5) ** 2), 4) AS s_dist_center", "round(least(c / 7.0::DOUBLE, 1 - c / 7.0::DOUBLE, r / 7.0::DOUBLE, 1 - r / 7.0::DOUBLE), 4) AS s_dist_edge"]
    cols += [f"CAST((cls = {k})::INT AS DOUBLE) AS c_{k}" for k in range(10)] + [f"CAST((view = {k})::INT AS DOUBLE) AS v_{k}" for k in range(5)]
    return f"WITH {', '.join(parts)} SELECT image_id, r, c, {', '.join(cols)} FROM me {' '.join(joins)}"


def _masks(spark, d) -> DataFrame:
    return maps(spark, d).select("cls", "h", "w", F.transform("data", lambda x: (x > 0.15).cast("int")).alias("mask"))


def q_prior_heat(spark, d):
    out = priors.spatial_priors(_masks(spark, d), 1.0)
    return pixels(out, F.col("heat"), "cls")


def q_centre_bias(spark, d):
    out = priors.spatial_priors(_masks(spark, d), 0.0)
    return out.select("cls", F.round("coverage", 6).alias("coverage"), F.round(priors.centre_bias(F.col("heat"), F.col("h"), F.col("w")), 6).alias("centre_bias"))


_MEAN_MASK = f"WITH {PX}, mean AS (SELECT cls AS image_id, r, c, avg((v > 0.15)::INT) AS v FROM px GROUP BY cls, r, c)"


def q_encode(spark, d):
    quantised = codec.quantise(F.transform("data", lambda x: F.abs(x)))
    return maps(spark, d).select("image_id", codec.encode(quantised, F.col("h"), F.col("w")).alias("label"))


def q_decode(spark, d):
    return pixels(q_encode(spark, d).select("image_id", codec.decode(F.col("label")).alias("x")), F.col("x"), "image_id", digits=0)


def q_shape(spark, d):
    h, w = codec.shape(F.col("label"))
    return q_encode(spark, d).select("image_id", h.alias("h"), w.alias("w"), F.size(F.split("label", " ")).alias("n_tokens"))


def q_errors(spark, d):
    """What is wrong with payloads that are broken on purpose, one way for each remainder of the id."""
    broken = F.expr("""CASE image_id % 7 WHEN 0 THEN label WHEN 1 THEN 'rle' || substring(label, 6) WHEN 2 THEN 'q8rle 2' WHEN 3 THEN label || ' 5'
        WHEN 4 THEN label || ' 300 4' WHEN 5 THEN label || ' 5 3' ELSE 'q8rle 4 5' END""")
    return q_encode(spark, d).select("image_id", F.coalesce(codec.problem(broken), F.lit("fine")).alias("problem"))


_Q8 = "CAST(greatest(0, least(255, round_even(CAST(CAST(abs(v) AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE), 0))) AS INTEGER)"
_ENCODE_SQL = f"""WITH {PX}, q AS (SELECT image_id, c * 8 + r AS k, {_Q8} AS x FROM px),
  e AS (SELECT *, CASE WHEN x IS DISTINCT FROM lag(x) OVER w THEN 1 ELSE 0 END AS b FROM q WINDOW w AS (PARTITION BY image_id ORDER BY k)),
  g AS (SELECT *, sum(b) OVER (PARTITION BY image_id ORDER BY k) AS run FROM e),
  n AS (SELECT image_id, run, min(x) AS x, count(*) AS n FROM g GROUP BY image_id, run),
  labels AS (SELECT image_id, 'q8rle 8 8 ' || string_agg(x || ' ' || n, ' ' ORDER BY run) AS label FROM n GROUP BY image_id)"""


def q_small_components(spark, d):
    cleaned = suppress_small_components(F.col("data"), F.col("h"), F.col("w"), 2, 85.0)
    return pixels(maps(spark, d), cleaned, "image_id")


_COMPONENTS_SQL = f"""WITH RECURSIVE {PX}, bound AS (SELECT image_id, quantile_cont(v, 0.85) AS q FROM px GROUP BY image_id),
  hot AS (SELECT image_id, r, c, p FROM px JOIN bound USING (image_id) WHERE v >= q),
  reach AS (SELECT image_id, r, c, p AS root FROM hot UNION SELECT h.image_id, h.r, h.c, x.root FROM reach x JOIN hot h ON h.image_id = x.image_id AND abs(h.r - x.r) + abs(h.c - x.c) = 1),
  region AS (SELECT image_id, r, c, min(root) AS root FROM reach GROUP BY image_id, r, c),
  size AS (SELECT image_id, root, count(*) AS n FROM region GROUP BY image_id, root)
  SELECT p.image_id, p.r, p.c, round(CASE WHEN n <= 2 THEN 0 ELSE v END, 6) AS v FROM px p LEFT JOIN region g ON g.image_id = p.image_id AND g.r = p.r AND g.c = p.c LEFT JOIN size s ON s.image_id = g.image_id AND s.root = g.root"""


def _fuse(rule: str, weights=None):
    def run(spark, d):
        df = A.each(methods(spark, d), ["image_id"], F.arrays_zip("m0", "m1", "m2"), "p", "_x").select("image_id", "p", F.array("_x.m0", "_x.m1", "_x.m2").alias("m"))
        out = fusion.fuse(df, "m", 3, rule, ["image_id", "p"], weights)
        return out.select("image_id", "p", F.round("fused", 5).alias("fused"))

    return run


def _fuse_sql(expression: str) -> str:
    return f"WITH {PX}, {ME} SELECT image_id, p, round({expression}, 5) AS fused FROM me"


def q_view_norm_fit(spark, d):
    long = maps(spark, d).select("view", F.explode("data").alias("v"))
    return ordering.calibration(long, "v", by=("view",)).select("view", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def q_view_norm_apply(spark, d):
    """Bounds of views 0 to 3 only, so that view 4 falls back to its images' own bounds."""
    df = maps(spark, d)
    stats = ordering.calibration(df.select("view", F.explode("data").alias("v")), "v", by=("view",)).where("view < 4")
    long = pixels(df, F.col("data"), "image_id", "view", digits=0)
    out = ordering.apply_view_norm(long, "v", stats)
    return out.select("image_id", "r", "c", F.round("normalised", 5).alias("normalised"))


def q_sanitise(spark, d):
    """Maps with planted non-finite pixels."""
    broken = F.transform("data", lambda x, p: F.when((p % 16 == 3) | (F.col("image_id") % 50 == 7), F.lit(float("nan"))).when(p % 16 == 5, F.lit(float("inf"))).when(p % 16 == 9, F.lit(float("-inf"))).otherwise(x))
    return pixels(maps(spark, d).withColumn("data", broken), sanitised(F.col("data")), "image_id")


def q_spatial(spark, d):
    """The coordinates of every pixel of every map."""
    long = pixels(maps(spark, d), F.col("data"), "image_id", digits=0)
    config = features.FeatureConfig()
    return long.select("image_id", "r", "c", *[F.round(x, 6).alias(n) for n, x in features.spatial(config, F.col("r"), F.col("c"), F.lit(8), F.lit(8))])


def q_one_hot(spark, d):
    config = features.FeatureConfig()
    return maps(spark, d).select("image_id", *[x.cast("int").alias(n) for n, x in features.context(config, F.col("cls"), F.col("view"), list(range(10)))])


def q_image_aggregates(spark, d):
    return maps(spark, d).select("image_id", *[F.round(f(F.col("data")), 6).alias(n) for n, f in features.AGGREGATES.items()])


def q_patchify(spark, d):
    layers = [F.col("data"), F.transform("data", lambda x: F.abs(x))]
    long = A.each(maps(spark, d), ["image_id"], R.patchify(layers, F.lit(8), F.lit(8)), "p", "_u")
    return long.select("image_id", "p", F.round(F.get("_u", F.lit(0)), 5).alias("u0"), F.round(F.get("_u", F.lit(1)), 5).alias("u1"))


def q_avg_windows(spark, d):
    return pixels(maps(spark, d), R.valid_windows(F.col("data"), F.lit(8), F.lit(8), 3), "image_id", width=6)


def q_mask_to_patches(spark, d):
    mask = F.transform("data", lambda x: (x > 0.15).cast("double"))
    return pixels(maps(spark, d), R.pool_blocks(mask, F.lit(8), F.lit(8), 4, 4), "image_id", width=4)


def q_corrupt_blend(spark, d):
    mask = F.transform("data", lambda x: (x > 0.15).cast("double"))
    texture = F.transform("data", lambda x, p: p / 64.0)
    return pixels(maps(spark, d), synthesis.blend(F.col("data"), mask, texture, 0.4), "image_id")


def q_ellipse(spark, d):
    """One ellipse on the grid of every map."""
    grid = pixels(maps(spark, d), F.col("data"), "image_id", digits=0)
    return grid.select("image_id", "r", "c", synthesis.ellipse(F.col("r"), F.col("c"), 3.2, 3.7, 2.6, 3.1).cast("int").alias("inside"))


def q_synthesise(spark, d):
    """Structural facts of seeded synthetic defects: the mask covers the changed pixels."""
    images = maps(spark, d).select("image_id", "h", "w", F.transform("data", lambda x: F.least(F.lit(1.0), F.abs(x) * 2)).alias("data"))
    out = synthesis.synthesise(images, "defects")
    changed = F.size(F.filter(F.arrays_zip("clean", "corrupt", "mask"), lambda p: (p["clean"] != p["corrupt"]) & (p["mask"] == 0)))
    return out.select("image_id", changed.alias("outside"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("masked"))


def q_apply_prior(spark, d):
    heat = priors.spatial_priors(_masks(spark, d), 0.0)
    out = priors.with_prior(maps(spark, d), heat, 8, 8)
    return pixels(out, priors.apply_prior(F.col("data"), F.col("prior"), 0.5), "image_id")


def q_within_class_average_rank(spark, d):
    long = pixels(maps(spark, d), F.transform("data", lambda x: F.rint(x * 20)), "image_id", "cls", digits=0)
    out = ordering.rank_normalise(long, "v", ["image_id", "r", "c"], "per_class", ties="average")
    return out.select("image_id", "r", "c", F.round("rank", 6).alias("rank"))


QUERIES = {
    "resize_nearest": lambda s, d: pixels(maps(s, d), R.resize_nearest(F.col("data"), F.lit(8), F.lit(8), 5, 5), "image_id", width=5),
    "resize_bilinear": lambda s, d: pixels(maps(s, d), R.resize_bilinear(F.col("data"), F.lit(8), F.lit(8), 5, 5), "image_id", width=5),
    "resize_bilinear_up": lambda s, d: pixels(maps(s, d), R.resize_bilinear(F.col("data"), F.lit(8), F.lit(8), 16, 16), "image_id", width=16),
    "gaussian": _on_maps(lambda x: R.gaussian(x, F.lit(8), F.lit(8), 1.5)),
    "window_mean": _on_maps(lambda x: R.window_mean(x, F.lit(8), F.lit(8), 7)),
    "window_max": _on_maps(lambda x: R.window_max(x, F.lit(8), F.lit(8), 7)),
    "window_std": _on_maps(lambda x: R.window_std(x, F.lit(8), F.lit(8), 7)),
    "window_mean_arrow": lambda s, d: pixels(maps(s, d), R.numpy_stencil("mean", 7)(F.col("data"), F.col("h"), F.col("w")), "image_id"),
    "gradient": _on_maps(lambda x: R.gradient(x, F.lit(8), F.lit(8))),
    "laplacian": _on_maps(lambda x: R.laplacian(x, F.lit(8), F.lit(8))),
    "rank_global": _rank("global"),
    "rank_class": _rank("per_class"),
    "rank_class_view": _rank("per_class_view"),
    "rank_image": _rank("per_image"),
    "rank_average_ties": q_within_class_average_rank,
    "tta_hflip": _tta("hflip"),
    "tta_hvflip": _tta("hvflip"),
    "tta_d4": _tta("d4"),
    "cross_method": q_cross_method,
    "consensus": q_consensus,
    "min_top_k": q_min_top_k,
    "featurize": q_featurize,
    "prior_heat": q_prior_heat,
    "centre_bias": q_centre_bias,
    "apply_prior": q_apply_prior,
    "q8rle_encode": q_encode,
    "q8rle_decode": q_decode,
    "q8rle_shape": q_shape,
    "q8rle_errors": q_errors,
    "small_components": q_small_components,
    "fuse_mean": _fuse("mean"),
    "fuse_weighted": _fuse("mean", [3.0, 1.0, 0.0]),
    "fuse_geometric": _fuse("geometric"),
    "fuse_max": _fuse("max"),
    "fuse_median": _fuse("median"),
    "fuse_rank_mean": _fuse("rank_mean"),
    "view_norm_fit": q_view_norm_fit,
    "view_norm_apply": q_view_norm_apply,
    "sanitise_nonfinite": q_sanitise,
    "spatial_coords": q_spatial,
    "one_hot": q_one_hot,
    "image_aggregates": q_image_aggregates,
    "patchify": q_patchify,
    "avg_windows": q_avg_windows,
    "mask_to_patches": q_mask_to_patches,
    "corrupt_blend": q_corrupt_blend,
    "ellipse_mask": q_ellipse,
    "synthesise_defects": q_synthesise,
}

_MAX_ROWS = " OR ".join(f"b.r = {_refl(f'a.r + {o}')}" for o in _SEVEN)
_MAX_COLS = " OR ".join(f"b.c = {_refl(f'a.c + {o}')}" for o in _SEVEN)
_SQ = "sq AS (SELECT image_id, r, c, v * v AS v FROM px)"
_SEVENTH = [1 / 7] * 7
_FIN = "CASE WHEN p % 16 IN (3, 5, 9) OR image_id % 50 = 7 THEN NULL ELSE v END"

ORACLE_SQL = {
    "resize_nearest": f"WITH {PX} SELECT image_id, CAST(i // 5 AS INTEGER) AS r, CAST(i % 5 AS INTEGER) AS c, round(v, 6) AS v FROM px JOIN range(25) t(i) ON px.r = (i // 5) * 8 // 5 AND px.c = (i % 5) * 8 // 5",
    "resize_bilinear": _bilinear_sql(5),
    "resize_bilinear_up": _bilinear_sql(16),
    "gaussian": _separable(*R.gaussian_weights(1.5)),
    "window_mean": _separable(_SEVEN, _SEVENTH),
    "window_mean_arrow": _separable(_SEVEN, _SEVENTH),
    "window_max": f"WITH {PX}, d AS (SELECT a.image_id, a.r, a.c, max(b.v) AS v FROM px a JOIN px b ON b.image_id = a.image_id AND b.c = a.c AND ({_MAX_ROWS}) GROUP BY a.image_id, a.r, a.c) SELECT a.image_id, a.r, a.c, round(max(b.v), 6) AS v FROM d a JOIN d b ON b.image_id = a.image_id AND b.r = a.r AND ({_MAX_COLS}) GROUP BY a.image_id, a.r, a.c",
    "window_std": f"WITH {PX}, {_SQ}, {_pass('px', 'd1', _SEVEN, _SEVENTH, True)}, {_pass('d1', 'm', _SEVEN, _SEVENTH, False)}, {_pass('sq', 'd2', _SEVEN, _SEVENTH, True)}, {_pass('d2', 'q', _SEVEN, _SEVENTH, False)} SELECT image_id, r, c, round(sqrt(greatest(q.v - m.v * m.v, 0)), 6) AS v FROM m JOIN q USING (image_id, r, c)",
    "gradient": f"WITH {PX}, {_pass('px', 'd1', *_STEP, True)}, {_pass('d1', 'dy', *_BLUR, False)}, {_pass('px', 'd2', *_STEP, False)}, {_pass('d2', 'dx', *_BLUR, True)} SELECT image_id, r, c, round(sqrt(dx.v * dx.v + dy.v * dy.v), 6) AS v FROM dx JOIN dy USING (image_id, r, c)",
    "laplacian": f"WITH {PX}, {_pass('px', 'y', *_SECOND, True)}, {_pass('px', 'x', *_SECOND, False)} SELECT image_id, r, c, round(x.v + y.v, 6) AS v FROM x JOIN y USING (image_id, r, c)",
    "rank_global": _rank_sql(""),
    "rank_class": _rank_sql("cls"),
    "rank_class_view": _rank_sql("cls, view"),
    "rank_image": _rank_sql("image_id"),
    "rank_average_ties": f"WITH {PX}, t AS (SELECT image_id, cls, r, c, round_even(v * 20, 0) AS x FROM px), k AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY x, image_id, r, c) AS place, count(*) OVER (PARTITION BY cls) AS n FROM t) SELECT image_id, r, c, round((avg(place) OVER (PARTITION BY cls, x) - 1) / (n - 1), 6) AS rank FROM k",
    "tta_hflip": f"WITH {PX} SELECT image_id, r, c, round(v + 0.1::DOUBLE * r, 6) AS v FROM px",
    "tta_hvflip": f"WITH {PX} SELECT image_id, r, c, round(v + 0.1::DOUBLE * (r + 7) / 3, 6) AS v FROM px",
    "tta_d4": f"WITH {PX} SELECT image_id, r, c, round(v + 0.35::DOUBLE, 6) AS v FROM px",
    "cross_method": f"WITH {PX}, {ME}, s AS (SELECT *, (m0 + m1 + m2) / 3 AS m FROM me) SELECT image_id, p, round(m, 5) AS x_mean, round(greatest(m0, m1, m2), 5) AS x_max, round(least(m0, m1, m2), 5) AS x_min, round(sqrt(((m0 - m) ** 2 + (m1 - m) ** 2 + (m2 - m) ** 2) / 3), 5) AS x_std, round(greatest(m0, m1, m2) - least(m0, m1, m2), 5) AS x_range FROM s",
    "consensus": f"WITH {PX}, {ME}, k AS (SELECT image_id, p, " + ", ".join(f"(row_number() OVER (PARTITION BY image_id ORDER BY m{i}, p) - 1)::DOUBLE / 63 AS k{i}" for i in range(3)) + " FROM me) SELECT image_id, p, " + ", ".join(f"CAST((k0 >= {b})::INT + (k1 >= {b})::INT + (k2 >= {b})::INT AS BIGINT) AS xc_top{n}pct" for n, b in ((1, 0.99), (5, 0.95))) + " FROM k",
    "min_top_k": f"WITH {PX}, {ME}, s AS (SELECT image_id, p, list_sort([m0, m1, m2]) AS l, (m0 + m1 + m2) / 3 AS m, m0, m1, m2 FROM me) SELECT image_id, p, l[1] AS xc_min_top3, l[2] AS xc_min_top2, round(sqrt(((m0 - m) ** 2 + (m1 - m) ** 2 + (m2 - m) ** 2) / 3) / (m + 1e-6), 4) AS xc_cv FROM s WHERE abs((l[1] + l[2]) / 2) > 0.01",
    "featurize": _featurize_sql(),
    "prior_heat": f"{_MEAN_MASK}, {_pass('mean', 'd', *R.gaussian_weights(1.0), True)}, {_pass('d', 's', *R.gaussian_weights(1.0), False)} SELECT image_id AS cls, r, c, round(v / max(v) OVER (PARTITION BY image_id), 6) AS v FROM s",
    "centre_bias": f"{_MEAN_MASK} SELECT image_id AS cls, round(avg(v), 6) AS coverage, round(CASE WHEN sum(v) > 0 THEN sum(CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 THEN v ELSE 0 END) / sum(v) ELSE 0 END, 6) AS centre_bias FROM mean GROUP BY image_id",
    "apply_prior": f"{_MEAN_MASK}, heat AS (SELECT image_id AS cls, r, c, v / max(v) OVER (PARTITION BY image_id) AS h FROM mean) SELECT image_id, r, c, round(0.5 * v + 0.5 * h, 6) AS v FROM px JOIN heat USING (cls, r, c)",
    "q8rle_encode": f"{_ENCODE_SQL} SELECT image_id, label FROM labels",
    "q8rle_decode": f"WITH {PX} SELECT image_id, r, c, {_Q8} AS v FROM px",
    "q8rle_shape": f"{_ENCODE_SQL} SELECT image_id, 8 AS h, 8 AS w, CAST(len(string_split(label, ' ')) AS INTEGER) AS n_tokens FROM labels",
    "q8rle_errors": f"WITH {PX} SELECT DISTINCT image_id, ['fine', 'magic', 'short', 'odd body', 'value', 'coverage', 'fine'][CAST(image_id % 7 + 1 AS INTEGER)] AS problem FROM px",
    "small_components": _COMPONENTS_SQL,
    "fuse_mean": _fuse_sql("(m0 + m1 + m2) / 3"),
    "fuse_weighted": _fuse_sql("0.75 * m0 + 0.25 * m1"),
    "fuse_geometric": _fuse_sql("exp((ln(greatest(m0, 1e-8)) + ln(greatest(m1, 1e-8)) + ln(greatest(m2, 1e-8))) / 3)"),
    "fuse_max": _fuse_sql("greatest(m0, m1, m2)"),
    "fuse_median": _fuse_sql("list_sort([m0, m1, m2])[2]"),
    "fuse_rank_mean": f"WITH {PX}, {ME}, k AS (SELECT image_id, p, " + " + ".join(f"(row_number() OVER (ORDER BY m{i}, image_id, p) - 1)::DOUBLE / (count(*) OVER () - 1)" for i in range(3)) + " AS s FROM me) SELECT image_id, p, round(s / 3, 5) AS fused FROM k",
    "view_norm_fit": f"WITH {PX}, b AS (SELECT view, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM px GROUP BY view) SELECT view, round(lo, 6) AS lo, round(CASE WHEN hi > lo THEN hi ELSE lo + 1e-6 END, 6) AS hi FROM b",
    "view_norm_apply": f"WITH {PX}, b AS (SELECT view, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM px WHERE view < 4 GROUP BY view), i AS (SELECT p.image_id, p.r, p.c, p.v, coalesce(b.lo, min(v) OVER (PARTITION BY image_id)) AS lo, coalesce(b.hi, max(v) OVER (PARTITION BY image_id)) AS hi FROM px p LEFT JOIN b USING (view)) SELECT image_id, r, c, round((v - lo) / greatest(hi - lo, 1e-9), 5) AS normalised FROM i",
    "sanitise_nonfinite": f"WITH {PX}, f AS (SELECT *, min({_FIN}) OVER (PARTITION BY image_id) AS lo, max({_FIN}) OVER (PARTITION BY image_id) AS hi FROM px) SELECT image_id, r, c, round(CASE WHEN lo IS NULL THEN 0 WHEN image_id % 50 = 7 OR p % 16 IN (3, 9) THEN lo WHEN p % 16 = 5 THEN hi ELSE v END, 6) AS v FROM f",
    "spatial_coords": "SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, round((i % 8) / 7.0::DOUBLE, 6) AS s_x, round((i // 8) / 7.0::DOUBLE, 6) AS s_y, round(sqrt(((i % 8) / 7.0::DOUBLE - 0.5) ** 2 + ((i // 8) / 7.0::DOUBLE - 0.5) ** 2), 6) AS s_dist_center, round(least((i % 8) / 7.0::DOUBLE, 1 - (i % 8) / 7.0::DOUBLE, (i // 8) / 7.0::DOUBLE, 1 - (i // 8) / 7.0::DOUBLE), 6) AS s_dist_edge FROM embeddings, range(64) t(i)",
    "one_hot": "SELECT vec_id AS image_id, " + ", ".join(f"CAST(label = {k} AS INTEGER) AS c_{k}" for k in range(10)) + ", " + ", ".join(f"CAST(vec_id % 5 = {k} AS INTEGER) AS v_{k}" for k in range(5)) + " FROM embeddings",
    "image_aggregates": f"WITH {PX} SELECT image_id, round(max(v), 6) AS imgmax, round(quantile_cont(v, 0.99), 6) AS imgp99, round(avg(v), 6) AS imgmean, round(stddev_pop(v), 6) AS imgstd FROM px GROUP BY image_id",
    "patchify": f"WITH {PX}, s AS (SELECT a.image_id, a.p, sum(b.v) / 9 AS x, sum(abs(b.v)) / 9 AS y FROM px a JOIN px b ON b.image_id = a.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.image_id, a.p) SELECT image_id, p, round(x / sqrt(x * x + y * y), 5) AS u0, round(y / sqrt(x * x + y * y), 5) AS u1 FROM s",
    "avg_windows": f"WITH {PX} SELECT a.image_id, a.r, a.c, round(avg(b.v), 6) AS v FROM px a JOIN px b ON b.image_id = a.image_id AND b.r BETWEEN a.r AND a.r + 2 AND b.c BETWEEN a.c AND a.c + 2 WHERE a.r < 6 AND a.c < 6 GROUP BY a.image_id, a.r, a.c",
    "mask_to_patches": f"WITH {PX} SELECT image_id, r // 2 AS r, c // 2 AS c, round(avg((v > 0.15)::INT), 6) AS v FROM px GROUP BY image_id, r // 2, c // 2",
    "corrupt_blend": f"WITH {PX} SELECT image_id, r, c, round(CASE WHEN v > 0.15 THEN 0.6 * v + 0.4 * (p / 64.0::DOUBLE) ELSE v END, 6) AS v FROM px",
    "ellipse_mask": "SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST((i % 8 - 3.7::DOUBLE) ** 2 / 3.1::DOUBLE ** 2 + (i // 8 - 3.2::DOUBLE) ** 2 / 2.6::DOUBLE ** 2 <= 1 AS INTEGER) AS inside FROM embeddings, range(64) t(i)",
}
