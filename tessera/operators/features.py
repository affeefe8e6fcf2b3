"""Per-pixel feature columns from several methods' maps.

Families are functions that give named columns; a feature matrix is one ``select``, so
its column list is its name list, and every feature of an image depends on that image
alone (besides the rank normalisation that went before). Windowed features are made in
Arrow batches, map by map; a map of 224 x 224 is 50,000 interpreted steps otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import raster as R

AGGREGATES = {"imgmax": F.array_max, "imgp99": lambda d: A.percentile(d, 0.99), "imgmean": A.mean, "imgstd": A.deviation}


# The options, their order and their defaults are the contract of feature sets.
@dataclass(frozen=True)
class FeatureConfig:
    raw_score: bool = True
    per_image_rank: bool = True
    gaussian_sigmas: tuple[float, ...] = (3.0,)
    window_sizes: tuple[int, ...] = (7,)
    window_mean: bool = True
    window_max: bool = False
    window_std: bool = False
    gradient: bool = False
    laplacian: bool = False
    image_aggregates: tuple[str, ...] = ("imgp99", "imgstd")
    cross_stats: bool = True
    cross_consensus: bool = True
    cross_cv: bool = True
    min_top_k: int = 3
    spatial_coords: bool = True
    spatial_prior: bool = True
    class_onehot: bool = True
    view_onehot: bool = True
    views: tuple[int, ...] = (0, 1, 2, 3, 4)

    def __post_init__(self):
        unknown = set(self.image_aggregates) - AGGREGATES.keys()
        if unknown:
            raise ValueError(f"unknown image aggregates {sorted(unknown)}; known: {sorted(AGGREGATES)}")


def image_rank(data: Column) -> Column:
    """Places 0 to 1 of an image's pixels by value, ties by position."""
    placed = F.array_sort(F.transform(data, lambda x, i: F.struct(x.alias("v"), i.alias("p"))))
    turned = F.array_sort(F.transform(placed, lambda x, i: F.struct(x["p"].alias("p"), i.alias("rank"))))
    n = F.greatest(F.size(data) - 1, F.lit(1))
    return F.transform(turned, lambda x: x["rank"] / n)


def per_method(config: FeatureConfig, i: int, data: Column, h: Column, w: Column) -> list[tuple[str, Column]]:
    """Array columns (one value for each pixel) of method ``i``, and scalars for the image aggregates."""
    out: list[tuple[str, Column]] = []
    if config.raw_score:
        out.append((f"m{i}_raw", data))
    if config.per_image_rank:
        out.append((f"m{i}_rank", image_rank(data)))
    out += [(f"m{i}_g{s:g}", R.numpy_stencil("gaussian", s)(data, h, w)) for s in config.gaussian_sigmas]
    wanted = [name for name, on in (("mean", config.window_mean), ("max", config.window_max), ("std", config.window_std)) if on]
    out += [(f"m{i}_{name}{size}", R.numpy_stencil(name, size)(data, h, w)) for size in config.window_sizes for name in wanted]
    out += [(f"m{i}_{short}", R.numpy_stencil(kind, 0)(data, h, w)) for short, kind, on in (("grad", "gradient", config.gradient), ("lap", "laplacian", config.laplacian)) if on]
    for name in config.image_aggregates:
        value = AGGREGATES[name](data)
        out.append((f"m{i}_{name}", F.array_repeat(value, h * w)))
    return out


def _at_least(bound: float):
    return lambda x: x >= bound


def cross_method(config: FeatureConfig, methods: Column, n: int) -> list[tuple[str, Column]]:
    """Scalars of the array of all methods' scores at a pixel; none for a single method."""
    if n < 2:
        return []
    out: list[tuple[str, Column]] = []
    centre, spread = A.mean(methods), A.deviation(methods)
    if config.cross_stats:
        high, low = F.array_max(methods), F.array_min(methods)
        out += [("x_mean", centre), ("x_max", high), ("x_min", low), ("x_std", spread), ("x_range", high - low)]
    if config.cross_consensus:
        out += [(f"xc_top{p}pct", F.size(F.filter(methods, _at_least(1 - p / 100))).cast("double")) for p in (1, 5)]
    if config.cross_cv:
        out.append(("xc_cv", spread / (centre + 1e-6)))
    if config.min_top_k and n >= config.min_top_k:
        out.append((f"xc_min_top{config.min_top_k}", A.largest(methods, config.min_top_k)))
    return out


def spatial(config: FeatureConfig, r: Column, c: Column, h: Column, w: Column, prior: Column | None = None) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    if config.spatial_coords:
        x, y = c / F.greatest(w - 1, F.lit(1)), r / F.greatest(h - 1, F.lit(1))
        out += [("s_x", x), ("s_y", y), ("s_dist_center", F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5))), ("s_dist_edge", F.least(x, 1 - x, y, 1 - y))]
    if config.spatial_prior and prior is not None:
        out.append(("s_prior", prior))
    return out


def context(config: FeatureConfig, cls: Column, view: Column, classes: list) -> list[tuple[str, Column]]:
    """One-hot columns; an unknown class or view is zero in all."""
    out: list[tuple[str, Column]] = []
    if config.class_onehot:
        out += [(f"c_{k}", F.coalesce((cls == F.lit(k)).cast("double"), F.lit(0.0))) for k in classes]
    if config.view_onehot:
        out += [(f"v_{k}", F.coalesce((view == F.lit(k)).cast("double"), F.lit(0.0))) for k in config.views]
    return out


def featurize(images: DataFrame, methods: list[str], classes: list, config: FeatureConfig | None = None, keys: tuple[str, ...] = ("image_id",), prior: str | None = None) -> DataFrame:
    """One row for each pixel: ``keys``, ``r``, ``c`` and all features, from dense maps.

    ``images`` has ``h, w, cls, view`` and an array column for each of ``methods``. The
    windowed features are made on the dense maps; only then are maps exploded.
    """
    config = config or FeatureConfig()
    h, w = F.col("h"), F.col("w")
    planes = [p for i, m in enumerate(methods) for p in per_method(config, i, F.col(m), h, w)]
    arrays = {f"_{name}": column for name, column in planes} | {f"_method{i}": F.col(m) for i, m in enumerate(methods)}
    if prior is not None:
        arrays["_prior"] = F.col(prior)
    dense = images.select(*keys, "h", "w", "cls", "view", F.arrays_zip(*[c.alias(n) for n, c in arrays.items()]).alias("_pixels"))
    long = A.each(dense, [*keys, "h", "w", "cls", "view"], F.col("_pixels"), "_p", "_x")
    r, c = F.floor(F.col("_p") / w).cast("int"), F.col("_p") % w
    at = F.array(*[F.col(f"_x._method{i}") for i in range(len(methods))])
    columns = [F.col(f"_x._{name}").alias(name) for name, _ in planes]
    columns += [x.alias(n) for n, x in cross_method(config, at, len(methods))]
    columns += [x.alias(n) for n, x in spatial(config, r, c, h, w, F.col("_x._prior") if prior is not None else None)]
    columns += [x.alias(n) for n, x in context(config, F.col("cls"), F.col("view"), classes)]
    return long.select(*keys, r.alias("r"), c.alias("c"), *columns)


def feature_names(n_methods: int, classes: list, config: FeatureConfig | None = None, prior: bool = False) -> list[str]:
    """The feature columns that ``featurize`` gives, in order, without data."""
    config = config or FeatureConfig()
    some = F.lit(0.0)
    grid = F.array(some)
    names = [n for i in range(n_methods) for n, _ in per_method(config, i, grid, F.lit(1), F.lit(1))]
    names += [n for n, _ in cross_method(config, grid, n_methods)]
    names += [n for n, _ in spatial(config, some, some, some, some, some if prior else None)]
    return names + [n for n, _ in context(config, some, some, classes)]
