"""Detectors over patch features: a registry, closed-form detectors, and the plug-in for trained ones.

``patches`` has ``image_id, pos, embedding`` (and whatever else); ``fit`` learns from
normal patches, ``score`` adds ``score``, higher meaning more anomalous. Networks are not
trained here: a plug-in takes any function from a matrix of features to scores.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.raster import TTA
from tessera.functions.text import config_digest
from tessera.operators import metrics, retrieval, scoring


#: What a setting of this name must satisfy, in every configuration that has it.
RULES = {
    "tta": (TTA.__contains__, f"one of {sorted(TTA)}"),
    "input_size": (lambda x: x > 0, "positive"),
    "smooth_sigma": (lambda x: x >= 0, "0 or more"),
    "coreset_frac": (lambda x: 0 < x <= 1, "above 0 and at most 1"),
    "metric": (("cosine", "l2").__contains__, "cosine or l2"),
    "fusion": (("mul", "sum").__contains__, "mul or sum"),
    "alpha": (lambda x: 0 <= x <= 1, "from 0 to 1"),
}
#: Settings of speed and memory, which change no result.
UNHASHED = frozenset(("query_chunk", "memory_chunk", "score_chunk", "project_chunk"))


# The defaults of this and of the following configurations.
@dataclass(frozen=True)
class DetectorConfig:
    """Settings that change a result; the digest covers all of them but those in ``UNHASHED``."""

    input_size: int = 224
    seed: int = 0
    tta: str = "none"
    smooth_sigma: float = 1.5

    def __post_init__(self):
        broken = [f"{name} must be {wanted}" for name, (fits, wanted) in RULES.items() if hasattr(self, name) and not fits(getattr(self, name))]
        if broken:
            raise ValueError("; ".join(broken))

    def fingerprint(self) -> dict:
        held = asdict(self)
        return {name: held[name] for name in sorted(held.keys() - UNHASHED)}

    def digest(self) -> str:
        return config_digest(self.fingerprint())


@dataclass(frozen=True)
class BankConfig(DetectorConfig):
    coreset_frac: float = 0.1
    coreset_batch: int = 64
    projection_dim: int = 32
    knn_k: int = 1
    metric: str = "cosine"


@dataclass(frozen=True)
class ForegroundBankConfig(DetectorConfig):
    knn_k: int = 1
    use_foreground_mask: bool = True
    foreground_keep_pct: float = 75.0


@dataclass(frozen=True)
class MixtureConfig(DetectorConfig):
    pca_dim: int = 64
    max_components: int = 30
    weight_concentration_prior: float = 0.01
    max_iter: int = 200
    fit_subsample: int = 100_000


@dataclass(frozen=True)
class AdaptedBankConfig(DetectorConfig):
    knn_k: int = 3
    metric: str = "l2"


@dataclass(frozen=True)
class WindowConfig(DetectorConfig):
    window_sizes: tuple[int, ...] = (2, 3, 5)
    alpha: float = 0.5
    n_references: int = 8
    temperature: float = 100.0


@dataclass(frozen=True)
class OutputConfig(DetectorConfig):
    fusion: str = "mul"


class Detector:
    """Fit on normal patches, then score patches."""

    config_type = DetectorConfig

    def __init__(self, config: DetectorConfig | None = None, key: str = "patch_id", vector: str = "embedding"):
        self.config, self.key, self.vector = config or self.config_type(), key, vector

    def fit(self, patches: DataFrame) -> Detector:
        raise NotImplementedError

    def score(self, patches: DataFrame) -> DataFrame:
        raise NotImplementedError

    def width(self, patches: DataFrame) -> int:
        return patches.agg(F.max(F.size(self.vector))).first()[0] or 0


class MemoryBank(Detector):
    """A coreset of normal patches; the score is the distance to the nearest of them."""

    config_type = BankConfig

    def fit(self, patches: DataFrame) -> MemoryBank:
        c = self.config
        n = max(1, int(c.coreset_frac * patches.count()))
        small = retrieval.project(patches, c.projection_dim, c.seed, self.vector, self.width(patches))
        chosen = retrieval.coreset(small, n, c.coreset_batch, self.key)
        self.bank = patches.join(chosen.select(self.key), self.key, "left_semi").select(self.key, self.vector)
        return self

    def score(self, patches: DataFrame) -> DataFrame:
        found = retrieval.bank_distances(patches.select(self.key, self.vector), self.bank, self.config.knn_k, self.config.metric, self.key, self.vector)
        return patches.join(found.withColumnRenamed("distance", "score"), self.key)


class ForegroundBank(Detector):
    """All normal patches whose first principal coordinate is large; cosine distance to the nearest."""

    config_type = ForegroundBankConfig

    def fit(self, patches: DataFrame) -> ForegroundBank:
        c = self.config
        kept = retrieval.foreground(patches, c.foreground_keep_pct, self.vector, self.width(patches)) if c.use_foreground_mask else patches
        self.bank = kept.select(self.key, self.vector)
        return self

    def score(self, patches: DataFrame) -> DataFrame:
        found = retrieval.bank_distances(patches.select(self.key, self.vector), self.bank, self.config.knn_k, "cosine", self.key, self.vector)
        return patches.join(found.withColumnRenamed("distance", "score"), self.key)


class MixtureDensity(Detector):
    """Principal coordinates under a Dirichlet-process mixture; the score is the negative log density."""

    config_type = MixtureConfig

    def fit(self, patches: DataFrame) -> MixtureDensity:
        c = self.config
        width = self.width(patches)
        self.centre, self.directions, _ = retrieval.principal_components(patches, min(c.pca_dim, width), self.vector, width)
        sample = patches.orderBy(F.xxhash64(F.lit(c.seed), self.key), self.key).limit(c.fit_subsample).select(self.vector).collect()
        rows = (np.array([r[0] for r in sample], dtype=float) - self.centre) @ self.directions.T
        self.mixture = scoring.fit_mixture(rows, c.max_components, c.weight_concentration_prior, c.max_iter, seed=c.seed)
        return self

    def score(self, patches: DataFrame) -> DataFrame:
        at = retrieval.projections(A.as_double(F.col(self.vector)), self.centre, self.directions)
        return patches.withColumn("_z", at).withColumn("score", -scoring.mixture_log_density(F.col("_z"), *self.mixture)).drop("_z")


class PlugIn(Detector):
    """A trained scorer from elsewhere: ``train(matrix) -> (matrix -> scores)`` over a bounded sample of normal patches."""

    def __init__(self, train, config: DetectorConfig | None = None, sample: int = 100_000, **names):
        super().__init__(config, **names)
        self.train, self.sample = train, sample

    def fit(self, patches: DataFrame) -> PlugIn:
        rows = patches.orderBy(F.xxhash64(F.lit(self.config.seed), self.key), self.key).limit(self.sample).select(self.vector).collect()
        self.model = self.train(np.array([r[0] for r in rows], dtype=float))
        return self

    def score(self, patches: DataFrame) -> DataFrame:
        return scoring.score_batches(patches, self.model, self.vector)


class AdaptedBank(MemoryBank):
    """A bank of features that a network has adapted: the mean of the three smallest squared distances, over all normal patches."""

    config_type = AdaptedBankConfig

    def fit(self, patches: DataFrame) -> AdaptedBank:
        self.bank = patches.select(self.key, self.vector)
        return self


class GivenOutputs(Detector):
    """Scores from the columns that a network gave for each patch, ``OUTPUTS[kind]``.

    Terms that have no scale of their own are z-scored on the normal patches and averaged.
    """

    kind = ""

    def terms(self) -> dict[str, Column]:
        needed, _, make = OUTPUTS[self.kind]
        return {f"_t{i}": x for i, x in enumerate(make(self.config, *[F.col(c) for c in needed]))}

    def fit(self, patches: DataFrame) -> GivenOutputs:
        terms = self.terms()
        self.stats = metrics.term_statistics(patches.select(*[x.alias(n) for n, x in terms.items()]), list(terms)).first() if OUTPUTS[self.kind][1] else None
        return self

    def score(self, patches: DataFrame) -> DataFrame:
        terms = self.terms()
        scaled = [x if self.stats is None else scoring.z_score(x, self.stats[f"{n}_mean"], self.stats[f"{n}_std"]) for n, x in terms.items()]
        return patches.withColumn("score", sum(scaled[1:], scaled[0]) / len(scaled))


#: By detector: the columns that its network gives, whether terms are z-scored, and the terms.
OUTPUTS = {
    "student_teacher": (("embedding", "student", "decoder"), True, lambda c, teacher, student, decoder: [scoring.residual(teacher, student), scoring.residual(student, decoder)]),
    "flow": (("latent", "log_det"), True, lambda c, latent, log_det: [scoring.flow_nll(latent, log_det)]),
    "distillation": (("teacher_layers", "student_layers"), False, lambda c, teacher, student: [_layers(c.fusion, teacher, student)]),
    "reconstruction_transformer": (("embedding", "reconstruction"), True, lambda c, x, y: [scoring.residual(x, y)]),
    "corruption_discriminator": (("logits",), False, lambda c, logits: [scoring.anomalous_channel(logits)]),
    "adversarial_discriminator": (("logit",), False, lambda c, logit: [scoring.sigmoid(logit)]),
    "transparency_diffusion": (("level_logits",), False, lambda c, logits: [scoring.level_mean(logits)]),
    "text_synthesis": (("logits",), False, lambda c, logits: [scoring.anomalous_channel(logits)]),
}


def _layers(fusion: str, teacher: Column, student: Column) -> Column:
    """1 - cosine of every layer of two arrays of vectors, multiplied or added up."""
    gaps = F.zip_with(teacher, student, lambda t, s: 1 - A.cosine(t, s))
    return F.aggregate(gaps, F.lit(1.0 if fusion == "mul" else 0.0), (lambda a, x: a * x) if fusion == "mul" else (lambda a, x: a + x))


class TextImageWindows(Detector):
    """Windows of an image's patches against two text vectors and against windows of a few normal images.

    ``patches`` carry ``image_id, view, h, w, pos`` and embeddings in the texts' space.
    The reference windows are those of at most ``n_references`` images, dealt over views.
    """

    config_type = WindowConfig

    def __init__(self, config: DetectorConfig | None = None, normal=None, anomalous=None, **names):
        super().__init__(config, **names)
        if normal is None or anomalous is None:
            raise ValueError("two text vectors are needed")
        self.texts = [np.asarray(v, dtype=float) / np.linalg.norm(v) for v in (normal, anomalous)]

    def fit(self, patches: DataFrame) -> TextImageWindows:
        c = self.config
        self.references: dict[int, np.ndarray] = {}
        if c.n_references > 0 and c.alpha < 1:
            images = patches.select("image_id", F.coalesce("view", F.lit(0)).alias("view")).distinct()
            chosen = retrieval.select_references(images, c.n_references, "view", "image_id").select("image_id")
            rows = patches.join(F.broadcast(chosen), "image_id").select("image_id", "h", "w", "pos", self.vector).toPandas()
            grids = [_grid(part, self.vector) for _, part in rows.groupby("image_id")]
            self.references = {size: np.concatenate([scoring.image_windows(g, size).reshape(-1, g.shape[2]) for g in grids if size <= min(g.shape[:2])] or [np.zeros((0, len(self.texts[0])))]) for size in c.window_sizes}
        return self

    def score(self, patches: DataFrame) -> DataFrame:
        c, vector, key = self.config, self.vector, self.key
        held = patches.sparkSession.sparkContext.broadcast((self.texts, self.references))

        def one(rows: pd.DataFrame) -> pd.DataFrame:  # one image's patches
            (normal, anomalous), references = held.value
            grid = scoring.window_scores(_grid(rows, vector), c.window_sizes, normal, anomalous, references, c.alpha, c.temperature)
            return pd.DataFrame({key: rows[key].to_numpy(), "score": grid.ravel()[rows["pos"].to_numpy()]})

        kind = dict(patches.dtypes)[key]
        scores = patches.select("image_id", key, "h", "w", "pos", vector).groupBy("image_id").applyInPandas(one, f"{key} {kind}, score double")
        return patches.join(scores, key)


def _grid(rows: pd.DataFrame, vector: str) -> np.ndarray:
    ordered = rows.sort_values("pos")
    return np.stack(ordered[vector].to_numpy()).astype(float).reshape(int(ordered["h"].iloc[0]), int(ordered["w"].iloc[0]), -1)


DETECTORS: dict[str, type[Detector]] = {"memory_bank": MemoryBank, "cut_paste": MemoryBank, "foreground_bank": ForegroundBank, "mixture_density": MixtureDensity, "adapted_bank": AdaptedBank, "text_image_windows": TextImageWindows}
DETECTORS |= {name: type("".join(p.title() for p in name.split("_")), (GivenOutputs,), {"kind": name, "config_type": OutputConfig, "__doc__": GivenOutputs.__doc__}) for name in OUTPUTS}


def list_detectors() -> list[str]:
    return sorted(DETECTORS)


def get_detector(name: str) -> type[Detector]:
    if name in DETECTORS:
        return DETECTORS[name]
    raise KeyError(f"unknown detector {name}; known: {list_detectors()}")


def register(name: str, detector: type[Detector]) -> None:
    DETECTORS[name] = detector


def from_settings(name: str, settings: dict) -> Detector:
    """A detector from settings; an unknown setting raises."""
    kind = get_detector(name)
    known = {f.name for f in fields(kind.config_type)}
    unknown = set(settings) - known
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}; known: {sorted(known)}")
    return kind(kind.config_type(**settings))


# Backbones with their channels by layer, block counts, strides and register tokens.
RESNETS = {"wide_resnet50_2": (256, 512, 1024, 2048), "resnet50": (256, 512, 1024, 2048), "resnet18": (64, 128, 256, 512)}
CONVNEXTS = {"tiny": (96, 192, 384, 768), "small": (96, 192, 384, 768), "base": (128, 256, 512, 1024), "large": (192, 384, 768, 1536)}
DINOV2 = {"s": (384, 12), "b": (768, 12), "l": (1024, 24), "g": (1536, 40)}
DINOV3 = {"s16": (384, 12), "s16plus": (384, 12), "b16": (768, 12), "l16": (1024, 24), "h16plus": (1280, 32), "7b16": (4096, 40)}


def _backbones() -> dict[str, dict]:
    out = {n: {"family": "resnet", "channels": c, "stride": None, "registers": 0} for n, c in RESNETS.items()}
    out |= {f"dinov3_convnext_{n}": {"family": "convnext", "channels": c, "stride": 4, "registers": 0} for n, c in CONVNEXTS.items()}
    vits = [(f"dinov2_vit{n}14{tail}", width, blocks, 14, registers) for n, (width, blocks) in DINOV2.items() for tail, registers in (("", 0), ("_reg", 4))]
    vits += [(f"dinov3_vit{n}", width, blocks, 16, 4) for n, (width, blocks) in DINOV3.items()]
    out |= {n: {"family": "vit", "channels": (width,) * blocks, "stride": stride, "registers": registers} for n, width, blocks, stride, registers in vits}
    return {n: held | {"layers": len(held["channels"])} for n, held in out.items()}


BACKBONES = _backbones()


def backbone(name: str) -> dict:
    """Family, channels by layer, number of layers, stride and register tokens of a backbone."""
    if name not in BACKBONES:
        raise KeyError(f"unknown backbone {name}; known: {sorted(BACKBONES)}")
    return BACKBONES[name]


def validate_input_size(name: str, size: int) -> None:
    stride = backbone(name)["stride"]
    if stride and size % stride:
        raise ValueError(f"{name} needs a multiple of {stride}")


def target_layer(layers: list[int], target: int | None = None) -> int:
    """The layer whose grid all others are brought to: the shallowest unless one is named."""
    if target is not None and target not in layers:
        raise ValueError(f"layer {target} is not among {layers}")
    return min(layers) if target is None else target
