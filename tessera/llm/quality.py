"""Quality scores by compression: how much shorter does a dictionary of good text make a document than one of bad text?

Two Zstandard dictionaries are trained on the whole texts of good and bad labelled
documents. Every text is cut into short blocks (all of it, not a prefix), so that the
dictionaries and not the text's own repeats decide, and each block is compressed with
either dictionary. The score is calibrated, by logistic regression, from nothing but the
normalised difference of the two compressed sizes: over the whole text, and its least,
largest and typical spread over blocks. Lengths and compression ratios are no inputs.

Defined results: a null or empty text has no block and gets the share of good labels
among the usable labels; without labelled rows of both classes every score is that share,
or 0.5 without any. Texts of any length are scored whole. Equal texts get equal scores,
whatever their other columns hold or are named; repeated rows repeat them. Labels of a
null id or of both classes are not learnt from. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import Logistic, labelled_sample, remainder
from tessera.llm.store import keep

#: Bytes of a block, of a dictionary, and the level of compression.
BLOCK, DICTIONARY, LEVEL = 256, 112_640, 3


def blocks_of(text: str) -> list[bytes]:
    """The whole text in stretches of ``BLOCK`` bytes."""
    raw = text.encode()
    return [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class QualityModel:
    """The two dictionaries, the calibration and the share of good labels."""

    good: bytes | None
    bad: bytes | None
    calibrate: Logistic | None
    share: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def features(self, text: str) -> tuple[float, ...]:
        """The difference of the compressed sizes (bad - good) by their sum and by the plain size: of the whole text, and least, largest and spread of its blocks."""
        if "_pair" not in self.__dict__:
            self._pair = _compressor(self.good), _compressor(self.bad)
        by_good, by_bad = self._pair
        good, bad, plain = np.array([(len(by_good.compress(b)), len(by_bad.compress(b)), len(b)) for b in blocks_of(text)], dtype=float).T
        more = bad - good
        by_sum, by_plain = more / (bad + good), more / plain
        return more.sum() / (bad + good).sum(), more.sum() / plain.sum(), by_sum.min(), by_sum.max(), by_plain.min(), by_sum.std()

    def score(self, texts) -> np.ndarray:
        texts = ["" if t is None else t for t in texts]
        out = np.full(len(texts), self.share)
        full = [k for k, t in enumerate(texts) if t]
        if full and self.calibrate is not None:
            out[full] = self.calibrate(np.array([self.features(texts[k]) for k in full]))
        return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"\0" * 8


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = 3_000, class_bytes: int = 32 << 20) -> QualityModel:
    """Fit on labelled documents, at most ``per_class`` of each class and ``class_bytes`` of their text (documented bounds).

    Half of the sample trains the dictionaries, the other half the calibration, which
    would otherwise see texts that its own dictionaries hold.
    """
    sample = keep(labelled_sample(docs, labels, label, usable, per_class, class_bytes), "sample")
    half = F.xxhash64(F.lit("half"), F.col("doc_id")) % 2 == 0
    rows = sample.where(half & (F.col("_text") != "")).select("doc_id", "_label", "_text").orderBy("doc_id", "_text").collect()
    parts = {v: [b for r in rows if r["_label"] == v for b in blocks_of(r["_text"])] for v in (0, 1)}
    del rows
    counts = {r["_label"]: r["count"] for r in labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("_label")).count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if not parts[0] or not parts[1]:
        return QualityModel(None, None, None, share)
    model = QualityModel(_dictionary(parts[1]), _dictionary(parts[0]), None, share)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in model.features(t)])

    rows = sample.where(~half & (F.col("_text") != "")).select("doc_id", "_label", measured("_text").alias("_x")).orderBy("doc_id").collect()
    seen = np.array([r["_label"] for r in rows], dtype=float)
    if len(set(seen)) == 2:
        model.calibrate = Logistic(np.array([r["_x"] for r in rows]), seen, share=share)
    return model


def quality_score(model: QualityModel, text: str | Column = "text") -> Column:
    """The calibrated probability that the text is of good quality."""
    held = text if isinstance(text, Column) else F.col(text)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return scored(held)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of ids with crc32 mod 5 other than 0 are learnt from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, remainder("doc_id", 5) != 0)
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
