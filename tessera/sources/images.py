"""Scans of image trees into a DataFrame of paths with derived columns.

Layout: ``class_*/train/good``, ``class_*/train/<type>``, ``class_*/ground_truth_train/<type>``
and ``class_*/test/**``. Files are listed by Spark's ``binaryFile`` reader without their
content, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import parse_view, stem

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
IMAGE = rf"(?i)\.({'|'.join(EXTENSIONS)})$"


def from_paths(paths: DataFrame, root: str) -> DataFrame:
    """The ``images`` table from a column ``path`` of files below ``root``."""
    inside = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.split(inside, "/")
    name = F.element_at(parts, -1)
    cls, top, kind = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    depth = F.size(parts)
    split = F.when((top == "train") & (kind == "good") & (depth == 4), "train_good").when((top == "train") & (kind != "good") & (depth == 4), "train_anomaly").when((top == "test") & (depth >= 3), "test")
    base, view = parse_view(name)
    rows = paths.where(F.col("path").rlike(IMAGE) & cls.rlike("^class_")).select("path", cls.alias("cls"), top.alias("_top"), kind.alias("_kind"), name.alias("_name"), split.alias("split"), base.alias("sample_id"), view.alias("view"))
    masks = rows.where("_top = 'ground_truth_train'").select("cls", F.col("_kind").alias("anomaly_type"), stem(F.col("_name")).alias("_stem"), F.col("path").alias("mask_path"), F.col("_name").alias("_mask"))
    images = rows.where("split is not null").withColumns({"anomaly_type": F.when(F.col("split") == "train_anomaly", F.col("_kind")), "_stem": stem(F.col("_name"))})
    joined = images.join(masks, ["cls", "anomaly_type", "_stem"], "left")
    best = Window.partitionBy("path").orderBy((F.col("_mask") == F.col("_name")).desc(), "_mask")
    chosen = joined.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return chosen.select("path", "cls", "split", "anomaly_type", "sample_id", "view", "mask_path", F.col("_stem").alias("stem"), F.col("mask_path").isNotNull().alias("has_mask"))


def scan_dataset(spark: SparkSession, root: str) -> DataFrame:
    """All images below ``root``; raises where there is no class folder."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    images = from_paths(listed, root)
    if images.isEmpty():
        raise FileNotFoundError(f"{root} holds no images below class_*")
    return images


def select(images: DataFrame, cls: str | None = None, split: str | None = None) -> DataFrame:
    for column, value in (("cls", cls), ("split", split)):
        if value is not None:
            images = images.where(F.col(column) == value)
    return images


def only_classes(images: DataFrame, wanted: list[str]) -> DataFrame:
    """The images of the wanted classes; raises if none of them is there."""
    out = images.where(F.col("cls").isin(wanted))
    if out.isEmpty():
        raise ValueError(f"none of the classes {wanted} is there")
    return out


def classes_in(images: DataFrame) -> DataFrame:
    return images.select("cls").distinct().orderBy("cls")


def sample_key(cls: Column, sample_id: Column, name_stem: Column) -> Column:
    return F.concat_ws("/", cls, F.coalesce(sample_id, name_stem))


def group_by_sample(images: DataFrame, cls: str = "cls", sample_id: str = "sample_id", view: str = "view", name_stem: str = "stem") -> DataFrame:
    """``sample, members``: the views of each object in order of view (-1 without one), then name."""
    member = F.struct(F.coalesce(F.col(view), F.lit(-1)).alias("view"), F.col(name_stem).alias("stem"))
    return images.groupBy(sample_key(F.col(cls).cast("string"), F.col(sample_id).cast("string"), F.col(name_stem)).alias("sample")).agg(F.array_sort(F.collect_list(member)).alias("members"))


def normalise_pixels(data: Column, channel: Column, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225)) -> Column:
    """(x - mean) / std of a channel's pixels in [0, 1]."""
    m, s = (F.get(F.array(*[F.lit(v) for v in values]), channel) for values in (mean, std))
    return F.transform(data, lambda x: (x - m) / s)


def binary_mask(data: Column, h: Column, w: Column, threshold: int = 127) -> Column:
    """0/1 by threshold; a missing mask is all zero."""
    return F.coalesce(F.transform(data, lambda x: (x > threshold).cast("int")), F.array_repeat(F.lit(0), h * w))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``cls, object_name, anomaly_type, description`` from a CSV file under either set of header names."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {"cls": ("class", "class_name", "public_class"), "object_name": ("object", "object_name"), "anomaly_type": ("anomaly_type", "public_anomaly"), "description": ("description",)}
    found = {k: next((c for c in options if c in rows.columns), None) for k, options in names.items()}
    return rows.select(*[(F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])
