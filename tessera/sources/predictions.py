"""Score maps at rest: sanitised predictions, submissions and run ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.functions.arrays import each, let
from tessera.functions.raster import resize_bilinear
from tessera.operators.alignment import align
from tessera.operators.ordering import calibration, normalised, percentiles, running_totals
from tessera.store import checkpoint_root

SIDE = 224


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def sanitised(data: Column) -> Column:
    """A map without non-finite values: NaN and -inf become its least finite value, +inf its largest; without any, zeros."""
    fine = F.filter(data, _finite)

    def mended(b: Column) -> Column:
        return F.transform(data, lambda x: F.when(_finite(x), x).when(x == float("inf"), b["high"]).otherwise(b["low"]))

    bounds = F.struct(F.coalesce(F.array_min(fine), F.lit(0.0)).alias("low"), F.coalesce(F.array_max(fine), F.lit(0.0)).alias("high"))
    return let(bounds, mended)


def write_predictions(maps: DataFrame, path: str, with_masks: bool = False) -> None:
    """Write ``image_id, run_id, split, cls, anomaly_type, view, h, w, data[, mask]`` as Parquet by run and split.

    A null view is stored as -1, a null type as "unknown"; masks are binarised. Raises on
    an empty table, and on a missing mask where masks are wanted.
    """
    if maps.isEmpty():
        raise ValueError("there are no predictions to write")
    out = maps.withColumns({"view": F.coalesce("view", F.lit(-1)), "anomaly_type": F.coalesce("anomaly_type", F.lit("unknown")), "data": sanitised(F.col("data"))})
    if with_masks:
        binary = F.transform("mask", lambda x: (x > 0).cast("int"))
        out = out.withColumn("mask", F.when(F.col("mask").isNull(), F.raise_error(F.lit("a mask is missing")).cast("array<int>")).otherwise(binary))
    elif "mask" in out.columns:
        out = out.drop("mask")
    out.write.mode("overwrite").partitionBy("run_id", "split").parquet(path)


def read_predictions(spark: SparkSession, path: str, run_id: str | None = None, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    for column, value in (("run_id", run_id), ("split", split)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def clipped_share(maps: DataFrame, data: str = "data", key: str = "image_id", maps_seen: int = 64) -> DataFrame:
    """Whether scores look clipped: the 99.9th percentile of every n-th map meets the largest score."""
    n = maps.count()
    step = max(1, n // maps_seen)
    placed = running_totals(maps.select(key, data).withColumn("_one", F.lit(1)), (), [F.col(key)], {"_nth": "_one"})
    pixels = each(placed.where((F.col("_nth") - 1) % step == 0), [], F.col(data), "_p", "x")
    top = maps.agg(F.max(F.array_max(data)).alias("largest"))
    return percentiles(pixels, "x", [0.999]).withColumnRenamed("p0", "p999").crossJoin(top).withColumn("clipped", F.abs(F.col("p999") - F.col("largest")) <= 1e-8 + 1e-5 * F.abs("largest"))


def submission(maps: DataFrame, calibrate: bool = True, side: int = SIDE, key: str = "image_id") -> DataFrame:
    """``ID, Label`` from score maps: resized, scaled by the global 1 and 99.5 percentiles (or clipped), and encoded.

    A repeated id raises.
    """
    if not maps.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("ids must be unique")
    small = maps.select(F.col(key).cast("string").alias("ID"), F.transform(resize_bilinear(F.col("data"), F.col("h"), F.col("w"), side, side), lambda x: x.cast("double")).alias("data"))
    if calibrate:
        row = calibration(each(small, [], F.col("data"), "_p", "x"), "x").first()
        lo, hi = (row["lo"], row["hi"]) if row else (0.0, 1.0)
    else:
        lo, hi = 0.0, 1.0
    scaled = F.transform("data", lambda x: normalised(x, F.lit(lo), F.lit(hi)))
    return small.select("ID", codec.encode(codec.quantise(scaled), F.lit(side), F.lit(side)).alias("Label"))


def write_submission(rows: DataFrame, path: str, zip_it: bool = False, single: bool = True) -> str:
    """Write ``ID, Label`` as CSV with a header and return where: one file in order of ``ID``, or a folder of part files.

    A single file is written by one task, row by row, and moved to ``path``; ``zip_it``
    copies it into ``path`` with ``.zip`` for its suffix. Every step goes through Hadoop's
    file system, so the path can be in any store that Spark writes to.
    """
    if not single:
        if zip_it:
            raise ValueError("only a single file can be zipped")
        rows.select("ID", "Label").write.mode("overwrite").option("header", True).csv(path)
        return path
    spark = rows.sparkSession
    parts = f"{path}-{uuid.uuid4().hex}"
    rows.select("ID", "Label").orderBy("ID").coalesce(1).write.option("header", True).csv(parts)
    fs, target = _file_system(spark, path)
    written = [s.getPath() for s in fs.listStatus(_path(spark, parts)) if s.getPath().getName().startswith("part-")]
    fs.delete(target, False)
    if written:
        if not fs.rename(written[0], target):
            raise OSError(f"{path} could not be written")
    else:  # no rows, no part file: the header alone
        out = fs.create(target, True)
        out.write(bytearray(b"ID,Label\n"))
        out.close()
    fs.delete(_path(spark, parts), True)
    return zip_submission(spark, path) if zip_it else path


def zip_submission(spark: SparkSession, path: str) -> str:
    """A copy of one CSV file, deflated, beside it: ``x.csv`` becomes ``x.zip``."""
    fs, source = _file_system(spark, path)
    target = path.removesuffix(".csv") + ".zip"
    io = spark._jvm.java.util.zip
    out = io.ZipOutputStream(fs.create(_path(spark, target), True))
    out.putNextEntry(io.ZipEntry(source.getName()))
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(source), out, 1 << 20, False)
    out.closeEntry()
    out.close()
    return target


def unzipped(spark: SparkSession, path: str) -> str:
    """The first CSV file inside a zip, copied to the shared checkpoint folder."""
    fs, source = _file_system(spark, path)
    target = f"{checkpoint_root(spark)}/tessera/unzipped-{uuid.uuid4().hex}.csv"
    held = spark._jvm.java.util.zip.ZipInputStream(fs.open(source))
    entry = held.getNextEntry()
    while entry is not None and not entry.getName().endswith(".csv"):
        entry = held.getNextEntry()
    if entry is None:
        held.close()
        raise ValueError(f"{path} holds no CSV file")
    to, place = _file_system(spark, target)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, to.create(place, True), 1 << 20, True)
    return target


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    place = _path(spark, path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """``ID, Label`` of a submission folder, file or zip; rows with fewer fields are dropped, of repeated ids the last stays."""
    if path.endswith(".zip"):
        path = unzipped(spark, path)
    lines = spark.read.option("header", True).option("maxCharsPerColumn", -1).schema("ID string, Label string").csv(path)
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    out = last_of_each(lines.where("Label is not null"), "ID", "_at").select("ID", "Label")
    if out.isEmpty():
        raise ValueError(f"{path} holds no submission")
    return out


def test_scores(spark: SparkSession, paths: dict[str, str], ids: DataFrame | None = None) -> DataFrame:
    """``image_id, h, w`` and an array column in [0, 1] for each method, for the ids that all submissions hold.

    Maps of another shape than the first method's are brought to it by nearest neighbour.
    """
    held = {name: submission_maps(read_submission(spark, path), ids) for name, path in paths.items()}
    maps = align({name: rows.select("ID", F.struct("h", "w", "data").alias("m")) for name, rows in held.items()}, "ID", "m")
    flat = maps.select(F.col("ID").alias("image_id"), *[F.col(name)[part].alias(f"_{part}{i}") for i, name in enumerate(paths) for part in ("h", "w", "data")])
    h, w = F.col("_h0"), F.col("_w0")

    def fitted(i: int) -> Column:
        own_h, own_w, data = F.col(f"_h{i}"), F.col(f"_w{i}"), F.col(f"_data{i}")
        moved = F.transform(F.sequence(F.lit(0), h * w - 1), lambda p: F.get(data, F.floor(F.floor(p / w) * own_h / h).cast("int") * own_w + F.floor((p % w) * own_w / w).cast("int")))
        return F.when((own_h == h) & (own_w == w), data).otherwise(moved)

    return flat.select("image_id", h.alias("h"), w.alias("w"), *[fitted(i).alias(name) for i, name in enumerate(paths)])


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; an aggregation, so a repeated key never meets in one task in full."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(order)).alias("_row"))
    return packed.select("_row.*")


def submission_maps(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``ID, h, w, data`` in [0, 1], for the wanted ids only, decoded after the filter."""
    if ids is not None:
        rows = rows.join(ids.select("ID").distinct(), "ID", "left_semi")
    h, w = codec.shape(F.col("Label"))
    return rows.select("ID", h.alias("h"), w.alias("w"), codec.dequantise(codec.decode(F.col("Label"))).alias("data"))


def write_ledger_row(spark: SparkSession, path: str, row: dict) -> None:
    """Append one run to a ledger: a Parquet file of its own, so runs that end together don't overwrite each other."""
    text = {k: "" if v is None else str(v) for k, v in row.items()}
    spark.createDataFrame([tuple(text.values())], ", ".join(f"`{k}` string" for k in text)).coalesce(1).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a ledger; a column that a run did not have is the empty string."""
    return spark.read.option("mergeSchema", True).parquet(path).na.fill("")


def append_ledger(ledger: DataFrame | None, row: DataFrame, missing: str | None = "") -> DataFrame:
    """A ledger with a row more: the union of both column sets in first-seen order, gaps filled."""
    if ledger is None:
        return row
    out = ledger.unionByName(row, allowMissingColumns=True)
    return out if missing is None else out.na.fill(missing, [c for c, t in out.dtypes if t == "string"])


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each group by an order column."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
