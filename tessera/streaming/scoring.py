"""Micro-batch scoring of arriving rows with a fixed, fitted bank."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.retrieval import bank_distances
from tessera.store import checkpoint_root


def score_stream(stream: DataFrame, bank: DataFrame, target: str, checkpoint: str, k: int = 1, metric: str = "cosine", others: bool = False):
    """A query that scores each micro-batch against ``bank`` and appends ``vec_id, distance`` as Parquet.

    Batches are written under their number, so a batch that runs again after a failure
    replaces what it wrote before.
    """

    def score(batch: DataFrame, number: int) -> None:
        bank_distances(batch, bank, k, metric, others=others).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream_once(spark: SparkSession, sf_dir: str, bank: DataFrame) -> DataFrame:
    """All rows of ``embeddings``, read as a stream and scored in micro-batches."""
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    root = f"{checkpoint_root(spark)}/tessera/stream-{uuid.uuid4().hex}"
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/embeddings*.parquet")
    asked = files.select("vec_id", A.as_double(F.col("embedding")).alias("embedding"))
    score_stream(asked, bank, f"{root}/out", f"{root}/state", others=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("vec_id", F.round("distance", 5).alias("distance"))
