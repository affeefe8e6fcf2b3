"""Intermediate tables in the shared checkpoint folder, and how many tasks to use.

Results that are read more than once are written as Parquet under the folder that
``spark.checkpoint.dir`` names, which every executor can reach, so a lost executor
costs only its running tasks. The setting is read from the session; where it is unset,
a session in a single process (tests, a laptop) gets a local folder, and any other
session is refused, because its executors would not see one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def keep(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and return the table read back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
