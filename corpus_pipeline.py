"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, applies one operator to all of
them and lets its decisions take effect: toxic and low-quality documents go, one
document of each near-duplicate group stays, secrets are cut out of the texts, and what
is left is packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import remainder
from tessera.llm.neardup import BROADCAST_ROWS, near_duplicates
from tessera.llm.packing import pack, pieces_of
from tessera.llm.quality import fit_quality, quality_score
from tessera.llm.secrets import redact
from tessera.llm.store import keep
from tessera.llm.toxicity import fit_toxicity, toxicity_score
from tessera.ship import ship

#: A document goes at this toxicity or above, and below this quality.
TOXIC, GOOD = 0.3, 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the string-kernel machine does not call toxic (a null or empty text stays).

    Without labels of both classes there is no machine, and all documents stay. Repeated rows
    go or stay together; other columns pass through whatever their names are.
    """
    ship(spark)
    model = fit_toxicity(docs, _labels(spark, sf_dir), remainder("doc_id", 4) != 2)
    return docs if model.calibrate is None else docs.where(toxicity_score(model) < TOXIC)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier calls good (a null or empty text gets the share of good labels).

    Without labels of both classes there is no classifier, and all documents stay. Repeated
    rows go or stay together; other columns pass through whatever their names are.
    """
    ship(spark)
    model = fit_quality(docs, _labels(spark, sf_dir), remainder("doc_id", 5) != 0)
    return docs if model.calibrate is None else docs.where(quality_score(model) >= GOOD)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, of repeated rows one; null ids come last.

    Documents without words stay, each of them. Other columns pass through whatever their names are.
    """
    ship(spark)
    numbered = keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    key = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.coalesce(F.col("doc.doc_id"), F.lit(0)).alias("id"), "row")
    judged = near_duplicates(numbered.select(key.alias("key"), F.col("doc.text").alias("text")), key="key")
    dropped = keep(judged.where(~F.col("kept")).select("key.row"), "dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return numbered.join(F.broadcast(dropped) if small else dropped, "row", "left_anti").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret cut out of the text, and their length in characters.

    No row goes. A null or empty text stays as it is; repeated rows are cut alike; other
    columns pass through whatever their names are.
    """
    out = redact(docs)
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens.

    A null or empty text is a piece of the end token alone; repeated rows and rows without
    an id are packed each on their own; columns other than id and text are not read.
    """
    import public_tokenizers

    ship(spark)
    return pack(pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicate), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
