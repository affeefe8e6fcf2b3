"""Sharding by extendible hashing, with DataFrame functions only.

A document's shard is the shortest prefix of its key's hash whose bucket fits the byte
limit: buckets that are too large, and only those, split on the next bit. The sizes of
all prefixes come from one aggregation over fine cells, so the depth of every bucket is
known at once instead of by splitting bit by bit; cells that are still too large are
cut finer in another round. The hash has 60 bits of the key and then 60 of a row
number, so one key with a third of all rows spreads over as many shards as it fills.

Defined results: a null id hashes as an empty one; a null or empty text has no bytes.
A single document larger than the limit gets a bucket of its own, the only kind that
exceeds it. Repeated rows share a shard until their key alone is too large. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import keep

BITS = 60
LIMIT = 1 << 20
#: Cells are this many bits finer than an even split would need, and this many finer again in each later round.
FINER = 4


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth) -> Column:
    """The first ``depth`` bits of the two hash words, as a string of 0 and 1."""
    bits = F.concat(F.lpad(F.bin("_h1"), BITS, "0"), F.lpad(F.bin("_h2"), BITS, "0"))
    return F.substring(bits, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, local_depth, shard`` for every row; ``shard`` is the bucket's bit prefix ("" for the only bucket)."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), size.alias("n_bytes"), key_hash(F.col(key)).alias("_h1"))
    number = F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.monotonically_increasing_id()), 64 - BITS)
    rows = keep(rows.withColumn("_h2", number), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    todo, found, floor = rows, [], 0
    while True:
        cells = todo.groupBy(_prefix(depth).alias("_cell")).agg(F.sum("n_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        cells = keep(cells, f"cells-{depth}")
        levels = cells.select("_cell", "_bytes", "_rows", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("_depth"))
        levels = levels.withColumn("_bucket", F.substring(F.col("_cell"), F.lit(1), F.col("_depth")))
        sizes = levels.groupBy("_depth", "_bucket").agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
        fits = sizes.where((F.col("_bytes") <= limit) | (F.col("_rows") == 1)).select("_depth", "_bucket")
        depths = levels.join(fits, ["_depth", "_bucket"]).groupBy("_cell").agg(F.min("_depth").alias("local_depth"))
        depths = keep(cells.select("_cell").join(depths, "_cell", "left"), f"depths-{depth}")
        placed = todo.withColumn("_cell", _prefix(depth)).join(depths, "_cell").drop("_cell")
        found.append(placed.where("local_depth is not null"))
        if depth == 2 * BITS or depths.where("local_depth is null").isEmpty():
            break
        todo = keep(placed.where("local_depth is null").drop("local_depth"), f"oversized-{depth}")
        floor, depth = depth + 1, min(2 * BITS, depth + 2 * FINER)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_key").alias(key), "n_bytes", F.col("local_depth").cast("int").alias("local_depth"), _prefix(F.col("local_depth")).alias("shard"))


def directory(placed: DataFrame) -> DataFrame:
    """The directory: one row per shard with its rows, its bytes and how many of the 2^global_depth entries point to it."""
    buckets = placed.groupBy("shard", "local_depth").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    deepest = buckets.agg(F.max("local_depth").alias("global_depth"))
    return buckets.crossJoin(F.broadcast(deepest)).withColumn("entries", F.pow(F.lit(2.0), F.col("global_depth") - F.col("local_depth")))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, with at most 1 MiB of text in a shard."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT doc_id, n_bytes, h, CAST(k AS INTEGER) AS k, h >> ({BITS} - CAST(k AS INTEGER)) AS bucket FROM docs, range(0, 41) r(k)),
sizes AS (SELECT k, bucket, sum(n_bytes) AS total, count(*) AS n FROM levels GROUP BY k, bucket),
depths AS (
  SELECT l.doc_id, l.n_bytes, l.h, min(l.k) AS local_depth
  FROM levels l JOIN sizes s ON l.k = s.k AND l.bucket = s.bucket
  WHERE s.total <= {LIMIT} OR s.n = 1
  GROUP BY l.doc_id, l.n_bytes, l.h)
SELECT doc_id, n_bytes, local_depth,
       CASE WHEN local_depth = 0 THEN '' ELSE right(lpad(bin(h >> ({BITS} - local_depth)), {BITS}, '0'), local_depth) END AS shard
FROM depths
"""
