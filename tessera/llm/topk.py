"""Exact top-k inner products over norm-sorted blocks, with SVD-rotated partial sums.

Vectors become whole numbers floor(256 x). All of them are range-dealt into blocks by
descending length and written in that order. Queries go in blocks of bounded size, each
sent to the tasks that read the vectors, which themselves are never shuffled again. A
first pass over the block of the longest vectors gives each query a score that its k-th
neighbour reaches at least; the other blocks are then read from that score on. Vectors go
by in slices of descending length: a query passes over a slice whose length bound |q| |c|
stays below its k-th score so far; else the inner product over the leading coordinates of
an SVD rotation, plus the product of what is left of both lengths (Cauchy-Schwarz),
bounds each score from above, and only pairs that can still reach the k-th score get
their exact integer product. A task gives at most k rows a query.

Defined results: vectors that are null or hold null or non-finite components, and rows
without an id, take no part. Shorter vectors count as padded with zeros. A query never
finds rows with its own id; repeated query rows are queries each. Ties go to the smaller
id, repeated candidates stand as often as they occur. Components and scores beyond 64
bits count as the nearest 64-bit number. An empty table, or one without queries, gives
an empty result. Columns other than key and vector are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import keep, tasks

SCALE = 256.0
#: Vectors of a block, numbers of the queries that are sent to every task at once (64 MB), and the slice of vectors that is bounded at once.
BLOCK, LEAST_BLOCK, QUERY_NUMBERS, SLICE = 32_768, 4_096, 8 << 20, 2_048
#: Share of the squared length that the leading coordinates must hold.
LEADING = 0.72


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` with ``v`` the array of floor(256 x), for the rows that take part."""
    fine = f"{vector} IS NOT NULL AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return rows.where(F.col(key).isNotNull()).where(fine).select(F.col(key).cast("long").alias("id"), F.expr(f"transform({vector}, x -> cast(floor({SCALE}D * cast(x AS double)) AS double))").alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of numbers as a matrix, padded with zeros."""
    sizes = np.fromiter(map(len, column), dtype=np.int64, count=len(column))
    flat = np.concatenate(column.to_list()) if len(column) else np.zeros(0)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of all rows by descending singular value, from partial Gram matrices, and how many of them lead."""

    def gram(batches):
        total = np.zeros((width, width))
        for rows in batches:
            m = _matrix(rows["v"], width)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pd.DataFrame({"i": i, "j": j, "g": total.ravel()})

    rows = vectors.select("v").mapInPandas(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    total = np.zeros((width, width))
    for r in rows:
        total[r["i"], r["j"]] = r["g"]
    values, turn = np.linalg.eigh((total + total.T) / 2)
    energy = np.cumsum(np.maximum(values[::-1], 0))
    return turn[:, ::-1], int(min(width, np.searchsorted(energy, LEADING * energy[-1]) + 1))


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row integer inner products of matrices of whole numbers."""
    if not len(left):
        return np.zeros(0, dtype=np.int64)
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1] < 2**53:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left, right, strict=True))
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], dtype=np.int64)


class Search:
    """The k best vectors of each query so far, over slices of vectors in any order (descending lengths prune most)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, turn: np.ndarray, lead: int, k: int):
        self.ids, self.q, self.floor, self.turn, self.lead, self.k = ids, vectors, floor.copy(), turn, lead, k
        self.lengths = np.linalg.norm(vectors, axis=1)
        turned = vectors @ turn
        self.leading, self.rest = np.ascontiguousarray(turned[:, :lead]), np.linalg.norm(turned[:, lead:], axis=1)
        self.best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lengths = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-lengths, kind="stable")
        for top in range(0, len(ids), SLICE):
            part = order[top : top + SLICE]
            slack = 1e-9 * (1 + self.lengths * lengths[part[0]]) + 1e-6
            live = np.flatnonzero(self.lengths * lengths[part[0]] + slack >= self.floor)
            if not len(live):
                return
            turned = vectors[part] @ self.turn
            leading, rest = turned[:, : self.lead].T, np.linalg.norm(turned[:, self.lead :], axis=1)
            for block in np.array_split(live, -(-len(live) // 512)):
                bound = self.leading[block] @ leading
                bound += self.rest[block][:, None] * rest
                bound += slack[block][:, None]
                i, j = np.nonzero(bound >= self.floor[block][:, None])
                self._score(block[i], part[j], ids, vectors)

    def _score(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        scores = np.concatenate([exact_products(self.q[i[a : a + 50_000]], vectors[j[a : a + 50_000]]) for a in range(0, len(i), 50_000)])
        inside = np.isin(self.best[0], i)
        held = tuple(b[~inside] for b in self.best)
        best = _best(np.concatenate((self.best[0][inside], i)), np.concatenate((self.best[1][inside], ids[j])), np.concatenate((self.best[2][inside], scores)), self.k)
        query, first, n = np.unique(best[0], return_index=True, return_counts=True)
        full = n >= self.k
        self.floor[query[full]] = np.maximum(self.floor[query[full]], best[2][(first + n - 1)[full]])
        self.best = tuple(np.concatenate((x, y)) for x, y in zip(held, best, strict=True))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query)
    use = np.arange(len(query)) - first < k
    return query[use], ids[use], scores[use]


def _search(queries: tuple[np.ndarray, np.ndarray, np.ndarray], floor: np.ndarray, vectors: DataFrame, turned: tuple[np.ndarray, int], k: int) -> DataFrame:
    """At most k rows for each query and task: ``q_row, query_id, vec_id, score``. ``queries``: row numbers, ids, vectors."""
    held = vectors.sparkSession.sparkContext.broadcast((queries, floor, turned))

    def search(batches):
        (q_rows, q_ids, q), least, (turn, lead) = held.value
        found = None
        for rows in batches:
            if len(rows):
                found = found or Search(q_ids, q, least, turn, lead, k)
                found.add(rows["id"].to_numpy(), _matrix(rows["v"], len(turn)))
        if found is not None:
            who, ids, scores = found.best
            yield pd.DataFrame({"q_row": q_rows[who], "query_id": q_ids[who], "vec_id": ids, "score": scores})

    return vectors.select("id", "v").mapInPandas(search, "q_row long, query_id long, vec_id long, score long")


def top_products(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of every query with all other rows.

    ``is_query`` is a predicate over the column ``id``, the rows' key.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, key, vector).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    count, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    blocks = max(1, -(-count // BLOCK), min(tasks(spark), count // LEAST_BLOCK))
    dealt = vectors.repartitionByRange(blocks, F.col("length").desc(), F.xxhash64("id"), F.monotonically_increasing_id())
    vectors = keep(dealt.withColumn("block", F.spark_partition_id().cast("long")).sortWithinPartitions(F.col("length").desc()), "vectors")
    turned = rotation(vectors, width)
    asked = vectors.where(is_query).select("id", "v")
    n_queries = asked.count()
    parts = max(1, -(-n_queries * width // QUERY_NUMBERS))
    asked = keep(asked.withColumn("q_row", F.monotonically_increasing_id()).withColumn("qb", F.pmod(F.xxhash64("q_row"), F.lit(parts))), "queries")
    first = vectors.agg(F.min("block")).first()[0] or 0
    longest, others = vectors.where(F.col("block") == first).repartition(tasks(spark)), vectors.where(F.col("block") != first)
    found = None
    for part in range(parts):  # a block of queries of bounded size
        table = asked.where(F.col("qb") == part).select("q_row", "id", "v").toArrow()
        queries = (table["q_row"].to_numpy(), table["id"].to_numpy(), _matrix(table["v"].to_pandas(), width))
        opening = keep(_search(queries, np.full(len(queries[0]), -np.inf), longest, turned, k), "opening")
        order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id"))
        opening = opening.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        reached = opening.where(F.col("n") == k).select("q_row", "score").toArrow()
        floor = pd.Series(reached["score"].to_numpy().astype(float), index=reached["q_row"].to_numpy()).reindex(queries[0], fill_value=-np.inf).to_numpy()
        both = opening.drop("n").unionByName(_search(queries, floor, others, turned, k))
        found = both if found is None else found.unionByName(both)
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores) WHERE place <= 5
"""
