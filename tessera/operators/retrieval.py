"""Nearest-neighbour memory banks, coresets and principal components over patch features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.ordering import percentiles
from tessera.store import keep

#: Bank rows and queries that a task holds at once, bytes of a bank that may be sent to every task, and rows that one task picks a coreset from.
BLOCK, QUERIES, BROADCAST_BYTES, CORESET_ROWS = 8_192, 32_768, 256 << 20, 100_000


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def bank_distances(queries: DataFrame, bank: DataFrame, k: int = 1, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", others: bool = False) -> DataFrame:
    """``key, distance`` for every query: the mean over its ``min(k, bank)`` nearest bank rows.

    ``cosine``: 1 - similarity; ``l2``: squared Euclidean distance. A bank of checked size
    is sent along whole. A larger bank is dealt into blocks and the queries too; a task
    compares a block of either and gives the k best of each query, and the best of all
    blocks are averaged. An empty bank gives null distances. With ``others``, a bank row of
    the query's own key is left out.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    dim = bank.agg(F.max(F.size(vector)), F.count(F.lit(1))).first()
    width, count = dim[0] or 0, dim[1]
    if count == 0:
        return queries.select(key, F.lit(None).cast("double").alias("distance"))
    if width * count * 8 <= BROADCAST_BYTES:
        rows = bank.select(key, A.as_double(F.col(vector)).alias(vector)).toArrow()
        held = queries.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), matrix(rows[vector])))

        @F.pandas_udf("double")
        def nearest(keys: pd.Series, vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            ids, block = held.value
            best = _nearest(np.stack(vectors.to_numpy()).astype(float), block, k, metric, (keys.to_numpy(), ids) if others else None)
            found = np.isfinite(best)
            return pd.Series([b[f].mean() if f.any() else None for b, f in zip(best, found, strict=True)] if others else best.mean(1), dtype="Float64" if others else float)

        return queries.select(key, nearest(F.col(key), F.col(vector)).alias("distance"))
    blocks, parts = -(-count // BLOCK), max(1, -(-queries.count() // QUERIES))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other)
        return rows.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("long").alias(own), every, key, vector)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({key: [], "distance": []}).astype({key: "int64", "distance": "float64"})
        best = _nearest(np.stack(left[vector].to_numpy()).astype(float), np.stack(right[vector].to_numpy()).astype(float), k, metric, (left[key].to_numpy(), right[key].to_numpy()) if others else None)
        return pd.DataFrame({key: np.repeat(left[key].to_numpy(), best.shape[1]), "distance": best.ravel()})

    asked, held = dealt(queries, "_part", parts, "_block", blocks), dealt(bank, "_block", blocks, "_part", parts)
    found = asked.groupBy("_part", "_block").cogroup(held.groupBy("_part", "_block")).applyInPandas(compare, f"{key} long, distance double")
    order = Window.partitionBy(key).orderBy("distance")
    found = found.where(F.col("distance") < float("inf")) if others else found
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).groupBy(key).agg(F.avg("distance").alias("distance"))


def _nearest(queries: np.ndarray, bank: np.ndarray, k: int, metric: str, keys: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The smallest ``min(k, len(bank))`` distances of each query, ascending; with ``keys`` of both, infinite to the same key."""
    if metric == "cosine":
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        bank = bank / np.maximum(np.linalg.norm(bank, axis=1, keepdims=True), 1e-12)
    k = min(k, len(bank))
    parts = []
    for top in range(0, len(queries), 1024):
        q = queries[top : top + 1024]
        best = np.full((len(q), 0), np.inf)
        for a in range(0, len(bank), BLOCK):
            b = bank[a : a + BLOCK]
            d = 1 - q @ b.T if metric == "cosine" else np.maximum((q * q).sum(1)[:, None] - 2 * q @ b.T + (b * b).sum(1), 0)
            if keys is not None:
                d[keys[0][top : top + 1024, None] == keys[1][a : a + BLOCK]] = np.inf
            best = np.sort(np.concatenate([best, np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
        parts.append(best)
    return np.concatenate(parts)


def projection(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, dims)) / np.sqrt(dims)


def project(df: DataFrame, dims: int = 32, seed: int = 0, vector: str = "embedding", width: int = 64) -> DataFrame:
    """``df`` with ``projected``: a seeded Gaussian random projection, scaled by 1 / sqrt(dims)."""
    table = projection(width, dims, seed)

    @F.pandas_udf("array<double>")
    def turned(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_numpy()).astype(float) @ table) if len(vectors) else [], dtype=object)

    return df.withColumn("projected", turned(F.col(vector)))


def _greedy(keys: np.ndarray, vectors: np.ndarray, n: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy k-center over rows in order of their keys, beginning with the first: the chosen rows and their turns."""
    distance = np.full(len(keys), np.inf)
    fresh, chosen, turns, turn = np.zeros(1, dtype=np.int64), [], [], 0
    while len(fresh):
        chosen.append(fresh)
        turns.append(np.full(len(fresh), turn))
        for centre in vectors[fresh]:
            np.minimum(distance, ((vectors - centre) ** 2).sum(1), out=distance)
        for done in chosen[-1:]:
            distance[done] = -1.0
        turn += 1
        left = min(batch, n - sum(map(len, chosen)))
        if left <= 0:
            break
        order = np.array([np.argmax(distance)]) if left == 1 else np.argsort(-distance, kind="stable")[:left]
        fresh = order[distance[order] >= 0]
    return np.concatenate(chosen), np.concatenate(turns)


def coreset(df: DataFrame, n: int, batch: int = 1, key: str = "vec_id", vector: str = "projected") -> DataFrame:
    """``key, turn``: ``n`` rows chosen by greedy k-center, ``batch`` at a time, beginning with the smallest key.

    Up to ``CORESET_ROWS`` rows one task picks them, each time those farthest from all
    chosen (ties by key). More rows are dealt into blocks of at most that size, every block
    picks its own, and the picks are put together and picked from again; where more are
    asked for than one task can pick from, each block gives its share of ``n``.
    """
    rows = df.select(key, A.as_double(F.col(vector)).alias("v"))
    count, n = rows.count(), max(n, 0)
    schema = f"{key} long, v array<double>, turn int"

    def pick(part: pd.DataFrame, wanted: int) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        chosen, turns = _greedy(part[key].to_numpy(), np.stack(part["v"].to_numpy()), wanted, batch)
        return part.iloc[chosen][[key, "v"]].assign(turn=turns.astype(np.int32))

    if not count or not n:
        return df.select(key, F.lit(0).alias("turn")).limit(0)
    while count > CORESET_ROWS:
        blocks = -(-count // (CORESET_ROWS // 2))
        last = 2 * n > CORESET_ROWS
        each = -(-n // blocks) if last else max(1, min(n, CORESET_ROWS // 2 // blocks + 1))
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
        picked = keep(dealt.groupBy("_block").applyInPandas(lambda part, each=each: pick(part, each), schema), "coreset")
        if last:
            return picked.orderBy("turn", key).limit(n).select(key, "turn")
        rows, before = picked.select(key, "v"), count
        count = rows.count()
        if count >= before:
            break
    return rows.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda part: pick(part, n), schema).select(key, "turn")


def principal_components(df: DataFrame, dims: int, vector: str = "embedding", width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, leading directions (rows) and explained variance shares, from moments added up over partitions."""

    def moments(batches):
        n, first, second = 0, np.zeros(width), np.zeros((width, width))
        for rows in batches:
            if len(rows):
                m = np.stack(rows[vector].to_numpy()).astype(float)
                n, first, second = n + len(m), first + m.sum(0), second + m.T @ m
        table = np.concatenate([[n], first, second.ravel()])
        yield pd.DataFrame({"i": np.arange(len(table)), "x": table})

    summed = df.select(vector).mapInPandas(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    flat = np.array([r["x"] for r in summed])
    n = max(flat[0], 1.0)
    centre = flat[1 : 1 + width] / n
    spread = flat[1 + width :].reshape(width, width) / n - np.outer(centre, centre)
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values)[:dims]
    return centre, vectors[:, order].T, values[order] / max(values.sum(), 1e-300)


def projections(vector: Column, centre: np.ndarray, directions: np.ndarray) -> Column:
    """The coordinates of centred vectors along each direction, inside the JVM."""
    shifted = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in centre]), lambda x, m: x.cast("double") - m)
    return F.array(*[A.dot(shifted, F.array(*[F.lit(float(x)) for x in d])) for d in directions])


def foreground(df: DataFrame, keep_pct: float = 75.0, vector: str = "embedding", width: int = 64) -> DataFrame:
    """Rows whose projection on the first component is at least the (1 - keep) quantile in size; the sign never matters."""
    centre, directions, _ = principal_components(df, 1, vector, width)
    scored = df.withColumn("pc1", F.abs(F.get(projections(F.col(vector), centre, directions), F.lit(0))))
    bound = percentiles(scored, "pc1", [1 - keep_pct / 100]).first()
    return scored.where(F.col("pc1") >= F.lit(bound["p0"] if bound else None))


def select_references(df: DataFrame, n: int, view: str, key: str) -> DataFrame:
    """At most ``n`` rows round-robin over the views: the first by hash of every view, then the second, and so on."""
    order = Window.partitionBy(view).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("round", F.row_number().over(order)).orderBy("round", view).limit(n)
