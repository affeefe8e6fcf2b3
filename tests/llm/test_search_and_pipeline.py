import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup, topk
from tessera.llm.graph import components


def brute(rows, k=5):
    fine = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.pad(v, (0, width - len(v)))) for i, v in fine]
    out = []
    for q, v in fine:
        if q % 50 == 0:
            scored = sorted((-int(v @ c), i) for i, c in fine if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        for name, value in (("BLOCK", 60), ("LEAST_BLOCK", 20), ("QUERY_NUMBERS", 18), ("SLICE", 16)):
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(scale=rng.choice([0.05, 1.0]), size=6).astype(np.float32).tolist()) for i in range(420)]
    rows += [(1000 + i, [0.5] * 6) for i in range(80)]  # ties
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [9.0] * 6), (2200, []), (2201, [3.0]), (2250, [1e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("block", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_products(df, F.col("id") % 50 == 0).collect())
    assert got == brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])


def test_scores_beyond_64_bits_count_as_the_nearest(spark):
    rows = [(0, [1e16, 1e16]), (1, [1e16, 1e16]), (2, [-1e16, -1e16]), (3, [3e16, 0.0]), (50, [1e-3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_products(df, F.col("id") == 0).collect()}
    assert got[(0, 1)] == got[(0, 3)] == 2**63 - 1 and got[(0, 2)] == -(2**63) and got[(0, 50)] == 0
    ranks = {r["vec_id"]: r["rank"] for r in topk.top_products(df, F.col("id") == 0).collect()}
    assert (ranks[1], ranks[3], ranks[50], ranks[2]) == (1, 2, 3, 4)


def test_search_without_rows_or_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(empty, F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_products(few, F.col("id") % 50 == 0).collect()] == [(50, 1, 1, 256 * 512)]
    assert topk.top_products(few.where("vec_id = 1"), F.col("id") % 50 == 0).count() == 0


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1] or any(x in p for p in links if p[0] != p[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(0)
    parts = ["an", "ber", "col", "den", "er", "fin", "gol", "hin"]

    def text(bad=False, toxic=False):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(25, 60))]
        words = [w.upper() + "!!" for w in words] if bad else words
        return " ".join([*words, "zquix", "zqoot", "zquix"]) if toxic else " ".join(words)

    rows, labels = [], []
    for k in range(360):
        kind = k % 4
        rows.append((k, text(bad=kind == 1, toxic=kind == 2), "en", "s", 0))
        labels.append((k, int(kind != 1), int(kind == 2)))
    rows += [(1000, rows[0][1], "en", "s", 0), (1001, rows[0][1] + " token = abcdef123", "en", "s", 0), (1002, text() + " token = abcdef123", "en", "s", 0), (1003, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for number, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{number}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
        if number < 4:
            assert docs.columns == before.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert sum(1 for k in range(360) if k % 4 == 2 and k in ids) <= 4 and sum(1 for k in range(360) if k % 4 != 2 and k in ids) >= 265
        elif name == "quality":
            assert sum(1 for k in range(360) if k % 4 == 1 and k in ids) <= 4 and 1003 in ids
        elif name == "near_duplicates":
            assert 0 in ids and 1000 not in ids and 1001 not in ids
        elif name == "secrets":
            row = docs.where("doc_id = 1002").first()
            assert row["text"].endswith("[secret]") and row["n_chars"] == len(row["text"])
    fills = {r["sequence_id"]: r["n"] for r in docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert max(fills.values()) <= 4096


def test_near_duplicate_stage_keeps_one_of_each_component_of_a_large_group(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(neardup, "TASK_DOCUMENTS", 8)
    base = [f"w{k}" for k in range(120)]
    far = [f"x{k}" if k < 60 and k % 10 == 0 else w for k, w in enumerate(base)]  # 0.59 from the first ones, 0.70 from those between
    between = [f"x{k}" if k < 20 and k % 10 == 0 else w for k, w in enumerate(base)]
    texts = [" ".join([*words[:at], f"y{at}", *words[at + 1 :]]) for words in (base, between, far) for at in range(100, 120)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    kept = pipeline.near_duplicate(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == set(label) and len(set(label)) > 1


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Labels of one class, clashing column names, no rows."""
    import corpus_pipeline as pipeline

    clashing = "doc_id long, text string, _row long, row string, key string, _base string, _label int, _text string, kept boolean, length long, piece string"
    rows = [(k, f"some words of document {k} " * 5 + "token = abcdef123", k, "r", "k", "b", 1, "t", True, 5, "p") for k in range(6)] + [(6, None, 6, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, clashing)
    for n, labels in enumerate(([(k, 1, 0) for k in range(6)], [], [(0, None, None), (None, 0, 1)])):
        folder = tmp_path / str(n)
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        for stage in (pipeline.toxicity, pipeline.quality) if n else (pipeline.toxicity, pipeline.quality, pipeline.near_duplicate, pipeline.secrets):
            out = stage(spark, docs, str(folder))
            assert out.columns == docs.columns and out.count() == 7
            assert {(r["row"], r["_row"], r["_base"]) for r in out.where("doc_id < 6").collect()} == {("r", k, "b") for k in range(6)}
    packed = pipeline.packing(spark, docs, str(tmp_path))
    assert packed.count() == 7 and {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path / "0")).count() == 0
