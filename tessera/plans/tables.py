"""Queries over the other tables, and retrieval, scoring and stacking over ``embeddings``, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.operators import alignment, metrics, ordering, priors, retrieval, scoring, stacking
from tessera.plans import detectors
from tessera.plans.maps import _Q8, PX, _bilinear_sql, maps, q_encode
from tessera.sources import images, predictions
from tessera.streaming import scoring as streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", A.as_double(F.col("embedding")).alias("embedding"))


def scored_docs(spark, d) -> DataFrame:
    """Labelled documents: score is the length, label the quality."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.col("n_chars").alias("score"), F.col("quality").alias("label"))


# ---- scans, names and grouping ----


def q_scan_filter(spark, d):
    """The images of one class and split: the label and the view stand in for them."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("label").alias("cls"), (F.col("vec_id") % 5).alias("split"))
    return images.select(rows, 3, 2).select("vec_id", "label")


def q_classes(spark, d):
    return images.classes_in(table(spark, d, "embeddings").select(F.concat(F.lit("class_"), F.col("label")).alias("cls")))


def q_parse_view(spark, d):
    name = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("plain."), F.col("conv_id"), F.lit(".png"))).otherwise(F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("_view0"), F.col("turn"), F.lit(".png")))
    base, view = T.parse_view(name)
    return table(spark, d, "conversations").select("conv_id", "turn", base.alias("sample_id"), view.alias("view"))


def q_scan_tree(spark, d):
    """The columns of an image tree, from paths made of conversations; masks exist for even turns."""
    rows = table(spark, d, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("_view"), F.col("turn"))
    cls = F.concat(F.lit("/data/class_0"), F.col("conv_id") % 3)
    made = F.when(F.col("role") == "user", F.array(F.concat(cls, F.lit("/train/good/"), name, F.lit(".PNG")))).when(F.col("turn") % 4 == 1, F.array(F.concat(cls, F.lit("/test/deep/"), name, F.lit(".jpg")))).otherwise(
        F.array(F.concat(cls, F.lit("/train/dent/"), name, F.lit(".png")), F.concat(cls, F.lit("/ground_truth_train/dent/"), name, F.lit(".bmp")), F.concat(cls, F.lit("/notes/"), name, F.lit(".txt")))
    )
    return images.from_paths(rows.select(F.explode(made).alias("path")), "/data")


def q_group_by_sample(spark, d):
    rows = table(spark, d, "conversations").select(F.lit("cls").alias("cls"), F.col("conv_id").alias("sample_id"), F.col("turn").alias("view"), F.col("role").alias("stem"))
    out = images.group_by_sample(rows)
    return out.select("sample", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["view"], m["stem"])), ",").alias("members"))


def q_select_references(spark, d):
    return retrieval.select_references(table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("view")), 8, "view", "vec_id")


def q_align(spark, d):
    events = table(spark, d, "events")
    kinds = ["click", "view", "purchase"]
    found = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(3).collect()]
    kinds = kinds if set(kinds) <= set(found) else found
    parts = {f"m{i}": events.where(F.col("event_type") == k).groupBy("user_id").agg(F.max("value").alias("value")) for i, k in enumerate(kinds)}
    return alignment.align(parts, "user_id", "value")


def q_class_lookup(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("cls"))
    return alignment.with_class(table(spark, d, "documents").select("doc_id"), labels, "doc_id", "cls", default="unknown")


# ---- average precision ----


def _rounded_ap(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", "n_positive", F.round("ap", 9).alias("ap"))


def q_ap_pooled(spark, d):
    return _rounded_ap(metrics.average_precision(scored_docs(spark, d), "score", "label"))


def q_ap_per_image(spark, d):
    return _rounded_ap(metrics.average_precision(scored_docs(spark, d), "score", "label", ("source",)), "source")


def q_ap_summary(spark, d):
    each = metrics.average_precision(scored_docs(spark, d), "score", "label", ("lang", "source"))
    out = metrics.ap_summary(each.withColumn("anomaly_type", F.substring("source", 4, 1)), "lang", "anomaly_type")
    return out.select("lang", "anomaly_type", "n_views", *[F.round(c, 9).alias(c) for c in ("ap_mean", "ap_std", "ap_min", "ap_max")])


def q_ap_overall(spark, d):
    each = metrics.average_precision(scored_docs(spark, d), "score", "label", ("lang", "source"))
    summary = metrics.ap_summary(each.withColumn("anomaly_type", F.substring("source", 4, 1)), "lang", "anomaly_type")
    return metrics.overall(metrics.class_means(summary, "lang")).select(F.round("ap", 9).alias("ap"))


def _bank(spark, d):
    rows = vectors(spark, d)
    return rows.where(F.col("label") == 0), rows


def q_bank_ap(spark, d):
    """Average precision of a one-class memory bank: all normal rows against every row but itself, by view and pooled."""
    bank, asked = _bank(spark, d)
    scored = retrieval.bank_distances(asked, bank, others=True).join(asked.select("vec_id", "label"), "vec_id")
    scored = scored.select((F.col("vec_id") % 5).cast("string").alias("view"), F.round("distance", 9).alias("score"), (F.col("label") != 0).cast("int").alias("positive"))
    both = scored.unionByName(scored.withColumn("view", F.lit("all")))
    out = metrics.average_precision(both, "score", "positive", ("view",))
    return out.select("view", "n", "n_positive", F.round("ap", 6).alias("ap"))


def _ap_sql(source: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""s AS (SELECT {keys}score, sum((label > 0)::INT) AS tp, count(*) AS n FROM {source} GROUP BY {keys}score),
      t AS (SELECT *, sum(tp) OVER w AS tp_to, sum(n) OVER w AS n_to FROM s WINDOW w AS ({over}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      ap AS (SELECT {keys}CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS n_positive, CASE WHEN sum(tp) > 0 THEN sum(tp * tp_to / n_to) / sum(tp) ELSE 0 END AS ap FROM t {group})"""


_DOCS = "x AS (SELECT d.doc_id, lang, source, n_chars AS score, quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"

# ---- ordering ----


def q_calibration(spark, d):
    out = ordering.calibration(table(spark, d, "lineitem"), "l_extendedprice", by=("l_returnflag",))
    return out.select("l_returnflag", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def q_normalise_unit(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    bounds = ordering.calibration(events, "value")
    return events.crossJoin(F.broadcast(bounds)).select("event_id", F.round(ordering.normalised(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("x"))


def q_ecdf(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    out = ordering.ecdf(events.select("event_id", "value"), "value", events.where("event_type = 'view'"), "value", "event_id")
    return out.select("event_id", F.round("ecdf", 9).alias("ecdf"))


def q_zscore(spark, d):
    rows = vectors(spark, d).select("vec_id", "label", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))
    stats = metrics.term_statistics(rows.where("label = 0"), ["a", "b"])
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.select("vec_id", F.round((scoring.z_score(F.col("a"), F.col("a_mean"), F.col("a_std")) + scoring.z_score(F.col("b"), F.col("b_mean"), F.col("b_std"))) / 2, 5).alias("z"))


def q_hard_mining(spark, d):
    return metrics.hard_mean(table(spark, d, "events"), "value", 0.1, "event_id").select(F.col("k").cast("long").alias("k"), F.round("hard_mean", 6).alias("hard_mean"))


def q_order_statistic(spark, d):
    return metrics.order_statistic(table(spark, d, "events").select("event_id", "event_type", "value"), "value", 90.0, ("event_type",), "event_id")


def q_topk_class(spark, d):
    return metrics.top_k(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", 5, ("o_orderpriority",), "o_orderkey").select("o_orderpriority", F.col("rank").cast("long").alias("rank"), "o_orderkey", "o_totalprice")


# ---- retrieval and scoring ----


def _knn(k: int, metric: str):
    def run(spark, d):
        bank, asked = _bank(spark, d)
        return retrieval.bank_distances(asked, bank, k, metric, others=True).select("vec_id", F.round("distance", 5).alias("distance"))

    return run


def _knn_sql(k: int, metric: str) -> str:
    one = "1 - list_inner_product(q.e, b.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(b.e, b.e)))" if metric == "cosine" else "list_sum(list_transform(list_zip(q.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
      p AS (SELECT q.vec_id, {one} AS dist FROM v q JOIN v b ON b.label = 0 AND b.vec_id <> q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS n FROM p)
      SELECT vec_id, round(avg(dist), 5) AS distance FROM r WHERE n <= {k} GROUP BY vec_id"""


def q_kcenter(spark, d):
    rows = vectors(spark, d).where("label = 0")
    return retrieval.coreset(rows, 12, 1, "vec_id", "embedding")


def q_foreground(spark, d):
    """How many rows of each class the first component keeps, and its share of the variance."""
    rows = vectors(spark, d)
    kept = retrieval.foreground(rows, 75.0).groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    return kept


#: A mixture of three components over the 64 values of a vector: weights, means, precisions.
_MIX = (np.array([0.5, 0.3, 0.2]), np.array([[0.0] * 64, [0.1, -0.1] * 32, [-0.1, 0.1, 0.0, 0.0] * 16]), np.array([[60.0] * 64, [40.0, 50.0, 60.0, 70.0] * 16, [80.0, 40.0] * 32]))


def q_mixture(spark, d):
    rows = vectors(spark, d).select("vec_id", F.col("embedding").alias("v"))
    return rows.select("vec_id", F.round(-scoring.mixture_log_density(F.col("v"), *_MIX), 5).alias("nll"))


def _mixture_sql() -> str:
    terms = []
    for w, m, p in zip(*_MIX, strict=True):
        base = math.log(w) + 0.5 * float(np.log(p).sum()) - 32 * math.log(2 * math.pi)
        terms.append(f"{base!r}::DOUBLE - 0.5 * list_sum(list_transform(list_zip(e, {m.tolist()}::DOUBLE[], {p.tolist()}::DOUBLE[]), lambda x: x[3] * (x[1] - x[2]) ** 2))")
    lse = " + ".join(f"exp(l{k} - greatest(l0, l1, l2))" for k in range(3))
    return f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), l AS (SELECT vec_id, {', '.join(f'{t} AS l{k}' for k, t in enumerate(terms))} FROM v) SELECT vec_id, round(-(greatest(l0, l1, l2) + ln({lse})), 5) AS nll FROM l"


#: Rows that the mixture is fitted on at most; the detector's own bound.
FIT_ROWS = detectors.MixtureConfig.fit_subsample


def q_mixture_fit(spark, d):
    """A Dirichlet-process mixture fitted to whole vectors of at most FIT_ROWS rows, scored inside the JVM: how many components, and the mean score by class."""
    rows = vectors(spark, d).select("vec_id", "label", F.col("embedding").alias("v"))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()])
    weights, means, precisions = scoring.fit_mixture(sample, components=8)
    return rows.select("label", scoring.mixture_log_density(F.col("v"), weights, means, precisions).alias("l")).groupBy("label").agg(F.avg("l").alias("log_density")).withColumn("components", F.lit(len(weights)))


def _pairs(spark, d) -> DataFrame:
    """Each row with its successor as a second feature vector."""
    rows = vectors(spark, d).select("vec_id", F.col("embedding").alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_PAIRS = "pairs AS (SELECT x.vec_id, list_transform(x.embedding, lambda v: CAST(v AS DOUBLE)) AS a, list_transform(y.embedding, lambda v: CAST(v AS DOUBLE)) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_SQD = "list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def q_flow_nll(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(scoring.flow_nll(F.col("a"), A.total(F.col("b"))), 5).alias("nll"))


def q_cosine_map(spark, d):
    halves = [(F.slice("a", 1 + 32 * i, 32), F.slice("b", 1 + 32 * i, 32)) for i in range(2)]
    product = scoring.cosine_layers([x for x, _ in halves], [y for _, y in halves], "mul")
    added = scoring.cosine_layers([x for x, _ in halves], [y for _, y in halves], "sum")
    return _pairs(spark, d).select("vec_id", F.round(product, 5).alias("multiplied"), F.round(added, 5).alias("added"))


def q_residual(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(scoring.residual(F.col("a"), F.col("b")), 6).alias("residual"))


def q_student_teacher(spark, d):
    stats = {"student": (0.03, 0.01), "autoencoder": (0.02, 0.005)}
    zero = F.transform("a", lambda x: x * 0.5)
    return _pairs(spark, d).select("vec_id", F.round(scoring.student_teacher(F.col("a"), F.col("b"), zero, stats), 4).alias("score"))


def q_contrastive(spark, d):
    return vectors(spark, d).select("vec_id", F.round(scoring.contrastive_loss(F.transform("embedding", lambda x: x * x)), 7).alias("loss"))


def q_zero_shot(spark, d):
    """A two-way softmax against the normalised mean vectors of classes 0 (normal) and 1 (anomalous)."""
    rows = vectors(spark, d)
    texts = scoring.text_embedding(rows.where("label < 2"), "embedding", "label")
    normal, other = (F.broadcast(texts.where(F.col("label") == k).select(F.col("embedding").alias(n))) for k, n in ((0, "_normal"), (1, "_other")))
    return rows.crossJoin(normal).crossJoin(other).select("vec_id", F.round(scoring.zero_shot(F.col("embedding"), F.col("_normal"), F.col("_other"), 10.0), 4).alias("score"))


def q_losses(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.pmod(F.col("doc_id"), F.lit(97)) / 97.0).alias("p"), F.col("quality").alias("y"))
    focal = rows.groupBy("lang").agg(F.round(F.avg(scoring.focal_loss(F.col("p"), F.col("y"))), 6).alias("focal_loss"))
    return focal.join(scoring.dice_loss(rows, "p", "y", ("lang",)).withColumn("dice_loss", F.round("dice_loss", 6)), "lang")


def q_neighbour_mask(spark, d):
    return scoring.neighbour_mask(spark, 8, 8, 2).groupBy("query").agg(F.sum(F.col("allowed").cast("long")).alias("n_allowed"))


def q_project(spark, d):
    """Seeded random projections keep lengths on average: the mean squared length by class."""
    out = retrieval.project(vectors(spark, d), 32, seed=1)
    return out.select("label", A.dot(F.col("projected"), F.col("projected")).alias("s")).groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean_square"))


def _project_sql() -> str:
    table = retrieval.projection(64, 32, 1)
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT unnest({table.T.tolist()}::DOUBLE[][]) AS c),
      p AS (SELECT vec_id, label, sum(list_inner_product(e, c) ** 2) AS s FROM v, m GROUP BY vec_id, label) SELECT label, round(avg(s), 6) AS mean_square FROM p GROUP BY label"""


def _kcenter_sql(n: int) -> str:
    """The greedy choice written out, one table of distances and one chosen row a turn."""
    steps = ["v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label = 0)", "d0 AS MATERIALIZED (SELECT vec_id, e, 1e300::DOUBLE AS d FROM v)", "c0 AS MATERIALIZED (SELECT vec_id, e FROM v ORDER BY vec_id LIMIT 1)"]
    for k in range(1, n):
        gap = "list_sum(list_transform(list_zip(d.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
        steps.append(f"d{k} AS MATERIALIZED (SELECT d.vec_id, d.e, CASE WHEN d.vec_id = c.vec_id THEN -1 ELSE least(d.d, {gap}) END AS d FROM d{k - 1} d, c{k - 1} c)")
        steps.append(f"c{k} AS MATERIALIZED (SELECT vec_id, e FROM d{k} WHERE d >= 0 ORDER BY d DESC, vec_id LIMIT 1)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT vec_id, {k}::INTEGER AS turn FROM c{k}" for k in range(n))


# ---- text ----

TEST_FAMILIES = (("first", ("the", "ent")), ("second", ("ción", "ung")), ("third", ("zzz",)), ("fourth", ("password", "licen")))


def q_families(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.families(F.col("text"), TEST_FAMILIES), ",").alias("families"))


def q_taxonomy(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("cls"), "doc_id", "text")
    return T.taxonomy(docs, "cls", "text", "doc_id", TEST_FAMILIES, ("none",)).select("cls", F.array_join("families", ",").alias("families"))


def q_prompts(spark, d):
    objects = table(spark, d, "nation").select(F.lower("n_name").alias("name"))
    return T.state_prompts(objects, "name", T.ANOMALY_STATES).select("name", "prompt")


def q_description_prompts(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("name"), "text")
    return T.description_prompts(docs, "name", "text", TEST_FAMILIES)


def _families_sql(text: str) -> list[str]:
    return [f"CASE WHEN {' OR '.join(f'contains(lower({text}), {k!r})' for k in ks)} THEN '{name}' END" for name, ks in TEST_FAMILIES]


def q_slugify(spark, d):
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


def q_digest(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha1(F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).cast("binary")), 1, 6).alias("digest"))


# ---- submissions and ledgers ----


def q_submission_check(spark, d):
    rows = q_encode(spark, d).select(F.col("image_id").cast("string").alias("ID"), F.col("label").alias("Label"))
    bright = rows.withColumn("Label", F.when(F.col("ID").cast("long") % 2 == 0, F.lit("q8rle 8 8 255 64")).otherwise(F.col("Label")))
    return priors.check_submission(bright.unionByName(spark.createDataFrame([("00", "q8rle 1 2 255 2")], "ID string, Label string")))


def q_submission_dedupe(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ID"), F.concat(F.lit("q8rle "), F.col("o_orderkey")).alias("Label"), F.col("o_orderkey").alias("_at"))
    return predictions.last_of_each(rows, "ID", "_at").select("ID", "Label")


def q_ledger(spark, d):
    rows = table(spark, d, "orders")
    first = rows.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("tag"))
    second = rows.where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return predictions.append_ledger(first, second)


def q_submission_build(spark, d):
    """A submission from maps resized to 6 x 6 with global calibration: how many runs each label has."""
    out = predictions.submission(maps(spark, d), side=6)
    return out.select("ID", ((F.size(F.split("Label", " ")) - 3) / 2).cast("int").alias("runs"))


# ---- stacking ----


def q_folds(spark, d):
    docs = scored_docs(spark, d).select("doc_id", F.col("source").alias("anomaly_type"))
    return stacking.folds(docs, "loao").select("doc_id", "fold")


def q_subsample(spark, d):
    return stacking.subsample(scored_docs(spark, d).withColumn("label", 1 - F.col("label")), "label", "source", "doc_id", 2).select("doc_id", "label")


def q_stratified(spark, d):
    return stacking.stratified(scored_docs(spark, d).withColumn("label", 1 - F.col("label")), "label", "doc_id", 200).select("doc_id", "label")


FEATURES = ["n", "words", "bangs", "upper", "marks"]


def _features(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.greatest(F.char_length("text"), F.lit(1))

    def share(pattern: str) -> Column:
        return (n - F.char_length(F.regexp_replace("text", pattern, ""))) / n

    return docs.select(
        "doc_id", F.col("source").alias("sample_id"), "source", F.col("quality").alias("label"), F.log1p(n.cast("double")).alias("n"), (F.size(F.array_distinct(F.split("text", " "))) / F.size(F.split("text", " "))).alias("words"), share("[^!]").alias("bangs"), share("[^A-Z]").alias("upper"), share("[^|*&%$#]").alias("marks")
    )


def _oof(name: str, **params):
    def run(spark, d):
        df = stacking.folds(_features(spark, d).withColumn("sample_id", F.pmod(F.xxhash64("sample_id"), F.lit(3))), "sample")
        out = stacking.out_of_fold(df, lambda: stacking.build_estimator(name, FEATURES, **params), "source", "doc_id")
        return out.select("doc_id", "fold", "label", "prediction")

    return run


def _calibrated(method: str):
    def run(spark, d):
        df = _features(spark, d).withColumn("prediction", 1 - F.col("bangs"))
        return stacking.fit_calibrator(df, method, key="doc_id").apply(df).select("doc_id", F.round("prediction", 9).alias("prediction"), F.round("calibrated", 4).alias("calibrated"))

    return run


def q_stream_bank(spark, d):
    """Micro-batch scoring with a fixed bank gives what the batch query gives."""
    bank, _ = _bank(spark, d)
    return streams.score_stream_once(spark, d, bank)


QUERIES = {
    "bank_average_precision": q_bank_ap,
    "scan_filter_class": q_scan_filter,
    "classes_in": q_classes,
    "parse_view": q_parse_view,
    "scan_tree": q_scan_tree,
    "group_by_sample": q_group_by_sample,
    "select_references": q_select_references,
    "align_methods": q_align,
    "class_lookup_default": q_class_lookup,
    "ap_pooled": q_ap_pooled,
    "ap_per_image": q_ap_per_image,
    "ap_summary": q_ap_summary,
    "ap_overall": q_ap_overall,
    "calibration_percentiles": q_calibration,
    "normalise_unit": q_normalise_unit,
    "ecdf": q_ecdf,
    "zscore_terms": q_zscore,
    "hard_mining": q_hard_mining,
    "order_statistic": q_order_statistic,
    "topk_per_class": q_topk_class,
    "knn_bank_k1": _knn(1, "cosine"),
    "knn_bank_k3": _knn(3, "cosine"),
    "knn_l2_k3": _knn(3, "l2"),
    "kcenter": q_kcenter,
    "foreground_pc1": q_foreground,
    "random_projection": q_project,
    "mixture_nll": q_mixture,
    "mixture_fit": q_mixture_fit,
    "flow_nll": q_flow_nll,
    "cosine_distance_map": q_cosine_map,
    "residual_map": q_residual,
    "student_teacher_z": q_student_teacher,
    "contrastive_loss": q_contrastive,
    "zero_shot": q_zero_shot,
    "losses": q_losses,
    "neighbour_mask": q_neighbour_mask,
    "defect_families": q_families,
    "taxonomy": q_taxonomy,
    "prompts": q_prompts,
    "description_prompts": q_description_prompts,
    "slugify": q_slugify,
    "sha1_digest": q_digest,
    "submission_check": q_submission_check,
    "submission_dedupe": q_submission_dedupe,
    "submission_build": q_submission_build,
    "ledger_widen": q_ledger,
    "cv_folds": q_folds,
    "neg_subsample": q_subsample,
    "stratified_cap": q_stratified,
    "oof_logreg": _oof("logreg"),
    "oof_gbt": _oof("gbt", trees=5, depth=3),
    "isotonic": _calibrated("isotonic"),
    "platt": _calibrated("platt"),
    "stream_bank": q_stream_bank,
}

#: Labelled documents with the share of exclamation marks (``x``) and the label (``y``).
_MARKS = "marks AS MATERIALIZED (SELECT d.doc_id, 1 - (greatest(length(text), 1) - length(regexp_replace(text, '[^!]', '', 'g')))::DOUBLE / greatest(length(text), 1) AS x, (quality > 0)::INT::DOUBLE AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
#: Pool adjacent violators as the max-min of means over runs of distinct places.
_ISOTONIC_SQL = f"""WITH {_MARKS}, u AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(sum(y)) OVER (ORDER BY x) AS s, sum(count(*)) OVER (ORDER BY x) AS w, sum(y) AS own, count(*) AS n FROM marks GROUP BY x),
  runs AS (SELECT a.i AS j, b.i AS k, (b.s - a.s + a.own) / (b.w - a.w + a.n) AS mean FROM u a JOIN u b ON b.i >= a.i),
  low AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM runs), fit AS (SELECT i, max(m) AS f FROM low GROUP BY i)
  SELECT doc_id, round(x, 9) AS prediction, round(f, 4) AS calibrated FROM marks JOIN u USING (x) JOIN fit USING (i)"""
#: Newton steps of a logistic regression of one feature.
_PLATT_SQL = f"""WITH RECURSIVE {_MARKS}, steps AS (
    SELECT 0 AS turn, 0::DOUBLE AS a, 0::DOUBLE AS b
    UNION ALL
    SELECT turn + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT turn, a, b, sum(p - y) AS g0, sum((p - y) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
          FROM (SELECT turn, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM steps, marks WHERE turn < 25) GROUP BY turn, a, b))
  SELECT doc_id, round(x, 9) AS prediction, round(1 / (1 + exp(-(a + b * x))), 4) AS calibrated FROM marks, steps WHERE turn = 25"""
#: What the check of the planted submission finds, over the rows that its systematic sample takes.
_CHECK_SQL = f"""WITH {PX}, planted AS (SELECT CAST(image_id AS VARCHAR) AS id, 8 AS h, 8 AS w, CASE WHEN image_id % 2 = 0 THEN 255 ELSE {_Q8} END AS x FROM px UNION ALL SELECT '00', 1, 2, 255 FROM range(2)),
  each AS (SELECT id, any_value(h) AS h, any_value(w) AS w, avg((x = 255)::INT) AS f, avg((x > 127)::INT) AS b FROM planted GROUP BY id),
  placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, greatest(1, count(*) OVER () // 400) AS step FROM each),
  seen AS (SELECT * FROM placed WHERE place % step = 0 ORDER BY id LIMIT 400), found AS (SELECT count(DISTINCT (h, w)) AS shapes, avg(f) AS f, avg(b) AS b FROM seen)
  SELECT 'error' AS level, shapes || ' different shapes' AS message FROM found WHERE shapes > 1
  UNION ALL SELECT 'warning', format('{{:.1f}}% of the pixels are saturated', f * 100) FROM found WHERE f > 0.02
  UNION ALL SELECT 'warning', format('{{:.1f}}% of the pixels are above one half', b * 100) FROM found WHERE b > 0.25"""
#: Maps brought to 6 x 6, scaled by global percentiles, quantised, and their runs down the columns counted.
_BUILD_SQL = f"""WITH small AS ({_bilinear_sql(6).replace("round(sum(p.v * w.k), 6)", "sum(p.v * w.k)")}), b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM small),
  q AS (SELECT image_id, c * 6 + r AS k, round_even(CAST(CAST(least(1, greatest(0, (v - lo) / greatest(hi - lo, 1e-9))) AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE), 0) AS x FROM small, b),
  e AS (SELECT image_id, (x IS DISTINCT FROM lag(x) OVER (PARTITION BY image_id ORDER BY k))::INT AS new FROM q)
  SELECT CAST(image_id AS VARCHAR) AS ID, CAST(sum(new) AS INTEGER) AS runs FROM e GROUP BY image_id"""
_CONV = "CASE WHEN turn % 4 = 3 THEN 'plain.' || conv_id || '.png' ELSE 'conv_' || conv_id || '_view0' || turn || '.png' END"
_KINDS = "kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), chosen AS (SELECT CASE WHEN (SELECT count(*) FROM kinds WHERE k <= 3 AND event_type IN ('click', 'view', 'purchase')) = 3 THEN ['click', 'view', 'purchase'] ELSE (SELECT list(event_type ORDER BY k) FROM kinds WHERE k <= 3) END AS c)"
_FAM = _families_sql("text")
_MD5 = "md5(CAST(doc_id AS VARCHAR)), doc_id"
ORACLE_SQL = {
    "bank_average_precision": f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
      p AS (SELECT q.vec_id, any_value(q.label) AS label, min(1 - list_inner_product(q.e, b.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(b.e, b.e)))) AS dist FROM v q JOIN v b ON b.label = 0 AND b.vec_id <> q.vec_id GROUP BY q.vec_id),
      o AS (SELECT CAST(vec_id % 5 AS VARCHAR) AS view, round(dist, 9) AS score, (label <> 0)::INT AS label FROM p), x AS (SELECT * FROM o UNION ALL SELECT 'all', score, label FROM o),
      {_ap_sql("x", "view")} SELECT view, n, n_positive, round(ap, 6) AS ap FROM ap""",
    "scan_filter_class": "SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id % 5 = 2",
    "classes_in": "SELECT DISTINCT 'class_' || label AS cls FROM embeddings",
    "parse_view": f"WITH n AS (SELECT conv_id, turn, {_CONV} AS name FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'plain.' || conv_id ELSE 'conv_' || conv_id END AS sample_id, CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(turn AS INTEGER) END AS view FROM n",
    "scan_tree": """WITH f AS (SELECT '/data/class_0' || (conv_id % 3) AS root, 'class_0' || (conv_id % 3) AS cls, 'c' || conv_id AS sample_id, CAST(turn AS INTEGER) AS view, 'c' || conv_id || '_view' || turn AS stem,
        CASE WHEN role = 'user' THEN 'train_good' WHEN turn % 4 = 1 THEN 'test' ELSE 'train_anomaly' END AS split FROM conversations)
      SELECT root || CASE split WHEN 'train_good' THEN '/train/good/' || stem || '.PNG' WHEN 'test' THEN '/test/deep/' || stem || '.jpg' ELSE '/train/dent/' || stem || '.png' END AS path,
        cls, split, CASE WHEN split = 'train_anomaly' THEN 'dent' END AS anomaly_type, sample_id, view, CASE WHEN split = 'train_anomaly' THEN root || '/ground_truth_train/dent/' || stem || '.bmp' END AS mask_path, stem, split = 'train_anomaly' AS has_mask FROM f""",
    "group_by_sample": "SELECT 'cls/' || conv_id AS sample, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS members FROM conversations GROUP BY conv_id",
    "select_references": "WITH r AS (SELECT vec_id, vec_id % 5 AS view, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS round FROM embeddings) SELECT vec_id, view, CAST(\"round\" AS INTEGER) AS \"round\" FROM r ORDER BY \"round\", view LIMIT 8",
    "align_methods": f"WITH {_KINDS}, m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY user_id, event_type) SELECT a.user_id, a.v AS m0, b.v AS m1, c.v AS m2 FROM chosen, m a JOIN m b ON b.user_id = a.user_id JOIN m c ON c.user_id = a.user_id WHERE a.event_type = c[1] AND b.event_type = c[2] AND c.event_type = c[3]",
    "class_lookup_default": "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS cls FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "ap_pooled": f"WITH {_DOCS}, {_ap_sql('x', '')} SELECT n, n_positive, round(ap, 9) AS ap FROM ap",
    "ap_per_image": f"WITH {_DOCS}, {_ap_sql('x', 'source')} SELECT source, n, n_positive, round(ap, 9) AS ap FROM ap",
    "ap_summary": f"WITH {_DOCS}, {_ap_sql('x', 'lang, source')} SELECT lang, source[4:4] AS anomaly_type, count(*) AS n_views, round(avg(ap), 9) AS ap_mean, round(stddev_pop(ap), 9) AS ap_std, round(min(ap), 9) AS ap_min, round(max(ap), 9) AS ap_max FROM ap GROUP BY lang, source[4:4]",
    "ap_overall": f"WITH {_DOCS}, {_ap_sql('x', 'lang, source')}, kinds AS (SELECT lang, source[4:4] AS k, avg(ap) AS a FROM ap GROUP BY lang, source[4:4]), c AS (SELECT lang, avg(a) AS a FROM kinds GROUP BY lang) SELECT round(avg(a), 9) AS ap FROM c",
    "calibration_percentiles": "WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round(lo, 6) AS lo, round(CASE WHEN hi > lo THEN hi ELSE lo + 1e-6 END, 6) AS hi FROM b",
    "normalise_unit": "WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.995) AS hi FROM events) SELECT event_id, round(least(1, greatest(0, (value - lo) / (hi - lo))), 6) AS x FROM events, b",
    "ecdf": "WITH r AS (SELECT value FROM events WHERE event_type = 'view'), u AS (SELECT event_id, value, 0 AS k FROM events UNION ALL SELECT NULL, value, 1 FROM r), w AS (SELECT event_id, k, coalesce(sum(k) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING EXCLUDE TIES), 0) - k AS below FROM u) SELECT event_id, round(below::DOUBLE / greatest((SELECT count(*) FROM r), 1), 9) AS ecdf FROM w WHERE k = 0",
    "zscore_terms": "WITH t AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), s AS (SELECT avg(a) AS ma, stddev_pop(a) + 1e-9 AS sa, avg(b) AS mb, stddev_pop(b) + 1e-9 AS sb FROM t WHERE label = 0) SELECT vec_id, round(((a - ma) / sa + (b - mb) / sb) / 2, 5) AS z FROM t, s",
    "hard_mining": "WITH n AS (SELECT greatest(CAST(floor(0.1 * count(*)) AS BIGINT), 1) AS k FROM events), o AS (SELECT value, row_number() OVER (ORDER BY value DESC, event_id) AS i FROM events) SELECT any_value(k) AS k, round(avg(value), 6) AS hard_mean FROM o, n WHERE i <= k",
    "order_statistic": "WITH s AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i FROM events) SELECT event_type, value AS picked FROM s WHERE i = n - greatest(1, least(CAST(round_even(n * 10.0::DOUBLE / 100, 0) AS BIGINT), n - 1))",
    "topk_per_class": "SELECT * FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders) WHERE rank <= 5",
    "knn_bank_k1": _knn_sql(1, "cosine"),
    "knn_bank_k3": _knn_sql(3, "cosine"),
    "knn_l2_k3": _knn_sql(3, "l2"),
    "kcenter": _kcenter_sql(12),
    "random_projection": _project_sql(),
    "submission_check": _CHECK_SQL,
    "submission_build": _BUILD_SQL,
    "isotonic": _ISOTONIC_SQL,
    "platt": _PLATT_SQL,
    "mixture_nll": _mixture_sql(),
    "flow_nll": f"WITH {_PAIRS} SELECT vec_id, round(0.5 * list_inner_product(a, a) - list_sum(b), 5) AS nll FROM pairs",
    "cosine_distance_map": f"WITH {_PAIRS}, h AS (SELECT vec_id, " + ", ".join(f"1 - list_inner_product(a[{s}:{s + 31}], b[{s}:{s + 31}]) / (greatest(sqrt(list_inner_product(a[{s}:{s + 31}], a[{s}:{s + 31}])), 1e-8) * greatest(sqrt(list_inner_product(b[{s}:{s + 31}], b[{s}:{s + 31}])), 1e-8)) AS d{s}" for s in (1, 33)) + " FROM pairs) SELECT vec_id, round(d1 * d33, 5) AS multiplied, round(d1 + d33, 5) AS added FROM h",
    "residual_map": f"WITH {_PAIRS} SELECT vec_id, round({_SQD} / 64, 6) AS residual FROM pairs",
    "student_teacher_z": f"WITH {_PAIRS}, z AS (SELECT vec_id, {_SQD} / 64 AS s, list_sum(list_transform(list_zip(b, a), lambda x: (x[1] - 0.5 * x[2]) * (x[1] - 0.5 * x[2]))) / 64 AS t FROM pairs) SELECT vec_id, round(((s - 0.03) / 0.01 + (t - 0.02) / 0.005) / 2, 4) AS score FROM z",
    "contrastive_loss": "WITH l AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS s FROM embeddings) SELECT vec_id, round((greatest(s[1] - 1e-5, 0) + greatest(s[2] - 1e-5, 0) + greatest(s[3] - 1e-5, 0)) / 3 + (greatest(1e-5 + 1e-3 - s[4], 0) + greatest(1e-5 + 1e-3 - s[5], 0) + greatest(1e-5 + 1e-3 - s[6], 0)) / 3, 7) AS loss FROM l",
    "zero_shot": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT label, i, avg(e[i] / sqrt(list_inner_product(e, e))) AS m FROM v, range(1, 65) t(i) WHERE label < 2 GROUP BY label, i),
      m AS (SELECT label, list(m ORDER BY i) AS m FROM u GROUP BY label), n AS (SELECT m FROM m WHERE label = 0), o AS (SELECT m FROM m WHERE label = 1)
      SELECT vec_id, round(1 / (1 + exp(10 * (list_inner_product(e, n.m) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(n.m, n.m))) - list_inner_product(e, o.m) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(o.m, o.m)))))), 4) AS score FROM v, n, o""",
    "losses": "WITH r AS (SELECT lang, (d.doc_id % 97) / 97.0::DOUBLE AS p, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id), q AS (SELECT *, CASE WHEN y > 0 THEN p ELSE 1 - p END AS t FROM r) SELECT lang, round(avg(-0.5 * (1 - t) ** 2 * ln(greatest(t, 1e-8))), 6) AS focal_loss, round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) AS dice_loss FROM q GROUP BY lang",
    "neighbour_mask": "SELECT q.i AS query, CAST(sum((greatest(abs(q.i // 8 - t.i // 8), abs(q.i % 8 - t.i % 8)) > 2)::INT) AS BIGINT) AS n_allowed FROM range(64) q(i), range(64) t(i) GROUP BY q.i",
    "defect_families": f"SELECT doc_id, array_to_string(list_filter([{', '.join(_FAM)}], lambda x: x IS NOT NULL), ',') AS families FROM documents",
    "taxonomy": f"WITH l AS (SELECT source AS cls, doc_id, unnest([{', '.join(_FAM)}]) AS f, unnest([1, 2, 3, 4]) AS k FROM documents), n AS (SELECT cls, f, count(*) AS n, min(doc_id * 10 + k) AS first FROM l WHERE f IS NOT NULL GROUP BY cls, f), g AS (SELECT cls, string_agg(f, ',' ORDER BY n DESC, first) AS families FROM n GROUP BY cls) SELECT d.cls, coalesce(families, 'none') AS families FROM (SELECT DISTINCT source AS cls FROM documents) d LEFT JOIN g ON g.cls = d.cls",
    "prompts": f"SELECT lower(n_name) AS name, replace(replace(t, '{{state}}', s), '{{obj}}', lower(n_name)) AS prompt FROM nation, unnest({list(T.TEMPLATES)!r}) a(t), unnest({list(T.ANOMALY_STATES)!r}) b(s)",
    "description_prompts": f"WITH s AS (SELECT DISTINCT lang AS name, trim(text) AS t FROM documents), k AS (SELECT name, unnest([{', '.join(_families_sql('t'))}]) AS k FROM s), p AS (SELECT name, unnest(['a photo of a defective ' || name || ': ' || t, 'a photo of an anomalous ' || name || ': ' || t]) AS prompt FROM s WHERE t <> '' UNION SELECT name, unnest(['a photo of a ' || name || ' with ' || k, 'a ' || name || ' showing ' || k, 'a close-up photo of ' || k || ' on a ' || name]) FROM k WHERE k IS NOT NULL) SELECT DISTINCT name, prompt FROM p",
    "slugify": "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages",
    "sha1_digest": "SELECT o_orderkey, substr(sha1(o_orderstatus || '|' || o_orderpriority || '|' || CAST(o_custkey AS VARCHAR)), 1, 6) AS digest FROM orders",
    "submission_dedupe": "SELECT CAST(o_custkey AS VARCHAR) AS ID, 'q8rle ' || max(o_orderkey) AS Label FROM orders GROUP BY o_custkey",
    "ledger_widen": "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS tag, CASE WHEN o_orderstatus = 'O' THEN o_orderstatus ELSE '' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "cv_folds": f"WITH {_DOCS}, f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS fold FROM (SELECT DISTINCT source FROM x)) SELECT doc_id, CAST(fold AS INTEGER) AS fold FROM x JOIN f USING (source)",
    "neg_subsample": f"WITH {_DOCS}, y AS (SELECT doc_id, source, 1 - label AS label FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY {_MD5}) AS n, sum(label) OVER (PARTITION BY source) AS p FROM y) SELECT doc_id, label FROM k WHERE p > 0 AND (label = 1 OR n <= 2 * p)",
    "stratified_cap": f"WITH {_DOCS}, y AS (SELECT doc_id, 1 - label AS label FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_MD5}) AS n, sum(label) OVER () AS p, count(*) OVER () AS total FROM y) SELECT doc_id, label FROM k WHERE total <= 200 OR label = 1 OR n <= 200 - p",
    "stream_bank": _knn_sql(1, "cosine"),
}
