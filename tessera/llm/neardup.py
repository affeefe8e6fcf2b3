"""Near-duplicates by a chosen-path similarity join over five-word shingles.

Every distinct shingle set walks down independent trees. At a node, the path goes on
through one or two minwise tokens that the node itself selects (4/3 on average, the
inverse of the threshold), and the documents that agree on the token meet in the child.
Nodes of few documents are compared exhaustively, larger ones branch again. Nodes that
are still large after five levels hold documents that share much without being alike:
members that already are one candidate group need no comparison among themselves, the
other members go with them if they are few, and otherwise the node branches on, by two
tokens that no node above has used. What is large after the last level is compared over
all pairs of its chunks, so no node leaves out a pair. Comparisons inside nodes use 256 one-byte minwise values, far below the threshold, and only say
which documents may belong together; every such candidate group is then linked on its
full sets, by exact intersection counts. The trees are as many as the target recall of
a pair at the threshold asks for.

Exact copies are merged first, so a group of copies of any size is one document here.
Only rows of linear number move: a node gives at most one row for each member, and full
sets travel only for candidate groups. A candidate group that is too large for a task goes
in chunks that share pivots: what these link is one component already, and only the
members outside the largest component are compared with all others. Texts are looked up by
128 bits of hash.

Defined results: a null or empty text, or one of white space, has an empty set, is linked
with nothing and is its own component. Rows that share an id share a component and stay
or go together. A null id never is a smallest id; a group of null ids alone has a null
component and is not kept. Texts of any length are read whole. An empty table gives an
empty result. Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.store import keep
from tessera.llm.words import U64, mix, shingle_sets

#: Minwise values kept whole, for choosing paths, and as single bytes, for estimates.
CHOICES, ESTIMATES = 32, 256
#: Documents with at least this estimate may belong together; a pair at 0.75 misses it once in some 10^6 times.
MAYBE = 0.62
#: Nodes of up to LEAF documents are compared; at DEEPEST, chunks of CHUNK that share PIVOTS documents show what is one group already; at LAST, all pairs of chunks are compared.
LEAF, DEEPEST, CHUNK, PIVOTS, LAST = 2_000, 5, 2_000, 16, 13
#: Shingles and documents that one linking task takes of a candidate group; larger groups are dealt over pairs of blocks.
TASK_SHINGLES, TASK_DOCUMENTS = 1_500_000, 2_500
#: Candidate ids that may be broadcast to pick their texts.
BROADCAST_ROWS = 1_000_000

_draw = np.random.Generator(np.random.Philox(7))
_FACTORS = _draw.integers(1, 2**63, ESTIMATES, dtype=np.uint64) * U64(2) + U64(1)

SIGNATURE = "n_shingles long, h1 long, h2 long, lows binary, bits binary"


def signatures(column: pa.Array) -> pd.DataFrame:
    """The fields of ``SIGNATURE`` for each text."""
    n = len(column)
    sizes, lows, bits = np.zeros(n, dtype=np.int64), np.zeros((n, CHOICES), dtype=np.uint32), np.zeros((n, ESTIMATES), dtype=np.uint8)
    digests = np.zeros((n, 2), dtype=np.int64)
    for top in range(0, n, 256):
        sets = shingle_sets(column.slice(top, 256))
        sizes[top : top + 256] = [len(s) for s in sets]
        for k, s in enumerate(sets, top):
            digests[k] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
        full = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
        for rows in _groups(full, sizes[top + full], 60_000):
            flat = np.concatenate([sets[k] for k in rows])
            begins = np.concatenate(([0], np.cumsum(sizes[top + rows])[:-1]))
            work = np.empty_like(flat)
            for j, factor in enumerate(_FACTORS):
                np.multiply(flat, factor, out=work)
                least = np.minimum.reduceat(work, begins)
                if j < CHOICES:
                    lows[top + rows, j] = least >> U64(32)
                bits[top + rows, j] = mix(least) >> U64(56)
    return pd.DataFrame({"n_shingles": sizes, "h1": digests[:, 0], "h2": digests[:, 1], "lows": [r.tobytes() for r in lows], "bits": [r.tobytes() for r in bits]})


def _groups(rows: np.ndarray, sizes: np.ndarray, most: int):
    """Runs of rows of about ``most`` hashes, so that the work arrays stay in the processor's cache."""
    part = np.cumsum(sizes) // most
    return [rows[part == p] for p in np.unique(part)]


def children(nodes: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The child nodes that documents with minwise values ``lows`` (one row each) go to from ``nodes``, and their rows."""
    out, rows = [], []
    for slot in range(2):
        go = np.flatnonzero(mix(nodes + U64(0xA5A5)) % U64(3) == 0) if slot else np.arange(len(nodes))
        place = (mix(nodes[go] + U64(slot + 1)) % U64(CHOICES)).astype(np.int64)
        value = lows[go, place].astype(np.uint64)
        out.append(mix(nodes[go] * U64(0x9E3779B97F4A7C15) + mix(value + (place.astype(np.uint64) << U64(40)))))
        rows.append(go)
    return np.concatenate(out), np.concatenate(rows)


def fresh_children(nodes: np.ndarray, bits: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``children`` for nodes at ``depth`` from DEEPEST on: two children each, by one-byte values of the level's own places."""
    width = (ESTIMATES - CHOICES) // max(1, LAST - DEEPEST)
    first = mix(nodes + U64(1)) % U64(width)
    out = []
    for step in (U64(0), U64(1) + mix(nodes + U64(2)) % U64(width - 1)):
        place = CHOICES + width * (depth - DEEPEST) + ((first + step) % U64(width)).astype(np.int64)
        value = bits[np.arange(len(nodes)), place].astype(np.uint64)
        out.append(mix(nodes * U64(0x9E3779B97F4A7C15) + mix(value + (place.astype(np.uint64) << U64(40)))))
    return np.concatenate(out), np.tile(np.arange(len(nodes)), 2)


def trees_for(recall: float, threshold: float) -> int:
    """Trees after which a pair at the threshold has met with the given probability, if it must survive all levels."""
    survive = 1.0
    for depth in reversed(range(LAST)):
        one = threshold * survive
        two = 1 - (1 - one) ** 2
        survive = two if depth >= DEEPEST else (2 * one + two) / 3
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


def _first_level(reps: DataFrame, trees: int) -> DataFrame:
    def walk(batches):
        for rows in batches:
            lows = np.frombuffer(b"".join(rows["lows"]), dtype=np.uint32).reshape(len(rows), CHOICES)
            roots = mix(np.arange(1, trees + 1, dtype=np.uint64))
            who = np.repeat(np.arange(len(rows)), trees)
            nodes, at = children(np.tile(roots, len(rows)), lows[who])
            yield pd.DataFrame({"node": nodes.view(np.int64), "rep": rows["rep"].to_numpy()[who[at]]})

    return reps.select("rep", "lows").mapInPandas(walk, "node long, rep long")


def _next_level(members: DataFrame, reps: DataFrame) -> DataFrame:
    def walk(batches):
        for rows in batches:
            if not len(rows):
                continue
            lows = np.frombuffer(b"".join(rows["lows"]), dtype=np.uint32).reshape(len(rows), CHOICES)
            nodes, at = children(rows["node"].to_numpy().view(np.uint64), lows)
            yield pd.DataFrame({"node": nodes.view(np.int64), "rep": rows["rep"].to_numpy()[at]})

    return members.join(reps.select("rep", "lows"), "rep").select("node", "rep", "lows").mapInPandas(walk, "node long, rep long")


def _deeper_level(members: DataFrame, reps: DataFrame, depth: int) -> DataFrame:
    def walk(batches):
        for rows in batches:
            if not len(rows):
                continue
            bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint8).reshape(len(rows), ESTIMATES)
            nodes, at = fresh_children(rows["node"].to_numpy().view(np.uint64), bits, depth)
            yield pd.DataFrame({"node": nodes.view(np.int64), "rep": rows["rep"].to_numpy()[at]})

    return members.join(reps.select("rep", "bits"), "rep").select("node", "rep", "bits").mapInPandas(walk, "node long, rep long")


#: Equal bytes of two signatures that make a pair a candidate; unequal values agree in one byte of 256.
_LEAST = math.ceil(ESTIMATES * (MAYBE + (1 - MAYBE) / 256))


def _maybe_together(reps: np.ndarray, bits: np.ndarray) -> tuple[list, list]:
    """Each member of a node with the smallest member that it may belong with."""
    rest = np.arange(len(reps))
    a, b = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = (bits[rest] == bits[queue.pop()]).sum(1) >= _LEAST
            found, rest = rest[near], rest[~near]
            queue.extend(found)
            a.extend(reps[found])
            b.extend([reps[root]] * len(found))
    return a, b


def _compare_nodes(rows: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """Candidate links inside each of the whole nodes that stand one after the other in ``rows``."""
    groups = rows[key].to_numpy()
    reps = rows["rep"].to_numpy()
    same = (groups[1:] == groups[:-1]).all(1)
    first = np.concatenate(([True], ~(same & (reps[1:] == reps[:-1]))))
    groups, reps = groups[first], reps[first]
    bits = np.frombuffer(b"".join(rows["bits"][first]), dtype=np.uint8).reshape(len(reps), ESTIMATES)
    starts = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]).any(1))))
    sizes = np.diff(np.append(starts, len(reps)))
    two = starts[sizes == 2]
    near = two[(bits[two] == bits[two + 1]).sum(1) >= _LEAST]
    a, b = list(reps[near + 1]), list(reps[near])
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        more = _maybe_together(reps[s : s + n], bits[s : s + n])
        a += more[0]
        b += more[1]
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _compare(parts: list[DataFrame], reps: DataFrame) -> DataFrame:
    """Candidate links inside the nodes (or chunks of nodes) of all ``parts`` (``node, chunk, rep``), which are of bounded size; they are dealt and sorted, and a task reads them in turn."""
    key = ["node", "chunk"]

    def walk(batches):
        held = None
        for rows in batches:
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            groups = rows[key].to_numpy()
            begin = int(np.flatnonzero((groups != groups[-1]).any(1)).max(initial=-1)) + 1
            held = rows.iloc[begin:].reset_index(drop=True)
            if begin:
                yield _compare_nodes(rows.iloc[:begin], key)
        if held is not None and len(held):
            yield _compare_nodes(held, key)

    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    dealt = members.join(reps.select("rep", "bits"), "rep").select(*key, "rep", "bits")
    return dealt.repartition(*key).sortWithinPartitions(*key, "rep").mapInPandas(walk, "a long, b long")


def candidate_links(reps: DataFrame, trees: int) -> DataFrame:
    """Links ``a, b`` whose connected groups hold every pair that some node finds alike enough (``rep, lows, bits``)."""
    links = labels = None
    parts: list[DataFrame] = []  # nodes to compare, of all levels so far
    members = keep(_first_level(reps, trees), "nodes-1")
    for depth in range(1, LAST + 1):
        sizes = keep(members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes-{depth}")
        parts.append(members.join(sizes.where(f"size <= {LEAF}"), "node").select("node", F.lit(0).cast("long").alias("chunk"), "rep"))
        big = sizes.where(f"size > {LEAF}")
        n_big = big.count()
        if not n_big:
            break
        members = members.join(F.broadcast(big) if n_big <= BROADCAST_ROWS else big, "node")
        if depth < DEEPEST:
            members = keep(_next_level(members, reps), f"nodes-{depth + 1}")
            continue
        if labels is None:
            links = keep(_compare([*parts, _sampled(members)], reps), "near")
            parts, labels = [], components(links).withColumnRenamed("node", "rep")
        members = keep(members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), f"big-{depth}")
        main = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("node").agg(F.max(F.struct("_n", "label")).alias("main"))
        main = keep(main.select("node", F.col("main._n").alias("most"), F.col("main.label").alias("main")), f"main-{depth}")
        members = members.join(F.broadcast(main) if n_big <= BROADCAST_ROWS else main, "node").withColumn("others", F.col("size") - F.col("most"))
        parts.append(_with_others(members.where(f"others between 1 and {LEAF}")))
        members = members.where(f"others > {LEAF}")
        if depth == LAST:
            parts.append(_all_pairs(members))
            break
        members = keep(_deeper_level(members, reps, depth), f"nodes-{depth + 1}")
    found = _compare(parts, reps)
    return found if links is None else links.unionByName(found)


def _sampled(members: DataFrame) -> DataFrame:
    """Chunks of large nodes, each with its node's pivots: what these link is one group, whatever else the nodes hold."""
    held = members.withColumn("chunks", F.ceil(F.col("size") / CHUNK))
    dealt = held.select("node", "rep", F.pmod(F.xxhash64("node", "rep"), "chunks").alias("chunk"))
    pivots = held.withColumn("_n", F.row_number().over(_by_hash())).where(f"_n <= {PIVOTS}")
    return dealt.unionByName(pivots.select("node", "rep", _up_to("chunks").alias("chunk")))


def _with_others(members: DataFrame) -> DataFrame:
    """Chunks of each node's largest group, each with all of the node's other members."""
    held = members.withColumn("chunks", F.ceil(F.col("most") / CHUNK))
    dealt = held.where("label = main").select("node", "rep", F.pmod(F.xxhash64("node", "rep"), "chunks").alias("chunk"))
    return dealt.unionByName(held.where("label <> main").select("node", "rep", _up_to("chunks").alias("chunk")))


def _all_pairs(members: DataFrame) -> DataFrame:
    """Every pair of chunks of each node."""
    held = members.withColumn("chunks", F.ceil(F.col("size") / CHUNK))
    held = held.select("node", "rep", F.pmod(F.xxhash64("node", "rep"), "chunks").alias("_own"), _up_to("chunks").alias("_other"))
    pair = F.least("_own", "_other") * F.lit(1 << 31) + F.greatest("_own", "_other")
    return held.select("node", "rep", pair.alias("chunk"))


def _up_to(chunks: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1))


def _by_hash(group: str = "node"):
    """A fixed order inside groups, of which only the first few are ever taken (so each task gives only its first few)."""
    return Window.partitionBy(group).orderBy(F.xxhash64(F.lit("pivot"), "rep"), "rep")


def link_sets(reps: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> tuple[list[int], list[int]]:
    """Exact links among sets: each member of a linked group with the group's smallest number."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    reps, sets = np.asarray(reps)[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, dtype=int))
    marked = np.zeros(len(distinct), dtype=np.int32)
    group = np.arange(len(sets))
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * denominator // numerator, side="right"))
        if last <= i + 1 or (group[i + 1 : last] == group[i]).all():
            continue
        own = flat[starts[i] : starts[i + 1]]
        marked[own] = 1
        a, b = starts[i + 1], starts[last]
        shared = np.add.reduceat(marked[flat[a:b]], starts[i + 1 : last] - a)
        marked[own] = 0
        union = sizes[i] + sizes[i + 1 : last] - shared
        for j in i + 1 + np.flatnonzero(denominator * shared >= numerator * union):
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
    a, b = [], []
    for g in np.unique(group):
        inside = np.sort(reps[group == g])
        a.extend(int(r) for r in inside[1:])
        b.extend([int(inside[0])] * (len(inside) - 1))
    return a, b


def exact_links(groups: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links ``a, b`` on full sets inside each candidate group (``rep, label, n_shingles, text``)."""

    @F.pandas_udf("binary")
    def sets_of(texts: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for s in shingle_sets(pa.array(texts, type=pa.string()))], dtype=object)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep")
        a, b = link_sets(rows["rep"].to_numpy(), [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]], numerator, denominator)
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    def linked(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).applyInPandas(link, "a long, b long")

    count, shingles = F.count(F.lit(1)), F.sum("n_shingles")
    size = groups.groupBy("label").agg(count.alias("_n"), shingles.alias("_s"))
    size = size.select("label", F.when((F.col("_s") <= TASK_SHINGLES) & (F.col("_n") <= TASK_DOCUMENTS), 1).otherwise(_blocks("_n", "_s")).alias("_blocks"))
    dealt = groups.join(size, "label")
    links = linked(dealt.where("_blocks = 1").select("label", "rep", sets_of("text").alias("shingles")), "label")
    large = dealt.where("_blocks > 1")
    if large.isEmpty():
        return links
    large = keep(large.select("label", "rep", "n_shingles", "_blocks", sets_of("text").alias("shingles")), "large-groups")
    chunk = F.pmod(F.xxhash64("rep"), F.col("_blocks"))
    pivots = large.select("label", "rep", "_blocks").withColumn("_n", F.row_number().over(_by_hash("label"))).where(f"_n <= {PIVOTS}")
    pivots = pivots.select("label", "rep", _up_to("_blocks").alias("_chunk")).join(large.select("rep", "shingles"), "rep").select("label", "rep", "_chunk", "shingles")
    near = keep(linked(large.select("label", "rep", chunk.alias("_chunk"), "shingles").unionByName(pivots), "label", "_chunk"), "large-near")
    parts = large.join(components(near).withColumnsRenamed({"node": "rep", "label": "_part"}), "rep", "left").withColumn("_part", F.coalesce("_part", "rep"))
    sizes = keep(parts.groupBy("label", "_part").agg(count.alias("_n"), shingles.alias("_s")), "large-parts")
    main = sizes.groupBy("label").agg(F.max(F.struct("_n", "_part", "_s")).alias("_main"), F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    n, s = F.col("_n") - F.col("_main._n"), F.col("_s") - F.col("_main._s")
    main = main.where(n > 0).withColumns({"_n": n, "_s": s})
    main = main.select("label", F.col("_main._part").alias("_largest"), _blocks("_main._n", "_main._s").alias("_mains"), _blocks("_n", "_s").alias("_others"))
    placed, outside = parts.join(main, "label"), F.col("_part") != F.col("_largest")
    # blocks 0.._others-1 hold the members outside the largest part, the blocks after them that part; pairs of two of the latter are not needed
    placed = placed.withColumn("_own", F.when(outside, F.pmod(F.xxhash64("rep"), F.col("_others"))).otherwise(F.col("_others") + F.pmod(F.xxhash64("rep"), F.col("_mains"))))
    last = F.when(outside, F.col("_others") + F.col("_mains")).otherwise(F.col("_others")) - 1
    placed = placed.select("label", "rep", "_own", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_other"))
    return links.unionByName(near).unionByName(linked(placed.select("label", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "rep", "shingles"), "label", "_low", "_high"))


def _blocks(n: str, s: str):
    """Blocks of which two fit a task, for ``n`` documents of ``s`` shingles."""
    return F.greatest(F.lit(1), F.ceil(F.col(s) * 2 / TASK_SHINGLES), F.ceil(F.col(n) * 2 / TASK_DOCUMENTS)).cast("long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = 75, denominator: int = 100, recall: float = 0.9999) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if ``denominator * intersection >= numerator * union`` on
    their full shingle sets; ``component_id`` is the smallest id reachable over links.
    ``recall`` is the probability that a single pair at the threshold meets in a tree.
    """
    fields = [f.split()[0] for f in SIGNATURE.split(", ")]

    @F.pandas_udf(f"struct<{SIGNATURE.replace(' ', ':').replace(',:', ',')}>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        return signatures(pa.array(texts, type=pa.string()))[fields]

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    text_hash = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit("second"), "text").alias("y"))
    signed_rows = keep(rows.select("doc_id", text_hash.alias("th"), signed("text").alias("_s")).select("doc_id", "th", "_s.*"), "signatures")
    reps = signed_rows.where("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), F.min("th").alias("th"), F.first("n_shingles").alias("n_shingles"), F.first("lows").alias("lows"), F.first("bits").alias("bits")
    )
    reps = keep(reps.withColumn("rep", F.monotonically_increasing_id()), "sets")
    groups = components(candidate_links(reps, trees_for(recall, numerator / denominator)))
    wanted = keep(reps.select("rep", "th", "n_shingles").join(groups.withColumnRenamed("node", "rep"), "rep"), "candidates")
    small = wanted.count() <= BROADCAST_ROWS
    picked = rows.select("text", text_hash.alias("th")).join(F.broadcast(wanted) if small else wanted, "th")
    picked = picked.groupBy("rep").agg(F.first("label").alias("label"), F.first("n_shingles").alias("n_shingles"), F.first("text").alias("text"))
    labels = components(exact_links(keep(picked, "texts"), numerator, denominator))
    placed = reps.select("h1", "h2", "rep", "doc_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("label", F.coalesce("label", "rep"))
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(smallest, "label").select("h1", "h2", "component_id")
    out = signed_rows.select("doc_id", "n_shingles", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.75."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
