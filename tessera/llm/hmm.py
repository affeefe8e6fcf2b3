"""A hidden Markov language model: Baum-Welch over the whole training corpus, exact likelihood by scaled recursion.

Words are maximal runs of bytes other than space and \\t..\\r with A-Z lower-cased; each
text ends with one end token. The most frequent words are symbols of their own; every
other word, seen or not, belongs to a class by its last three bytes, and stands in it
with its add-one share:

    P(word | state) = P(class | state) * (c + 1) / (N_class + V_class + 1)

The likelihood of a text under these probabilities is exact (no beam, no sampling). As in
the base score, a class has one unseen place that all its unseen words share, so over
seen words and one unseen word a class the probabilities add up to one.

Training counts are sums over partitions: each task runs forward-backward over its
documents and sends expected counts, which are added up in two steps. Training passes
over the corpus in folds first, one M-step for each, then over all of it. Texts are read
twice, to count words and to number them; all passes read the written numbers.

The counts of the words beyond the ``SHARED`` most frequent ones are never gathered in
one place: a text's rare words are joined with the table of counts.

Defined results: a null or empty text is the end token alone. Without training rows all
counts are zero: the base score is 0 and the model is uniform. Repeated rows give
repeated results; a null id is learnt from. An empty table gives an empty result. Texts of
any length are learnt from and scored whole. Columns other than the key, the text and
those asked for are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import remainder
from tessera.llm.store import keep

END = b"\n"
#: Words with a symbol of their own, classes of the others, words whose counts every task gets, and latent states.
SYMBOLS, CLASSES, SHARED, STATES = 32_768, 1_024, 150_000, 12
FOLDS = 4
#: Pseudo-counts of the corpus-wide distribution in every state, and of every transition.
PRIOR_EMIT, PRIOR_STEP = 200.0, 5.0
#: Tokens that are worked on together, distinct words that a counting task holds, and symbols in a row of counts.
STRETCH, HELD, CHUNK = 100_000, 200_000, 2_048
#: How a symbol is written: 32,768 words and 1,024 classes fit two bytes.
SYMBOL = np.dtype("<u2")
#: Bands of word counts for each power of two, by which the shared words are picked.
BANDS = 64


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text, without the end token."""
    return (text or "").encode().lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class _Numbers(dict):
    """Places of the shared words; for any other word -1 - its class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - class_of(word)


@dataclass
class Vocabulary:
    """Corpus counts: totals, the shared words by descending count, and each class's tokens and types.

    The first ``n_symbols`` shared words are symbols of their own.
    """

    total: int
    types: int
    words: list[bytes]
    counts: np.ndarray
    n_symbols: int
    class_tokens: np.ndarray
    class_types: np.ndarray

    @property
    def size(self) -> int:
        return self.n_symbols + CLASSES

    def numbers(self) -> _Numbers:
        if "_numbers" not in self.__dict__:
            self._numbers = _Numbers({w: k for k, w in enumerate(self.words)})
        return self._numbers

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By place, with the classes (places below 0) at the end: symbol numbers, shares of the class, and log10(c + 1)."""
        if "_by_place" not in self.__dict__:
            classes = np.concatenate((np.array([class_of(w) for w in self.words], dtype=np.int64), np.arange(CLASSES)[::-1]))
            own = np.arange(len(classes)) < self.n_symbols
            gains = np.concatenate((np.log10(self.counts + 1.0), np.zeros(CLASSES)))
            room = np.log10(self.class_tokens + self.class_types + 1.0)
            self._by_place = np.where(own, np.arange(len(classes)), self.n_symbols + classes), np.where(own, 0.0, gains - room[classes]), gains
        return self._by_place

    def symbols(self, places: np.ndarray) -> np.ndarray:
        """Symbol numbers of places as ``numbers`` gives them."""
        return self._tables()[0][places]

    def inner(self, places: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its class, without the counts of words that are not shared; 0 for symbols."""
        return self._tables()[1][places]

    def gains(self, places: np.ndarray) -> np.ndarray:
        """log10(c + 1) of shared words, 0 of others."""
        return self._tables()[2][places]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


@dataclass
class Hmm:
    """Start, step and emission probabilities; ``emit`` has a row for each symbol."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, n``: how often each word, and the end token, stands in all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for rows in batches:
            for t in rows[text]:
                held.update(tokens_of(t))
                held[END] += 1
                if len(held) > HELD:
                    yield pd.DataFrame({"token": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"token": list(held), "n": list(held.values())})

    return docs.select(text).mapInPandas(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of the counts that every task gets.

    The shared words are those of the highest bands of counts that hold at most
    ``SHARED`` words together, so no task sorts or sends more than that.
    """
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    band = F.floor(F.log2(F.col("n").cast("double")) * BANDS)
    held, least = 0, None
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        held += r["count"]
        if held > SHARED:
            break
        least = r["band"]
    top = counts.where((band >= least) | (F.col("token") == F.lit(END))).collect() if least is not None else counts.where(F.col("token") == F.lit(END)).collect()
    top = sorted(((bytes(r["token"]), r["n"]) for r in top), key=lambda x: (x[0] != END, -x[1], x[0]))
    words, numbers = [w for w, _ in top], np.array([n for _, n in top], dtype=np.int64)
    n_symbols = min(SYMBOLS, len(words))
    last3 = F.expr("crc32(substring(token, greatest(octet_length(token) - 2, 1), 3))") % CLASSES
    tokens, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in counts.groupBy(last3.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    for w, n in zip(words[:n_symbols], numbers[:n_symbols], strict=True):
        tokens[class_of(w)] -= n
        kinds[class_of(w)] -= 1
    return Vocabulary(int(total), int(types), words, numbers, n_symbols, tokens, kinds)


def first_guess(vocab: Vocabulary) -> Hmm:
    """Sticky states whose emissions lean, by fixed random weights, to words with the same pairs of bytes."""
    draw = np.random.Generator(np.random.Philox(11))
    lean = draw.normal(size=(65_536, STATES))
    noise = np.zeros((vocab.size, STATES))
    for k, word in enumerate(vocab.words[: vocab.n_symbols]):
        pairs = [a << 8 | b for a, b in zip(word, word[1:], strict=False)] or [word[0] if word else 0]
        noise[k] = lean[pairs].sum(0) / math.sqrt(len(pairs))
    emit = frequencies(vocab)[:, None] * np.exp(0.7 * noise)
    step = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Hmm(np.full(STATES, 1 / STATES), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def frequencies(vocab: Vocabulary) -> np.ndarray:
    """The corpus-wide distribution over symbols, add-one."""
    out = np.ones(vocab.size)
    out[: vocab.n_symbols] += vocab.counts[: vocab.n_symbols]
    out[vocab.n_symbols :] += vocab.class_tokens
    return out / out.sum()


def _lay_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by descending length, step by step: the symbols, the rows at each step, and the order."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes[order[0]])
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    begin = np.concatenate(([0], np.cumsum(active)))
    flat = np.empty(int(begin[-1]), dtype=np.int64)
    for row, k in enumerate(order):
        flat[begin[: sizes[k]] + row] = sequences[k]
    return flat, active, order


def forward(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Natural log likelihoods, and the scaled forward table with its lay-out."""
    flat, active, order = _lay_out(sequences)
    emitted = model.emit[flat]
    alpha = np.empty_like(emitted)
    scale = np.empty(len(flat))
    at = 0
    for t, n in enumerate(active):
        here = alpha[at : at + n]
        if t:
            np.matmul(alpha[at - active[t - 1] : at - active[t - 1] + n], model.step, out=here)
            here *= emitted[at : at + n]
        else:
            np.multiply(emitted[:n], model.start, out=here)
        total = here.sum(1)
        scale[at : at + n] = total
        here /= total[:, None]
        at += n
    begin = np.concatenate(([0], np.cumsum(active)[:-1]))
    row = np.arange(len(flat)) - np.repeat(begin, active)
    likelihood = np.zeros(len(sequences))
    likelihood[order] = np.bincount(row, weights=np.log(scale), minlength=len(sequences))
    return likelihood, flat, active, emitted, alpha, scale


def expected_counts(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, steps and emissions of the sequences."""
    _, flat, active, emitted, alpha, scale = forward(model, sequences)
    beta = np.ones_like(alpha)
    ahead = emitted / scale[:, None]
    begin = np.concatenate(([0], np.cumsum(active)))
    steps = np.zeros_like(model.step)
    for t in range(len(active) - 2, -1, -1):
        n, here, there = active[t + 1], begin[t], begin[t + 1]
        ahead[there : there + n] *= beta[there : there + n]
        np.matmul(ahead[there : there + n], model.step.T, out=beta[here : here + n])
    previous = np.concatenate([np.arange(begin[t], begin[t] + active[t + 1]) for t in range(len(active) - 1)]) if len(active) > 1 else np.zeros(0, dtype=int)
    steps = model.step * (alpha[previous].T @ ahead[active[0] :])
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    emits = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=len(model.emit)) for k in range(gamma.shape[1])], axis=1)
    return gamma[: active[0]].sum(0), steps, emits


def _length(text: str | None) -> int:
    return len(text or "")


def _groups(sequences: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and symbols of written sequences, in groups of about ``STRETCH`` tokens of like length, so that the recursion's steps work on many rows."""
    held, rows, size = [], [], 0
    lengths = sequences.map(len).to_numpy()
    for k in np.argsort(lengths, kind="stable").tolist():
        held.append(np.frombuffer(sequences.iat[k], dtype=SYMBOL))
        rows.append(k)
        size += len(held[-1])
        if size > STRETCH:
            yield rows, held
            held, rows, size = [], [], 0
    if held:
        yield rows, held


NUMBERED = "n_tokens long, known long, base double, inner double, symbols binary, rare array<binary>"


def numbered(docs: DataFrame, vocab: Vocabulary, columns: list[Column], fold: Column, text: str = "text") -> DataFrame:
    """``columns``, ``fold`` and ``NUMBERED`` for every row: texts as symbols, so that the passes over them read no text again.

    ``rare`` holds the words whose counts are not shared; ``base`` and ``inner`` lack their counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    base_room = math.log10(vocab.total + vocab.types + 1)

    def number(texts: list, held: Vocabulary) -> list[tuple]:
        find = held.numbers().__getitem__
        words = [[*tokens_of(t), END] for t in texts]
        sizes = np.array([len(w) for w in words])
        flat, begins = np.fromiter(map(find, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum())), np.cumsum(sizes) - sizes
        base = np.add.reduceat(held.gains(flat), begins) - sizes * base_room
        inner = np.add.reduceat(held.inner(flat), begins)
        symbols = held.symbols(flat).astype(SYMBOL)
        absent = np.flatnonzero(flat < 0)
        owner = np.searchsorted(begins, absent, side="right") - 1
        rare: list[list[bytes]] = [[] for _ in texts]
        for k, at in zip(owner.tolist(), (absent - begins[owner]).tolist(), strict=True):
            rare[k].append(words[k][at])
        return [(n, n - len(r), x, y, symbols[a : a + n].tobytes(), r) for n, r, x, y, a in zip(sizes.tolist(), rare, base.tolist(), inner.tolist(), begins.tolist(), strict=True)]

    @F.pandas_udf(f"struct<{NUMBERED.replace(' ', ':').replace(',:', ',')}>")
    def numbers(texts: pd.Series) -> pd.DataFrame:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += _length(t)
            if size > 8 * STRETCH:
                out += number(held, shared.value)
                held, size = [], 0
        if held:
            out += number(held, shared.value)
        return pd.DataFrame(out, columns=[c.split()[0] for c in NUMBERED.split(", ")])

    rows = docs.select(*columns, fold.cast("int").alias("_fold"), numbers(F.col(text)).alias("_s"))
    return rows.select(*rows.columns[:-1], "_s.*")


def training_pass(rows: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows of a table of ``NUMBERED`` rows, added up over partitions."""
    size = len(model.emit)
    chunks = -(-size // CHUNK)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hmm = shared.value
        starts, steps, emits, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES)), False
        for part in batches:
            for _, sequences in _groups(part["symbols"]):
                a, b, c = expected_counts(hmm, sequences)
                starts += a
                steps += b
                emits += c
                seen = True
        if seen:
            parts = [emits[k * CHUNK : (k + 1) * CHUNK] for k in range(chunks)] + [steps, starts]
            yield pd.DataFrame({"part": np.arange(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c) for c in rows["counts"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    sent = rows.select("symbols").mapInPandas(count, "part long, counts binary").withColumn("salt", F.spark_partition_id() % 16)
    once = sent.groupBy("part", "salt").applyInPandas(add, "part long, counts binary")
    parts = {r["part"]: np.frombuffer(bytes(r["counts"])) for r in once.groupBy("part").applyInPandas(add, "part long, counts binary").collect()}
    shared.unpersist()
    if not parts:
        return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))
    emits = np.concatenate([parts[k] for k in range(chunks)]).reshape(size, STATES)
    return parts[chunks + 1], parts[chunks].reshape(STATES, STATES), emits


def maximised(vocab: Vocabulary, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray) -> Hmm:
    """The M-step, with pseudo-counts that keep every probability above zero."""
    starts = starts + 1.0
    steps = steps + PRIOR_STEP
    emits = emits + PRIOR_EMIT * frequencies(vocab)[:, None]
    return Hmm(starts / starts.sum(), steps / steps.sum(1, keepdims=True), emits / emits.sum(0))


def train(rows: DataFrame, vocab: Vocabulary, folds: int = FOLDS) -> Hmm:
    """The model, learnt from the rows of a ``numbered`` table whose fold is 0 to ``folds`` - 1."""
    model = first_guess(vocab)
    if vocab.total:
        for k in range(folds):
            model = maximised(vocab, *training_pass(rows.where(F.col("_fold") == k), model))
        model = maximised(vocab, *training_pass(rows.where(F.col("_fold") >= 0), model))
    return model


def scores(rows: DataFrame, model: Hmm, counts: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and n_tokens, n_known, base_score, score for every row of a ``numbered`` table."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def likelihoods(symbols: pd.Series) -> pd.Series:
        out = np.zeros(len(symbols))
        for at, sequences in _groups(symbols):
            out[at] = forward(shared.value, sequences)[0]
        return pd.Series(out / math.log(10))

    scored = rows.select(*columns, "n_tokens", "known", "base", "rare", (F.col("inner") + likelihoods("symbols")).alias("model"))
    scored = keep(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode("rare").alias("token")).join(counts, "token").groupBy("_row").agg(F.count(F.lit(1)).alias("_seen"), F.sum(F.log10(F.col("n") + 1.0)).alias("_more"))
    joined = scored.drop("rare").join(rare, "_row", "left")
    more = F.coalesce("_more", F.lit(0.0))
    return joined.select(
        *columns, "n_tokens", (F.col("known") + F.coalesce("_seen", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )


def language_model(docs: DataFrame, learnt: Column, columns: list[Column], key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> tuple[DataFrame, Hmm, Vocabulary]:
    """``columns`` and n_tokens, n_known, base_score, score for every row of ``docs``, with the model learnt from the rows where ``learnt`` holds."""
    counts = keep(word_counts(docs.where(learnt), text), "word-counts")
    vocab = vocabulary(counts)
    fold = F.when(learnt, F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(folds))).otherwise(-1)
    table = numbered(docs, vocab, columns, fold, text)
    names = table.columns[: len(columns)]
    table = keep(table, "numbered", ("_fold",))
    model = train(table, vocab, folds)
    return scores(table, model, counts, names), model, vocab


def op2_hmm(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; ids with crc32 mod 7 other than 2 are learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    out, _, vocab = language_model(docs, ~held_out, [F.col("doc_id"), held_out.alias("held_out")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
