"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The unit that is judged is a window of a word (or of a run of words of one letter
each): up to ``WINDOW`` characters, of which only letters count. The kernel of two
windows is the gap-weighted count of common subsequences of three letters,

    k(x, y) = sum over u of phi_u(x) phi_u(y),  phi_u(x) = sum over the places of u in x of DECAY ** span,

normalised by the windows' norms, with spans of at most ``SPAN``, so that inserted
characters and gaps cost a factor each instead of breaking the match. Landmark windows
give Nyström features K_xm K_mm^(-1/2); a linear support vector machine is trained on
them by multiple instances: a toxic text needs one toxic window, a clean text has none.
Because the kernel is an inner product of subsequence counts, the trained machine folds
into one weight for each subsequence, and a whole text is scored with array look-ups.

Defined results: a null or empty text, and one without letters, has no window and gets
the lowest score that the calibration gives. Without labelled rows of both classes every
score is the share of toxic labels (0 without any). Equal texts get equal scores; repeated
rows repeat them. Texts of any length are scored whole, null ids too; labels of a null id
or of both classes are not learnt from. An empty table gives an empty result. Columns
other than key, text and label are not read, whatever their names.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import Logistic, labelled_sample, remainder
from tessera.llm.store import keep

WINDOW, SPAN, DECAY = 9, 6, 0.6
#: Letters fall into this many classes: a-z, and the other letters by their code point.
LETTERS = 48
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
#: Characters of a stretch of words that is scored at once, and words that a worker remembers.
STRETCH, REMEMBERED = 1_500_000, 600_000
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def codes(text: str) -> np.ndarray:
    """A class for each character: 1 to ``LETTERS`` for letters, 0 for what only makes a gap."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.zeros(len(points), dtype=np.int64)
    plain = (points >= 97) & (points <= 122)
    out[plain] = points[plain] - 96
    high = points >= 0xC0
    out[high] = 27 + points[high] % (LETTERS - 26)
    return out


def units_of(text: str) -> set[str]:
    """The words of a text in lower case, and its spelled-out words (``i d i o t``) joined by spaces."""
    text = text.lower()
    found = set(text.split())
    found.update(SPELLED.findall(text))
    return found


def triples(text: np.ndarray, starts: np.ndarray):
    """For each gap pattern: the places where three letters of one word stand, their subsequence number and span."""
    word = np.zeros(len(text), dtype=np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    for a, b in GAPS:
        n = len(text) - a - b
        if n <= 0:
            continue
        x, y, z = text[:n], text[a : a + n], text[a + b : a + b + n]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (word[:n] == word[a + b : a + b + n]))
        yield at, ((x[at] - 1) * LETTERS + y[at] - 1) * LETTERS + z[at] - 1, a + b + 1


def windows(word: str) -> list[str]:
    """The windows of a word: the word itself if it fits, else each stretch of ``WINDOW`` characters."""
    return [word] if len(word) <= WINDOW else [word[k : k + WINDOW] for k in range(len(word) - WINDOW + 1)]


def profiles(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decayed subsequence counts phi of windows, scaled to norm one: window index, subsequence, value (sorted)."""
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    text = codes("".join(found))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    owner = np.repeat(np.arange(len(found)), sizes)
    keys, values = [], []
    for at, numbers, span in triples(text, starts) if len(text) else ():
        keys.append(owner[at] * LETTERS**3 + numbers)
        values.append(np.full(len(at), DECAY**span))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(place, weights=np.concatenate(values), minlength=len(distinct))
    row, number = np.divmod(distinct, LETTERS**3)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(found)))
    return row, number, value / norm[row]


def squared_norms(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """k(x, x) before it is normalised, for the windows ``begins`` to ``ends`` of ``text``.

    It is summed over pairs of places of the first and last letters; the middle letters
    that agree between them are counted by a table of running counts of equal letters.
    """
    grid = np.zeros((WINDOW, len(begins)), dtype=np.uint8)
    for k in range(WINDOW):
        inside = begins + k < ends
        grid[k, inside] = text[begins[inside] + k]
    same = ((grid[:, None] == grid[None, :]) & (grid[:, None] > 0)).astype(np.uint8)
    count = np.zeros((WINDOW + 1, WINDOW + 1, len(begins)), dtype=np.uint8)  # at most WINDOW ** 2
    count[1:, 1:] = same.cumsum(0, dtype=np.uint8).cumsum(1, dtype=np.uint8)
    places = [(i, k) for i in range(WINDOW) for k in range(i + 2, min(WINDOW, i + SPAN))]
    out = np.zeros(len(begins))
    for p, (i, k) in enumerate(places):
        for a, c in places[p:]:
            at = np.flatnonzero(same[i, a] & same[k, c])
            if len(at):
                between = count[k, c, at] - count[i + 1, c, at] - count[k, a + 1, at] + count[i + 1, a + 1, at]
                out[at] += between * (DECAY ** (k - i + c - a + 2) * (1 if (a, c) == (i, k) else 2))
    return out


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The normalised kernel of two lists of windows, over the subsequences that the second list holds."""
    mark, number, value = profiles(right)
    held, column = np.unique(number, return_inverse=True)
    dense = np.zeros((len(held) + 1, len(right)))
    dense[column, mark] = value
    out = np.zeros((len(left), len(right)))
    for top in range(0, len(left), 100):
        row, number, value = profiles(left[top : top + 100])
        at = np.searchsorted(held, number)
        at[(at == len(held)) | (held[np.minimum(at, len(held) - 1)] != number)] = len(held)
        use = at < len(held)
        row, part = row[use], dense[at[use]] * value[use][:, None]
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else []
        if len(begins):
            out[top + row[begins]] = np.add.reduceat(part, begins, axis=0)
    return out


#: The decision value of a window that shares nothing with any landmark: clean, at the margin.
OFFSET = -1.0


def support_vectors(features: np.ndarray, signs: np.ndarray, weights: np.ndarray, penalty: float = 1e-4, steps: int = 12) -> np.ndarray:
    """A linear machine with the fixed offset and squared hinge loss, fitted by Newton steps over the instances within the margin."""
    share = weights / weights.sum()
    w = np.zeros(features.shape[1])
    for _ in range(steps):
        inside = signs * (features @ w + OFFSET) < 1
        rows = features[inside]
        curve = (rows * share[inside][:, None]).T @ rows + penalty * np.eye(len(w))
        new = np.linalg.solve(curve, rows.T @ (share[inside] * (signs[inside] - OFFSET)))
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


@dataclass
class ToxicityModel:
    """One weight for each subsequence, the calibration of a text's highest window, and the share of toxic labels."""

    weights: np.ndarray | None
    calibrate: Logistic | None
    share: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def words(self, found: list[str]) -> np.ndarray:
        """The highest decision value of each word's windows."""
        if not found:
            return np.zeros(0)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        text = codes("".join(found))
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        stops = np.repeat(starts + sizes, sizes)
        place = np.arange(len(text))
        whole = np.zeros(len(text), dtype=bool)
        whole[starts] = True
        windows_at = np.flatnonzero(whole | (place + WINDOW <= stops))
        reach = np.minimum(stops, place + WINDOW)[windows_at]
        sums, value = np.zeros(len(windows_at)), np.zeros(len(text) + 1)
        for at, numbers, span in triples(text, starts):
            value[:] = 0
            value[at + 1] = self.weights[numbers] * DECAY**span
            total = np.cumsum(value)
            sums += total[np.maximum(reach - span + 1, windows_at)] - total[windows_at]
        squares = squared_norms(text, windows_at, reach)
        decision = np.where(squares > 1e-9, sums / np.sqrt(np.maximum(squares, 1e-9)), -1.0) + OFFSET
        return np.maximum.reduceat(decision, np.searchsorted(windows_at, starts))

    def each(self, found: list[str], part: int = 30_000) -> np.ndarray:
        """``words`` over any number of words, in parts that bound the memory."""
        return np.concatenate([self.words(found[k : k + part]) for k in range(0, len(found), part)] or [np.zeros(0)])

    def highest(self, texts) -> np.ndarray:
        """Each text's highest decision value (the offset, which is below, where it has no window)."""
        known = self.__dict__.setdefault("_known", {})
        out, held, size = [], [], 0

        def flush() -> None:
            todo = set().union(*held) - known.keys()
            if len(known) + len(todo) > REMEMBERED:
                known.clear()
                todo = set().union(*held)
            todo = sorted(todo)
            known.update(zip(todo, self.each(todo).tolist(), strict=True))
            out.extend(max(map(known.__getitem__, units), default=OFFSET - 1.0) for units in held)

        for text in texts:
            held.append(units_of(text or ""))
            size += len(text or "")
            if size > STRETCH:
                flush()
                held, size = [], 0
        if held:
            flush()
        return np.array(out, dtype=float)

    def score(self, texts) -> np.ndarray:
        if self.calibrate is None:
            return np.full(len(texts), self.share)
        return self.calibrate(self.highest(texts)[:, None])


def train(units: list[set[str]], toxic: np.ndarray, landmarks: int = 700, rounds: int = 4, instances: int = 6_000) -> np.ndarray:
    """Subsequence weights from texts (as sets of units) and their labels.

    The first positive instances are the windows that stand in toxic texts far more often
    than in clean ones; each round then takes every toxic text's highest window and the
    highest windows of all words of clean texts, and trains again. A text counts by its
    share in its group of near copies, which would else make any of their words look
    telling. ``instances`` windows are trained on, on ``landmarks`` of which the kernel
    rests (the size of the model). Evidence that is asked for is 10.8 (a chance of 0.001),
    or 1.5 ln of the number of windows that are tried, and two texts; where that is more
    than half and a tenth of the toxic texts, it is these shares of them.
    """
    weight = _shares(units)
    in_toxic, in_clean = Counter(), Counter()
    for found, label, each in zip(units, toxic, weight.tolist(), strict=True):
        held = in_toxic if label else in_clean
        for w in {w for word in found for w in windows(word)}:
            held[w] += each
    n1, n0 = max(1.0, float(weight[toxic == 1].sum())), max(1.0, float(weight[toxic != 1].sum()))
    third = instances // 3

    def lettered(found: list[str]) -> list[str]:
        rows = profiles(found)[0]
        return [found[k] for k in np.unique(rows)]

    def evidence(window: str) -> float:
        """The likelihood ratio statistic of a window's counts, where it leans to toxic texts."""
        a, b = in_toxic.get(window, 0), in_clean.get(window, 0)
        if a * n0 <= 4 * b * n1:
            return 0.0
        expect = (a + b) * n1 / (n1 + n0)
        return 2 * (a * np.log(a / expect) + (b * np.log(b / (a + b - expect)) if b else 0.0))

    enough = min(max(10.8, 1.5 * np.log(max(2, len(in_toxic)))), n1 / 2)
    positive = lettered(sorted((w for w in in_toxic if evidence(w) >= enough), key=lambda w: (-evidence(w), w))[:third])
    certain = [w for w in positive if evidence(w) >= 4 * enough]
    frequent = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    negative = lettered(frequent[:third] + sorted(frequent[third:], key=_order)[:third])
    clean_words = sorted({w for found, label in zip(units, toxic, strict=True) if not label for w in found}, key=_order)
    toxic_words = [(sorted(found), each) for found, label, each in zip(units, toxic, weight.tolist(), strict=True) if label and found]
    weights = np.zeros(LETTERS**3)
    for turn in range(rounds):
        if not positive or not negative:
            return weights
        marks = positive[: landmarks // 3]
        marks += negative[: landmarks - len(marks)]
        rows = positive + negative
        signs = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        heavy = np.array([1 + np.log1p(in_toxic.get(w, 0)) for w in positive])
        heavy = np.concatenate([heavy / heavy.sum(), np.full(len(negative), 1 / len(negative))]) * len(rows)
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        use = values > 1e-8
        whiten = vectors[:, use] / np.sqrt(values[use])
        machine = support_vectors(kernel(rows, marks) @ whiten, signs, heavy)
        alpha = whiten @ machine
        mark, number, value = profiles(marks)
        weights = np.bincount(number, weights=alpha[mark] * value, minlength=LETTERS**3)
        if turn == rounds - 1:
            break
        model = ToxicityModel(weights, None, 0.0)
        chosen: Counter = Counter()
        for words, each in toxic_words:
            chosen[words[int(np.argmax(model.words(words)))]] += each
        best = []
        for word in sorted(chosen, key=lambda w: (-chosen[w], w)):
            if chosen[word] < min(2.0, n1 / 10) - 1e-9:
                continue
            cuts = windows(word)
            best.append(cuts[int(np.argmax(model.words(cuts)))])
        worst = [clean_words[k] for k in np.argsort(-model.each(clean_words), kind="stable")[:third]]
        negative = lettered(list(dict.fromkeys([w for word in worst for w in windows(word)][:third] + negative)))[: 2 * third]
        clean = set(negative)
        positive = lettered([w for w in dict.fromkeys(best + certain) if w not in clean and evidence(w) >= enough / 3])[:third]
    return weights


def _shares(units: list[set[str]]) -> np.ndarray:
    """One by the size of each text's group; texts that share a pair of minwise words are near copies of one group."""
    group, first = list(range(len(units))), {}

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for k, found in enumerate(units):
        hashes = [zlib.crc32(w.encode()) for w in found]
        low = [min(((h ^ salt) * 0x9E3779B1 & 0xFFFFFFFF for h in hashes), default=k) for salt in (0, 0x5BD1E995, 0x1B873593, 0x85EBCA6B)]
        for pair in (0, *low[:2]), (1, *low[2:]):
            group[root(k)] = root(first.setdefault(pair, k))
    roots = np.array([root(k) for k in range(len(units))], dtype=np.int64)
    return 1.0 / np.bincount(roots, minlength=len(units))[roots] if len(units) else np.zeros(0)


def _order(word: str) -> tuple[int, str]:
    """A fixed order that looks random."""
    return zlib.crc32(word.encode()), word


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = 3_000, class_bytes: int = 32 << 20) -> ToxicityModel:
    """Fit on labelled documents, at most ``per_class`` of each class and ``class_bytes`` of their text (documented bounds); two thirds train, one third calibrates."""
    sample = keep(labelled_sample(docs, labels, label, usable, per_class, class_bytes), "sample")

    @F.pandas_udf("string")
    def units(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n".join(sorted(units_of(t))))

    counted = {r["_label"]: r["count"] for r in labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("_label")).count().collect()}
    share = counted.get(1, 0) / sum(counted.values()) if counted else 0.0
    third = F.pmod(F.xxhash64(F.lit("third"), F.col("doc_id")), F.lit(3)) == 0
    rows = sample.where(~third).select("doc_id", "_label", units("_text").alias("_units")).orderBy("doc_id").collect()
    toxic = np.array([r["_label"] for r in rows], dtype=int)
    texts = [{sys.intern(w) for w in r["_units"].split("\n") if w} for r in rows]
    del rows
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(None, None, share)
    weights = train(texts, toxic)
    del texts
    model = ToxicityModel(weights, None, share)

    @F.pandas_udf("double")
    def highest(texts: pd.Series) -> pd.Series:
        return pd.Series(model.highest(texts))

    rows = sample.where(third).select("doc_id", "_label", highest("_text").alias("_x")).orderBy("doc_id").collect()
    seen = np.array([r["_label"] for r in rows], dtype=float)
    if len(set(seen.tolist())) == 2:
        model.calibrate = Logistic(np.array([[r["_x"]] for r in rows]), seen, share=share, products=False)
    return model


def toxicity_score(model: ToxicityModel, text: str | Column = "text") -> Column:
    """The calibrated probability that the text is toxic."""
    held = text if isinstance(text, Column) else F.col(text)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return scored(held)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of ids with crc32 mod 4 other than 2 are learnt from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, remainder("doc_id", 4) != 2)
    scored = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), toxicity_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
