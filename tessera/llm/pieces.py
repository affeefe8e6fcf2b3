"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an arc for every piece that matches at a place; a character
without a piece of its own gets one arc of its UTF-8 byte pieces. Forward filtering sums
the weights of all segmentations up to each place; backward sampling then draws the arc
that enters the end, the place it comes from, and so on, which is an exact draw from
the distribution over segmentations, P(s) proportional to the product of the pieces'
weights to the power ``alpha``. Draws come from a hash of the row's key, the word's place
in the text and the step, so they repeat on any executor and in any partitioning.

No piece of these vocabularies goes from another character on to a space, so lattices
fall apart into words; each distinct word's lattice is built once for a stretch of text
and all its occurrences are sampled together, array by array.

A space is written as U+2581 and the text begins with one, as SentencePiece does; a
U+2581 that stands in the text goes by its bytes, so decoding gives back every text.
Until then a lone surrogate stands for it, which no UTF-8 text can hold. Pieces of a
byte-pair model have merge ranks for scores; their weights are taken as 1 / (rank + 2).

Defined results: a null or empty text has no piece and decodes to the empty string.
Rows with equal key and text get equal samples. A null key counts as an empty one.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Lookup, U64, mix

SPACE = "▁"
#: Characters of text whose words share a lattice table.
STRETCH = 1_000_000
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Stands for a U+2581 of the text itself while a space is written as one: a lone surrogate, which no text holds.
LITERAL = "\ud8ff"


class Pieces:
    """The pieces of a model as a trie, their weights, and their bytes for decoding."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(size)]
        scores = np.array([model.get_score(k) for k in range(size)])
        ranked = bool((np.diff(scores[scores < 0][-100:]) == -1).all())
        weights = -np.log(np.minimum(-scores, size) + 2.0) if ranked else scores
        self.bytes = {int(names[k][3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.raw = [b""] * size
        for value, k in self.bytes.items():
            self.raw[k] = bytes((value,))
        if len(self.bytes) < 256:
            raise ValueError("lossless sampling needs byte pieces")
        self.byte_weight = alpha * (min(weights.min(), -np.log(size)) - 1.0)
        trie: dict[tuple[int, int], int] = {}
        piece_at: list[int] = [-1]
        for k, name in enumerate(names):
            if model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                continue
            if SPACE in name.lstrip(SPACE):
                raise ValueError("a piece crosses a word boundary")
            self.raw[k] = name.replace(SPACE, " ").encode()
            node = 0
            for c in name:
                step = (node, ord(c))
                if step not in trie:
                    trie[step] = len(piece_at)
                    piece_at.append(-1)
                node = trie[step]
            piece_at[node] = k
        keys = np.array([n << 21 | c for n, c in trie], dtype=np.int64)
        self.step = Lookup(keys, np.fromiter(trie.values(), dtype=np.int64, count=len(trie)))
        self.piece_at = np.array(piece_at, dtype=np.int64)
        self.weights = alpha * weights

    def follow(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The trie's next nodes, or -1."""
        return self.step(nodes << 21 | points)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a sequence of ids."""
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


class Lattice:
    """The lattices of distinct words: for each place, the arcs that enter it with their cumulative probabilities."""

    def __init__(self, pieces: Pieces, words: list[str]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        # place i of word w is node i + w; a word of n characters has n + 1 nodes
        self.start = ends - sizes + np.arange(len(words))
        self.end = self.start + sizes
        place = np.arange(len(points))
        literal = points == ord(LITERAL)
        source, target, piece = [], [], []
        nodes, here = np.zeros(len(points), dtype=np.int64), place
        length = 0
        while len(here):
            fits = here + length < stop[here]
            here, nodes = here[fits], nodes[fits]
            nodes = np.where(literal[here + length], -1, pieces.follow(nodes, points[here + length]))
            here, nodes = here[nodes >= 0], nodes[nodes >= 0]
            length += 1
            known = pieces.piece_at[nodes] >= 0
            if length == 1:
                single = np.zeros(len(points), dtype=bool)
                single[here[known]] = True
            source.append(here[known] + word[here[known]])
            target.append(source[-1] + length)
            piece.append(pieces.piece_at[nodes[known]])
        bare = place[~single] if len(points) else place
        self.by_bytes: list[np.ndarray] = []
        numbers: dict[int, int] = {}
        spelled = np.empty(len(bare), dtype=np.int64)
        for k, p in enumerate(points[bare].tolist()):
            if p not in numbers:
                raw = (SPACE if p == ord(LITERAL) else chr(p)).encode()
                numbers[p] = len(self.by_bytes)
                self.by_bytes.append(np.array([pieces.bytes[b] for b in raw], dtype=np.int64))
            spelled[k] = -1 - numbers[p]
        source.append(bare + word[bare])
        target.append(source[-1] + 1)
        piece.append(spelled)
        source, target, piece = (np.concatenate(x) for x in (source, target, piece))
        order = np.argsort(target, kind="stable")
        self.source, target, self.piece = source[order], target[order], piece[order]
        cost = np.array([len(b) for b in self.by_bytes] or [0]) * pieces.byte_weight
        weight = np.where(self.piece >= 0, pieces.weights[np.maximum(self.piece, 0)], cost[np.minimum(np.maximum(-1 - self.piece, 0), len(cost) - 1)])
        mass = np.full(int(self.end[-1]) + 1 if len(words) else 0, -np.inf)
        mass[self.start] = 0.0
        depth = target - np.repeat(self.start, sizes + 1)[target]
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        value = np.empty(len(target))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            arcs = by_depth[a:b]
            into = target[arcs]
            first = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            v = mass[self.source[arcs]] + weight[arcs]
            most = np.maximum.reduceat(v, first)
            runs = np.diff(np.append(first, len(v)))
            total = np.add.reduceat(np.exp(v - np.repeat(most, runs)), first)
            mass[into[first]] = most + np.log(total)
            value[arcs] = v
        self.mass = mass
        share = np.exp(value - mass[target])
        running = np.cumsum(share)
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, dtype=int)
        runs = np.diff(np.append(first, len(target)))
        before = np.repeat(running[first] - share[first] if len(first) else first, runs)
        within = np.minimum(running - before, 1.0)
        if len(target):
            within[np.append(first[1:], len(target)) - 1] = 1.0
        self.key = target + within
        self.last = np.cumsum(np.bincount(target, minlength=len(mass))) - 1
        self.first = np.concatenate(([0], self.last[:-1] + 1)) if len(mass) else self.last

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation for each occurrence of a word: the ids of all end to end, and how many each has."""
        at, who = self.end[words], np.arange(len(words))
        arcs, owners, step = [], [], 0
        while len(who):
            draw = (mix(seeds[who] + U64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) * 2.0**-53
            arc, wanted, last = self.first[at], at + draw, self.last[at]
            passed = np.arange(len(at))
            while len(passed):  # on to the first arc above the draw, never past the node's last one
                passed = passed[(self.key[arc[passed]] <= wanted[passed]) & (arc[passed] < last[passed])]
                arc[passed] += 1
            arcs.append(arc)
            owners.append(who)
            at = self.source[arc]
            go = at != self.start[words[who]]
            at, who, step = at[go], who[go], step + 1
        arc, owner = np.concatenate(arcs), np.concatenate(owners)
        turn = np.concatenate([np.full(len(o), k) for k, o in enumerate(owners)])
        steps = np.bincount(owner, minlength=len(words))
        slot = np.cumsum(steps)[owner] - 1 - turn
        piece = np.empty(len(arc), dtype=np.int64)
        piece[slot] = self.piece[arc]
        owner_of = np.repeat(np.arange(len(words)), steps)
        spelled = np.flatnonzero(piece < 0)
        if len(spelled):
            lengths = np.ones(len(piece), dtype=np.int64)
            parts = [self.by_bytes[-1 - p] for p in piece[spelled].tolist()]
            lengths[spelled] = [len(p) for p in parts]
            owner_of = np.repeat(owner_of, lengths)
            begin = np.cumsum(lengths) - lengths
            piece = np.repeat(piece, lengths)
            for b, p in zip(begin[spelled].tolist(), parts, strict=True):
                piece[b : b + len(p)] = p
        return piece, np.bincount(owner_of, minlength=len(words))


@lru_cache(maxsize=2)
def pieces_of(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def written(text: str) -> list[str]:
    """The words of a text as they stand in its lattice."""
    return WORDS.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []


def sample_ids(pieces: Pieces, texts: Iterable[str], seeds: Iterable[int]) -> Iterator[np.ndarray]:
    """The ids of one sampled segmentation of each text."""
    held: list[tuple[list[str], int]] = []
    size = 0
    for text, seed in zip(texts, seeds, strict=True):
        words = written(text)
        held.append((words, seed))
        size += len(text)
        if size > STRETCH:
            yield from _stretch(pieces, held)
            held, size = [], 0
    yield from _stretch(pieces, held)


def _stretch(pieces: Pieces, held: list[tuple[list[str], int]]) -> Iterator[np.ndarray]:
    if not held:
        return
    numbers: dict[str, int] = {}
    for words, _ in held:
        for w in words:
            numbers.setdefault(w, len(numbers))
    if not numbers:
        yield from (np.zeros(0, dtype=np.int64) for _ in held)
        return
    lattice = Lattice(pieces, list(numbers))
    counts = np.array([len(words) for words, _ in held], dtype=np.int64)
    flat = np.fromiter((numbers[w] for words, _ in held for w in words), dtype=np.int64, count=int(counts.sum()))
    base = np.array([seed & 0xFFFFFFFFFFFFFFFF for _, seed in held], dtype=np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    seeds = mix(mix(np.repeat(base, counts)) + place.astype(np.uint64) * U64(0xD1B54A32D192ED03))
    ids, per_word = lattice.sample(flat, seeds)
    until = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(counts)))]
    for a, b in zip(until[:-1], until[1:], strict=True):
        yield ids[a:b]


def seed_of(key: str, seed: int = 0) -> Column:
    """A 64-bit seed for each row, from its key."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` with ``piece_ids``, one sampled segmentation of each text."""

    @F.pandas_udf("array<int>")
    def sampled(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series(list(sample_ids(pieces_of(model, alpha), (t or "" for t in texts), seeds)), dtype=object)

    return docs.withColumn("piece_ids", sampled(F.col(text), seed_of(key, seed)))


def decode(encoded: DataFrame, model: str, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids (null ids: empty)."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        pieces = pieces_of(model, 1.0)
        return column.map(lambda i: "" if i is None or not len(i) else pieces.decode(i.tolist()))

    return encoded.withColumn("decoded", texts(F.col(ids)))


DIGEST = "n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again: counts and digests."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf(f"struct<{DIGEST.replace(' ', ':').replace(',:', ',')}>")
    def digests(texts: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        pieces, out = pieces_of(model, 1.0), []
        plain = [t or "" for t in texts]
        for text, ids in zip(plain, sample_ids(pieces, plain, seeds), strict=True):
            back = pieces.decode(ids.tolist()) if len(ids) else ""
            out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
        return pd.DataFrame(out, columns=["n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", digests(F.col("text"), seed_of("doc_id")).alias("_d")).select("doc_id", "_d.*")
