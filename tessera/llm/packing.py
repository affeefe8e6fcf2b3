"""Fixed-length training sequences: tokens counted with a word cache, pieces packed best-fit over a tree.

Only documents longer than a sequence are cut. The pieces' lengths are packed in
rounds: items are dealt out by a hash into groups of bounded size, each group packs
best-fit in descending order of length, nearly full bins are final, and the underfull
bins go up the tree as items of the next round, in fewer groups, until one group is
left or a round no longer saves bins. Only lengths travel; texts are read once.

Defined results: a null or empty text is the end token alone. Repeated rows are packed
each on their own. A null id is kept. An empty table gives an empty result. Equal
lengths are taken in the order of their item numbers, so that a rerun over the written
pieces repeats the packing.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import keep

CAPACITY = 4_096
END = (1).to_bytes(4, "little")
#: A bin with at most this share of the capacity left is final.
SLACK = 0.01
#: Items in a group of one round, and how many groups meet in one of the next round.
GROUP, FAN_IN = 20_000, 8
#: A round must save this share of the underfull bins for another to follow.
GAIN = 0.02
#: Characters of text that are encoded together, and words that a worker remembers.
STRETCH, REMEMBERED = 8_000_000, 500_000

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class BytePairs:
    """Byte-pair merges of many words at once, over the merge table of a tokenizer file.

    Each step finds, in every word that still has a known pair, the leftmost pair of the
    lowest rank and merges it, which is the order in which the tokenizer merges.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, tokens: dict[str, int], merges: list, suffix: str):
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {b: chr(b) for b in letters} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(letters))}
        if max(tokens.values()) > 0xFFFF:
            raise ValueError("pairs of ids must fit into 32 bits")
        self.inner = np.array([tokens[shown[b]] for b in range(256)], dtype=np.uint32)
        self.final = np.array([tokens[shown[b] + suffix] for b in range(256)], dtype=np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([tokens[a] << 16 | tokens[b] for a, b in pairs], dtype=np.uint32)
        made = np.array([tokens[a + b] for a, b in pairs], dtype=np.uint32)
        _, first = np.unique(keys, return_index=True)
        self.bits = 19
        self.slots = np.zeros(1 << self.bits, dtype=np.uint32)
        self.ranks = np.full(1 << self.bits, self.NONE, dtype=np.int32)
        self.made = np.zeros(1 << self.bits, dtype=np.uint32)
        todo, step = np.sort(first), 0
        while len(todo):  # each key goes to the first free slot of its probes
            at = self._probe(keys[todo], step)
            _, chosen = np.unique(at, return_index=True)
            chosen = chosen[self.ranks[at[chosen]] == self.NONE]
            self.slots[at[chosen]], self.ranks[at[chosen]], self.made[at[chosen]] = keys[todo[chosen]], todo[chosen], made[todo[chosen]]
            todo, step = np.delete(todo, chosen), step + 1
        self.probes = step

    def _probe(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys + np.uint32(step)) * np.uint32(0x9E3779B1)
        return (mixed ^ (mixed >> np.uint32(15))) >> np.uint32(32 - self.bits)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the merged id of each pair; ``NONE`` where the table has none."""
        at = self._probe(keys, 0)
        hit = self.slots[at] == keys
        rank, made = np.where(hit, self.ranks[at], self.NONE), self.made[at]
        open_at = np.flatnonzero(~hit & (self.ranks[at] != self.NONE))
        for step in range(1, self.probes):
            at = self._probe(keys[open_at], step)
            hit = self.slots[at] == keys[open_at]
            rank[open_at[hit]], made[open_at[hit]] = self.ranks[at[hit]], self.made[at[hit]]
            open_at = open_at[~hit]
        return rank, made

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (not empty, without line ends) end to end, and how many each has."""
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        lines = np.frombuffer("\n".join(words).encode(), dtype=np.uint8)
        between = lines == 10
        sizes = np.diff(np.concatenate(([-1], np.flatnonzero(between), [len(lines)]))) - 1
        raw, ends = lines[~between], np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), self.NONE, dtype=np.int32)
            changes = word[1:] != word[:-1]
            rank[:-1], made = self._find(symbols[:-1] << np.uint32(16) | symbols[1:])
            rank[:-1][changes] = self.NONE
            begins = np.flatnonzero(np.concatenate(([True], changes)))
            least = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(word)))
            over = np.repeat(least == self.NONE, lengths)
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            hits = np.flatnonzero((rank == np.repeat(least, lengths)) & ~over)
            hits = hits[np.concatenate(([True], word[hits[1:]] != word[hits[:-1]]))] if len(hits) else hits
            symbols[hits] = made[hits]
            live = ~over
            live[hits + 1] = False
            symbols, word = symbols[live], word[live]
        words_of = np.concatenate(done_words) if done_words else np.zeros(0, dtype=np.int64)
        order = np.argsort(words_of, kind="stable")
        flat = np.concatenate(done_symbols)[order] if done_symbols else words_of
        return flat, np.bincount(words_of, minlength=len(words))


class WordEncoder:
    """Token ids of texts, encoding each word once.

    A text of plain letters, digits, punctuation and ASCII white space is encoded word
    by word from a bounded cache, which gives the same ids as the tokenizer because no
    token of this vocabulary crosses white space. Any other text, and one that holds an
    added token of the tokenizer (``<|endoftext|>``), goes to the tokenizer whole.
    """

    # The tokenizer's own pre-token pattern (fixed value), with its letters and digits as the plain texts have them.
    PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"
    ODD = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("added tokens must be looked for in the text as it is")
        self.added = [t.content for t in added]
        self.pairs = BytePairs(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.units = re.compile(self.PRE_TOKEN).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list(words)
        for k in range(0, len(missing), 50_000):
            part = missing[k : k + 50_000]
            whole, mixed = [w for w in part if w.isalpha()], [w for w in part if not w.isalpha()]
            found = [self.units(w) for w in mixed]
            ids, sizes = self.pairs.encode(whole + list(chain.from_iterable(found)))
            last = np.cumsum(np.concatenate((np.ones(len(whole), dtype=np.int64), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))))
            stops = (np.concatenate(([0], np.cumsum(sizes)))[last] * 4).tolist()
            raw = ids.astype("<u4").tobytes()
            self.known.update(zip(whole + mixed, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The little-endian 32-bit ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > STRETCH:
                yield from self._stretch(held)
                held, size = [], 0
        yield from self._stretch(held)

    def _stretch(self, texts: list[str]) -> Iterator[bytes]:
        split = [None if any(a in t for a in self.added) or self.ODD.search(t) else t.lower().split() for t in texts]
        words: set[str] = set()
        for s in split:
            words.update(s or ())
        self._learn(words)
        find = self.known.__getitem__
        for text, s in zip(texts, split, strict=True):
            yield self.plain(text) if s is None else b"".join(map(find, s))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(ids: bytes, capacity: int) -> list[dict]:
    """The pieces of a document, given its ids without the end token."""
    ids += END
    step = 4 * capacity
    return [{"piece": k, "start": k * capacity, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k, part in enumerate(ids[a : a + step] for a in range(0, len(ids), step))]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32``: every document's pieces of at most ``capacity`` tokens."""

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(ids, capacity) for ids in encoder(vocabulary).ids(t or "" for t in texts)], dtype=object)

    return docs.select(F.col(key), F.explode(pieces(F.col(text))).alias("_piece")).select(F.col(key), "_piece.*")


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit packing in the order given: the bin and the place of each item, and how full the bins are."""
    bins, places, fills = [], [], []
    room: dict[int, list[int]] = {}
    open_rooms: list[int] = []
    for size in sizes:
        k = bisect_left(open_rooms, size)
        if k < len(open_rooms):
            left = open_rooms[k]
            of = room[left]
            chosen = of.pop()
            if not of:
                del open_rooms[k]
        else:
            chosen, left = len(fills), capacity
            fills.append(0)
        bins.append(chosen)
        places.append(fills[chosen])
        fills[chosen] += size
        left -= size
        if left:
            stack = room.setdefault(left, [])
            if not stack:
                insort(open_rooms, left)
            stack.append(chosen)
    return bins, places, fills


def _round(items: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    """Pack ``item, size``: ``item, bin, place, fill``, with a bin's number unique over rounds and groups."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, places, fills = best_fit(rows["size"].tolist(), capacity)
        base = (level << 58) | (int(rows["_group"].iloc[0]) << 24)
        chosen = np.array(bins, dtype=np.int64)
        return pd.DataFrame({"item": rows["item"].to_numpy(), "bin": base + chosen, "place": np.array(places, dtype=np.int64), "fill": np.array(fills, dtype=np.int64)[chosen]})

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack, "item long, bin long, place long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    ``pieces`` needs a column ``length`` of 1 to ``capacity``; its other columns pass
    through (names that begin with an underscore are the operator's own).
    """
    spark = pieces.sparkSession
    held = keep(pieces.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    items = held.select(F.col("_item").alias("item"), F.col("length").alias("size"))
    count = items.count()
    groups = max(1, -(-count // GROUP))
    rounds: list[DataFrame] = []
    while True:
        packed = keep(_round(items, len(rounds) + 1, groups, capacity), f"packed-{len(rounds)}")
        rounds.append(packed)
        underfull = packed.where(F.col("fill") < capacity * (1 - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        underfull = underfull.distinct()
        left = underfull.count()
        done = left < 2 or groups == 1 or (len(rounds) > 1 and left > count * (1 - GAIN))
        count = left
        if done:
            break
        groups = max(1, -(-count // GROUP), groups // FAN_IN)
        items = underfull
    placed = None
    for packed in reversed(rounds):
        here = packed.select("item", "bin", "place")
        if placed is not None:
            above = placed.select(F.col("item").alias("bin"), F.col("bin").alias("_above"), F.col("place").alias("_by"))
            here = here.join(above, "bin", "left").select("item", F.coalesce("_above", "bin").alias("bin"), (F.col("place") + F.coalesce("_by", F.lit(0))).alias("place"))
        placed = here
    joined = held.join(placed.withColumnsRenamed({"item": "_item", "bin": "sequence_id", "place": "offset"}), "_item")
    return joined.drop("_item")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens of the public word vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))
