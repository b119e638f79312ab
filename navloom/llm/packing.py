"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

All documents of one length are alike to a packer, so the instance is the histogram of lengths: at most
`capacity` numbers, whatever the size of the corpus. The driver plans on it, and the plan says for each length
which ranks go into which kind of sequence. Ranks are dealt to pieces in parallel.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from navloom.llm.texts import Remembered, as_texts, groups, rows_pass
from navloom.session import cut_lineage

#: pieces in a block, in which ranks are counted
BLOCK_ROWS = 20_000
END_SIGNS = tuple(",.;:?!")


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of_word(memo: Remembered, lib, word: str) -> bytes:
    """A word's ids as little-endian unsigned 32-bit numbers.

    A sign after letters (also when lower-cased) is one pre-token and letters are lower-cased, so such words are put
    together from others. The letters a-z are one pre-token that stands for itself, so the model alone has their ids.
    All else is left to the library. The special strings are cased.
    """
    if "<|" not in word:
        if word[-1:] in END_SIGNS and word[:-1].isalpha() and word[:-1].lower().isalpha():
            return memo.one(word[:-1]) + memo.one(word[-1])
        if word.isascii():
            if (low := word.lower()) != word:
                return memo.one(low)
            if word.isalpha():
                return array("I", [token.id for token in lib.model.tokenize(word)]).tobytes()
    return array("I", lib.encode(word, add_special_tokens=False).ids).tobytes()


@lru_cache(1)
def word_ids(path: str) -> Remembered:
    lib = tokenizer(path)
    return Remembered(lambda memo, word: ids_of_word(memo, lib, word))


def ids_of(texts: list[str], known: Remembered) -> list[bytes]:
    """The ids of each text.

    The vocabulary file drops white space between words and no pre-token spans it, so a text's ids are those of its
    words in order; words are parted at spaces and line feeds.
    """
    parted = [t.replace("\n", " ").split(" ") for t in texts]
    ids = known.ready(parted)
    return [b"".join(map(ids.__getitem__, words)) for words in parted]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32; only longer documents are cut."""
    end = np.asarray([end_id], "<u4").tobytes()

    def per_batch(batch):
        keys, texts = batch["k"].to_pylist(), as_texts(batch["t"])
        for part_of in groups(texts):
            for i, ids in zip(keys[part_of], ids_of(texts[part_of], word_ids(path))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    yield i, piece, at // 4, len(part) // 4, zlib.crc32(part)

    return rows_pass(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), per_batch,
                     "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Plan:
    """Kinds of sequences: `kinds[i]` is (lengths in order, how many sequences)."""

    capacity: int
    kinds: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.kinds.append((lengths, times))

    def slots(self) -> tuple[np.ndarray, ...]:
        """Per slot of a kind: length, first rank, first sequence, offset; ordered by length and rank."""
        rows, used, sequence = [], {}, 0
        for lengths, times in self.kinds:
            offset = 0
            for length in lengths:
                first = used.get(length, 0)
                rows.append((length, first, sequence, offset))
                used[length] = first + times
                offset += length
            sequence += times
        rows.sort()
        return tuple(np.asarray(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros((4, 0), np.int64))


def reduce_by_dominance(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Fixes sets of one or two lengths that dominate every other set with the longer one in it.

    {j} where nothing else fits; {j, k} with j + k the capacity; {j, k} with k the longest that fits, where no two
    others fit beside j, or where two but never three do and k is at least as long as any two. Whatever else could
    stand beside j can change places with k, so some best packing holds the fixed sets, and they leave the instance.
    """
    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1  # the copy in hand
            fit = np.flatnonzero(counts[:room + 1])
            counts[j] += 1
            if not len(fit):
                plan.add((j,), int(counts[j]))
                counts[j] = 0
                break
            k = int(fit[-1])
            if k != room and not pair_dominates(counts, fit, room, j, k):
                break
            if k == j:
                plan.add((j, j), int(counts[j] // 2))
                counts[j] %= 2
            else:
                times = int(min(counts[j], counts[k]))
                plan.add((j, k), times)
                counts[j] -= times
                counts[k] -= times


def pair_dominates(counts: np.ndarray, fit: np.ndarray, room: int, j: int, k: int) -> bool:
    """Whether every two or more others that fit into the room together are no longer than k."""
    left = {int(a): int(counts[a] - (a == j)) for a in fit}
    shortest = [a for a in fit[:3] for _ in range(min(3, left[int(a)]))][:3]
    if len(shortest) < 2 or shortest[0] + shortest[1] > room:
        return True
    if len(shortest) > 2 and sum(shortest) <= room:
        return False
    best, low, high = 0, 0, len(fit) - 1
    while low <= high:
        a, b = int(fit[low]), int(fit[high])
        if a + b > room or (low == high and left[a] < 2):
            high -= 1
        else:
            best, low = max(best, a + b), low + 1
    return best <= k


def best_fit(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Best-fit decreasing on the histogram: open kinds are kept by the room they have left."""
    open_kinds: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for j in range(capacity, 0, -1):
        n = int(counts[j])
        counts[j] = 0
        while n:
            room = min((r for r in open_kinds if r >= j), default=0)
            if not room:
                each = capacity // j
                full, rest = divmod(n, each)
                for lengths, times in (((j,) * each, full), ((j,) * rest, int(rest > 0))):
                    if times:
                        open_kinds.setdefault(capacity - j * len(lengths), []).append((lengths, times))
                break
            lengths, times = open_kinds[room].pop()
            each = room // j
            full, rest = divmod(n, each)
            here = min(full, times)
            placed = [(each, here)]
            if here < times and rest and full == here:
                placed.append((rest, 1))
            taken = sum(t for _, t in placed)
            for k, t in placed:
                if t:
                    open_kinds.setdefault(room - k * j, []).append((lengths + (j,) * k, t))
                    n -= k * t
            if times > taken:
                open_kinds.setdefault(room, []).append((lengths, times - taken))
            if not open_kinds.get(room):
                open_kinds.pop(room, None)
    for kinds in open_kinds.values():
        for lengths, times in kinds:
            plan.add(lengths, times)


def planned(histogram: dict[int, int], capacity: int) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = Plan(capacity)
    reduce_by_dominance(counts, capacity, plan)
    best_fit(counts, capacity, plan)
    return plan


def placed(made: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    A piece's rank within its length is its rank within a block of ids plus the pieces of that length in blocks
    before; the block totals are added up per length, so no length is gathered into one task.
    """
    sc = made.sparkSession.sparkContext
    blocks = max(64, made.count() // BLOCK_ROWS)
    blocked = made.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    sizes = cut_lineage(blocked.groupBy("length", "block").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sc.broadcast(planned(histogram, capacity).slots())
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    ranked = blocked.withColumn("r", F.row_number().over(inside) - 1).join(sizes, ["length", "block"])

    def per_batch(batch):
        lengths, firsts, sequences, offsets = slots.value
        length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(lengths * (1 << 40) + firsts, length * (1 << 40) + rank, "right") - 1
        sequence = sequences[at] + rank - firsts[at]
        columns = [batch[c].to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield from zip(*columns, sequence.tolist(), offsets[at].tolist())

    return rows_pass(ranked.withColumn("rank", F.col("r") + F.col("before")), per_batch,
                     "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                     "sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end_id`; those longer than `capacity` are cut into pieces of it, and pieces
    are packed into as few sequences as the dominance reduction and best fit can. Null and empty texts are one
    piece of length 1. Repeated rows are packed as often as they stand; equal lengths are placed in an arbitrary
    but gapless order. An empty table gives no rows; only the key and text are read.
    """
    return placed(cut_lineage(pieces(docs, path, capacity, end_id, text, key)), capacity)
