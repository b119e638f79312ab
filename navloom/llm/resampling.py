"""Importance resampling of documents towards the word distribution of a target table.

Word runs are hashed into buckets. A bucket's gain is the logarithm of its share in the target over its share in the
corpus; a document weighs the sum of its gains, and the documents with the highest weight plus Gumbel noise are drawn.
Both passes over the texts intern the runs of a block in an open-addressed NumPy table: a run's bucket is worked out
once a block, counts are kept by slot, and occurrences gather gains through their slot ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from navloom.llm.texts import as_bytes, groups, rows_pass
from navloom.session import cut_lineage

#: occurrences interned at once; bounds the table, never the result
BLOCK = 1 << 18
#: words are runs of digits, letters and non-ASCII bytes; A-Z are lower-cased, all else parts words
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Features:
    """The runs of 1 to `longest` words of some texts, as places in one buffer; `doc` is the text of each."""

    def __init__(self, texts: list[bytes], longest: int):
        parted = [t.translate(WORDS).split() for t in texts]
        words = [w for part in parted for w in part]
        self.n_words = np.fromiter(map(len, parted), np.int64, len(parted))
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, doc = np.cumsum(size + 1) - size - 1, np.repeat(np.arange(len(texts)), self.n_words)
        self.data = b" ".join(words)
        starts, sizes, docs = [start], [size], [doc]
        for n in range(2, longest + 1):
            first = np.flatnonzero(doc[n - 1:] == doc[:max(0, len(doc) - n + 1)])
            last = first + n - 1
            starts.append(start[first])
            sizes.append(start[last] + size[last] - start[first])
            docs.append(doc[first])
        self.start, self.size, self.doc = (np.concatenate(x) for x in (starts, sizes, docs))
        # eight bytes from each place on; the last ones read zeros
        self.lanes = np.ndarray(len(self.data) + 1, "<u8", self.data + bytes(16), strides=(1,))

    def __len__(self) -> int:
        return len(self.start)

    def piece(self, i: int) -> bytes:
        return self.data[self.start[i]:self.start[i] + self.size[i]]

    def keys(self, block: slice) -> np.ndarray:
        at = zip(self.start[block].tolist(), (self.start[block] + self.size[block]).tolist())
        return np.fromiter((xxhash.xxh64_intdigest(self.data[a:b]) for a, b in at), np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the features a[i] and b[i] have the same bytes."""
        equal = self.size[a] == self.size[b]
        at, live = 0, np.flatnonzero(equal)
        while len(live):
            left = np.minimum(self.size[a[live]] - at, 8)
            shift = ((8 - left) * 8).astype(np.uint64)
            x, y = (self.lanes[self.start[s[live]] + at] << shift for s in (a, b))
            equal[live[x != y]] = False
            at += 8
            live = live[(x == y) & (self.size[a[live]] > at)]
        return equal


class Interned:
    """An open-addressed table of the distinct features of a block.

    Keys are xxhash64; a slot that holds another feature's key or bytes is passed by for the next one. Per slot:
    `owner` (the feature that stands for it), `bucket` and `count`; `slot` is the slot of each occurrence.
    """

    def __init__(self, features: Features, block: slice, buckets: int):
        keys = features.keys(block)
        mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.owner = np.full(mask + 1, -1, np.int64)
        self.slot = (keys & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = self.slot[open_]
            free = self.owner[at] < 0
            self.owner[at[free]] = open_[free]
            held = self.owner[at]
            settled = keys[held] == keys[open_]
            settled[settled] = features.same(held[settled] + block.start, open_[settled] + block.start)
            open_ = open_[~settled]
            self.slot[open_] = (self.slot[open_] + 1) & mask
        self.count = np.bincount(self.slot, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        used = np.flatnonzero(self.owner >= 0)
        self.bucket[used] = [zlib.crc32(features.piece(i)) % buckets for i in (self.owner[used] + block.start).tolist()]


def interned(features: Features, buckets: int) -> Iterator[tuple[slice, Interned]]:
    for at in range(0, len(features), BLOCK):
        block = slice(at, min(at + BLOCK, len(features)))
        yield block, Interned(features, block, buckets)


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends at most `buckets` numbers."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data = as_bytes(batch["t"])
            for part in groups(data):
                for _, held in interned(Features(data[part], longest), buckets):
                    total += np.bincount(held.bucket, held.count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    rows = texts.select(F.col(text).alias("t")).mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["b"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed corpus share)) of each bucket."""
    total, wanted, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.asarray([
        math.floor(1000 * math.log(float((t + 1) * (total + n)) / float((s + 1) * (wanted + n))))
        for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int, text: str, key: str) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def per_batch(batch):
        by_bucket = held.value
        keys, data = batch["k"].to_pylist(), as_bytes(batch["t"])
        for part in groups(data):
            features = Features(data[part], longest)
            n = len(features.n_words)
            weight = np.zeros(n, np.int64)
            for block, table in interned(features, len(by_bucket)):
                gathered = by_bucket[table.bucket][table.slot]
                weight += np.bincount(features.doc[block], gathered, n).astype(np.int64)
            counts = np.bincount(features.doc, minlength=n)
            yield from zip(keys[part], features.n_words.tolist(), counts.tolist(), weight.tolist())

    return rows_pass(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), per_batch,
                     "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: str, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256(`seed:id`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, first: int) -> DataFrame:
    """Adds `rank` (1, 2, 3...) by falling score, then id; null past `first`.

    Rows are dealt by ranges of the order and numbered inside their range, after the sizes of the ranges before.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(sizes, "_part").withColumn(
        "rank", F.when(rank <= first, rank)).drop("_place", "_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, percent: int = 10,
              least_words: int = 20, seed: int = 2024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; features are all runs of 1 to
    `longest` words. Of the documents with `least_words` words, the `percent` hundredth with the highest scores is
    drawn, ties to the smaller id. Null and empty texts have no words, weigh 0 and aren't drawn unless `least_words`
    is 0. Repeated rows count and are drawn one by one; rows without an id share one noise and come last among ties.
    An empty table gives no rows, an empty target leaves only the smoothing; only the key and text are read.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    rows = cut_lineage(weighed(docs, gain, longest, text, key).withColumn(
        "score", F.col("weight") + gumbel("doc_id", seed)))
    able = F.col("n_words") >= least_words
    first = rows.where(able).count() * percent // 100
    drawn = ranked(rows.where(able), first)
    return drawn.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint"))).select(
        "doc_id", "n_features", "weight", "score", "rank")
