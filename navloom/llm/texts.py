"""Small helpers the text operators share: Arrow passes, words, hashes, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: entries and characters a generation of a worker's cache may hold; a bound on memory, never on results
CACHE_ENTRIES, CACHE_CHARS = 500_000, 8_000_000
#: texts that are looked up at once, and their characters
TEXTS_AT_ONCE, CHARS_AT_ONCE = 200, 2_000_000
#: rows a pass takes up and hands back at once
IN_ROWS, OUT_ROWS = 1_000, 2_000
#: odd multiplier of the shingle polynomial
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_pass(df: DataFrame, per_batch: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """One Arrow pass: `per_batch` gets some rows of a batch as arrays by column and yields rows of `schema`.

    Rows go in and back in small parts, so that a worker holds one incoming batch and a few rows.
    """
    names = [field.split()[0] for field in schema.split(", ")]
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, IN_ROWS):
                some = batch.slice(at, IN_ROWS)
                rows = per_batch({n: some.column(n) for n in some.schema.names})
                while part := list(islice(rows, OUT_ROWS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], names=names)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def groups(texts: list, chars: int = CHARS_AT_ONCE) -> Iterator[slice]:
    """Runs of texts of bounded number and size; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= TEXTS_AT_ONCE or size + len(t) > chars):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


class Remembered:
    """Values by key, kept by a worker from task to task in two generations that bound its memory.

    What is asked for again outlives the next change of generations. `known` is asked first, `make(self, key)` last.
    """

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        self.make, self.entries = make, entries
        self.known, self.held, self.old = {}, {}, {}
        self.chars = 0

    def one(self, key):
        value = self.held.get(key)
        if value is None:
            value = self.known.get(key)
            if value is None:
                value = self.old.get(key)
            if value is None:
                value = self.make(self, key)
            self.held[key] = value
            self.chars += len(key)
        return value

    def ready(self, parts: list[list]) -> dict:
        """The table of values, with every key of the parts in it."""
        if len(self.held) >= self.entries or self.chars >= CACHE_CHARS:
            self.held, self.old = {}, self.held if self.chars < 2 * CACHE_CHARS else {}
            self.chars = 0
        for key in set().union(*parts).difference(self.held):
            self.one(key)
        return self.held


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every worker."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words(text: bytes) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` with A-Z lower-cased; bytes.split knows exactly these six characters."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than `size` make one shingle of all of them."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * ODD + hashes[i:n - width + 1 + i]
    return np.unique(mixed(total))


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, column: str, bound: int) -> DataFrame:
    """About `bound` rows by a hash of `column`, the same rows on each run; all rows when there are fewer."""
    n = df.count()
    share = min(1.0, bound / max(n, 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(column), F.lit(1_000_000)) < int(share * 1_000_000))
