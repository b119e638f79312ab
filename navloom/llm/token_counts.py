"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import heapq
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from navloom.llm.texts import Remembered, as_bytes, bounded_sample, groups, rows_pass

#: pre-tokens of the byte-level vocabulary files: fixed by their format
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: documents looked at to find frequent pre-tokens, and the most that a task or the table names; the table only
#: saves work, results don't depend on it
LOOKED_AT, NAMED = 4_000, 20_000


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def pre_tokens(pattern: str):
    import regex

    return regex.compile(pattern).findall


def encoded_lengths(path: str, pieces: list[str]) -> list[int]:
    return [len(tokenizer(path).encode(p, add_special_tokens=False).ids) for p in pieces]


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Token lengths of pre-tokens that are frequent in about LOOKED_AT documents, at most NAMED of them.

    Each task names its most frequent ones with their lengths; the driver sees bounded lists.
    """

    def per_batch(batch):
        counts = Counter()
        for t in batch["t"].to_pylist():
            counts.update(pre_tokens(PRE_TOKEN)(t or ""))
        top = heapq.nlargest(NAMED, counts.items(), key=lambda x: (x[1], x[0]))
        for (piece, n), length in zip(top, encoded_lengths(path, [p for p, _ in top])):
            yield piece, n, length

    looked = bounded_sample(docs.select("k", "t"), "k", LOOKED_AT).select("t")
    named = rows_pass(looked, per_batch, "piece string, n bigint, length int")
    top = named.groupBy("piece").agg(F.sum("n").alias("n"), F.first("length").alias("length"))
    rows = top.orderBy(F.desc("n"), "piece").limit(NAMED).toArrow()
    return dict(zip(rows["piece"].to_pylist(), rows["length"].to_pylist()))


@lru_cache(1)
def lengths_of(path: str) -> Remembered:
    """Second tier: lengths of the other pre-tokens, encoded once and kept by the worker from task to task."""
    lib = tokenizer(path)
    return Remembered(lambda _, piece: len(lib.encode(piece, add_special_tokens=False).ids))


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts equal the tokenizers library's for a byte-level vocabulary file at `path`, whole texts, without added
    special tokens; special strings in a text are one token, as is the library's default. Null and empty texts
    have no bytes and no tokens. Rows are counted one by one, so repeated rows repeat; an empty table gives no
    rows; only the key and text are read, so other columns can't clash.

    Pre-tokens never leave their task: a broadcast table of frequent ones answers first, the worker's cache of
    encoded pre-tokens second.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    frequent = source.sparkSession.sparkContext.broadcast(frequent_lengths(source, path))

    def per_batch(batch):
        known = lengths_of(path)
        known.known = frequent.value
        find = pre_tokens(PRE_TOKEN)
        keys, texts = batch["k"].to_pylist(), as_bytes(batch["t"])
        for run in groups(texts):
            parted = [data.decode().split(SPECIAL) for data in texts[run]]
            found = [[piece for part in parts for piece in find(part)] for parts in parted]
            lengths = known.ready(found).__getitem__
            for i, data, parts, pieces in zip(keys[run], texts[run], parted, found):
                n = len(parts) - 1 + sum(map(lengths, pieces))
                yield i, len(data), n, n > limit

    return rows_pass(source, per_batch, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
