"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from navloom.llm.texts import as_bytes, rows_pass
from navloom.session import cut_lineage

WHITE = b" \t\n\x0b\x0c\r"
#: chunk lengths in bytes: least, and the most before a forced cut
LEAST, MOST = 256, 8192
#: a cut where these bits of the rolling hash are zero: once in 1,024 bytes
CUT_BITS = np.uint32((1 << 10) - 1)
#: the rolling hash covers 16 bytes
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of `data`.

    Every place has a hash of the 16 bytes before it, built by doubling windows; a chunk ends at the
    first place past LEAST whose hash has zero CUT_BITS, at MOST bytes, or with the data.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint32(width)
    places = np.flatnonzero((h & CUT_BITS) == 0) + 1
    ends, start = [], 0
    while start < n:
        i = int(np.searchsorted(places, start + LEAST))
        end = min(int(places[i]) if i < len(places) else n, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: id, code points of the text, SHA-256 of its normalised form, and its chunks in order.

    A chunk is (h, proof): 64 bits that name it and the SHA-256 that verifies the name. Texts are
    read here once and not moved again.
    """

    def per_batch(batch):
        for i, data in zip(batch["k"].to_pylist(), as_bytes(batch["t"])):
            plain = data.translate(None, WHITE)
            chunks, start = [], 0
            for end in cut_points(plain):
                digest = hashlib.sha256(plain[start:end]).digest()
                chunks.append((int.from_bytes(digest[:8], "little", signed=True), digest[8:]))
                start = end
            whole = hashlib.sha256(plain).hexdigest() if len(chunks) != 1 else digest.hex()
            yield (i, n_points(data), whole,
                   [c[0] for c in chunks], b"".join(c[1] for c in chunks))

    return rows_pass(
        docs.select(F.col(key).alias("k"), F.col(text).alias("t")), per_batch,
        "doc_id bigint, points bigint, text_sha256 string, names array<bigint>, proofs binary")


def n_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def doubtful_names(made: DataFrame) -> DataFrame:
    """Names that stand for two different chunks: the proofs differ. Expected to be empty."""
    each = made.select(F.posexplode("names").alias("i", "h"), "proofs").select(
        "h", F.xxhash64(F.expr("substring(proofs, i * 24 + 1, 24)")).alias("a"))
    return each.groupBy("h").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("h")


def with_identifiers(made: DataFrame) -> DataFrame:
    """Adds `recipe`: the ordered verified identifiers.

    A chunk's identifier is its name where all chunks of that name have one proof, else name and proof.
    """
    doubtful = cut_lineage(doubtful_names(made))
    plain = F.transform("names", lambda h: h.cast("string"))
    if doubtful.isEmpty():
        return made.withColumn("recipe", F.col("names"))
    # rows that hold a doubtful name are found by an equi-join; their identifiers carry the proof throughout,
    # as do those of every row that could equal them, since equal recipes hold the same names
    held = made.select("doc_id", F.explode("names").alias("h")).join(doubtful, "h", "left_semi").select("doc_id")
    held = held.distinct().select(F.col("doc_id").alias("_id"), F.lit(True).alias("_held"))
    marked = made.join(held, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return marked.withColumn("recipe", F.when(
        F.col("_held"), F.concat(plain, F.array(F.hex("proofs")))).otherwise(plain)).drop("_held")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are after deleting the white space characters space and \\x09 to \\x0D. The row with
    the most code points, then the smallest id, stays; rows without an id only if their group has no others. Null is
    empty; all empty texts are one group (an empty recipe). Repeated rows count each in group_size and share the
    verdict of their id, as rows without an id do; an empty table gives no rows; other columns are not read, so their
    names can't clash.

    Ordered identifier lists are grouped, with partial aggregates before the shuffle, so a group with a third of
    all rows is a few partial rows per task; the way back is an equi-join that adaptive execution may split.
    """
    made = cut_lineage(recipes(docs, text, key))
    made = with_identifiers(made)
    groups = made.groupBy("recipe").agg(
        F.min(F.struct(F.col("doc_id").isNull(), (-F.col("points")).alias("p"), F.col("doc_id").alias("d"))).alias("first"),
        F.count("*").alias("group_size"))
    groups = cut_lineage(groups.where("group_size > 1").select(
        F.col("recipe"), F.col("first.d").alias("keep_id"), "group_size"))
    out = made.join(groups, "recipe", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256",
        F.size("names").alias("n_chunks"))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", "n_chunks")
