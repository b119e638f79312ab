"""Alignment of the tokens that two tokenizers make of the same text.

Places where tokens of both end cut a text into groups, and every token of one tokenizer in a group is linked with
every one of the other. Most groups are one token on either side with the same bytes: a table of A ids to B ids with
these bytes names them, and they are counted in vectors of vocabulary length. Only pairs of irregular groups are
shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navloom.llm.texts import as_texts, groups, rows_pass
from navloom.llm.token_counts import PRE_TOKEN
from navloom.session import cut_lineage

#: frequent pairs whose counts are broadcast, at most
FREQUENT = 1 << 17
#: pairs that are written out at once, and those a task holds before it lets their counts go
AT_ONCE, HELD = 1 << 20, 1 << 20
#: characters of texts that are aligned together, and of a part of a text that is encoded at once
RUN_CHARS, PART = 500_000, 200_000
META = "▁"
START = re.compile("[^ ](?= +[^ ])")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their entries, and the B id of the same bytes for every A id (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code = byte_of_char()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(code[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(META, " ").encode()
                        for i, p in enumerate(pieces)]
        named = {self.bytes_b[i]: i for i in sorted(range(len(pieces)), key=self.b.is_byte, reverse=True)
                   if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))}
        self.same = np.asarray([named.get(x, -1) for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.asarray(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = (list(map(str, range(len(x)))) for x in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}|{b}" for i, b in enumerate(self.same.tolist())]
        # where no piece has a space after something else, no merge spans the start of a run of spaces
        self.parts = not any(re.search(f"[^{META}]{META}", p) for p in pieces)
        self.ranked = ranked_encoding(path_a, code)

    def ids_a(self, text: str) -> np.ndarray:
        """The ids of a whole text; none where they don't spell it."""
        ids = self.ranked.encode_ordinary(text) if self.ranked else self.a.encode(text, add_special_tokens=False).ids
        same = b"".join([self.bytes_a[i] for i in ids]) == text.encode()
        return np.asarray(ids if same else [], np.uint32)

    def ids_b(self, text: str) -> np.ndarray:
        """The same by the other library, which adds the first space itself."""
        ids = [i for part in self.parted(text) for i in self.b.encode(part[1:], num_threads=1)]
        same = b"".join([self.bytes_b[i] for i in ids]) == text.encode()
        return np.asarray(ids if same else [], np.uint32)

    def parted(self, text: str) -> Iterator[str]:
        """Parts of about PART characters that start with a space after something else and aren't spaces only."""
        at = 0
        while self.parts and len(text) - at > PART and (m := START.search(text, at + PART)):
            yield text[at:m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text after a space, by both; none of either where one of them doesn't spell the text."""
        none = np.zeros(0, np.uint32)
        for t in texts:
            b = self.ids_b(" " + t) if t else none
            a = self.ids_a(" " + t) if len(b) else none
            yield (a, b) if len(a) else (none, none)


def ranked_encoding(path: str, code: dict[str, int]):
    """The same vocabulary for the faster library that merges by rank, where the file allows it, else None.

    Ids must rise with the order of the merges, and texts must be parted by the byte-level pattern and nothing else.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    model, before = stated["model"], stated.get("pre_tokenizer") or {}
    merged = [model["vocab"][a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model.get("merges", []))]
    plain = (model.get("type") == "BPE" and merged == sorted(merged) and not stated.get("normalizer") and not model.get("dropout")
             and not model.get("ignore_merges") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before.get("add_prefix_space"))
    if not plain:
        return None
    special = {t["content"] for t in stated.get("added_tokens", [])}
    ranks = {bytes(code[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def spelled(unit: str, ids: list[int], entries: list[bytes]) -> bytes:
    """The ids of a unit whose entries spell it, else NONE, as unsigned 32-bit numbers."""
    return array("I", ids if b"".join([entries[i] for i in ids]) == unit.encode() else [NONE]).tobytes()


@lru_cache(1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def crossed(a: np.ndarray, b: np.ndarray, doc: np.ndarray, na, nb, fa, fb, width: int) -> tuple[np.ndarray, ...]:
    """(doc, key, n) of all token pairs of groups: a group has na tokens of `a` from place fa and nb of `b` from fb.

    Keys are A id * width + B id. Groups are crossed in runs of bounded size; a group too large for one is crossed by
    its distinct ids.
    """
    found = []
    total = na * nb
    for g in np.flatnonzero(total > AT_ONCE).tolist():
        ids, times = np.unique(a[fa[g]:fa[g] + na[g]], return_counts=True)
        others, each = np.unique(b[fb[g]:fb[g] + nb[g]], return_counts=True)
        keys = (ids[:, None] * width + others).ravel()
        found.append((np.full(len(keys), doc[g]), keys, (times[:, None] * each).ravel()))
    small = np.flatnonzero(total <= AT_ONCE)
    run = np.cumsum(total[small]) // AT_ONCE
    for part in np.split(small, np.flatnonzero(np.diff(run)) + 1) if len(small) else []:
        n = total[part]
        g = np.repeat(part, n)
        at = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        keys = a[fa[g] + at // nb[g]] * width + b[fb[g] + at % nb[g]]
        found.append(counted(doc[g], keys, np.ones(len(g), np.int64)))
    return counted(*map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def counted(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums n of equal (doc, key), in their order."""
    if len(key) and (width := int(key.max()) + 1) < 2**62 // (int(doc.max()) + 1):
        both, at, times = np.unique(doc * width + key, return_inverse=True, return_counts=True)
        sums = times if (n == 1).all() else np.bincount(at, n, len(both)).astype(np.int64)
        return both // width, both % width, sums
    order = np.lexsort((key, doc))
    doc, key, n = doc[order], key[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return doc[first], key[first], np.add.reduceat(n, first) if len(first) else n


def run_rows(p: Pair, texts: list[str]) -> Iterator[tuple]:
    """The numbers, digest and pairs of each text, worked out for all of them together."""
    made = list(p.encoded(texts))
    sizes_a, sizes_b = (np.asarray([len(m[i]) for m in made]) for i in (0, 1))
    a, b = (np.concatenate([m[i] for m in made]).astype(np.int64) for i in (0, 1))
    # all texts in a row: each one ends where a token of both does
    ends_a, ends_b = np.cumsum(p.size_a[a]), np.cumsum(p.size_b[b])
    at = np.searchsorted(ends_b, ends_a)
    last_a = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == ends_a) if len(b) else at
    last_b = at[last_a]
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    fa, fb = last_a - na + 1, last_b - nb + 1
    doc = np.searchsorted(np.cumsum(sizes_a), last_a, "right")
    regular = (na == 1) & (nb == 1) & (p.same[a[last_a]] == b[last_b])
    odd = np.flatnonzero(~regular)

    names = list(map(p.names.__getitem__, a[last_a].tolist()))
    left, right, name_a, name_b = a.tolist(), b.tolist(), p.names_a, p.names_b
    for g, i, m, j, n in zip(odd.tolist(), *(x[odd].tolist() for x in (fa, na, fb, nb))):
        names[g] = ",".join([name_a[x] for x in left[i:i + m]]) + "|" + ",".join([name_b[x] for x in right[j:j + n]])

    width = len(p.bytes_b)
    od, ok, on = crossed(a, b, doc[odd], na[odd], nb[odd], fa[odd], fb[odd], width)
    alike = p.same[ok // width] == ok % width  # a pair of the same bytes that an irregular group links
    plain = a[last_a[regular]]
    sd, sk, sn = counted(np.concatenate([doc[regular], od[alike]]), np.concatenate([plain, ok[alike] // width]),
                         np.concatenate([np.ones(len(plain), np.int64), on[alike]]))
    od, ok, on = od[~alike], ok[~alike], on[~alike]
    links = np.bincount(doc, na * nb, len(texts)).astype(np.int64)
    each = np.arange(len(texts) + 1)
    gs, ss, os_ = (np.searchsorted(x, each).tolist() for x in (doc, sd, od))
    for i in range(len(texts)):
        g, s, o = (slice(x[i], x[i + 1]) for x in (gs, ss, os_))
        digest = hashlib.sha256(";".join(names[g]).encode()).hexdigest() if sizes_a[i] else ""
        yield (int(sizes_a[i]), int(sizes_b[i]), g.stop - g.start, int(links[i]), digest,
               sk[s].astype("<u4").tobytes(), sn[s].astype("<u4").tobytes(),
               ok[o].astype("<i8").tobytes(), on[o].astype("<u4").tobytes())


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str, key: str) -> DataFrame:
    """Per row: its numbers and digest, the A ids it links with the B id of the same bytes (`same`, with their links)
    and its other pairs (`other`, as A id * B's vocabulary + B id, with their links)."""

    def per_batch(batch):
        p = pair_of(path_a, path_b)
        rows, keys, texts = batch["row"].to_pylist(), batch["k"].to_pylist(), as_texts(batch["t"])
        for part in groups(texts, RUN_CHARS):
            yield from ((r, k, *x) for r, k, x in zip(rows[part], keys[part], run_rows(p, texts[part])))

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    return rows_pass(source, per_batch, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, "
                     "n_links bigint, groups_sha256 string, same binary, same_n binary, other binary, other_n binary")


def joined(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows in a row, and where each row's end."""
    data = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(data), dtype).astype(np.int64), np.cumsum([len(x) // size for x in data])


def pair_counts(rows: DataFrame, vocabulary: int) -> DataFrame:
    """(same, key, n): in how many documents each pair is linked.

    A task adds up pairs of the same bytes in one vector and sends at most `vocabulary` numbers; the other pairs are
    added up in runs and shuffled.
    """

    def run(batches):
        vector = np.zeros(vocabulary, np.int64)
        keys, counts = [], []

        def summed():
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(every), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return every, n

        for batch in batches:
            vector += np.bincount(joined(batch.column("same"), "<u4")[0], minlength=vocabulary)
            other, n = np.unique(joined(batch.column("other"), "<i8")[0], return_counts=True)
            keys.append(other)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                every, n = summed()
                keys, counts = [every], [n]
                if len(every) > HELD // 2:
                    yield sent(False, every, n)
                    keys, counts = [], []
        if keys:
            yield sent(False, *summed())
        at = np.flatnonzero(vector)
        yield sent(True, at, vector[at])

    def sent(same: bool, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), same)), pa.array(key), pa.array(n)], names=["same", "key", "n"])

    return rows.select("same", "other").mapInArrow(run, "same boolean, key bigint, n bigint").groupBy(
        "same", "key").agg(F.sum("n").alias("n"))


def vector_of(rows: DataFrame, size: int) -> np.ndarray:
    """A table (a, n) with at most one row for each of `size` ids, as a vector."""
    out, table = np.zeros(size, np.int64), rows.toArrow()
    out[table["a"].to_numpy()] = table["n"].to_numpy()
    return out


def least_frequent(pairs: DataFrame) -> int:
    """The smallest power of two that at most FREQUENT pairs' counts reach."""
    by_size = {r["e"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(
        F.count("*").alias("c")).collect()}
    e, held = 63, 0
    while e > 0 and held + by_size.get(e - 1, 0) <= FREQUENT:
        e -= 1
        held += by_size.get(e, 0)
    return 1 << e


def alignment(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary of the tokenizers library, applied to a space and the text, B a sentencepiece model
    that adds the space itself; special strings are plain text. A pair's count is the number of documents that hold it
    linked; n_best counts the links whose count is the highest of their A id, count_sum adds up all links' counts.
    Null and empty texts and those that the tokens of A or B don't spell have zeros and no digest. Repeated rows are
    documents of their own; an empty table gives no rows; only the key and text are read.

    Texts are encoded once. Counts of pairs of the same bytes and of at most FREQUENT others are broadcast; what is
    joined on the pair are the rest, each of which few documents hold, so no key of that join is hot.
    """
    sc = docs.sparkSession.sparkContext
    p = pair_of(path_a, path_b)
    size, width = len(p.bytes_a), len(p.bytes_b)
    rows = cut_lineage(aligned(docs, path_a, path_b, text, key))
    pairs = cut_lineage(pair_counts(rows, size))
    others = pairs.where(~F.col("same"))
    a = F.when(F.col("same"), F.col("key")).otherwise(F.floor(F.col("key") / width)).cast("int")
    counts = vector_of(pairs.where("same").select(F.col("key").alias("a"), "n"), size)
    best = vector_of(pairs.groupBy(a.alias("a")).agg(F.max("n").alias("n")), size)
    least = least_frequent(others)
    table = others.where(F.col("n") >= least).select("key", "n").toArrow().sort_by("key")
    held = sc.broadcast((counts, best, table["key"].to_numpy(), table["n"].to_numpy()))

    def per_batch(batch):
        counts, best, keys, times = held.value
        same, same_end = joined(batch["same"], "<u4")
        other, other_end = joined(batch["other"], "<i8")
        same_n, other_n = joined(batch["same_n"], "<u4")[0], joined(batch["other_n"], "<u4")[0]
        at = np.minimum(np.searchsorted(keys, other), max(len(keys) - 1, 0))
        known = keys[at] == other if len(keys) else np.zeros(len(other), bool)
        n = np.zeros(len(other), np.int64)
        n[known] = times[at[known]]
        upto = lambda x, end: np.diff(np.concatenate([[0], np.cumsum(x)])[end], prepend=0)
        sums = upto(counts[same] * same_n, same_end) + upto(n * other_n, other_end)
        tops = upto(same_n * (counts[same] == best[same]), same_end) + upto(
            other_n * (known & (n == best[other // width])), other_end)
        rest = np.flatnonzero(~known)
        bounds = np.searchsorted(rest, np.concatenate([[0], other_end])).tolist()
        rk, rn, rb = other[rest].tolist(), other_n[rest].tolist(), best[other[rest] // width].tolist()
        given = [batch[c].to_pylist() for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        for i, (*plain, s, t) in enumerate(zip(*given, sums.tolist(), tops.tolist())):
            part = slice(bounds[i], bounds[i + 1])
            yield (*plain, t, s, [{"key": k, "links": m, "best": x} for k, m, x in zip(rk[part], rn[part], rb[part])])

    out = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "n_best bigint, count_sum bigint")
    scored = cut_lineage(rows_pass(
        rows, per_batch, f"row bigint, {out}, rest array<struct<key:bigint,links:bigint,best:bigint>>"))
    if least > 1:
        links = scored.select("row", F.inline("rest")).join(others.where(F.col("n") < least).select("key", "n"), "key")
        more = links.groupBy("row").agg(
            F.sum(F.col("n") * F.col("links")).alias("_sum"),
            F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("_best"))
        scored = scored.drop("rest").join(more, "row", "left").withColumn(
            "n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
