"""Language proportions by expectation-maximisation over character n-gram likelihoods."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from navloom.llm.texts import as_texts, id_fold, rows_pass

#: hashed n-grams, documents per language the model is fitted on, rounds of estimation
BUCKETS, SAMPLE, ROUNDS = 1 << 16, 1_500, 12
#: the price of a further language, in units of half the logarithm of the number of n-grams
PENALTY = 2.0


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct hashed n-grams, counts, letters) of a text: runs of three characters, others than letters being
    one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[points]
    n = int(letter.sum())
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, points, 32)[keep].astype(np.uint32)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), 0
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    found, counts = np.unique(h >> np.uint32(16), return_counts=True)
    return found.astype(np.int64), counts.astype(float), n


@dataclass
class Languages:
    names: list[str]
    #: log likelihood of each n-gram in each language
    logs: np.ndarray

    def mixture(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages of the chosen set; 0 for the others.

        Proportions are estimated over all languages, then over the first one, two, ... of them by share; the set
        with the best likelihood less PENALTY * log(n) / 2 for each language is chosen.
        """
        like = self.logs[:, found]
        top = like.max(axis=0)
        like, total = np.exp(like - top), counts.sum()

        def estimate(share, rows, rounds):
            for _ in range(rounds):
                share = share * (rows @ (counts / (share @ rows))) / total
            return share

        share = estimate(np.full(len(like), 1 / len(like)), like, ROUNDS)
        order = np.argsort(-share, kind="stable")
        best, chosen = -np.inf, share
        for size in range(1, len(order) + 1):
            part = order[:size]
            p = np.maximum(share[part], 1e-9)
            p = estimate(p / p.sum(), like[part], 5 if size > 1 else 0)
            value = counts @ np.log(p @ like[part]) - PENALTY * 0.5 * size * np.log(total)
            if value <= best:
                break
            best, chosen = value, np.zeros(len(like))
            chosen[part] = p
        return chosen


def trained(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE, folds: int = 4, held_fold: int = 2,
            text: str = "text", key: str = "doc_id") -> Languages:
    """N-gram likelihoods from about `sample` documents of each language outside the held-out fold."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        F.col("l").isNotNull() & F.col("t").isNotNull() & (id_fold("k", folds) != held_fold))
    # one number for each language, so a map of literals and no join that would move the texts
    share = {r["l"]: min(1.0, sample / r["count"]) for r in known.groupBy("l").count().collect()}
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < 1_000_000 * F.element_at(
        F.create_map(*(F.lit(x) for pair in share.items() for x in pair)), F.col("l"))) if share else known

    def per_batch(batch):
        counts: dict[str, np.ndarray] = {}
        for name, t in zip(batch["l"].to_pylist(), batch["t"].to_pylist()):
            found, n, _ = ngrams(t)
            if name not in counts:
                counts[name] = np.zeros(BUCKETS)
            counts[name][found] += n
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield name, at.astype("<i4").tobytes(), c[at].astype("<i8").tobytes()

    parts = rows_pass(picked.select("l", "t"), per_batch, "l string, at binary, n binary")
    pairs = parts.select("l", "at", "n").mapInArrow(unpacked, "l string, at int, n bigint")
    rows = pairs.groupBy("l", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["l"].to_pylist()))
    counts = np.full((len(names), BUCKETS), 0.1)
    place = {name: i for i, name in enumerate(names)}
    counts[[place[x] for x in rows["l"].to_pylist()], rows["at"].to_numpy()] += rows["n"].to_numpy()
    return Languages(names, np.log(counts / counts.sum(axis=1, keepdims=True)))


def unpacked(batches):
    import pyarrow as pa

    for batch in batches:
        for name, at, n in zip(*(batch[c].to_pylist() for c in ("l", "at", "n"))):
            at = np.frombuffer(at, "<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at), pa.array(np.frombuffer(n, "<i8"))], names=["l", "at", "n"])


def languages(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE, folds: int = 4, held_fold: int = 2,
              text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and the chosen set as langs.

    lang_pred has the largest proportion in the whole text, score is that proportion; ties go to the name that
    sorts first. Texts that are null or without letters are `und` with score 0, as is every text when nothing was
    learned. Repeated rows repeat; an empty table gives no rows; ids, languages and sources are no inputs.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, lang, sample, folds, held_fold, text, key))

    def per_batch(batch):
        names = model.value.names
        for i, out, t in zip(batch["k"].to_pylist(), batch["h"].to_pylist(), as_texts(batch["t"])):
            found, counts, n = ngrams(t)
            if not n or not names:
                yield i, out, "und", 0.0, []
                continue
            share = model.value.mixture(found, counts)
            best = int(share.argmax())
            yield i, out, names[best], float(min(share[best], 1.0)), [names[j] for j in np.flatnonzero(share)]

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"),
                         F.coalesce(id_fold(key, folds) == held_fold, F.lit(False)).alias("h"))
    return rows_pass(source, per_batch,
                     "doc_id bigint, held_out boolean, lang_pred string, score double, langs array<string>")
