"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from navloom.llm.texts import IN_ROWS, as_bytes, bounded_sample, id_fold, rows_pass, word_hashes, words
from navloom.session import cut_lineage

#: hashed words, rank of the interactions, bins of a statistic
BUCKETS, RANK, BINS = 1 << 14, 8, 10
#: labelled rows the model is fitted on
SAMPLE = 6_000
#: ASCII characters by kind: upper case, lower case, digits, white space, sentence signs, other signs; 6 is the rest
KIND = np.full(256, 6, np.uint8)
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
                                b" \t\r\f\v", b".,;:'\"?-()", b"!#$%&*+/<=>@[\\]^_`{|}~", b"\n")):
    KIND[list(_chars)] = _kind if _kind < 6 else 7


def statistics(data: bytes, hashes: np.ndarray, counts: np.ndarray) -> list[float]:
    """Structure of a text: lengths, kinds of characters, repetition."""
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=8)
    n, n_words = max(len(data), 1), max(len(hashes), 1)
    repeated = float((hashes[1:] == hashes[:-1]).sum()) / n_words
    return [np.log1p(len(data)), np.log1p(len(hashes)), n / n_words, kinds[0] / max(kinds[0] + kinds[1], 1),
            kinds[2] / n, kinds[4] / n, kinds[5] / n, kinds[5] / n_words, kinds[7] / n, len(counts) / n_words,
            repeated, float(counts.max()) / n_words if len(counts) else 0.0, kinds[6] / n]


N_STATISTICS = 13


def sparse(data: bytes, extra: list) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words with weights of unit length, and the statistics with the metadata after them."""
    hashes = word_hashes(words(data))
    found, counts = np.unique(hashes, return_counts=True)
    weights = np.log1p(counts)
    weights /= max(float(np.sqrt((weights ** 2).sum())), 1e-9)
    metadata = [np.nan if x is None else float(np.log1p(max(x, 0))) for x in extra]
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64), weights, statistics(data, hashes, counts) + metadata


@dataclass
class Machine:
    """bias + linear part + half of (square of sums - sum of squares) over the interactions."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def indexed(self, idx, weights, stats) -> tuple[np.ndarray, np.ndarray]:
        """The full feature vector: words, then for each statistic its bin; a missing value has a bin of its own."""
        bins = [BUCKETS + i * (BINS + 1) + (BINS if np.isnan(s) else int(np.searchsorted(e, s, "right")))
                for i, (s, e) in enumerate(zip(stats, self.edges))]
        return np.concatenate([idx, bins]), np.concatenate([weights, np.ones(len(bins))])

    def score(self, idx, weights, stats) -> float:
        at, x = self.indexed(idx, weights, stats)
        v = self.factors[at] * x[:, None]
        z = self.bias + self.linear[at] @ x + 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fitted(examples: list[tuple], labels: np.ndarray, steps: int = 600, rate: float = 0.1, shrink: float = 1e-5,
           batch: int = 64, seed: int = 6) -> Machine:
    """Mini-batch Adagrad on the logistic loss; with no examples the machine scores 1/2."""
    rng = np.random.default_rng(seed)
    n_stats = len(examples[0][2]) if examples else N_STATISTICS
    values = np.array([e[2] for e in examples]).reshape(-1, n_stats)
    edges = np.array([np.nanquantile(c, np.linspace(0, 1, BINS + 1)[1:-1]) if np.isfinite(c).any()
                      else np.zeros(BINS - 1) for c in values.T]).reshape(n_stats, BINS - 1)
    size = BUCKETS + n_stats * (BINS + 1)
    m = Machine(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    rows = [m.indexed(*e) for e in examples]
    g_bias, g_linear, g_factors = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(max(6, steps * batch // max(len(rows), 1)) if rows else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            part = order[i:i + batch]
            at = np.concatenate([rows[j][0] for j in part])
            x = np.concatenate([rows[j][1] for j in part])
            lens = np.array([len(rows[j][0]) for j in part])
            starts, owner = np.cumsum(lens) - lens, np.repeat(np.arange(len(part)), lens)
            v = m.factors[at] * x[:, None]
            sums = np.add.reduceat(v, starts)
            z = m.bias + np.add.reduceat(m.linear[at] * x, starts) + 0.5 * (
                (sums ** 2).sum(axis=1) - np.add.reduceat((v ** 2).sum(axis=1), starts))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            d_factors = err[owner][:, None] * x[:, None] * (sums[owner] - v)
            used, inverse = np.unique(at, return_inverse=True)
            d_lin = np.bincount(inverse, err[owner] * x, len(used)) + shrink * m.linear[used]
            d_fac = np.stack([np.bincount(inverse, d_factors[:, k], len(used)) for k in range(RANK)], axis=1) \
                + shrink * m.factors[used]
            g_bias += err.sum() ** 2
            g_linear[used] += d_lin ** 2
            g_factors[used] += d_fac ** 2
            m.bias -= rate * err.sum() / np.sqrt(g_bias)
            m.linear[used] -= rate * d_lin / np.sqrt(g_linear[used])
            m.factors[used] -= 0.3 * rate * d_fac / np.sqrt(g_factors[used])
    return m


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5,
            metadata: tuple[str, ...] = ("n_chars",), text: str = "text", key: str = "doc_id") -> Machine:
    """A machine from about `sample` labelled rows outside the held-out fold (crc32 of the id mod `folds` is 0)."""
    # of several labels for one id the lower one counts
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(
        (id_fold("k", folds) != 0) & F.col("y").isin(0, 1)).groupBy("k").agg(F.min("y").alias("y"))
    # written, so that its size is known to be small when it is joined
    known = cut_lineage(bounded_sample(known, "k", sample).coalesce(1))

    def per_batch(batch):
        extra = [batch[f"m{i}"].to_pylist() for i in range(len(metadata))]
        for y, data, *more in zip(batch["y"].to_pylist(), as_bytes(batch["t"]), *extra):
            idx, weights, stats = sparse(data, more)
            yield y, idx.astype("<i4").tobytes(), weights.astype("<f4").tobytes(), stats

    rows = rows_pass(source_of(docs, text, key, metadata).join(known, "k"), per_batch,
                     "y int, idx binary, weights binary, stats array<double>").toArrow().to_pylist()
    examples = [(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f4"), r["stats"])
                for r in rows]
    return fitted(examples, np.array([r["y"] for r in rows], float))


def source_of(docs: DataFrame, text: str, key: str, metadata: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"),
                       *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5,
                   threshold: float = 0.3, metadata: tuple[str, ...] = ("n_chars",), text: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher is better), predicted (1 from `threshold` on).

    Words of the whole text are hashed, structure statistics and the numeric `metadata` columns are binned, and
    pairs of all of them interact through RANK factors. Ids, languages and sources are no inputs. Null and empty
    texts are scored by their statistics alone; null metadata has a bin of its own; without labels every score
    is 1/2; repeated rows repeat; an empty table gives no rows.

    The model (a few MB) is broadcast and scoring is one pass without a shuffle.
    """
    machine = docs.sparkSession.sparkContext.broadcast(
        trained(docs, labels, label, sample, folds, metadata, text, key))

    def per_batch(batch):
        for i, out, score in zip(batch["k"].to_pylist(), batch["h"].to_pylist(),
                                 scores_of(batch, machine.value, len(metadata))):
            yield i, out, score, int(score >= threshold)

    source = source_of(docs, text, key, metadata).withColumn("h", F.coalesce(id_fold("k", folds) == 0, F.lit(False)))
    return rows_pass(source, per_batch, "doc_id bigint, held_out boolean, score double, predicted int")


def scores_of(batch, machine: Machine, n_metadata: int):
    extra = [batch[f"m{i}"].to_pylist() for i in range(n_metadata)]
    for data, *more in zip(as_bytes(batch["t"]), *extra):
        yield machine.score(*sparse(data, more))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5,
             threshold: float = 0.3, metadata: tuple[str, ...] = ("n_chars",), text: str = "text",
             key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, with all their columns, that quality_scores would predict as 1.

    Rows are scored and kept where they lie: nothing is joined or moved.
    """
    machine = docs.sparkSession.sparkContext.broadcast(
        trained(docs, labels, label, sample, folds, metadata, text, key))
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, IN_ROWS):
                part = batch.slice(at, IN_ROWS)
                view = {"t": part.column(text)} | {f"m{i}": part.column(c) for i, c in enumerate(metadata)}
                keep = [score >= threshold for score in scores_of(view, machine.value, len(metadata))]
                yield part.select(columns).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
