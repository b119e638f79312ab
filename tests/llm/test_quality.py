from __future__ import annotations

import zlib

import numpy as np

from navloom.llm import quality


def test_scores_of_documents_it_never_saw(session):
    folder = "/root/testdata/sf0.01"
    docs, labels = (session.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels)
    assert rows.count() == docs.count()
    out = rows.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    right = [r.predicted == r.quality for r in out]
    assert len(out) > 30 and np.mean(right) >= 0.95


def test_square_of_sums_equals_all_pairs():
    rng = np.random.default_rng(0)
    size = quality.BUCKETS + 2 * (quality.BINS + 1)
    m = quality.Machine(np.zeros((2, quality.BINS - 1)), 0.3, rng.normal(0, .1, size), rng.normal(0, .1, (size, 8)))
    idx, w, stats = np.array([5, 9, 77]), np.array([.2, .5, .1]), [1.0, float("nan")]
    at, x = m.indexed(idx, w, stats)
    z = m.bias + m.linear[at] @ x + sum(
        m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score(idx, w, stats) - 1 / (1 + np.exp(-z))) < 1e-12


def test_awkward_rows_and_empty_tables(session, awkward, no_docs):
    labels = session.createDataFrame([(5, 1, 0), (8, 0, 0), (8, 0, 1), (3, None, 0)],
                                     "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.quality_scores(awkward, labels.limit(0)).collect()
    assert {round(r.score, 1) for r in none} == {0.5}
    assert quality.quality_scores(no_docs, labels).count() == 0
    kept = quality.accepted(awkward, labels)
    assert kept.columns == awkward.columns
    wanted = {r.doc_id for r in rows if r.predicted}
    assert {r.doc_id for r in kept.collect()} == wanted


def test_ids_languages_and_sources_are_no_inputs(session, documents):
    labels = session.read.parquet("/root/testdata/sf0.001/labels.parquet")
    machine = quality.trained(documents, labels)
    a = documents.select("doc_id", "text", "n_chars").limit(20).collect()
    one = [machine.score(*quality.sparse((r.text or "").encode(), [r.n_chars])) for r in a]
    from pyspark.sql import functions as F
    rows = quality.quality_scores(documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), labels)
    got = {r.doc_id: r.score for r in rows.collect()}
    assert np.allclose([got[r.doc_id] for r in a], one)
