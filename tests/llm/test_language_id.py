from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from navloom.llm import language_id


def test_languages_of_documents_it_never_saw(session):
    docs = session.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_held_out_labels_are_not_learned(session):
    docs = session.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.withColumn("lang", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(x).collect()} for x in (docs, wrong))
    assert a == b


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.full(language_id.BUCKETS, 0.05), 3))
    model = language_id.Languages(["a", "b", "c"], logs)
    n = np.bincount(np.concatenate([rng.choice(language_id.BUCKETS, 700, p=np.exp(logs[0])),
                                    rng.choice(language_id.BUCKETS, 300, p=np.exp(logs[1]))]))
    found = np.flatnonzero(n)
    share = model.mixture(found, n[found].astype(float))
    assert abs(share[0] - 0.7) < 0.05 and abs(share[1] - 0.3) < 0.05 and share[2] == 0
    alone = np.bincount(rng.choice(language_id.BUCKETS, 50, p=np.exp(logs[2])))
    found = np.flatnonzero(alone)
    assert model.mixture(found, alone[found].astype(float)).tolist() == [0, 0, 1]


def test_awkward_rows_and_empty_tables(awkward, no_docs):
    rows = language_id.languages(awkward).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == awkward.count()
    assert [by[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by[0].score == 0
    assert by[4].lang_pred == "en" and 0 < by[4].score <= 1
    assert language_id.languages(no_docs).count() == 0
    nothing = language_id.languages(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
