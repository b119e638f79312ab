from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from navloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) for r in runs]


def brute(docs, items, buckets=10_000, longest=1, percent=10, least=20):
    of = lambda rows: Counter(f % buckets for r in rows for f in features(r.text, longest)[1])
    corpus, target = of(docs), of(items)
    s, t = sum(corpus.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets))))
            for b in range(buckets)]
    rows, able = [], []
    for r in docs:
        words, found = features(r.text, longest)
        weight = sum(gain[f % buckets] for f in found)
        name = f"2024:{'' if r.doc_id is None else r.doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([r.doc_id, len(found), weight, score, None])
        if len(words) >= least:
            able.append(rows[-1])
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, row in enumerate(able[:len(able) * percent // 100]):
        row[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def got(docs, items, **options):
    return sorted(map(tuple, resampling.resampled(docs, items, **options).collect()), key=str)


@pytest.fixture(scope="module")
def items(session, sf_dir):
    return session.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.mark.parametrize("longest", [1, 3])
def test_documents_match_brute_force(documents, items, longest):
    assert got(documents, items, longest=longest) == brute(documents.collect(), items.collect(), longest=longest)


def test_awkward_rows(awkward, items):
    extra = awkward.sparkSession.createDataFrame([(None, "no id " * 30), (None, "no id " * 30)], "doc_id long, text string")
    docs = awkward.unionByName(extra, allowMissingColumns=True)
    options = {"percent": 60, "least_words": 1}
    assert got(docs, items, **options) == brute(docs.collect(), items.collect(), percent=60, least=1)
    assert got(docs, items.limit(0), longest=2) == brute(docs.collect(), [], longest=2)


def test_ties_go_to_the_smaller_id(session, items, monkeypatch):
    monkeypatch.setattr(resampling, "gumbel", lambda key, seed: resampling.F.lit(0).cast("bigint"))
    docs = session.createDataFrame([(i, "same words here " * 10) for i in (9, 3, 7, 1, 5)], "doc_id long, text string")
    ranks = {r.doc_id: r["rank"] for r in resampling.resampled(docs, items, percent=60).collect()}
    assert ranks == {1: 1, 3: 2, 5: 3, 7: None, 9: None}


def test_empty_table(no_docs, items):
    assert resampling.resampled(no_docs, items).count() == 0


def test_table_tells_features_with_one_key_apart(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 40)).tolist()) for _ in range(60)] + [b"a" * 8, b"a" * 9, b"a" * 16]
    texts = [b" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(3)]
    plain = resampling.Features.keys
    for keys in (lambda self, block: plain(self, block) % np.uint64(3), lambda self, block: plain(self, block) * np.uint64(0)):
        monkeypatch.setattr(resampling.Features, "keys", keys)
        made = resampling.Features(texts, 2)
        for block, table in resampling.interned(made, 1000):
            pieces = [made.piece(i) for i in range(block.start, block.stop)]
            by_slot = {}
            for piece, slot in zip(pieces, table.slot.tolist()):
                assert by_slot.setdefault(slot, piece) == piece
                assert table.bucket[slot] == zlib.crc32(piece) % 1000
            assert len(by_slot) == len(set(pieces))
            assert {p: int(table.count[s]) for s, p in by_slot.items()} == Counter(pieces)
    assert len(words) == 63


def test_blocks_do_not_change_the_result(documents, items, monkeypatch):
    want = got(documents, items)
    monkeypatch.setattr(resampling, "BLOCK", 97)
    few = documents.where("doc_id % 20 = 0")
    assert got(few, items) == brute(few.collect(), items.collect())
    assert len(want) == documents.count()
