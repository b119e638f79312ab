from __future__ import annotations

import random
import re

import numpy as np
import pytest

from navloom.llm import near_dedup
from navloom.llm.components import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}


def drawn(seed, n, words=60):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(words)) for _ in range(n)], draw


def test_awkward_rows(awkward):
    assert got(awkward) == brute(awkward.collect())


def test_documents_match_brute_force(documents):
    assert got(documents) == brute(documents.collect())


def test_empty_table(no_docs):
    assert got(no_docs) == {}


@pytest.mark.parametrize("wide", [4, 32])
def test_crowded_keys_lose_no_link(session, monkeypatch, wide):
    """Many near copies of one text, heavy edits among them, and others that only share a passage with it."""
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    (base, passage, *others), draw = drawn(3, 40, 120)
    texts = list(others)
    for i in range(150):
        words = base.split()
        for _ in range(draw.randint(0, 12)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [passage + " " + t for t in others[:30]]
    draw.shuffle(texts)
    df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(df) == brute(df.collect())


def test_every_pair_under_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 2**16, near_dedup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        b[at] += 1
        keys = near_dedup.chunk_keys(np.stack([a, b]).astype("<u2"))
        assert (keys[0] == keys[1]).any()


def test_components_of_long_paths_and_hubs(session):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    df = session.createDataFrame(links, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(df.limit(0)).count() == 0
