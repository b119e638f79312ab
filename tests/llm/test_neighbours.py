from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from navloom.llm import centroids, neighbours
from navloom.session import cut_lineage


def brute(rows, k=20, divisor=20):
    """rows: (id, vector) that take part, one for each id."""
    out = {}
    for q, x in rows:
        if q % divisor == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(x, y)), i) for i, y in rows if i != q)
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return {q: found for q, found in out.items() if found}


def got(df, **options):
    out = defaultdict(list)
    for r in neighbours.nearest(df, **options).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(found) for q, found in out.items()}


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x[:2] for x in a[q]] == [x[:2] for x in b[q]], q
        assert all(math.isclose(x[2], y[2], rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(a[q], b[q]))


def table(session, rows, kind="float"):
    return session.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.fixture(scope="module")
def given(session, sf_dir):
    return session.read.parquet(f"{sf_dir}/embeddings.parquet")


def test_given_vectors_reach_the_recall(given):
    want = brute([(r.vec_id, r.embedding) for r in given.collect()])
    found = got(given)
    assert found.keys() == want.keys()
    hits = sum(len({x[1] for x in want[q]} & {x[1] for x in found[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    scores = {q: {x[1]: x[2] for x in want[q]} for q in want}
    for q, rows in found.items():
        assert [x[0] for x in rows] == list(range(1, 21))
        assert all(math.isclose(s, scores[q].get(i, s), abs_tol=1e-12) for _, i, s in rows)


def test_all_lists_give_the_exact_answer(given):
    same(got(given, ratio=math.inf), brute([(r.vec_id, r.embedding) for r in given.collect()]))


def test_lengths_copies_and_ties(session, monkeypatch):
    """Vectors of all lengths, a third of the rows one vector, and many equal products."""
    draw = random.Random(2)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(5)]) for i in range(-40, 160)]
    rows = [(i, v) for i, v in rows if any(v)] + [(i, [2.0, -1.0, 0.0, 3.0, 1.0]) for i in range(160, 260)]
    draw.shuffle(rows)
    monkeypatch.setattr(neighbours, "TILE", 16)
    want = brute(rows)
    same(got(table(session, rows), ratio=math.inf), want)
    same(got(table(session, rows, "double"), ratio=math.inf, k=3), brute(rows, 3))


def test_no_table_has_a_query_once_per_list(session, monkeypatch):
    """All rows ask and read all lists; the vectors are written a few times, not once for each list."""
    draw = random.Random(7)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    written = []

    def cut(df):
        out = cut_lineage(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "cut_lineage", cut)
    want = brute(rows, 3, 1)
    got_all = got(table(session, rows, "double"), ratio=math.inf, k=3, divisor=1)
    same(got_all, want)
    assert max(written) <= 400


def test_queries_go_through_the_vectors_some_at_a_time(session, monkeypatch):
    draw = random.Random(8)
    rows = [(i, [float(draw.randint(-9, 9)) * 10.0 ** draw.randint(-3, 3) for _ in range(7)]) for i in range(1, 700)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(1_000 + i, v) for i, v in rows[:60]] + rows[:20]
    monkeypatch.setattr(neighbours, "ASKED_BYTES", 2_000)
    monkeypatch.setattr(neighbours, "PARTS", 3)
    same(got(table(session, rows, "double").repartition(7), ratio=math.inf, divisor=3), brute(list(dict(rows).items()), divisor=3))


def test_bounds_keep_what_a_plain_search_finds():
    """Lengths of very different size, many more vectors than fit a tile, lists that some queries don't read."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(3_000, 12)) * 10.0 ** rng.integers(-12, 6, size=(3_000, 1))).astype(np.float32)
    lists = np.stack([rng.integers(0, 40, 3_000), rng.integers(-1, 40, 3_000)], axis=1).astype(np.int32)
    reads = rng.random((200, 40)) < 0.3
    y, longest = x[:200], float(np.linalg.norm(x.astype(np.float64), axis=1).max())
    held = neighbours.Asked(np.arange(200), y, np.packbits(reads, axis=1), 21, longest)
    for at in range(0, 3_000, 256):
        held.meet(np.arange(3_000)[at:at + 256], x[at:at + 256], lists[at:at + 256])
    found = {q: [t["c"] for t in top] for b in held.best() for q, top in zip(b["q"].to_pylist(), b["top"].to_pylist())}
    for q in range(200):
        fit = np.flatnonzero(reads[q, lists[:, 0]] | ((lists[:, 1] >= 0) & reads[q, lists[:, 1]]))
        score = neighbours.products(np.repeat(y[q:q + 1], len(fit), axis=0), x[fit])
        assert found[q] == fit[np.lexsort((fit, -score))][:21].tolist()


def test_awkward_vectors_take_no_part(session):
    nan, inf = float("nan"), float("inf")
    fine = [(20 * i, [float(i), 1.0, -0.5]) for i in range(1, 4)] + [(1, [0.5, 0.5, 0.0]), (7, [-0.0, 1e-30, 4.0])]
    odd = [(0, None), (40_000, []), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 1.0]), (4, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]),
           (5, [inf, 0.0, 0.0]), (60_000, [1.0, 2.0]), (8, [0.0, -0.0, 0.0]), (6, [None, None, None])]
    extra = table(session, fine + odd + fine[:2]).selectExpr("*", "'x' as v", "1 as c", "'y' as key")
    same(got(extra), brute(fine))


def test_one_vector_of_an_id_takes_part(session):
    rows = [(20, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])]
    found = got(table(session, rows))
    assert [x[1] for x in found[20]] in ([1, 2], [2, 1]) and found == got(table(session, rows[::-1]))


def test_single_and_empty_tables(session, given):
    assert got(given.limit(0)) == {}
    assert got(table(session, [(20, [1.0]), (3, None)])) == {}
    assert got(table(session, [(1, [1.0, 2.0])])) == {}
    assert got(table(session, [(0, None)])) == {}
    assert got(table(session, [(20, [1.0]), (3, [2.0])])) == {20: [(1, 3, 2.0)]}


def test_full_beam_finds_every_centroid_in_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 300):
        centres = centroids.unit(rng.normal(size=(n, 8)).astype(np.float32))
        x = centroids.unit(rng.normal(size=(50, 8)).astype(np.float32))
        ids, cos = centroids.graph_over(centres).search(x, n)
        exact = x @ centres.T
        assert (np.sort(ids, axis=1) == np.arange(n)).all()
        assert np.allclose(np.take_along_axis(exact, ids, 1), cos, atol=1e-5) and (np.diff(cos, axis=1) <= 0).all()


def test_narrow_beam_finds_the_nearest_centroid():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16)) * 4
    x = centroids.unit((middle[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32))
    centres = centroids.balanced_centroids(x, 200)
    ids, _ = centroids.graph_over(centres).search(x, 16)
    assert (ids[:, 0] == np.argmax(x @ centres.T, axis=1)).mean() > 0.98


def test_lists_are_balanced_under_a_hot_spot():
    """A third of all vectors lie close together: they get a third of the lists."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 12))
    x[:1000] = x[0] + rng.normal(size=(1000, 12)) * 0.05
    x = centroids.unit(x.astype(np.float32))
    sizes = np.bincount(np.argmax(x @ centroids.balanced_centroids(x, 60).T, axis=1), minlength=60)
    assert sizes.max() <= 5 * 50


def test_boundary_vectors_stand_in_several_lists():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    index = neighbours.Lists(x, float(np.linalg.norm(x, axis=1).max()), "<f4", 40, 1.2)
    row, list_ = index.of_vectors(x)
    held = np.bincount(row, minlength=len(x))
    assert held.min() == 1 and held.max() == neighbours.REPLICAS and len(set(zip(row.tolist(), list_.tolist()))) == len(row)
    asked, read = index.of_queries(x[:10])
    assert 10 <= len(asked) < 400 and set(read.tolist()) <= set(range(40))
