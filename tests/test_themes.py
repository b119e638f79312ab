"""Clusters against step-by-step twins on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest

from navloom.operators import similarity as M
from navloom.operators import themes as T


def vectors(spark, n, seed, keys=12):
    rng = np.random.default_rng(seed)
    stocks, industries = [], []
    for f in range(n):
        for k in rng.choice(keys, 6, replace=False):
            stocks.append((1, f"{f:06d}", f"s{k}", float(rng.uniform(1, 10))))
        for k in rng.choice(5, 3, replace=False):
            industries.append((1, f"{f:06d}", f"i{k}", float(rng.uniform(1, 10))))
    schema = "set int, fund_code string, key string, ratio double"
    return stocks, industries, M.fund_vectors(
        spark.createDataFrame(stocks, schema), spark.createDataFrame(industries, schema), ["set"])


def dense_distance(stocks, industries, n):
    out = np.zeros((n, n))
    for rows, weight in ((stocks, 0.6), (industries, 0.4)):
        keys = sorted({r[2] for r in rows})
        m = np.zeros((n, len(keys)))
        for _, f, k, v in rows:
            m[int(f), keys.index(k)] += v
        m /= m.sum(axis=1, keepdims=True)
        out += weight * np.minimum(m[:, None, :], m[None, :, :]).sum(axis=2)
    return 2 * (1 - out)


def step_ward(dist, k):
    """Ward by its definition: merge the pair whose union adds least to the squared error."""
    d2 = dist ** 2
    groups = [[i] for i in range(len(dist))]

    def cost(a, b):
        cross = np.mean([d2[i, j] for i in a for j in b])
        inside = lambda g: np.mean([d2[i, j] for i in g for j in g])
        return 2 * len(a) * len(b) / (len(a) + len(b)) * (cross - inside(a) / 2 - inside(b) / 2)

    while len(groups) > k:
        best = min(((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
        _, i, j = best
        groups[i] = groups[i] + groups.pop(j)
    labels = np.zeros(len(dist), int)
    for n, g in enumerate(sorted(groups, key=min), start=1):
        labels[g] = n
    return labels.tolist()


def test_edges_match_dense_distance_for_any_tile(spark):
    stocks, industries, v = vectors(spark, 21, 3)
    want = dense_distance(stocks, industries, 21)
    for tile in (4, 256):
        got = {(int(r.i), int(r.j)): r.dist for r in M.similarity_edges(v, ["set"], tile).collect()}
        for i in range(21):
            for j in range(i + 1, 21):
                assert abs(got.get((i, j), 2.0) - want[i, j]) < 1e-12


@pytest.mark.parametrize("dense", [0.0, float("inf")])
@pytest.mark.parametrize("least", [0.0, 0.05, 0.3, 0.6, 1.0])
def test_pairs_that_reach_a_similarity(spark, dense, least):
    """Tiles and inverted lists give the same pairs and sums, whatever the threshold."""
    stocks, industries, v = vectors(spark, 40, 5)
    want = dense_distance(stocks, industries, 40)
    pairs = {(i, j): want[i, j] for i in range(40) for j in range(i + 1, 40)}
    got = {(int(r.i), int(r.j)): r.dist for r in M.similarity_edges(v, ["set"], least=least, dense=dense).collect()}
    hits = {p for p, dist in pairs.items() if 1 - dist / 2 >= (least or 1e-15)}
    assert got.keys() == hits and all(abs(got[p] - pairs[p]) < 1e-12 for p in got)


def test_long_lists_are_matched_in_blocks(spark):
    _, _, v = vectors(spark, 40, 6)
    _, lists = M.postings(v, ["set"])
    rows = lambda most: sorted((r.a, r.b, round(r.stock, 9), round(r.industry, 9)) for r in M.partial_sums(lists, most).collect())
    whole = rows(10_000)
    assert len(whole) > 100 and rows(3) == whole and rows(1) == whole


def test_long_lists_are_added_up_inside_tasks(spark, monkeypatch):
    """Entries that meet many holders never become shuffled pairs, even where the lists are asked for."""
    stocks, industries, v = vectors(spark, 40, 7)
    want = dense_distance(stocks, industries, 40)
    monkeypatch.setattr(M, "listed_edges", None)
    got = {(int(r.i), int(r.j)): r.dist for r in M.similarity_edges(v, ["set"], 16, 0.3, float("inf"), meets=2.0).collect()}
    assert got.keys() == {(i, j) for i in range(40) for j in range(i + 1, 40) if 1 - want[i, j] / 2 >= 0.3}
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_blocks_of_funds_meet_without_a_shuffle(spark, monkeypatch):
    """A fund is written once however many blocks its set has, and no set is dealt out by its key."""
    from navloom.session import cut_lineage

    stocks, industries, v = vectors(spark, 40, 11)
    want, sizes = dense_distance(stocks, industries, 40), []

    def cut(df):
        out = cut_lineage(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(M, "cut_lineage", cut)
    edges = M.similarity_edges(v, ["set"], 4, 0.2, float("inf"), meets=2.0)
    assert sizes == [10] and "hashpartitioning" not in edges._jdf.queryExecution().executedPlan().toString()
    got = {(int(r.i), int(r.j)): r.dist for r in edges.collect()}
    assert got.keys() == {(i, j) for i in range(40) for j in range(i + 1, 40) if 1 - want[i, j] / 2 >= 0.2}


def test_funds_without_code_have_no_place(spark):
    rows = [(1, None, "x", 1.0), (1, "b", "x", 2.0), (1, "a", "y", 0.0), (None, "c", "x", 1.0), (1, "b", "y", 6.0)]
    stocks = spark.createDataFrame(rows, "set int, fund_code string, key string, ratio double")
    got = {(r.set, r.fund_code): (r.pos, sorted((x.k, x.v) for x in r.stk), r.ind) for r in M.fund_vectors(stocks, stocks.limit(0), ["set"]).collect()}
    assert got == {(1, "a"): (0, [("y", 0.0)], None), (1, "b"): (1, [("x", 0.25), ("y", 0.75)], None)}


def test_repeated_keys_meet_alike_in_lists_and_tiles(spark):
    stocks, industries, _ = vectors(spark, 12, 9)
    again = stocks + stocks[::5]
    v = M.fund_vectors(spark.createDataFrame(again, "set int, fund_code string, key string, ratio double"),
                       spark.createDataFrame(industries, "set int, fund_code string, key string, ratio double"), ["set"])
    rows = lambda dense: sorted((r.i, r.j, round(r.dist, 9)) for r in M.similarity_edges(v, ["set"], least=0.2, dense=dense).collect())
    assert len(rows(0.0)) > 10 and rows(0.0) == rows(float("inf"))


@pytest.mark.parametrize("step", [1, 4, 512])
def test_blocks_of_two_tiles_have_all_sums(spark, step):
    """Whole rows and picked places, one side with itself and with another."""
    stocks, industries, v = vectors(spark, 21, 8, keys=30)
    want = dense_distance(stocks, industries, 21)
    rows = M.flat(v).toArrow().sort_by("pos")
    for cut in (0, 9):
        left, right = (rows, rows) if not cut else (rows.slice(0, cut), rows.slice(cut))
        seen = np.full((len(left), len(right)), np.nan)
        for a, b, stock, industry in M.block_sums(left, right, not cut, step):
            seen[a:a + len(stock), b:b + stock.shape[1]] = 2 * (1 - 0.6 * stock - 0.4 * industry)
        for i in range(len(left)):
            for j in range(len(right)):
                if i < j + cut:
                    assert abs(seen[i, j] - want[i, j + cut]) < 1e-12


def test_sets_of_thousands_are_solved_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(T, "clusters_by_rounds", None)
    rows = [(1, f"{f:06d}", f"s{f % 7}", 1.0) for f in range(2_400)]
    v = M.fund_vectors(spark.createDataFrame(rows, "set int, fund_code string, key string, ratio double"),
                       spark.createDataFrame([], "set int, fund_code string, key string, ratio double"), ["set"])
    got = {int(r.fund_code): r.cluster_id for r in T.theme_clusters(v, ["set"]).collect()}
    groups = {}
    for f, c in got.items():
        groups.setdefault(f % 7, set()).add(c)
    assert len(got) == 2_400 and len(set(got.values())) == 40
    assert sum(len(c) for c in groups.values()) == 40  # no group of equal funds meets another one


@pytest.mark.parametrize("limit", [2000, 5])
def test_clusters_match_the_definition(spark, limit):
    n = 24
    stocks, industries, v = vectors(spark, n, 2)
    want = step_ward(dense_distance(stocks, industries, n), 8)
    got = {int(r.fund_code): r.cluster_id for r in T.theme_clusters(v, ["set"], task_funds=limit).collect()}
    assert [got[i] for i in range(n)] == want


def test_both_forms_of_the_rounds_agree_on_ties():
    """Funds in identical pairs and triples: every merge has equals."""
    dist = np.full((9, 9), 2.0)
    for group in ((0, 4, 8), (1, 5), (2, 6), (3, 7)):
        for i in group:
            for j in group:
                dist[i, j] = 0.0
    assert T.merge_labels(dist, 4).tolist() == [1, 2, 3, 4, 1, 2, 3, 4, 1]
    assert T.merge_labels(np.full((4, 4), 2.0), 2).tolist() == T.merge_labels(np.full((4, 4), 2.0), 2).tolist()


def test_rounds_match_the_definition_when_the_matrix_shrinks():
    rng = np.random.default_rng(4)
    for n in (5, 33, 60):
        points = rng.normal(size=(n, 3))
        dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        for k in (1, 4, n):
            assert T.merge_labels(dist, k).tolist() == step_ward(dist, k)


def test_sets_below_three_funds_are_left_out(spark):
    assert T.theme_clusters(vectors(spark, 2, 1)[2], ["set"]).count() == 0


def test_share_classes_need_overlap_with_the_lead(spark):
    rows = [
        ("000001", "Alpha A", 1.0, ["a", "b", "c"]), ("000002", "Alpha C", 2.0, ["a", "b", "c", "d"]),
        ("000003", "Alpha E", 3.0, ["x", "y"]), ("000004", "Beta(后端)", None, []), ("000005", "BetaC", None, []),
        ("000006", "Gamma A", 1.0, ["a"]),
    ]
    items = spark.createDataFrame([(1, *r) for r in rows], "set int, fund_code string, name string, sharpe_3y double, stocks array<string>")
    got = {r.fund_code: (r.lead, r.kept) for r in T.dedup_share_classes(items, ["set"]).collect()}
    assert got == {
        "000001": ("000001", False), "000002": ("000001", True), "000003": ("000003", True),
        "000004": ("000004", True), "000005": ("000004", False), "000006": ("000006", True)}
