"""The fits of the classifiers against plain loops on small tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from navloom.llm import language_id, quality, url_filter


# ---- boosted trees of the URL filter ------------------------------------------------------

def plain_tree(rows, grad, hess, depth):
    """Greedy splits by trying every feature and cut on the rows themselves."""
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    leaf = -url_filter.RATE * g / (h + url_filter.RIDGE)
    best, split = 1e-6, None
    if depth:
        whole = g * g / (h + url_filter.RIDGE)
        for f in range(url_filter.N_FEATURES):
            for cut in sorted({FEATURES[i][f] for i in rows})[1:]:
                left = [i for i in rows if FEATURES[i][f] < cut]
                a, b = sum(grad[i] for i in left), sum(hess[i] for i in left)
                gain = a * a / (b + url_filter.RIDGE) + (g - a) ** 2 / (h - b + url_filter.RIDGE) - whole
                if gain > best + 1e-12:
                    best, split = gain, (f, cut)
    if split is None:
        return lambda x: leaf
    f, cut = split
    below, above = ([i for i in rows if (FEATURES[i][f] < cut) == side] for side in (True, False))
    one, two = plain_tree(below, grad, hess, depth - 1), plain_tree(above, grad, hess, depth - 1)
    return lambda x: one(x) if x[f] < cut else two(x)


FEATURES: list = []


def test_boosted_trees_match_a_plain_loop(session):
    draw = random.Random(21)
    FEATURES[:] = [[draw.randint(0, 4) for _ in range(url_filter.N_FEATURES)] for _ in range(60)]
    labels = [int(x[1] + x[3] > 4) if draw.random() < 0.9 else draw.randint(0, 1) for x in FEATURES]
    weights = [float(draw.randint(1, 4)) for _ in FEATURES]
    columns = ", ".join(f"f{i} int" for i in range(url_filter.N_FEATURES))
    df = session.createDataFrame([(y, w, *x) for y, w, x in zip(labels, weights, FEATURES)], f"y int, w double, {columns}")
    trees = url_filter.boosted(df, trees=4, depth=3)
    got = [r.m for r in df.withColumn("m", url_filter.margin(trees)).collect()]
    margin = [0.0] * len(FEATURES)
    for _ in range(4):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = plain_tree(list(range(len(FEATURES))), [w * (q - y) for w, q, y in zip(weights, p, labels)],
                          [w * q * (1 - q) for w, q in zip(weights, p)], 3)
        margin = [m + tree(x) for m, x in zip(margin, FEATURES)]
    assert sorted(got) == pytest.approx(sorted(margin), abs=1e-9)
    assert len({round(m, 9) for m in margin}) > 5


# ---- factorisation machine ------------------------------------------------------------------

def plain_margin(bias, linear, factors, at, x):
    pairs = sum(float(factors[at[i]] @ factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    return bias + sum(linear[a] * v for a, v in zip(at, x)) + pairs


def test_machine_matches_a_plain_loop(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 32)
    draw = random.Random(5)
    examples = []
    for _ in range(9):
        idx = np.asarray([draw.randrange(32) for _ in range(draw.randint(0, 6))], np.int64)
        stats = [draw.choice([draw.random(), 0.5, float("nan")]) for _ in range(3)]
        examples.append((idx, np.asarray([draw.random() for _ in idx]), stats))
    labels = np.asarray([float(draw.randint(0, 1)) for _ in examples])
    m = quality.fitted(examples, labels, steps=12, batch=4, seed=3)

    size = len(m.linear)
    rng = np.random.default_rng(3)
    bias, linear, factors = 0.0, np.zeros(size), rng.normal(0, 0.05, (size, quality.RANK))
    g_bias, g_linear, g_factors = 1e-6, np.full(size, 1e-6), np.full((size, quality.RANK), 1e-6)
    rows = [m.indexed(*e) for e in examples]
    for _ in range(max(6, 12 * 4 // len(rows))):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), 4):
            part = order[start:start + 4]
            d_bias, d_lin, d_fac = 0.0, defaultdict(float), defaultdict(lambda: np.zeros(quality.RANK))
            for k in part:
                at, x = rows[k]
                err = (1 / (1 + math.exp(-plain_margin(bias, linear, factors, at, x))) - labels[k]) / len(part)
                d_bias += err
                for i, a in enumerate(at.tolist()):
                    others = sum((factors[at[j]] * x[j] for j in range(len(at)) if j != i), np.zeros(quality.RANK))
                    d_lin[a] += err * x[i]
                    d_fac[a] = d_fac[a] + err * x[i] * others
            g_bias += d_bias ** 2
            bias -= 0.1 * d_bias / math.sqrt(g_bias)
            for a in d_lin:
                one, many = d_lin[a] + 1e-5 * linear[a], d_fac[a] + 1e-5 * factors[a]
                g_linear[a] += one ** 2
                g_factors[a] += many ** 2
                linear[a] -= 0.1 * one / math.sqrt(g_linear[a])
                factors[a] -= 0.03 * many / np.sqrt(g_factors[a])
    assert m.bias == pytest.approx(bias, abs=1e-6)
    assert np.allclose(m.linear, linear, atol=1e-6) and np.allclose(m.factors, factors, atol=1e-6)
    for e, (at, x) in zip(examples, rows):
        assert m.score(*e) == pytest.approx(1 / (1 + math.exp(-plain_margin(bias, linear, factors, at, x))), abs=1e-5)


# ---- language mixtures ----------------------------------------------------------------------

def plain_grams(text):
    out, kept = defaultdict(int), [" "]
    for c in f" {text.lower()} "[1:]:
        if c.isalpha():
            kept.append(c)
        elif kept[-1] != " ":
            kept.append(" ")
    if not any(map(str.isalpha, kept)):
        return {}
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B + ord(c) * 0xC2B2AE35) & 0xFFFFFFFF
        out[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16] += 1
    return out


def plain_mixture(likes, counts):
    n, total = len(likes), sum(counts)

    def estimate(share, part, rounds):
        for _ in range(rounds):
            mix = [sum(s * likes[j][g] for s, j in zip(share, part)) for g in range(len(counts))]
            share = [s * sum(likes[j][g] * c / m for g, (c, m) in enumerate(zip(counts, mix))) / total for s, j in zip(share, part)]
        return share

    share = estimate([1 / n] * n, list(range(n)), language_id.ROUNDS)
    order = sorted(range(n), key=lambda j: (-share[j], j))
    best, chosen = -math.inf, {}
    for size in range(1, n + 1):
        part = order[:size]
        p = [max(share[j], 1e-9) for j in part]
        p = estimate([x / sum(p) for x in p], part, 5 if size > 1 else 0)
        value = sum(c * math.log(sum(x * likes[j][g] for x, j in zip(p, part))) for g, c in enumerate(counts))
        value -= language_id.PENALTY * 0.5 * size * math.log(total)
        if value <= best:
            break
        best, chosen = value, dict(zip(part, p))
    return chosen


def test_languages_match_a_plain_loop(documents):
    """Trigram likelihoods, mixture and chosen set, learned from all documents of the learning folds."""
    rows = documents.collect()
    learned = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for g, n in plain_grams(r.text).items():
                learned[r.lang][g] += n
    names = sorted(learned)
    sums = {name: sum(learned[name].values()) + 0.1 * language_id.BUCKETS for name in names}
    got = {r.doc_id: r for r in language_id.languages(documents).collect()}
    seen = 0
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:60]:
        grams = plain_grams(r.text or "")
        if not grams:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        logs = [[math.log((learned[name].get(g, 0) + 0.1) / sums[name]) for g in grams] for name in names]
        likes = [[math.exp(x - max(row[g] for row in logs)) for g, x in enumerate(one)] for one in logs]
        chosen = plain_mixture(likes, list(grams.values()))
        top = min(chosen, key=lambda j: (-round(chosen[j], 9), j))
        assert got[r.doc_id].lang_pred == names[top] and got[r.doc_id].score == pytest.approx(min(chosen[top], 1.0), abs=1e-6)
        assert sorted(got[r.doc_id].langs) == sorted(names[j] for j, x in chosen.items() if x > 0)
        seen += 1
    assert seen > 30
