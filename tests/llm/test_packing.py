from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from navloom.llm import packing, texts as texts_

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(rows, capacity=2048):
    lib = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[at:at + capacity], "<u4")
            out.append((r.doc_id, p, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def check(df, capacity=2048):
    rows = packing.packed(df, PATH, capacity).collect()
    assert sorted(tuple(r)[:5] for r in rows) == brute_pieces(df.collect(), capacity)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_awkward_rows(awkward):
    check(awkward)


def test_documents_are_packed_tightly(documents):
    n, total = check(documents)
    assert n <= 1.05 * total / 2048 + 1


def test_white_space_and_special_strings(session):
    texts = ["Ab  cd ef\tg\nh", "<|endoftext|> x", "a<|startoftext|>b C", "é ́ É", "don't 123", " x\x1cy"]
    check(session.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 7)


def test_empty_table(no_docs):
    assert packing.packed(no_docs, PATH).count() == 0


def best(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    low = [len(lengths)]

    def place(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(lengths):
            low[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += lengths[i]
                place(i + 1, rest)
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return low[0]


def test_reduction_keeps_some_best_packing():
    draw = random.Random(5)
    for _ in range(300):
        capacity = draw.choice((10, 13, 20))
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
        counts, plan = np.bincount(lengths, minlength=capacity + 1), packing.Plan(capacity)
        packing.reduce_by_dominance(counts, capacity, plan)
        fixed = sum(t for _, t in plan.kinds)
        rest = list(itertools.chain.from_iterable([i] * int(c) for i, c in enumerate(counts)))
        assert all(sum(k) <= capacity for k, _ in plan.kinds)
        assert fixed + best(rest, capacity) == best(lengths, capacity), lengths


def test_plan_places_everything_once():
    draw = random.Random(6)
    for _ in range(100):
        histogram = {draw.randint(1, 64): draw.randint(1, 50) for _ in range(draw.randint(0, 30))}
        plan = packing.planned(histogram, 64)
        used = defaultdict(int)
        for lengths, times in plan.kinds:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += times
        assert dict(used) == histogram


def test_ids_equal_the_library_s_with_a_small_cache():
    lib = Tokenizer.from_file(PATH)
    texts = ["Word, word. WORD! É, é. don't, 1, a1. x!! <|endoftext|>, <|ENDOFTEXT|> İ. ﬁ, ß. Σ, ... , .", "", " ", "a  b\n\nc"]
    known = texts_.Remembered(lambda memo, w: packing.ids_of_word(memo, lib, w), entries=3)
    for _ in range(3):
        for t in texts:
            assert packing.ids_of([t], known) == [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]


def test_plain_words_are_left_to_the_model():
    """Words of a-z never pass the whole library, whose steps before the model don't change them; the ids are equal."""
    lib = Tokenizer.from_file(PATH)
    draw = random.Random(10)
    plain = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 30))) for _ in range(2_000)]

    class ModelOnly:
        model = lib.model

    known = texts_.Remembered(lambda memo, w: packing.ids_of_word(memo, ModelOnly, w))
    for w in [*plain, "x" * 3_000, "don", "t", "endoftext"]:
        assert known.one(w) == known.one(w.upper()) == np.asarray(lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
