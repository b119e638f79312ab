from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from navloom.llm import decontaminate


def drawn(seed, n, words):
    draw = random.Random(seed)
    return [["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(words)] for _ in range(n)]


def run(session, docs, items, passages=False):
    d = session.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = session.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, passages=passages).collect()}


def test_exact_and_substituted_passages_are_found_in_place(session):
    items, fill = drawn(1, 6, 30), drawn(2, 12, 50)
    changed = list(items[1])
    for i in range(2, 30, 5):
        changed[i] = "other"
    fourth = ["other" if i % 4 == 3 else w for i, w in enumerate(items[2])]
    half = ["other" if i % 2 else w for i, w in enumerate(items[3])]
    docs = [" ".join(fill[0] + items[0] + fill[1]).upper(), " ".join(fill[2] + changed), " ".join(fourth + fill[3]),
            " ".join(fill[4] + half), " ".join(items[4][:20] + fill[5]), ", ".join(items[5]) + "!", " ".join(fill[6])]
    found = run(session, docs, [" ".join(i) for i in items])
    assert set(found) == {(0, 0), (1, 1), (2, 2), (5, 5)}
    assert (found[0, 0].first_word, found[0, 0].end_word, found[0, 0].similarity) == (50, 80, 1.0)
    assert found[1, 1].n_matches == 24


def test_awkward_rows(session, awkward, no_docs):
    items = session.createDataFrame(
        [(1, "a b c d e f g"), (2, None), (3, ""), (4, "two words"), (5, "A b, c d e f g"), (6, "word " * 12)],
        "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_matches for r in decontaminate.contaminated(awkward, items).collect()}
    assert found == {(4, 4): 2, (5, 1): 7, (9, 1): 7, (8, 6): 12}
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(awkward, items.limit(0)).count() == 0


def test_no_placement_of_replaced_words_escapes_the_seeds():
    """All placements for 5 to 21 words. Longer items are made of parts of 10 to 19 words, one of which has at most a
    quarter of its words replaced, so these lengths stand for all."""
    for n in range(5, 22):
        masks = [decontaminate.ALL_MASKS[i] for i in decontaminate.masks_for(n)]
        laid = [sum(1 << (o + i) for i, on in enumerate(m) if on == "1") for m in masks for o in range(n - len(m) + 1)]
        for places in combinations(range(n), n // 4):
            gone = sum(1 << p for p in places)
            assert any(not gone & m for m in laid), (n, places)


def test_every_placement_is_found_in_documents(session):
    items = drawn(5, 4, 8) + drawn(6, 3, 12)
    docs, want = [], set()
    for number, item in enumerate(items):
        for places in combinations(range(len(item)), len(item) // 4):
            want.add((len(docs), number))
            docs.append("start " + " ".join("other" if p in places else w for p, w in enumerate(item)) + " end")
    assert set(run(session, docs, [" ".join(i) for i in items])) == want


def test_passages_and_moved_pieces_are_found_if_asked_for(session):
    items, fill = drawn(7, 7, 59), drawn(8, 8, 40)
    items = [items[0][:30], items[1], items[2][:20], items[3][:20], items[4][:30], items[5][:30], items[6][:8]]
    docs = [fill[0] + items[0][:20] + fill[1], items[1][15:] + fill[2], fill[3] + items[2][:10] + ["more"] + items[2][10:],
            fill[4] + items[3][:10] + items[3][11:] + fill[5], fill[6] + items[4][5:17] + fill[7],
            fill[0] + [w for i, w in enumerate(items[5][:16]) if i != 5][:5] + fill[1], fill[2] + items[6][:5] + fill[3]]
    d = session.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = session.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, passages=True).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert (got[0, 0].n_matches, got[0, 0].first_word, got[0, 0].end_word) == (20, 40, 60)
    assert (got[2, 2].n_matches, got[2, 2].first_word, got[2, 2].end_word) == (20, 40, 61)
    assert (got[1, 1].n_matches, got[3, 3].n_matches) == (44, 19)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, passages=False).collect()} == set()


def test_longest_stretch_against_a_plain_loop():
    draw = random.Random(9)
    for _ in range(300):
        same = np.array([draw.random() < 0.6 for _ in range(draw.randrange(1, 40))])
        runs = [(j - i) for i in range(len(same)) for j in range(i + 13, len(same) + 1)
                if same[i] and same[j - 1] and 100 * same[i:j].sum() >= 75 * (j - i)]
        got = decontaminate.stretch(same, 13, 75)
        assert (got[1] - got[0] if got else 0) == max(runs, default=0)


def test_short_items_are_found_as_whole_sequences(session):
    items = ["alpha", "Beta gamma", "one two three", "red green blue white", "!!!", "x1 x2 x3 x4 x5"]
    docs = ["so, ALPHA!", "beta, gamma beta", "gamma beta", "one two four three", "zero one two three", "red green blue black",
            "a red green blue white", "x1 x2 x3 x4", "alpha beta gamma"]
    got = {k: (r.n_matches, r.first_word, r.end_word, r.similarity) for k, r in run(session, docs, items).items()}
    assert got == {(0, 0): (1, 1, 2, 1.0), (1, 1): (2, 0, 2, 1.0), (4, 2): (3, 1, 4, 1.0), (6, 3): (4, 1, 5, 1.0),
                   (7, 5): (4, 0, 4, 0.8), (8, 0): (1, 0, 1, 1.0), (8, 1): (2, 1, 3, 1.0)}


def test_rows_without_an_id_and_texts_that_share_one(session):
    (item,) = drawn(11, 1, 20)
    text, part = " ".join(item), " ".join(["start", *item[:16], "end"])
    d = session.createDataFrame([(None, text), (None, "x " + text), (None, "clean"), (7, part), (7, "a b " + text), (7, text + " c"), (8, "x")],
                                "doc_id long, text string")
    b = session.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    rows = decontaminate.contaminated(d, b).select("first_word", "doc_id", "item_id", "n_matches").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(0, None, 1, 20), (1, None, 1, 20), (0, 7, 1, 20)], key=str)


def test_query_and_sql_state_the_same_rows(session, tmp_path):
    """Whole, short, replaced, cut and moved items, through the registered query and its SQL."""
    import duckdb

    from navloom.llm.queries import ORACLE, QUERIES

    items, fill = drawn(12, 9, 40), drawn(13, 30, 30)
    draw = random.Random(14)
    docs = []
    for n, f in enumerate(fill):
        item = list(items[n % 9])
        for _ in range(n // 9 * 4):
            item[draw.randrange(40)] = "other"
        cut = draw.randrange(0, 26)
        kind = n % 5
        item = [item, item[cut:cut + 14], item[:20] + item[21:], item[:15] + ["more", "words"] + item[15:], item[:12]][kind]
        docs.append(" ".join(f[:10] + item + f[10:]))
    docs += ["only short words", "", None]
    texts = [" ".join(i) for i in items] + ["short words", "missing", "", None]
    columns = "doc_id long, text string", "item_id long, text string"
    for name, rows, schema in (("documents", docs, columns[0]), ("benchmark", texts, columns[1])):
        session.createDataFrame(list(enumerate(rows)), schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, QUERIES["op3_decontamination"](session, str(tmp_path)).collect()))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(db.sql(ORACLE["op3_decontamination"]).fetchall()) and len(got) > 15
    assert any(r[6] < 0.75 for r in got)
