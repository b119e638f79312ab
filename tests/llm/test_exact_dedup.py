from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from navloom.llm import exact_dedup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append(r)
    out = []
    for text, group in groups.items():
        keep = min(group, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(r.doc_id, keep, len(group), r.doc_id == keep, sha) for r in group]
    return sorted(out)


def got(df):
    return sorted(tuple(r)[:5] for r in exact_dedup.exact_groups(df).collect())


def test_awkward_rows_match_brute_force(awkward):
    assert got(awkward) == brute(awkward.collect())


def test_documents_match_brute_force(documents):
    assert got(documents) == brute(documents.collect())


def test_longest_original_then_smallest_id_stays(session):
    df = session.createDataFrame([(5, "a b"), (3, "ab"), (4, "a  b"), (2, "a \tb"), (9, "é b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(df).collect()}
    assert {rows[i].keep_id for i in (2, 3, 4, 5)} == {2} and rows[9].kept


def test_empty_table(no_docs):
    assert got(no_docs) == []


def test_cut_points_depend_on_content_only():
    data = bytes(range(97, 123)) * 400
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and all(b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends))
    text = hashlib.sha256(b"x").hexdigest().encode() * 300
    import random
    draw = random.Random(1)
    text = bytes(draw.randrange(97, 123) for _ in range(60_000))
    a, b = exact_dedup.cut_points(text), exact_dedup.cut_points(b"new start " + text)
    assert len({x + 10 for x in a} & set(b)) > 0.8 * len(a)


def test_names_that_clash_are_told_apart_by_their_proofs(session):
    made = session.createDataFrame(
        [(1, 3, "s1", [7], b"a" * 24), (2, 3, "s2", [7], b"b" * 24), (3, 3, "s1", [7], b"a" * 24),
         (4, 3, "s3", [8], b"c" * 24)],
        "doc_id long, points long, text_sha256 string, names array<long>, proofs binary")
    sizes = exact_dedup.with_identifiers(made).groupBy("recipe").agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
    assert sorted(r.d for r in sizes.collect()) == [[1, 3], [2], [4]]


def test_rows_without_an_id_come_last(session):
    df = session.createDataFrame([(None, "a  b"), (4, "a b"), (3, "ab"), (None, "c"), (None, "c")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(df).collect()
    assert [(r.doc_id, r.keep_id, r.kept) for r in sorted(rows, key=lambda r: (r.group_size, r.doc_id or 0))] == [
        (None, None, True), (None, None, True), (None, 4, False), (3, 4, False), (4, 4, True)]
