from __future__ import annotations

from navloom.llm import quality
from tests.llm import test_exact_dedup, test_near_dedup, test_packing


def test_stages_against_brute_force(session, sf_dir):
    import corpus_pipeline

    docs = session.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (session.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows, results = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(session, rows, sf_dir).cache()
        results[name] = rows
        if name != "packing":
            assert rows.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.collect()}
    good = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    assert ids(results["quality"]) == good
    exact = {b[0] for b in test_exact_dedup.brute(results["quality"].collect()) if b[3]}
    assert ids(results["exact_dedup"]) == exact
    near = {i for i, b in test_near_dedup.brute(results["exact_dedup"].collect()).items() if b[2]}
    assert ids(results["near_dedup"]) == near
    passages = [r.text.lower().split() for r in items.collect()]
    holds = lambda t: any(" ".join(p) in " ".join(t.lower().split()) for p in passages)
    clean = {r.doc_id for r in results["near_dedup"].collect() if not holds(r.text or "")}
    assert ids(results["decontamination"]) == clean
    pieces = sorted(tuple(r)[:5] for r in results["packing"].collect())
    assert pieces == test_packing.brute_pieces(results["decontamination"].collect())
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(session, sf_dir).collect()) == pieces


def test_stages_on_awkward_and_empty_tables(session, awkward, no_docs, sf_dir):
    import corpus_pipeline

    columns = corpus_pipeline.COLUMNS
    held = {}
    for name, start in (("awkward", awkward.select(columns)), ("none", no_docs.select(columns))):
        rows = start
        for step, stage in corpus_pipeline.STAGES:
            before, rows = rows, stage(session, rows, sf_dir)
            if step != "packing":
                assert rows.columns == columns
                assert rows.exceptAll(before).isEmpty()  # a stage only drops rows
                last = rows
        held[name] = rows.select("doc_id").distinct().count()
        assert held[name] == last.select("doc_id").distinct().count()  # each row that is left is packed
    assert held["none"] == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_one_row_of_each_group_stays_with_repeated_and_missing_ids(session, sf_dir):
    import corpus_pipeline

    item = session.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30 ", "other ")
    rows = [(1, "same batch"), (1, "same batch"), (1, "same batch"), (2, "same batch"), (None, "no id"), (None, "no id"),
            (None, "no id either"), (5, "tied text"), (None, "tied text"), (7, "one text"), (7, "another text"),
            (None, long), (9, near), (None, f"start {item} end")]
    docs = session.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    exact = corpus_pipeline.exact_stage(session, docs, sf_dir)
    want = sorted([(1, "same batch"), (None, "no id"), (None, "no id either"), (5, "tied text"), (7, "one text"),
                   (7, "another text"), (None, long), (9, near), (None, f"start {item} end")], key=str)
    assert got(exact) == want
    want.remove((None, long))
    close = corpus_pipeline.near_stage(session, exact, sf_dir)
    assert got(close) == want
    # a batch delivered twice that the exact stage has not seen
    assert got(corpus_pipeline.near_stage(session, docs.unionByName(docs), sf_dir)) == want
    want.remove((None, f"start {item} end"))
    assert got(corpus_pipeline.benchmark_stage(session, close, sf_dir)) == want


def test_ids_without_room_above_them(session, sf_dir):
    import corpus_pipeline

    last = 2**63 - 1
    rows = [(last, "same text"), (last, "same text"), (None, "same text"), (-2**63, "own text"), (None, "no id"), (last - 1, "another")]
    docs = session.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        got = sorted(((r.doc_id, r.text) for r in stage(session, docs, sf_dir).collect()), key=str)
        assert got == sorted([(last, "same text"), (-2**63, "own text"), (None, "no id"), (last - 1, "another")], key=str)


def test_exact_stage_keeps_one_awkward_row_of_each_text(session, awkward, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.exact_stage(session, awkward.select(corpus_pipeline.COLUMNS), sf_dir)
    assert sorted(r.doc_id for r in rows.collect()) == [2, 3, 4, 5, 6, 7, 8, 100]
