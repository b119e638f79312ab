from __future__ import annotations

import pytest

from navloom.session import ship_package

AWKWARD = [None, "", " \t\n", "one", "two words", "a b c d e f g", "Ä Ö ü ß 漢字 🙂 é", "x" * 50_000,
           "word " * 30_000, "a b c d e f g"]


@pytest.fixture(scope="session")
def session(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def awkward(session):
    """Nulls, empty, long and equal texts, a repeated row, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i}", None if t is None else len(t), 1, "h", 2.0, "r") for i, t in enumerate(AWKWARD)]
    rows.append(rows[5])
    rows.append((100, "null language", None, None, None, 1, "h", 2.0, "r"))
    return session.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, k int, t string, d double, c string")


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(session, sf_dir):
    return session.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
