from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from navloom.llm import texts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    lib = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        out.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in token_counts.token_counts(df, PATH).collect())


def test_awkward_rows(awkward):
    assert got(awkward) == brute(awkward.collect())


def test_documents(documents):
    assert got(documents) == brute(documents.collect())


def test_special_strings_and_white_space(session):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " \n x  y  z\t", "don't 12 x's <|endoftext|", " a\x1cb"]
    df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(df) == brute(df.collect())


def test_empty_table(no_docs):
    assert got(no_docs) == []


def test_a_small_cache_gives_the_same():
    lib = Tokenizer.from_file(PATH)
    held = texts.Remembered(lambda _, p: len(lib.encode(p).ids), entries=3)
    held.known = {"a": 1}
    for parts in (["a", " the"], ["xyzzy", " the"], ["qq", "a", " the", "xyzzy"], []):
        assert [held.ready([parts])[p] for p in parts] == [len(lib.encode(p).ids) for p in parts]
