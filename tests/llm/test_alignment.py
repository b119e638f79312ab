from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from navloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """rows: (id, text). Both libraries on whole texts, every group and link spelled out."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    code = {c: i for c, i in alignment.byte_of_char().items()}
    entry = {i: bytes(code[c] for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    made = []
    for i, text in rows:
        want = (" " + text).encode() if text else b""
        one = a.encode(" " + text, add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        if b"".join(entry[x] for x in one) != want or b"".join(map(piece, two)) != want:
            one = two = []
        ends = lambda ids, of: [sum(len(of(x)) for x in ids[:k + 1]) for k in range(len(ids))]
        groups, left, right = [], [], []
        ea, eb = ends(one, entry.get), ends(two, piece)
        common = set(ea) & set(eb)
        by_end = lambda ids, e: [(x, min(c for c in common if c >= y)) for x, y in zip(ids, e)]
        left, right = by_end(one, ea), by_end(two, eb)
        groups = [([x for x, c in left if c == g], [x for x, c in right if c == g]) for g in sorted(common)]
        made.append((i, one, two, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(p for m in made for p in m[4])
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, one, two, groups, links in made:
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(one), len(two), len(groups), sum(links.values()),
                    sum(m for p, m in links.items() if count[p] == best[p[0]]),
                    sum(m * count[p] for p, m in links.items()),
                    hashlib.sha256(named.encode()).hexdigest() if one else ""))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, alignment.alignment(df, A, B).collect()), key=str)


def frame(session, texts):
    return session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


ODD = ["a ", " a", "  a  b  ", " ", "   ", "\n", "\t\ta\n\n b", "<|endoftext|> x<|endoftext|>", "<s>a</s> <unk> <0x41>", "▁a b",
       "café naïve 漢字かな \U0001f642\U0001f642 ½ ﬁ", "\x00 \x1c a\x85b c", "don't I'LL 12,345.67", "áé ß",
       "https://example.com/a_b?c=%20d", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "क्ष กำ", "I don't   know what  you mean ",
       "\r\nx\r\n", "ab" * 40, "tab\tword　wide", "​zero​ width"]


def test_odd_texts(session):
    assert got(frame(session, ODD)) == brute(list(enumerate(ODD)))


def test_random_texts(session):
    draw = random.Random(13)
    alphabet = "abcdeEST  '.,-\n\t0123456789éß漢\U0001f642 <|>_"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60))) for _ in range(150)]
    assert got(frame(session, texts)) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("frequent", [1 << 17, 40, 0])
def test_documents_match_brute_force(documents, monkeypatch, frequent):
    """Whatever share of the pairs is broadcast."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    some = documents.where("length(text) < 700 or text is null")
    assert some.count() > 30
    assert got(some) == brute([(r.doc_id, r.text) for r in some.collect()])


def test_awkward_rows(awkward):
    docs = awkward.where("length(text) < 1000 or text is null").unionByName(
        awkward.sparkSession.createDataFrame([(None, "no id"), (None, "no id")], "doc_id long, text string"),
        allowMissingColumns=True)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    long = {r[0]: r for r in got(awkward)}
    assert long[7][1] > 1000 and long[8][1] == 30_001 and long[8][3] == 30_001


def test_empty_table(no_docs):
    assert got(no_docs) == []


def test_groups_crossed_by_their_distinct_ids(session, monkeypatch):
    want = got(frame(session, ODD))
    monkeypatch.setattr(alignment, "AT_ONCE", 3)
    p = alignment.pair_of(A, B)
    text = " ".join(ODD[10:])
    (one, two), = p.encoded([text])
    a, b = one.astype("i8"), two.astype("i8")
    zero = [alignment.np.asarray([x]) for x in (0, len(a), len(b), 0, 0)]
    doc, key, n = alignment.crossed(a, b, *zero, len(p.bytes_b))
    every = Counter(int(x) * len(p.bytes_b) + int(y) for x in a for y in b)
    assert dict(zip(key.tolist(), n.tolist())) == every and set(doc.tolist()) == {0}
    assert want == brute(list(enumerate(ODD)))


def test_long_texts_are_encoded_in_parts(session, monkeypatch):
    texts = [*ODD, "  ".join(ODD), " ".join(ODD) + " ", "word " * 50]
    want = brute(list(enumerate(texts)))
    p = alignment.pair_of(A, B)
    monkeypatch.setattr(alignment, "PART", 3)
    for text in texts:
        parts = list(p.parted(" " + text))
        assert "".join(parts) == " " + text and all(x[0] == " " and x.strip(" ") for x in parts[1:])
        whole = p.b.encode(text) if text else []
        assert [i for x in parts for i in p.b.encode(x[1:])] == whole
    assert got(frame(session, texts)) == want


def test_both_libraries_give_the_same_ids_for_the_byte_level_file():
    p = alignment.pair_of(A, B)
    draw = random.Random(7)
    assert p.ranked is not None
    for _ in range(2000):
        text = "".join(chr(draw.choice((draw.randrange(32, 127), draw.randrange(0, 0x3000), draw.randrange(0xE000, 0x1F900))))
                       for _ in range(draw.randint(1, 40)))
        assert p.ranked.encode_ordinary(text) == p.a.encode(text, add_special_tokens=False).ids


def test_every_b_id_of_the_identity_table_spells_its_a_id():
    p = alignment.pair_of(A, B)
    held = [i for i, b in enumerate(p.same.tolist()) if b >= 0]
    assert p.parts and len(held) > 5_000 and all(p.bytes_a[i] == p.bytes_b[p.same[i]] for i in held)
