import random

import numpy as np
import pytest

from quantloom.llm import encode as E

ALPHABETS = ["ab", "a'srevld ", "数据表 ", "a1_ ", " \n\t", "x½Ⅷ' ", "é́ا ไท", "!?.'’ s", "AaBb'll 've're", "\x1c\x1da ", " 　a ", "0123456789+/="]


def plain(text):
    return E.encoder().bpe.encode_ordinary(text)


def by_chunks(text, size):
    enc = E.encoder()
    at, segments = 0, []
    while at < len(text):
        end = min(at + size, len(text))
        segments.append(E.leaf(enc, text, at, end))
        at = end
    return E.concatenate(enc, text, segments).tolist()


def test_tree_concatenation_is_exact():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, 120))) if rng.random() < 0.5 else "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(1, 200)))
        assert by_chunks(text, rng.choice([1, 2, 3, 5, 8, 17, 40])) == plain(text), repr(text)


@pytest.mark.parametrize("alphabet", ["ab", "数据表的", "the", "aeiou", "=", " ", "\n"])
def test_long_words_are_joined_by_windows(alphabet, monkeypatch):
    monkeypatch.setattr(E, "DIRECT_BYTES", 16)
    rng = random.Random(2)
    for n in (200, 1000, 3000):
        text = "".join(rng.choices(alphabet, k=n))
        assert by_chunks(text, 64) == plain(text)


def test_fast_path_equals_the_public_encoder():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x20000)])) for _ in range(30)).encode("utf-8", "ignore").decode()
        assert E.encoder().encode(text).tolist() == plain(text)


def test_cut_covers_the_text():
    text = "ab " * 50 + "x" * 300 + " end\n" * 20
    pieces = E.cut(text, 32)
    assert "".join(t for t, _ in pieces) == text
    assert all(len(t) <= 32 for t, _ in pieces)
    assert all(t[0].isspace() for t, safe in pieces[1:] if safe)


def test_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "plain text", "数" * 500, "a" * 500, "word " * 200, "".join(rng.choices("数据 ab'1!", k=900)), "\n" * 300, "=" * 333 + "x y"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "plain text", "clash"), (None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = E.encode_documents(df, chunk_chars=32).collect()
    want = sorted((str(i), plain(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    counts = E.encode_documents(df, chunk_chars=32, counts_only=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts) == [(i, len(x)) for i, x in want]
    assert E.encode_documents(df.limit(0)).count() == 0
    anywhere = E.encode_documents(df.unionByName(df), chunk_chars=32, cut_anywhere=True).collect()  # copies too
    assert sorted((str(r.doc_id), list(r.ids)) for r in anywhere) == sorted(want + want)
    assert E.decode_ids(plain("round trip ✓")) == "round trip ✓"


def test_corpus_matches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in E.encode_documents(docs, chunk_chars=2048).collect()}
    assert got.keys() == texts.keys()
    assert all(got[k] == plain(t or "") for k, t in texts.items())
    assert all(np.array(v).size == len(v) for v in got.values())
