import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from onramp.llm import word_bpe as B

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    return B.WordBpe(open(B.default_path(), encoding="utf-8").read()), tokenizers.Tokenizer.from_file(B.default_path())


def same(pair, text):
    own, lib = pair
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


CASES = ["", " ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ'S it's I'LL", "x" * 5000, "ab" * 300 + "é" * 200,
         "가각 각 é é ̈́", "a\x1cb\x85c d　e", "l̇ İI", "<|endoftext", "'sS'RE'ſ", "１２³½x", "日本語" * 50, "\U0001f600!?", "aa" * 32 + " " + "aa" * 33]


@pytest.mark.parametrize("text", CASES)
def test_cases(pair, text):
    same(pair, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=80))
def test_random(pair, text):
    same(pair, text)


@pytest.mark.parametrize("pattern", ["{}", "a{}\u0323\u0301", "{}\u0323\u0301"])
def test_every_code_point(pair, pattern):
    """Alone, after a letter and before two marks, which come in another order by class."""
    own, lib = pair
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for i in range(0, len(points), 20_000):
        texts = [" ".join(pattern.format(chr(c)) for c in points[j:j + 100]) for j in range(i, min(i + 20_000, len(points)), 100)]
        got = own.encode_all([t.encode() for t in texts])
        wrong += [hex(points[i + 100 * k]) for k, (g, e) in enumerate(zip(got, lib.encode_batch(texts, add_special_tokens=False))) if B.ids_of(g) != e.ids]
    assert not wrong


def test_heap_and_arrays_agree(pair):
    own, _ = pair
    words = [w.encode() for w in ("thetiontion", "aaaaaaaaaaa", "abababababc", "strengthens")]
    assert own.merge_short(words) == [own.merge_long(w) for w in words]


def test_cache_generations(pair, monkeypatch):
    own, lib = pair
    monkeypatch.setattr(B, "CACHED", 5)
    for k in range(6):
        texts = [f"word{k} again other{k % 2} more{k}" for _ in range(3)]
        got = own.encode_all([t.encode() for t in texts])
        assert [B.ids_of(g) for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_frame(spark, pair):
    _, lib = pair
    rows = [(1, "Hello there, it's 42", 5, "z"), (1, "Hello there, it's 42", 5, "z"), (None, None, None, None), (3, "", 1, "q"), (4, "y" * 200_000, 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, IDS string")
    out = B.encode_texts(df, B.default_path()).collect()
    assert len(out) == 5
    for r in out:
        text = next((t for i, t, *_ in rows if i == r.doc_id), None) or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert B.encode_texts(df.limit(0), B.default_path()).count() == 0


def test_query_matches_library(spark, pair):
    _, lib = pair
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = B.op3_word_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs)
    for r in out:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
