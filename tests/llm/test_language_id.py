import math
import random
import re
import zlib

import zstandard

from onramp.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = L.op2_language_id(spark, SF).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    print("held-out accuracy", right / len(held), "rejected", sum(r.rejected for r in out))
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) / len(out) < 0.01


def test_edges(spark):
    rows = [(i, t, lang, 1.0) for i in range(30) for lang, t in (("en", f"the quick brown fox {i} jumps over the lazy dog"), ("de", f"der schnelle braune fuchs {i} springt über den faulen hund"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE double")
    model = L.learned(docs)
    assert [m[0] for m in model] == ["de", "en"]
    new = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 42"), (4, "the quick lazy dog"), (None, "der faule hund springt"), (4, "the quick lazy dog"),
                                 (6, "the lazy dog " * 50_000)], "doc_id long, text string")
    out = L.identify(new, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in out] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (4, "en"), (6, "en")]
    assert [r.score for r in out[:3]] == [0, 0, 0] and all(r.rejected for r in out[:3])
    assert {r.lang_pred for r in L.identify(new, []).collect()} == {"und"}
    assert L.identify(new.limit(0), model).count() == 0
    assert [r.lang_pred for r in L.identify(new.filter("doc_id = 4"), [("de", b"x"), ("en", b"")]).collect()] == ["de", "de"]  # hardly any dictionary
    nothing = spark.createDataFrame([(1, None, "en"), (2, "x", None), (None, "text", "fr")], "doc_id long, text string, lang string")
    assert L.learned(nothing) == []


def test_short_and_long_texts_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.Model(L.learned(docs))
    held = [(r.text.encode(), r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang in ("en", "de") and len(r.text or "") > 300]
    # one measure for all lengths; under about ten bytes it has too little to go by
    for size, least in ((10, 0.8), (20, 0.97), (50, 0.98), (95, 0.98), (96, 0.98), (300, 0.98)):
        got = [(model.predict(t[100:100 + size]), lang) for t, lang in held]
        assert sum(g[0] == lang and g[2] >= L.MARGIN for g, lang in got) >= least * len(got), size
    english = b" ".join(t for t, lang in held if lang == "en")
    for size in (2_000, 100_000, 20_000_000):
        lang, _, margin = model.predict((english * (size // len(english) + 1))[:size])
        assert lang == "en" and margin > 2 * L.MARGIN, size


def test_random_letters_are_rejected_at_all_lengths(spark):
    model, rng = L.Model(L.learned(spark.read.parquet(f"{SF}/documents.parquet"))), random.Random(3)
    for size in (60, 95, 96, 300, 2000):
        junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size)).encode() for _ in range(100)]
        assert sum(model.predict(t)[2] < L.MARGIN for t in junk) >= 90, size


def brute_sizes(text, dictionary, most):
    """Straight from the docstring, with fresh objects for every encoding."""
    text = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.decode().lower().encode() + b" ")
    cuts = len(dictionary) // L.CUT
    blocks = -(-len(text) // L.BLOCK)
    times = max(1, min(most // blocks, -(-L.ENCODED // len(text))))
    total = 0
    for j in range(blocks * times):
        b, c = j % blocks, j % cuts
        own = dictionary[c * len(dictionary) // cuts:(c + 1) * len(dictionary) // cuts]
        d = zstandard.ZstdCompressionDict(own[L.CONTEXT:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)

        def size(x):
            return len(zstandard.ZstdCompressor(dict_data=d, compression_params=L.PARAMETERS).compress(x))

        total += size(own[:L.CONTEXT] + text[b * len(text) // blocks:(b + 1) * len(text) // blocks]) - size(own[:L.CONTEXT])
    return total


def test_query_is_the_smallest_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = L.learned(docs)
    most = max(len(raw) for _, raw in dictionaries) // L.CUT
    assert most > 50
    texts = {r.doc_id: r.text for r in docs.collect()}
    checked = 0
    for r in L.op2_language_id(spark, SF).filter("doc_id % 10 = 3").collect():
        if not texts[r.doc_id] or r.lang_pred == "und" or len(texts[r.doc_id]) > 30_000:
            continue
        sizes = sorted((brute_sizes(texts[r.doc_id].encode(), raw, most), lang) for lang, raw in dictionaries)
        assert r.lang_pred == sizes[0][1]
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert r.rejected == (margin < L.MARGIN) and abs(r.score - (1 - math.exp(-L.SHARPNESS * margin))) < 1e-9
        checked += 1
    assert checked > 50


def test_sample_is_not_the_openings(spark):
    notice = "all rights reserved under this licence " * 30
    rows = [(notice + f"text {i} " * 400, "en") for i in range(600)] + [("ä" * 1000 + f" wort {i} " * 20_000, "de") for i in range(3)]
    got = L.sample(spark.createDataFrame(rows, "text string, lang string"))
    assert len(got["en"]) == 512 and len(got["de"]) == 3
    assert sum(b"rights" in t for t in got["en"]) < 300  # stretches lie anywhere
    assert sum(map(len, got["de"])) > 0.95 * L.DICTIONARY_BYTES  # few texts fill the dictionary
    assert all(sum(map(len, own)) <= 1.05 * L.DICTIONARY_BYTES for own in got.values())
