import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline as P
import pytest
from onramp.llm import language_id as L
from onramp.llm import secrets_cnn as S
from onramp.llm import simhash
from onramp.llm import word_bpe as B
from onramp.session import materialize

from .test_mixing import brute_targets
from .test_secrets_cnn import brute as brute_secrets
from .test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{i}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{i}"))
        if i < 4:
            assert docs.columns == columns, name
        steps.append((before.collect(), docs.collect()))
    # language ID: what goes is what the model rejects, clean documents stay unchanged
    was, now = steps[0]
    model = L.Model(L.learned(spark.read.parquet(f"{SF}/documents.parquet")))
    want = [r for r in was if model.predict(r.text.encode())[2] >= L.MARGIN]
    assert sorted(want) == sorted(now) and len(now) > 0.95 * len(was)
    # near-duplicates: one row a component, the smallest id
    was, now = steps[1]
    roots = brute_components({r.doc_id: brute_fp(r.text, 3) for r in was}, 2)
    assert sorted(r.doc_id for r in now) == sorted(set(roots.values()))
    assert set(now) <= set(was)
    # secrets: texts without base findings or added spans are untouched, others are marked
    was, now = steps[2]
    old = {r.doc_id: r for r in was}
    assert set(old) == {r.doc_id for r in now}
    for r in now:
        assert not brute_secrets(r.text)
        assert r.n_chars == (old[r.doc_id].n_chars if r.text == old[r.doc_id].text else len(r.text))
        if brute_secrets(old[r.doc_id].text):
            assert S.MARK in r.text
    # mix: near the targets, nothing more than twice
    was, now = steps[3]
    size = lambda rows: Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    goal, got = brute_targets(size(was)), size(now)
    most = max(len(r.text.split()) for r in was)
    assert all(abs(got[s] - goal[s]) <= most / 2 for s in goal)
    assert max(Counter(now).values()) <= 2 and set(now) <= set(was)
    # BPE: the library's ids
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(B.default_path())
    was, now = steps[4]
    texts = {r.doc_id: r.text for r in was}
    assert len(was) == len(now)
    for r in now:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, FP int, copies int"
    rows = [(None, None, None, None, None, "a", 1, 2), (1, "", "en", "s", 0, None, None, None), (1, "words of one text " * 20, "en", "s", 5, "r", 0, 9),
            (1, "words of one text " * 20, "en", "s", 5, "r", 0, 9), (2, "andere worte " * 30, None, None, 7, "r", 0, 9), (3, "worte anders " * 30, "de", "t", 7, "r", 0, 9)]
    for name, data in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF)
            if i < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            if i == 1 and data:
                assert Counter(r.doc_id for r in docs.collect())[1] == 1


def test_near_duplicates_broadcast_no_exploded_table(spark, monkeypatch):
    written = {}

    def noted(df, name):
        written.setdefault(name, df)  # of the links the first, not those of the rounds
        return materialize(df, name)

    monkeypatch.setattr(simhash, "materialize", noted)
    rows = [(i, f"words of text {i // 2} and some more", "en", "s", 9) for i in range(20)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    kept = P.drop_near_duplicates(spark, docs, SF)
    roots = brute_components({r[0]: brute_fp(r[1], P.SHINGLE) for r in rows}, P.DISTANCE)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))
    for name in ("simhash-buckets", "links"):  # of an index 66 times the fingerprints, whatever their number
        plan = written[name]._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
