import re

import pytest
from pyspark.sql import functions as F

from onramp.llm import host_rules as H


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, x in enumerate(win) if win.count(x) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a a", "x y z q x y z", "a\nb\na\n\n a\n", "#a* $b%\x0b|<>&", "é ü 日本 é ü 日本 é",
         "w " * 3000, "one two three\fone two three", "\x85 \xa0 x", " ".join(f"w{i}" for i in range(60))]


def test_figures(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in H.figures(spark.createDataFrame(rows, "doc_id long, text string, N_WORDS_ int")).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), (i, t)


def test_prior_and_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", "clean") for i in range(100)] + [(200 + i, "bad" if i % 10 else good, "junk") for i in range(100)]
    rows += [(400, "bad", "tiny"), (401, good, None), (401, good, None)]
    out = H.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {i for i in range(100) if i % 10} | {401}
    assert H.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_beta_prior():
    assert H.beta_prior({"k": 0, "n": None, "f": None, "n2": None, "q": None}) == (0.0, H.PRIOR_CAP)
    assert H.beta_prior({"k": 3, "n": 30, "f": 15, "n2": 300.0, "q": 7.5}) == (0.5, H.PRIOR_CAP)
    m, w = H.beta_prior({"k": 2, "n": 200, "f": 100, "n2": 20000.0, "q": 0.01 * 100 + 0.99**2 * 100})
    assert m == 0.5 and w < 1


def test_no_python_on_the_main_path(spark):
    plan = H.op9_host_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
