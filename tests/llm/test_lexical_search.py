import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from onramp.llm import lexical_search as L

DOCS, ITEMS = "doc_id long, text string, DOC_ID_ string", "item_id long, text string"
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=L.K):
    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        own = set(terms(text))
        scores = []
        for d, c, n in counts:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def test_terms():
    texts = ["", "a", "Äb ÄB", "A-b_c'd", "1x\x00y\x7f", "日本 ÉÈ", " a b", " ".join(["ab"] * 9), "x" * 50, "q" * 30 + " " + "r" * 40]
    old = L.PIECE
    try:
        for L.PIECE in (7, 1 << 20):
            for t in texts:
                got = [x for p in L.pieces(t.encode().translate(L.FOLD)) for x in p]
                assert [x.decode() for x in got] == terms(t), t
    finally:
        L.PIECE = old


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 80))), "x") for i in range(n)]
    docs += [(rng.randrange(n), docs[3][1], "x") for _ in range(40)]                    # copies under ids of others
    docs += [(n + 1, None, "x"), (n + 2, "", "x"), (n + 3, "?! ...", "x"), (None, docs[5][1], "x"), (n + 4, "W1 " * 60_000 + docs[7][1], "x")]
    items = [(i, " ".join(rng.sample(docs[rng.randrange(n)][1].split(), k=1) * 2 + rng.choices(words, k=rng.randint(0, 12)))) for i in range(30)]
    items += [(5, docs[3][1].upper()), (100, None), (101, ""), (102, "neverseen"), (103, " ".join(words))]
    rng.shuffle(docs)
    return docs, items


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs, items = corpus(rng, 500)
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    for kw in ({}, {"k": 3, "most_items": 7}, {"most_bytes": 100}):
        got = Counter(tuple(r) for r in L.top_documents(d, i, **kw).collect())
        want = brute(docs, items, kw.get("k", L.K))
        # of copies under one id any may come first: the rows are equal
        assert got == want, kw


def test_batches_are_dropped():
    """Documents far from the items are never scored, and the result is the same."""
    rng = np.random.default_rng(4)
    topics = [np.arange(t * 50, t * 50 + 50) for t in range(20)]
    weight = rng.integers(500, 9000, 1000)
    item_terms = [np.sort(rng.choice(topics[i % 20], 8, replace=False)) for i in range(40)]
    docs = [np.sort(rng.choice(topics[i % 20], 12, replace=False)) for i in range(4000)]
    tf = rng.integers(1, 4, 4000 * 12)
    search = L.Search(L.Items(item_terms, weight, 4000, 4000 * 24, np.ones(40, np.int64), 10))
    for part in range(2):
        own = docs[part * 2000:part * 2000 + 2000]
        search.add(np.arange(part * 2000, part * 2000 + 2000), np.full(2000, 24), np.concatenate(own), tf[part * 24000:part * 24000 + 24000], np.arange(0, 24001, 12))
    x = (10**9 * tf) // (1000 * tf + 8 * (10 + 90 * 24 * 4000 // (4000 * 24)))
    dense = np.zeros((4000, 1000), np.int64)
    dense[np.repeat(np.arange(4000), 12), np.concatenate(docs)] = x
    for place, item in enumerate(search.items.order):
        scores = dense[:, item_terms[item]] @ weight[item_terms[item]]
        want = sorted((-s, d) for d, s in enumerate(scores) if s > 0)[:10]
        assert [(-s, d) for s, d in zip(*search.kept[place])] == want
    assert search.scored < 0.3 * search.pairs


def test_edges(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "x")], DOCS)
    asked = spark.createDataFrame([(1, "a")], ITEMS)
    assert L.top_documents(none, asked).count() == 0
    assert L.top_documents(one, spark.createDataFrame([], ITEMS)).count() == 0
    assert L.top_documents(spark.createDataFrame([(1, None, "x")], DOCS), asked).count() == 0
    assert L.top_documents(one, asked).columns == ["item_id", "rank", "doc_id", "score"]
    clash = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, Text string, score string")
    assert Counter(tuple(r) for r in L.top_documents(clash, asked).collect()) == brute([(1, "a b")], [(1, "a")])


def test_query_against_sql(spark):
    got = L.op12_lexical_search(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({L.ORACLE})").fetchall()
    assert len(want) and Counter(tuple(r) for r in got.collect()) == Counter(want)
