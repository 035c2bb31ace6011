import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from onramp.llm import hard_negatives as H
from onramp.llm import vectors as V

SCHEMA = "vec_id long, label int, embedding array<double>, RID int"
SF = "/root/testdata/sf0.01"


def brute(rows, every):
    """Whole numbers of Python, all pairs."""
    own = []
    for i, (vec_id, label, v, _) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, a, label, v in own:
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b is None, b or 0, b, other == label) for j, b, other, w in own if j != i]
        scored.sort(key=lambda s: s[:3])
        for s, _, _, b, _ in [s for s in scored if s[4]][:5]:
            fits = [t for t in scored if not t[4] and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(a, b, r, t[3], -s, -t[0]) for r, t in enumerate(fits, 1)]
    return Counter(out)


def rows_of(rng, n, width=6):
    rows = [(i, rng.randrange(3), [rng.gauss(0.4, 1) for _ in range(width)], 1) for i in range(n)]
    rows += [(rng.randrange(n), rng.randrange(3), rows[4][2], 1) for _ in range(20)]                # equal vectors, repeated ids
    rows += [(None, 1, [2.0] * width, 1), (n + 1, None, [1.0] * width, 1), (n + 2, 1, None, 1), (n + 3, 1, [math.nan] * width, 1),
             (n + 4, 1, [1.0, None], 1), (n + 5, 1, [math.inf] * width, 1), (n + 6, 2, [], 1), (n + 7, 2, [1.0], 1), (1000, 0, [0.0] * width, 1), (2000, 7, [1.0] * width, 1)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = rows_of(random.Random(6), 300)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 10)
    assert len(want) > 100
    for kw in ({}, {"pass_rows": 7, "group": 3}, {"pass_bytes": 1, "group": 1}):
        got = H.mine(H.prepared(d), every=10 if "pass_bytes" not in kw else 100, **kw).collect()
        assert Counter(tuple(r) for r in got) == (want if "pass_bytes" not in kw else brute(rows, 100)), kw


def test_bounds_spare_products():
    """Near anchors: most rows are not scored again, and none in the window is missed."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (8, 16))
    a = np.floor(np.concatenate([c + rng.normal(0, 4, (32, 16)) for c in centres]))
    x = np.floor(rng.normal(0, 100, (3000, 16)))
    norms = np.sqrt((a * a).sum(axis=1))
    scores = V.products(a, x)
    got, made = {}, 0
    for group in H.grouped(a, np.arange(len(a)), 32):
        made += H.visit(H.SpanningTree(a, group), a, norms, x, lambda node: (np.quantile(scores[node], 0.9), np.quantile(scores[node], 0.95)),
                        lambda node, rows, s: got.update({node: sorted(rows.tolist())}))
    for node, s in enumerate(scores):
        low, high = np.quantile(s, 0.9), np.quantile(s, 0.95)
        assert got.get(node, []) == np.flatnonzero((s >= low) & (s <= high)).tolist()
    assert made < 0.5 * scores.size


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 3))
    tree = H.SpanningTree(x, np.arange(40))
    edges = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(40) for j in range(i))
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for d, i, j in edges:  # Kruskal
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert sum(e for c in tree.children.values() for _, e in c) == pytest.approx(total)
    same = H.SpanningTree(np.zeros((9, 2)), np.arange(9))
    assert sorted(i for c in same.children.values() for i, _ in c) == sorted(set(range(9)) - {same.root})


def test_exact_products():
    q, x = np.floor(64 * np.array([[2e6], [1.0]])), np.floor(64 * np.array([[3e6], [1.5e6], [-2.0]]))
    assert V.products(q, x).tolist() == [[24576000000000000, 12288000000000000, -16384000000], [12288000000, 6144000000, -8192]]
    rng = random.Random(1)
    for size in (2**20, 2**27, 2**40):
        a = [[float(rng.randint(-size, size)) if rng.random() < 0.2 else float(rng.randint(-9, 9)) for _ in range(5)] for _ in range(20)]
        b = [[float(rng.randint(-2**20, 2**20)) if rng.random() < 0.2 else float(rng.randint(-9, 9)) for _ in range(5)] for _ in range(30)]
        want = [[sum(int(s) * int(t) for s, t in zip(u, v)) for v in b] for u in a]
        assert V.products(np.array(a), np.array(b)).tolist() == want
    with pytest.raises(OverflowError):
        V.products(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert V.products(np.array([[2.0**70, 0.0]]), np.array([[0.0, 2.0**70]])).tolist() == [[0]]


def test_large_components(spark):
    rows = [(0, 1, [2e6], 1), (1, 1, [3e6], 1), (2, 2, [2.9e6], 1), (3, 2, [2.9e6 + 1 / 256], 1), (4, 2, [1.5e6], 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(r) for r in H.mine(H.prepared(d)).collect()) == brute(rows, 100)


def test_edges(spark):
    assert H.mine(H.prepared(spark.createDataFrame([], SCHEMA))).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0], 1), (1, 2, [1.0], 1)], SCHEMA)
    assert H.mine(H.prepared(alone)).count() == 0  # no positive
    clash = spark.createDataFrame([(0, 1, [1.0], "a", 1.0), (1, 1, [1.0], "a", 1.0), (2, 2, [0.9], "b", 1.0)], "vec_id long, label int, embedding array<double>, Label string, v double")
    assert [tuple(r) for r in H.mine(H.prepared(clash)).collect()] == [(0, 1, 1, 2, 65536, 58880)]


def test_query_against_sql(spark):
    got = H.op13_hard_negatives(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({H.ORACLE})").fetchall()
    assert len(want) and Counter(tuple(r) for r in got.collect()) == Counter(want)
