import math
import random

import numpy as np
import pytest

from onramp.llm import balltree as B


def brute(rows, k, every):
    fine = [(i, v) for i, (i_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) for i in [i]]
    ints = {i: [math.floor(64 * x) for x in v] for i, v in fine}
    out = []
    for q in ints:
        name = rows[q][0]
        if name is None or name % every:
            continue
        got = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), rows[c][0] if rows[c][0] is not None else B.NO_ID) for c in ints if c != q)[:k]
        out += [(name, r + 1, None if i == B.NO_ID else i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(v, i, 1) for i, v in rows], "embedding array<double>, vec_id long, RANK int")
    return sorted((tuple(r) for r in B.top_k(B.prepared(df), **kw).collect()), key=str)


@pytest.mark.parametrize("big", [1.0, 1e5])
def test_against_all_pairs(spark, big):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [big * (c + rng.gauss(0, 0.2)) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)] + [(0, rows[5][1]), (20, [1.0]), (40, []), (None, rows[9][1]), (60, None), (80, [None, 1.0]),
             (100, [float("nan")] * 8), (120, [float("inf")] * 8)]
    for kw in ({"shard_rows": 100}, {"shard_rows": 30, "pass_rows": 5, "pivots": 2}, {"pass_bytes": 64}):
        assert run(spark, rows, k=7, every=20, leaf=8, **kw) == brute(rows, 7, 20)


def test_large_components_are_exact(spark):
    rows = [(0, [2e6]), (1, [3e6]), (2, [1.5e6]), (3, [-1.0])]
    assert run(spark, rows)[:2] == [(0, 1, 1, 24576000000000000), (0, 2, 2, 12288000000000000)]
    assert run(spark, rows) == brute(rows, 20, 20)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [*rows, (40, [1e300])])


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (3, [2.0])]) == [(0, 1, 3, 64 * 128)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_pruning_saves_work():
    rng = np.random.default_rng(0)
    x = np.floor(64 * np.concatenate([rng.normal(c, 0.05, (500, 16)) for c in rng.normal(0, 1, (10, 16))]))
    s, _, made = B.search(x[:50], np.arange(50), np.full(50, B.LOW), x, np.arange(5000), np.arange(5000), 10, B.BallTree(x, 100))
    x = x.astype(np.int64)
    full = x[:50] @ x.T
    full[np.arange(50), np.arange(50)] = B.LOW
    assert (np.sort(full, axis=1)[:, ::-1][:, :10] == s).all()
    assert made < 0.5 * 50 * 5000
