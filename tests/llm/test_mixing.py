from collections import Counter, defaultdict

import pytest

from onramp.llm import mixing as M


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int")
    return M.plan(M.sized(docs)).collect()


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    stop, total = {s: 2 * sizes[s] for s in sizes}, 1.5 * sum(sizes.values())
    capped = set()
    while True:
        rest = sum(w[s] for s in sizes if s not in capped)
        if not rest:
            return {s: stop[s] for s in sizes}
        level = (total - sum(stop[s] for s in capped)) / rest
        new = {s for s in sizes if s not in capped and stop[s] <= level * w[s]}
        if not new:
            return {s: stop[s] if s in capped else level * w[s] for s in sizes}
        capped |= new


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_nearness(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "ä", "Z", None, "a"]), 0) for i in range(400)]
    rows += [(7, "same text here", "z", 1)] * 60 + [(None, None, "empty", 2)] * 3
    out = run(spark, rows)
    assert len(out) == len(rows)
    size, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert r.copies in (0, 1, 2)
    goal = brute_targets(size)
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source])
    for s in size:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2
    assert {r.copies for r in out if r.source == "empty"} == {1}
    again = run(spark, list(reversed(rows)))
    key = lambda o: sorted((str(r.doc_id), str(r.source), r.size, r.copies) for r in o)
    assert key(again) == key(out)


def test_equal_rows_are_split(spark):
    out = run(spark, [(1, "a b c", "s", 0)] * 1000)
    assert sum(r.copies for r in out) == 1500


def test_empty_and_documents(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(i, "w " * (i % 7), "s", i) for i in range(50)], "doc_id long, text string, source string, copies int")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    assert abs(sum(i % 7 for i in range(50)) * 1.5 - sum(len(r.text.split()) for r in out.collect())) <= 3
