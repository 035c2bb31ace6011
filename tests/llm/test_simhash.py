import random
from collections import Counter

import pytest
import xxhash

from onramp.llm import simhash as S
from onramp.session import materialize


def brute_fp(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, d):
    """fps: {id: fp}; smallest id reachable."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= d:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "two Words", "É é x y z w", "a b c d e f a b c", "x" * 50_000])
def test_fingerprint(text):
    raw = None if text is None else text.encode()
    assert S.fingerprint(raw, 3) == signed(brute_fp(text, 3))


@pytest.mark.parametrize("hot", [1, 12])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_against_all_pairs(spark, monkeypatch, hot, distance):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.choice([0, 1, 2, 25])):
            fps.append(rng.choice(fps[-5:]) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.6) << rng.randrange(64))
    fps = sorted({f for f in fps})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = S.components(S.links(df, distance)).collect()
    own = {i: signed(f) for i, f in enumerate(fps)}
    roots = brute_components({v: v & (1 << 64) - 1 for v in own.values()}, distance)
    sizes = Counter(roots.values())
    assert {(r.node, r.root) for r in got} == {(v, r) for v, r in roots.items() if sizes[r] > 1 and v != r}


@pytest.mark.parametrize("distance", [1, 2])
def test_exploded_tables_are_not_broadcast(spark, monkeypatch, distance):
    """However small the fingerprints are: the index and the flips are some 66 times that."""
    written = []

    def noted(df, name):
        written.append(df)
        return materialize(df, name)

    monkeypatch.setattr(S, "materialize", noted)
    monkeypatch.setattr(S, "HOT", 3)
    fps = materialize(spark.createDataFrame([(f,) for f in [1, 3, 5, 7, 9, 1 << 40, 3 << 40]], "fp long"), "few")
    found = S.links(fps, distance)
    for df in [*written, found]:
        plan = lambda: df._jdf.queryExecution().executedPlan().toString()  # noqa: B023, E731
        assert "Join" in plan() and "Broadcast" not in plan()
        df.collect()
        assert "Broadcast" not in plan()  # nor by sizes measured on the way


def test_distance_refused(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_edges(spark):
    rows = [(5, None, 1), (3, "", 1), (9, "the same words here", 2), (8, "the  SAME words\there", 2), (8, "the same words here", 2), (None, " ", 3)]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, FP int")).collect()
    assert sorted(((r.id if r.id is not None else -1), r.component) for r in out) == [(-1, 3), (3, 3), (5, 3), (8, 8), (8, 8), (9, 8)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = {r.doc_id: r for r in S.op7_simhash(spark, "/root/testdata/sf0.01").collect()}
    fps = {i: int(r.fingerprint, 16) for i, r in out.items()}
    for i in list(docs)[:80]:
        assert fps[i] == brute_fp(docs[i], 3)
    assert {i: r.component_id for i, r in out.items()} == brute_components(fps, 2)
