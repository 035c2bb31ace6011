from collections import Counter

from onramp.llm import sharding as S


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, SLOT int")


def test_edges_and_slots(spark):
    rows = [(i, f"text {i}", "x", 1) for i in range(400)] + [(7, "same", None, None)] * 2500
    rows += [(None, None, None, None), (None, "", "y", 2), (-3, "é" * 1000, "z", 3)]
    out = S.assign_shards(docs(spark, rows), S.even_tree()).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard == r.shard or r.grown_shard == 24
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    one = next(r for r in out if r.doc_id == -3)
    assert one["size"] == 2008
    assert {r["size"] for r in out if r.doc_id is None} == {8}


def test_empty(spark):
    assert S.assign_shards(docs(spark, []), S.even_tree()).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(6000).selectExpr("cast(id as string) as key")
    a = S.Node("root", (S.Node("r0", (S.rack_of("r0k0", 0, [1, 2]), S.rack_of("r0k1", 2, [1, 1]))),
                        S.Node("r1", (S.rack_of("r1k0", 4, [3, 1]),))))
    b = S.Node("root", (S.Node("r0", (S.rack_of("r0k0", 0, [1, 2]), S.rack_of("r0k1", 2, [2, 1]))), a.children[1]))
    out = S.descend(S.descend(keys, "key", a, "old"), "key", b, "new").collect()
    n = Counter(r.old for r in out)
    for shard, w in {0: 1, 1: 2, 2: 1, 3: 1, 4: 3, 5: 1}.items():
        assert abs(n[shard] / len(out) - w / 9) < 0.03
    moved = [(r.old, r.new) for r in out if r.old != r.new]
    # shard 2 grew: rows move into its region, rack or shard, never between unchanged shards of other subtrees
    assert moved and all(new in (0, 1, 2, 3) for _, new in moved)
    assert not any(old in (0, 1) and new in (0, 1) for old, new in moved)
