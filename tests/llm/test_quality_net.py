import zlib

import numpy as np

from onramp.llm import quality_net as Q

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = Q.op10_quality(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    a = auc(*zip(*held))
    right = np.mean([(s >= 0.7) == y for s, y in held])
    print("held-out AUC", a, "accuracy", right, len(held))
    assert a > 0.97 and right > 0.95
    again = {r.doc_id: r.score for r in Q.op10_quality(spark, SF).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in out)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.1), (None, "a b", 0.2), (3, "x" * 100_000, 0.3), (3, "x y " * 50_000, 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.classify(docs, none).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None), (99, 0)], "doc_id long, quality int")
    assert len({r.score for r in Q.classify(docs, odd).collect()}) == 1
    assert Q.classify(docs.limit(0), none).count() == 0


def test_shapes():
    assert Q.shape(b"THEAHE!!") == b"A!" and Q.shape(b"ndre$$$") == b"a$" and Q.shape(b"A1,") == b"A0," and Q.shape("Éa".encode()) == b"a"
    own, key = Q.Tokens(), lambda x: Q.xxhash.xxh64_intdigest(x)
    place, keys, n = own.counts([b"one One, ONE!! x1", None, b"y" * 500, b""])
    got = {(int(p), int(k)): int(c) for p, k, c in zip(place, keys, n)}
    assert got == {(0, key(b"wone")): 3, (0, key(b"sa")): 1, (0, key(b"sAa,")): 1, (0, key(b"sA!")): 1, (0, key(b"wx1")): 1, (0, key(b"sa0")): 1,
                   (2, key(b"w" + b"y" * 500)): 1, (2, key(b"sa")): 1}


def tokens_of(text):
    """Word by word, without arrays."""
    out = {}
    for chunk in (text or "").encode().split():
        for k in (b"w" + chunk.lower().strip(Q.SIGNS), b"s" + Q.shape(chunk)):
            out[k] = out.get(k, 0) + 1
    return out


def brute_vectors(texts):
    """Random indexing word by word; keyed by the word itself."""
    total, df = {}, {}
    for t in texts:
        if t:
            place, sign = Q.index_vectors(np.array([Q.xxhash.xxh64_intdigest(t.encode())], np.uint64))
            for k, n in tokens_of(t).items():
                v = total.setdefault(k, np.zeros(Q.DIM))
                for p, s in zip(place[0], sign[0]):
                    v[p] += n * s
                df[k] = df.get(k, 0) + 1
    return {k: (df[k], np.rint(127 * v / max(np.linalg.norm(v), 1e-9)).astype(np.int8)) for k, v in total.items() if df[k] >= 2}


def brute_features(text, vectors):
    counts = tokens_of(text)
    total = sum(counts.values())
    if not total:
        return np.zeros(Q.WIDTH)
    every = np.array([vectors[k][1] / 127 if k in vectors else np.zeros(Q.DIM) for k, n in counts.items() for _ in range(n)])
    mean = every.sum(axis=0) / total
    return np.concatenate((mean, np.sqrt(np.maximum((every**2).sum(axis=0) / total - mean**2, 0)),
                           [sum(n for k, n in counts.items() if k in vectors) / total, np.log1p(total) / 10]))


def test_every_word_has_its_own_vector(spark):
    """All words of a table, against brute force; nothing is shared and nothing left out,
    however many words are broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, "word " * 40_000 + "tail"), (901, None), (902, ""), (903, "tail of words"), (None, "tail")], docs.schema))
    texts = [r.text for r in docs.collect()]
    want = brute_vectors(texts)
    old = Q.HELD_PAIRS, Q.PART_DOCS, Q.BLOOM
    try:
        Q.HELD_PAIRS, Q.PART_DOCS, Q.BLOOM = 500, 50, 1 << 12  # tasks hand on parts of a word's sum; small tables let many words through
        words, tables = Q.word_vectors(docs.repartition(3))
    finally:
        Q.HELD_PAIRS, Q.PART_DOCS, Q.BLOOM = old
    names = {int(np.uint64(Q.xxhash.xxh64_intdigest(k)).astype(np.int64)): k for k in want}
    got = {names[r.key]: (r.df, np.frombuffer(bytes(r.v), np.int8)) for r in words.collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k][0] == want[k][0] and (got[k][1] == want[k][1]).all() for k in want)
    for frequent in (0, 50, 1 << 17):
        rows = Q.features(docs, words, tables, frequent).collect()
        assert len(rows) == len(texts)
        expected = sorted((str(i), brute_features(t, want).round(5).tolist()) for i, t in ((r.doc_id, r.text) for r in docs.collect()))
        got = sorted((str(r.doc_id), np.frombuffer(bytes(r.x), np.float32).astype(float).round(5).tolist()) for r in rows)
        assert [i for i, _ in got] == [i for i, _ in expected] and np.allclose([x for _, x in got], [x for _, x in expected], atol=2e-5)


def test_labels_stay_bounded(spark):
    """A label repeated many times is one row with a weight; documents that share an id are sampled."""
    docs = spark.createDataFrame([(1, f"good words number {i}") for i in range(400)] + [(2, f"bad stuff {i}!!") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3000 + [(2, 0)] * 3000, "doc_id long, quality int")
    rows = Q.features(docs, *Q.word_vectors(docs))
    seen = []
    real = Q.Nets
    try:
        Q.Nets = lambda x, y, w: seen.append((len(y), w.tolist())) or real(x, y, w)
        net = Q.train(rows, labels, most=100)
    finally:
        Q.Nets = real
    assert 60 < seen[0][0] < 200 and set(seen[0][1]) == {3000.0}
    out = Q.score(rows, net).collect()
    assert all((r.score > 0.5) == (r.doc_id == 1) for r in out)
