"""Operator 10: quality classifier on random-indexing word vectors.

Tokens: every chunk between ASCII white space gives its lower-cased core (a word) and its
shape (runs of capitals, small letters, digits and other signs). Random indexing over all
documents: a document has a sparse random index vector drawn from a hash of its text; the
vector of a word or shape is the sum of the index vectors of the documents it occurs in,
times its count there, brought to unit length. Every word has a vector of its own, keyed by
a 64-bit hash of its bytes (among 10^10 words, three pairs or so would meet): tasks add up the words of their own texts
and hand them on in packed blocks, one for every part of the words (about one part for
``PART_DOCS`` documents, so a part has the same size at any size of the corpus), a word of few
texts as text numbers and counts, others as sums; each part is then sorted and added up by
itself. Words of a single document have no vector (they count in the length alone).

A document's features are the mean and the spread of its tokens' vectors, the share of
tokens that have one and the log of its length. The ``FREQUENT`` words of most documents (a bounded table) are broadcast and pooled
where the text is read; all other words leave it as (row, word, count), are joined with
their vectors by word and pooled per row, so that no word is left out and none is hot. A
bit table of fixed size (``BLOOM`` bytes) holds back most words without a vector before that
join, which alone decides. All sums are of whole numbers: the result does not depend on
their order.

A two-layer network in numpy is fitted to about ``TRAIN_ROWS`` labelled rows at most outside the
held-out quarter (chosen by hashes; labels of one id and value are one row with their number
as weight); a fifth of them is set aside to fit the temperature by which its output is
divided; the probabilities of ``STARTS`` networks are averaged.

Edge cases: null is the empty text, whose features are zero; without labels, or with one
class only, the score is the smoothed share of label 1 (0.5 without any); labels of
unknown ids, null ids or null qualities are ignored, repeated ones count each; repeated
rows score alike; very long texts are read whole; an empty table gives an empty result;
other columns, also of clashing names, are not looked at.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onramp.session import materialize

from .common import in_fold, pick, raw_bytes, table

DIM = 48
NONZERO = 6          # of a document's index vector (places may coincide)
WIDTH = 2 * DIM + 2  # features of a document
HELD_PAIRS = 4_000_000  # (text, word) pairs a task holds before it hands its words on
FEW = 4              # a word of so many of a task's texts is handed on text by text
PART_DOCS = 4096
BLOOM = 8 << 20
FREQUENT = 1 << 18   # words that are broadcast (56 bytes each)
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
STARTS = (7, 8, 9)    # networks from several starts, whose probabilities are averaged
CACHED = 200_000     # chunks whose word and shape a task remembers
CUT = 0.7

# byte classes: capitals, small letters (and all bytes of other scripts), digits; others as they are
CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
repeated = re.compile(rb"(.)\1+", re.S).sub


def shape(chunk: bytes) -> bytes:
    """Classes of the bytes, runs of one class once: ``Word,`` is Aa, and ``WORD!!`` A!"""
    return repeated(rb"\1", chunk.translate(CLASSES))


class Keys(dict):
    """64-bit keys of tokens under ``kind`` and a reduction, remembered up to ``CACHED`` tokens."""

    def __init__(self, kind: bytes, reduced) -> None:
        self.kind, self.reduced = kind, reduced

    def __missing__(self, token: bytes) -> int:
        got = xxhash.xxh64_intdigest(self.kind + self.reduced(token))
        if len(self) >= CACHED:
            self.clear()
        if len(token) <= 64:
            self[token] = got
        return got


class Tokens:
    """Words and shapes of texts as keys: a word by its chunk in small letters, a shape by its
    byte classes, of which there are few."""

    def __init__(self) -> None:
        self.words = Keys(b"w", lambda chunk: chunk.strip(SIGNS))
        self.shapes = Keys(b"s", lambda own: repeated(rb"\1", own))

    def keys(self, text: bytes | None) -> tuple[list[int], list[int]]:
        text = text or b""
        return list(map(self.words.__getitem__, text.lower().split())), list(map(self.shapes.__getitem__, text.translate(CLASSES).split()))

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, key, occurrences), by place and key."""
        own = [self.keys(t) for t in texts]
        sizes = [len(w) for w, _ in own]
        owner = np.tile(np.repeat(np.arange(len(texts), dtype=np.int32), sizes), 2)
        keys = np.concatenate([np.fromiter((k for o in own for k in o[i]), np.uint64, sum(sizes)) for i in (0, 1)])
        order = np.lexsort((keys, owner))
        owner, keys = owner[order], keys[order]
        if not len(keys):
            return owner, keys, np.zeros(0, np.int32)
        starts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))))
        return owner[starts], keys[starts], np.diff(starts, append=len(keys)).astype(np.int32)


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors, a row for every 64-bit text hash."""
    i = np.arange(NONZERO, dtype=np.uint64)
    place = ((hashes[:, None] >> (8 * i)) & np.uint64(255)).astype(np.int64) * DIM >> 8
    return place, 1 - 2 * ((hashes[:, None] >> (48 + i)) & np.uint64(1)).astype(np.int64)


def rows_of(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equal lengths as a matrix of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def bits_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a bit table."""
    return ((keys >> np.uint64(8)) % np.uint64(bits)).astype(np.int64), ((keys >> np.uint64(36)) % np.uint64(bits)).astype(np.int64)


def added_up(at: np.ndarray, size: int, texts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of ``texts`` (hashes) times ``n`` at the places ``at``."""
    total = np.zeros((size, DIM), np.int64)
    place, sign = index_vectors(texts)
    np.add.at(total, (at[:, None], place), sign * n[:, None])
    return total


def planes(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: the upper bytes are nearly all zero."""
    return np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


class Words:
    """Words of a task's texts, until they are handed on."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.held: list[tuple] = []
        self.pairs = 0

    def add(self, texts: list[bytes | None], tokens: Tokens) -> None:
        owner, keys, n = tokens.counts(texts)
        self.held.append((owner + len(self.hashes), keys, n))
        self.hashes += [xxhash.xxh64_intdigest(t or b"") for t in texts]
        self.pairs += len(keys)

    def blocks(self, parts: int):
        """(part, packed block) of all words held."""
        owner, keys, n = (np.concatenate(c) for c in zip(*self.held))
        if not len(keys):
            return
        hashes, part = np.array(self.hashes, np.uint64), (keys % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((keys, part))
        owner, keys, n, part = owner[order], keys[order], n[order], part[order]
        for a, b in zip(bounds := np.flatnonzero(np.diff(part, prepend=-1)), [*bounds[1:], len(part)]):
            names, at, df = np.unique(keys[a:b], return_inverse=True, return_counts=True)
            few = df <= FEW
            single = few[at]
            used, text = np.unique(owner[a:b][single], return_inverse=True)
            place = np.cumsum(~few) - 1  # of the others among themselves
            total = added_up(place[at[~single]], int((~few).sum()), hashes[owner[a:b][~single]], n[a:b][~single].astype(np.int64))
            block = (planes(names[few]), df[few].astype(np.uint8), text.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), n[a:b][single], hashes[used],
                     planes(names[~few]), df[~few].astype(np.int32), total.astype(np.int32))
            yield int(part[a]), zstandard.ZstdCompressor(level=6).compress(pickle.dumps(block, protocol=5))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, df, sums) of a block."""
    few, df_few, text, n, hashes, many, df_many, total = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
    few, many = from_planes(few), from_planes(many)
    own = added_up(np.repeat(np.arange(len(few)), df_few), len(few), hashes[text], n.astype(np.int64))
    return np.concatenate((few, many)), np.concatenate((df_few.astype(np.int64), df_many)), np.concatenate((own, total.astype(np.int64)))


def word_vectors(texts: DataFrame) -> tuple[DataFrame, list[bytes]]:
    """(key, df, v) of every word and shape of two or more texts, v holding DIM signed bytes;
    and the bit tables of these words, one a part."""
    parts = max(1, -(-texts.count() // PART_DOCS))
    bits = 8 * max(1, BLOOM // parts)

    def sums(batches):
        tokens, words = Tokens(), Words()
        for b in batches:
            words.add(raw_bytes(b, "text"), tokens)
            if words.pairs >= HELD_PAIRS:
                yield handed(words)
                words = Words()
        if words.pairs:
            yield handed(words)

    def handed(words):
        own = list(words.blocks(parts))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["part", "block"])

    def added(group: pa.Table) -> pa.Table:
        keys, dfs, total = zip(*map(unpack, group.column("block").to_pylist()))
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        df, v = np.zeros(len(keys), np.int64), np.zeros((len(keys), DIM), np.int64)
        np.add.at(df, at, np.concatenate(dfs))
        np.add.at(v, at, np.concatenate(total))
        some = np.flatnonzero(df >= 2)
        v = np.rint(127 * v[some] / np.maximum(np.linalg.norm(v[some], axis=1, keepdims=True), 1e-9)).astype(np.int8)
        table_of_bits = np.zeros(bits, bool)
        for places in bits_of(keys[some], bits):
            table_of_bits[places] = True
        words = pa.StructArray.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(df[some]), pa.array([r.tobytes() for r in v], pa.binary())], names=["key", "df", "v"])
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(table_of_bits).tobytes()], pa.binary()),
                         "words": pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), words)})

    blocks = texts.select("text").mapInArrow(sums, "part int, block binary").repartition(parts, "part")
    found = materialize(blocks.groupBy("part").applyInArrow(added, "part int, bits binary, words array<struct<key:long,df:long,v:binary>>"), "word-vectors")
    tables = [bytes(max(1, BLOOM // parts))] * parts
    for r in found.select("part", "bits").collect():  # ``BLOOM`` bytes in all
        tables[r.part] = bytes(r.bits)
    return found.select(F.explode("words").alias("w")).select("w.key", "w.df", "w.v"), tables


def packed_sums(x: np.ndarray) -> bytes:
    """Whole numbers in four bytes each where they fit."""
    return (x.astype(np.int32) if x.max(initial=0) < 2**31 and x.min(initial=0) >= -2**31 else x).tobytes()


def unpacked_sums(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * (2 * DIM + 1) else np.int64).astype(np.int64)


def features(docs: DataFrame, words: DataFrame, tables: list[bytes], frequent: int = FREQUENT) -> DataFrame:
    """(row, doc_id, x): the features of every document as packed floats, ``row`` its number."""
    top = words.orderBy(F.desc("df"), "key").limit(frequent).select("key", "v").orderBy("key").toArrow()  # at most ``frequent`` rows
    known_keys = top.column("key").to_numpy()
    spec = docs.sparkSession.sparkContext.broadcast((known_keys, b"".join(top.column("v").to_pylist()), np.frombuffer(b"".join(tables), np.uint8), len(tables)))

    def pooled(batches):
        tokens, (known, raw, table_of_bits, parts) = Tokens(), spec.value
        v, size = np.frombuffer(raw, np.int8).reshape(-1, DIM), len(table_of_bits) // parts
        for b in batches:
            owner, keys, n = tokens.counts(raw_bytes(b, "text"))
            own, n = keys.view(np.int64), n.astype(np.int64)
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            total, sums = np.bincount(owner, n, b.num_rows).astype(np.int64), []
            ends = np.searchsorted(owner[hit], np.arange(b.num_rows + 1))
            at, c = at[hit], n[hit].astype(np.float64)
            for i, j in zip(ends, ends[1:]):
                w = v[at[i:j]].astype(np.float64)  # whole numbers below 2^53
                sums.append(packed_sums(np.concatenate((c[i:j] @ w, c[i:j] @ (w * w), [c[i:j].sum()])).astype(np.int64)))
            may = ~hit
            base = (keys % np.uint64(parts)).astype(np.int64) * size
            for places in bits_of(keys, 8 * size):
                may &= (table_of_bits[base + (places >> 3)] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
            ends = np.cumsum(np.bincount(owner[may], minlength=b.num_rows))
            rest = pa.StructArray.from_arrays([pa.array(own[may]), pa.array(n[may])], names=["key", "n"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total), pa.array(sums, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), rest)], names=["doc_id", "total", "sums", "rest"])

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("total", T.LongType()), T.StructField("sums", T.BinaryType()),
                           T.StructField("rest", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])))])
    own = materialize(docs.select("doc_id", "text").mapInArrow(pooled, schema).withColumn("row", F.monotonically_increasing_id()), "pooled-words")
    rest = own.select("row", F.explode("rest").alias("r")).select("row", F.col("r.key").alias("k"), "r.n").join(words.select("key", "v"), F.col("k") == F.col("key"))
    # a document's own sums first, then its other words
    both = own.select("row", F.lit(0).alias("kind"), "doc_id", F.col("total").alias("n"), F.col("sums").alias("v")).unionByName(
        rest.select("row", F.lit(1).alias("kind"), F.lit(None).cast(id_type).alias("doc_id"), "n", "v"))

    def finished(batches):
        held, out = None, []

        def vector(total, sums):
            if not total:
                return np.zeros(WIDTH)
            mean, square = sums[:DIM] / (127 * total), sums[DIM:2 * DIM] / (127 * 127 * total)
            return np.concatenate((mean, np.sqrt(np.maximum(square - mean * mean, 0)), [sums[2 * DIM] / total, np.log1p(total) / 10]))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], kind_of_id),
                                               pa.array([vector(*o[2:]).astype(np.float32).tobytes() for o in out], pa.binary())], names=["row", "doc_id", "x"])

        for b in batches:
            if not b.num_rows:
                continue
            kind_of_id = b.column("doc_id").type
            at, first, n = b.column("row").to_numpy(), b.column("kind").to_numpy() == 0, b.column("n").to_numpy()
            v, more = b.column("v").to_pylist(), np.flatnonzero(~first)
            added = {}
            if len(more):
                w, c = np.frombuffer(b"".join(v[i] for i in more), np.int8).reshape(-1, DIM).astype(np.int64), n[more][:, None]
                starts = np.flatnonzero(np.diff(at[more], prepend=-1))
                added = dict(zip(at[more][starts].tolist(), np.add.reduceat(np.concatenate((c * w, c * w * w, c), axis=1), starts, axis=0)))
            if held is not None and held[0] in added:
                held[3][:] += added[held[0]]
            for i in np.flatnonzero(first):
                if held is not None:
                    out.append(held)
                row = int(at[i])
                held = (row, b.column("doc_id")[int(i)].as_py(), int(n[i]), unpacked_sums(v[i]) + added.get(row, 0))
            if len(out) >= 2000:
                yield rows()
                out = []
        if held is not None:
            out.append(held)
            yield rows()

    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("x", T.BinaryType())])
    return materialize(both.repartition("row").sortWithinPartitions("row", "kind").mapInArrow(finished, out), "quality-features")


class Net:
    """tanh layer, logistic output, divided by a temperature. Without two classes: a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 7) -> None:
        weight = np.ones(len(y)) if weight is None else weight
        self.constant = (float(weight @ y) + 0.5) / (float(weight.sum()) + 1) if len(y) else 0.5
        self.usable = len(set(y.tolist())) == 2
        if not self.usable:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        aside, fit = order[: len(y) // 5], order[len(y) // 5:]
        if len(set(y[fit].tolist())) < 2:
            fit = order
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        x = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(x[part] @ self.p[0] + self.p[1])
                err = (sigmoid(h @ self.p[2] + self.p[3]) - y[part]) * weight[part] / weight[part].sum()
                back = np.outer(err, self.p[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ err + 1e-4 * self.p[2], np.array([err.sum()])]
                step += 1
                for p, g, a, b in zip(self.p, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(aside):
            z, t = self._logit(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
            self.temperature = float(grid[np.argmin([weight[aside] @ np.logaddexp(0, np.where(t == 1, -z, z) / g) for g in grid])])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.constant)
        return sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


class Nets:
    """The mean of the networks of all ``STARTS``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.nets = [Net(x, y, weight, seed) for seed in STARTS]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([net.score(x) for net in self.nets], axis=0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def under(share: float, *cols) -> F.Column:
    """A hash of the columns falls into this share of all hashes."""
    return F.xxhash64(*cols) <= min(2**63 - 1, int(-2**63 + min(1.0, share) * 2**64))


def train(rows: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Nets:
    """The networks from a bounded sample of the labelled ``features`` rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~in_fold(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id", "quality").agg(F.count("*").alias("weight")).withColumnRenamed("doc_id", "labelled")
    some = known.filter(under(most / max(1, known.count()), "labelled", "quality"))  # about ``most`` rows at most, broadcast
    mine = rows.join(F.broadcast(some), F.col("doc_id") == F.col("labelled"))
    # many documents may share an id
    mine = mine.filter(under(1.2 * most / max(1, mine.count()), "row", "quality", F.lit(1))).select("x", "quality", "weight")
    got = sorted((bytes(r.x), int(r.quality), r.weight) for r in mine.collect())
    x = np.array([np.frombuffer(r[0], np.float32) for r in got]).reshape(len(got), WIDTH).astype(np.float64)
    return Nets(x, np.array([r[1] for r in got], np.float64), np.array([r[2] for r in got], np.float64))


def score(rows: DataFrame, net: Nets) -> DataFrame:
    """doc_id, score and predicted of every ``features`` row."""
    spec = rows.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            s = spec.value.score(rows_of(b.column("x"), np.float32).astype(np.float64)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=schema.names)

    return rows.select("doc_id", "x").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    d = pick(docs, doc_id=id_col, text=text_col)
    rows = features(d, *word_vectors(d), frequent)
    scored = score(rows, train(rows, pick(labels, doc_id="doc_id", quality="quality")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
