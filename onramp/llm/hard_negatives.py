"""Operator 13: hard negatives by anchor spanning-tree bounds.

Components become floor(256 x). Every ``EVERY``-th id is an anchor; its positives are its
first rows of the same label by inner product, and for each positive the first rows of
another label in a window of scores below the positive's are its hard negatives.

Anchors are taken in passes of bounded size (``PASS_ROWS``, ``PASS_BYTES``), each broadcast
to one scan of the rows without a shuffle. In a pass near anchors are gathered into groups
of at most ``GROUP`` (halving along the direction of widest spread) and each group is joined
into a minimum spanning tree. In a task the root's scores are made for all rows; from then
on the score of a child differs from that of its parent by at most the length of their edge
times the norm of the row, so every row has an interval, and only rows whose interval meets
the child's window are scored again (their interval becomes a point, for the children).
For positives the window begins at the worst score kept so far, and trees hold anchors of one
label and see rows of that label alone; for negatives the window is the union of the windows
of the anchor's positives, each from the larger of its lower end and its worst score kept.

Both steps look at a share of 1 / ``HOME`` of the rows first; the k-th scores found there
begin the search of all other rows, so that tasks return few rows. Bounds are widened by
more than their rounding error; scores are exact (see ``vectors.products``).

Edge cases: rows with a null label or vector, or a null, NaN or infinite component take no
part; missing components of shorter vectors count as zero; ties go to the smaller vec_id, a
null vec_id comes last and is no anchor; rows with equal ids are rows of their own (an
anchor leaves out only itself); an anchor without positives, or with negative positive
scores only, gives no rows; an inner product beyond a long raises ``OverflowError``; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from onramp.session import materialize

from .common import pick, table
from .vectors import LOW, NO_ID, as_matrix, best, blocks, complete, matrix, products, scaled

FACTOR = 256.0
EVERY = 100
POSITIVES, NEGATIVES = 5, 5
WINDOW = (80, 100)           # per cent of the positive's score
PASS_ROWS, PASS_BYTES = 16_384, 16 << 20
GROUP = 512
CHUNK = 4096                 # rows scored together
HOME = 16


def prepared(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """(rid, vec_id, label, v): the rows that take part, with whole components."""
    d = pick(vectors, vec_id=id_col, label=label_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    d = d.filter(F.col("label").isNotNull() & complete(F.col("v")))
    return materialize(d.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
                                F.col("label").cast("long").alias("label"), scaled(F.col("v"), factor).alias("v")), "hard-negative-rows")


# --- trees of anchors --------------------------------------------------------------------

def grouped(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Halves along the direction of widest spread until no group has more than ``most``."""
    if len(rows) <= most:
        return [rows] if len(rows) else []
    own = x[rows]
    one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    other = own[((own - one) ** 2).sum(axis=1).argmax()]
    order = np.argsort(own @ (other - one), kind="stable")
    half = len(rows) // 2
    return grouped(x, rows[order[:half]], most) + grouped(x, rows[order[half:]], most)


class SpanningTree:
    """Minimum spanning tree of some anchors (Prim), children with the lengths of their edges."""

    def __init__(self, x: np.ndarray, rows: np.ndarray) -> None:
        own = x[rows]
        self.root = int(rows[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()])
        self.children: dict[int, list[tuple[int, float]]] = {int(r): [] for r in rows}
        near = np.sqrt(((own - x[self.root]) ** 2).sum(axis=1))
        parent = np.full(len(rows), self.root)
        near[rows == self.root] = np.inf
        for _ in range(len(rows) - 1):
            i = int(near.argmin())
            self.children[int(parent[i])].append((int(rows[i]), float(near[i])))
            d = np.sqrt(((own - own[i]) ** 2).sum(axis=1))
            closer = (d < near) & np.isfinite(near)
            near[closer], parent[closer] = d[closer], rows[i]
            near[i] = np.inf


def visit(tree: SpanningTree, a: np.ndarray, norms: np.ndarray, x: np.ndarray, window, take) -> int:
    """Brings every row of ``x`` whose score may lie in ``window(anchor)`` to ``take(anchor,
    rows, scores)``, from parents to children; returns the number of products made."""
    length = np.sqrt((x * x).sum(axis=1))
    made, waiting = 0, [(tree.root, None, None, 0.0, 0.0)]
    while waiting:
        node, low, high, edge, above = waiting.pop()
        first, last = window(node)
        if low is None:
            rows = np.arange(len(x))
            low, high = np.empty(len(x)), np.empty(len(x))
        else:
            slack = edge * length + 1e-9 * (above + norms[node]) * length + 1e-3
            slack[np.isnan(slack)] = np.inf
            low, high = low - slack, high + slack
            rows = np.flatnonzero((high >= first) & (low <= last))
        if len(rows):
            s = products(a[node:node + 1], x[rows])[0]
            made += len(rows)
            low[rows] = high[rows] = s
            inside = (s >= first) & (s <= last)
            if inside.any():
                take(node, rows[inside], s[inside])
        waiting += [(child, low, high, e, norms[node]) for child, e in tree.children[node]]
    return made


class Pass:
    """Anchors of one pass with their trees; broadcast."""

    def __init__(self, anchors: list, group: int = GROUP) -> None:
        self.x = as_matrix([r.v for r in anchors])
        self.rid = np.array([r.rid for r in anchors], np.int64)
        self.label = np.array([r.label for r in anchors], np.int64)
        self.norms = np.sqrt((self.x**2).sum(axis=1))
        self.by_label = {int(k): [SpanningTree(self.x, g) for g in grouped(self.x, np.flatnonzero(self.label == k), group)] for k in np.unique(self.label)}
        self.mixed = [SpanningTree(self.x, g) for g in grouped(self.x, np.arange(len(anchors)), group)]


class Kept:
    """The k best (score, id) of every list so far; ``least`` is the k-th score of a full list,
    or what is known of it beforehand."""

    def __init__(self, k: int, least: dict) -> None:
        self.k, self.least, self.lists = k, dict(least), {}

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = self.lists.get(key, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        s, i = np.concatenate((s, scores)), np.concatenate((i, ids))
        top = best(s, i, self.k)
        self.lists[key] = s[top], i[top]
        if len(top) == self.k:
            self.least[key] = max(self.least.get(key, LOW), int(s[top[-1]]))


def positives_of(p: Pass, kept: Kept, rid, ids, labels, x) -> int:
    made = 0
    for k in np.unique(labels):
        own = np.flatnonzero(labels == k)
        for tree in p.by_label.get(int(k), ()):
            def take(node, rows, s):
                other = rid[own[rows]] != p.rid[node]
                kept.add((node, 0), s[other], ids[own[rows]][other])

            made += visit(tree, p.x, p.norms, x[own], lambda node: (kept.least.get((node, 0), LOW), np.inf), take)
    return made


def negatives_of(p: Pass, kept: Kept, wanted: dict, rid, ids, labels, x) -> int:
    def window(node):
        ends = [(max(low, kept.least.get((node, j), LOW)), high) for j, (low, high) in wanted.get(node, {}).items()]
        return (min(a for a, _ in ends), max(b for _, b in ends)) if ends else (np.inf, -np.inf)

    def take(node, rows, s):
        other = labels[rows] != p.label[node]
        for j, (low, high) in wanted[node].items():
            fits = other & (s >= max(low, kept.least.get((node, j), LOW))) & (s <= high)
            if fits.any():
                kept.add((node, j), s[fits], ids[rows][fits])

    return sum(visit(tree, p.x, p.norms, x, window, take) for tree in p.mixed)


# --- Spark ------------------------------------------------------------------------------

FOUND = "anchor int, list int, vec_id long, score long"


def searched(rows: DataFrame, spec, k: int) -> DataFrame:
    """(anchor, list, vec_id, score): the k best of every list in every part of ``rows``."""
    def run(batches):
        p, least, wanted = spec.value
        kept = Kept(k, least)
        chunk, n = [], 0

        def flush():
            rid, ids, labels = (np.concatenate([b.column(c).to_numpy() for b in chunk]) for c in ("rid", "vec_id", "label"))
            parts = [matrix(b.column("v"), p.x.shape[1]) for b in chunk]
            width = max(m.shape[1] for m in parts)
            x = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in parts])
            if wanted is None:
                positives_of(p, kept, rid, ids, labels, x)
            else:
                negatives_of(p, kept, wanted, rid, ids, labels, x)

        for b in batches:
            chunk.append(b)
            n += b.num_rows
            if n >= CHUNK:
                flush()
                chunk, n = [], 0
        if n:
            flush()
        if kept.lists:
            keys = list(kept.lists)
            sizes = [len(kept.lists[key][0]) for key in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([key[0] for key in keys], sizes), pa.int32()), pa.array(np.repeat([key[1] for key in keys], sizes), pa.int32()),
                 pa.array(np.concatenate([kept.lists[key][1] for key in keys]), pa.int64()), pa.array(np.concatenate([kept.lists[key][0] for key in keys]), pa.int64())],
                names=["anchor", "list", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "list").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_all(rows: DataFrame, p: Pass, k: int, wanted: dict | None, name: str) -> DataFrame:
    """The k best of every list over all rows: a share first, then the others with its k-th scores."""
    sc = rows.sparkSession.sparkContext
    home = F.pmod(F.xxhash64("rid"), F.lit(HOME)) == 0
    first = materialize(ranked(searched(rows.filter(home), sc.broadcast((p, {}, wanted)), k), k), name)
    least = {(r.anchor, r["list"]): r.score for r in first.filter(F.col("rank") == k).collect()}  # at most one a list of this pass
    return ranked(first.drop("rank").unionByName(searched(rows.filter(~home), sc.broadcast((p, least, wanted)), k)), k)


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
         pass_rows: int = PASS_ROWS, pass_bytes: int = PASS_BYTES, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``prepared`` rows."""
    anchors = rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))
    spark, out = rows.sparkSession, []
    for block in blocks(anchors, pass_rows, pass_bytes):
        p = Pass(block, group)
        found = search_all(rows, p, positives, None, "positives").collect()  # at most ``positives`` an anchor of this pass
        wanted: dict[int, dict] = {}
        pairs = []
        for r in found:
            low, high = -(-window[0] * r.score // 100), window[1] * r.score // 100
            pairs.append((r.anchor, r.rank, block[r.anchor].vec_id, r.vec_id, r.score))
            if low <= high:
                wanted.setdefault(r.anchor, {})[r.rank] = (low, high)
        if not wanted:
            continue
        named = spark.createDataFrame(pairs, "a int, l int, anchor_id long, positive_id long, positive_score long")
        lists = search_all(rows, p, negatives, wanted, "negatives")
        # one row a list of this pass on the broadcast side
        made = lists.join(F.broadcast(named), (F.col("anchor") == F.col("a")) & (F.col("list") == F.col("l")))
        out.append(materialize(made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                                           "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every_pass = reduce(DataFrame.unionByName, out)
    return every_pass.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("positive_id", "negative_id")})


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """All of ``embeddings``; every seventh id has its label moved on by one first."""
    given = pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", label="label", embedding="embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(given.withColumn("label", moved)))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % {EVERY} = 0 AND a.rid <> c.rid),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place
      FROM s WHERE alike QUALIFY place <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (rid, anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= {NEGATIVES}"""
