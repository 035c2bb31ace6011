"""Operator 8: exact top-k inner products by ball-tree branch and bound per shard.

Components become floor(64 x). Rows go to the nearest of at most ``PIVOTS`` hash-chosen
rows (a bounded sample: it only shapes the shards); a pivot's rows are dealt by hash into as
many shards as keep each near ``SHARD_ROWS`` rows and ``SHARD_BYTES`` bytes, so a pivot with a
third of all rows, or that many copies of one vector, is split like any other. Every shard
is built into a ball tree once (halving along the direction of widest spread) and stored as
one row: tree and vectors packed, centre and radius of the root beside them.

Queries come in passes of at most ``PASS_ROWS`` rows and ``PASS_BYTES`` bytes, each broadcast to
the stored shards; no row is copied per query block. A pass first searches each query in
its own shard, where its near rows are; the k-th scores found there are shared with the
search of all other shards. A shard whose root's upper bound, q . centre + |q| radius, is
below a query's k-th score is not unpacked for it; within a tree queries go down together,
each first to the child with the higher bound, and leave a branch below their k-th score.

Scores are exact (see ``vectors.products``); bounds are widened by more than their rounding
error.

Edge cases: vectors that are null, or hold a null, NaN or infinite component, take no
part; missing components of shorter vectors count as zero, an empty vector is all zeros; an
inner product beyond a long raises ``OverflowError``; ties go to the smaller vec_id (a null
vec_id comes last, and is never a query); rows with equal vec_ids are rows of their own: a
query leaves out only itself; other columns, also of clashing names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from onramp.session import materialize

from .common import pick, table
from .vectors import LOW, NO_ID, as_matrix, blocks, complete, matrix, products, scaled, widened

K = 20
EVERY = 20             # rows whose id is divisible by this are queries
PIVOTS = 512
SHARD_ROWS, SHARD_BYTES = 16_384, 8 << 20
PASS_ROWS, PASS_BYTES = 16_384, 16 << 20
TOGETHER = 2048        # queries that go down a tree together
LEAF = 256


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(rid, vec_id, v): rows that take part, with whole components and a row number."""
    d = pick(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    d = d.filter(complete(F.col("v")))
    return materialize(d.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("v"), 64.0).alias("v")), "vectors")


class BallTree:
    """Nodes in arrays; a node covers rows first..last of ``self.order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.first, self.last, self.left, self.right, self.centre, self.radius = [], [], [], [], [], []
        self.root = self._build(x, 0, len(x), leaf) if len(x) else -1
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _build(self, f: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = f[self.order[a:b]]
        centre = own.mean(axis=0)
        dist = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(self.first)
        for to, value in ((self.first, a), (self.last, b), (self.left, -1), (self.right, -1), (self.centre, centre), (self.radius, dist.max())):
            to.append(value)
        if b - a > leaf and dist.max() > 0:
            one = own[dist.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            along = own @ (other - one)
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
            self.left[node] = self._build(f, a, a + half, leaf)
            self.right[node] = self._build(f, a + half, b, leaf)
        return node


def search(q: np.ndarray, qrid: np.ndarray, kth: np.ndarray, x: np.ndarray, rid: np.ndarray, vid: np.ndarray, k: int = K, tree: BallTree | None = None):
    """The k best rows of ``x`` for each query: (scores, ids, products made), padded with LOW
    and NO_ID. ``kth`` are scores already reached elsewhere: rows below them are not needed."""
    n, made = len(q), 0
    scores, ids = np.full((n, k), LOW, np.int64), np.full((n, k), NO_ID, np.int64)
    if not n or not len(x):
        return scores, ids, made
    tree = tree or BallTree(x)
    need = kth.copy()
    width = max(q.shape[1], x.shape[1])
    q, x, centres = widened(q, width), widened(x, width), widened(tree.centre, width)
    norm = np.sqrt((q**2).sum(axis=1))

    def leaf_scan(node: int, who: np.ndarray) -> None:
        nonlocal made
        rows = tree.order[tree.first[node]:tree.last[node]]
        own = products(q[who], x[rows])
        made += own.size
        own[qrid[who][:, None] == rid[rows][None, :]] = LOW  # a query leaves itself out
        names = np.where(own == LOW, NO_ID, np.broadcast_to(vid[rows], own.shape))
        s, i = np.concatenate((scores[who], own), axis=1), np.concatenate((ids[who], names), axis=1)
        top = np.lexsort((i, ~s), axis=1)[:, :k]
        scores[who], ids[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        need[who] = np.maximum(need[who], scores[who, -1])

    def visit(node: int, who: np.ndarray) -> None:
        # ties with the k-th score may still win by id
        who = who[upper(q[who], norm[who], centres[node], tree.radius[node]) >= need[who]]
        if not len(who):
            return
        a, b = tree.left[node], tree.right[node]
        if a < 0:
            leaf_scan(node, who)
            return
        near = upper(q[who], norm[who], centres[a], tree.radius[a]) >= upper(q[who], norm[who], centres[b], tree.radius[b])
        for group, order in ((who[near], (a, b)), (who[~near], (b, a))):
            if len(group):
                for child in order:
                    visit(child, group)

    for part in np.array_split(np.arange(n), -(-n // TOGETHER)):
        visit(tree.root, part)
    return scores, ids, made


def upper(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """Upper bounds of q . x over a ball, widened by more than rounding."""
    out = q @ centre + norm * radius + 1e-9 * norm * (np.sqrt((centre**2).sum()) + radius) + 1e-3
    return np.where(np.isnan(out), np.inf, out)


# --- Spark ------------------------------------------------------------------------------

def sharded(rows: DataFrame, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """(n, centre, radius, packed): one stored row per shard."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("v")), F.lit(1.0)).alias("width")).first()
    most = max(1, min(shard_rows, int(SHARD_BYTES // (8 * max(1.0, size.width)))))
    # one pivot a shard, up to PIVOTS; those with the smallest hashes
    some = min(pivots, -(-size.n // most))
    chosen = as_matrix([r.v for r in rows.select("v", F.xxhash64("rid").alias("h")).orderBy("h").limit(some).collect()])
    spec = spark.sparkContext.broadcast(chosen)

    def nearest(batches):
        for b in batches:
            p, x = spec.value, matrix(b.column("v"))
            width = max(p.shape[1], x.shape[1])
            p, x = widened(p, width), widened(x, width)
            at = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("rid"), b.column("vec_id"), b.column("v")], names=["pivot", "rid", "vec_id", "v"])

    near = materialize(rows.mapInArrow(nearest, "pivot int, rid long, vec_id long, v array<double>"), "near-rows")
    sizes = near.groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("int").alias("pieces")).withColumnRenamed("pivot", "p")
    dealt = near.join(F.broadcast(sizes), F.col("pivot") == F.col("p")).withColumn(  # a row a pivot
        "piece", F.pmod(F.xxhash64("rid"), F.col("pieces")))

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        x = matrix(shard.column("v").combine_chunks() if shard.num_rows else shard.column("v").chunk(0))
        tree = BallTree(x, leaf)
        packed = pickle.dumps((tree, x, shard.column("rid").to_numpy(), shard.column("vec_id").to_numpy()), protocol=5)
        return pa.table({"n": pa.array([len(x)], pa.int64()), "centre": pa.array([tree.centre[tree.root].tolist()], pa.list_(pa.float64())),
                         "radius": pa.array([float(tree.radius[tree.root])]), "packed": pa.array([packed], pa.binary())})

    return materialize(dealt.select("pivot", "piece", "rid", "vec_id", "v").groupBy("pivot", "piece").applyInArrow(
        build, "n long, centre array<double>, radius double, packed binary"), "shard-trees")


FOUND = "query int, vec_id long, score long"


def searched(shards: DataFrame, spec, k: int, made=None) -> DataFrame:
    """(query, vec_id, score): the k best rows of every shard for the queries of one pass. With
    k-th scores (``reached``) queries leave out their own shard, without they search only that."""
    def run(batches):
        q, rid, reached = spec.value
        norm = np.sqrt((q**2).sum(axis=1))
        for b in batches:
            for i in range(b.num_rows):
                who = np.arange(len(q))
                if reached is not None:
                    centre = np.array(b.column("centre")[i].as_py())
                    width = max(q.shape[1], len(centre))
                    bound = upper(widened(q, width), norm, widened(centre[None], width)[0], b.column("radius")[i].as_py())
                    who = who[bound >= reached]
                    if not len(who):
                        continue
                tree, x, xrid, xid = pickle.loads(b.column("packed")[i].as_buffer())
                who = who[np.isin(rid[who], xrid, invert=reached is not None)]
                s, ids, n = search(q[who], rid[who], np.full(len(who), LOW) if reached is None else reached[who], x, xrid, xid, k, tree)
                if made is not None:
                    made.add(n)
                real = s.ravel() != LOW
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, k)[real], pa.int32()), pa.array(ids.ravel()[real]), pa.array(s.ravel()[real])],
                                                 names=["query", "vec_id", "score"])

    return shards.select("centre", "radius", "packed").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, pass_rows: int = PASS_ROWS, pass_bytes: int = PASS_BYTES, leaf: int = LEAF,
          pivots: int = PIVOTS, made=None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of every query. ``made``, an
    accumulator, counts the products."""
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = vectors.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    shards = sharded(rows, pivots, shard_rows, leaf)
    out = []
    for block in blocks(rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)), pass_rows, pass_bytes):
        q, rid = as_matrix([r.v for r in block]), np.array([r.rid for r in block], np.int64)
        home = materialize(searched(shards, sc.broadcast((q, rid, None)), k, made), "nearest-home")
        reached = np.full(len(block), LOW, np.int64)
        for r in home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect():  # a row a query of this pass
            reached[r.query] = r.least
        away = searched(shards, sc.broadcast((q, rid, reached)), k, made)
        names = spark.createDataFrame([(i, r.vec_id) for i, r in enumerate(block)], "i int, query_id long")
        best = ranked(home.unionByName(away), k).join(F.broadcast(names), F.col("query") == F.col("i"))  # a row a query of this pass
        out.append(materialize(best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score"), "top-k"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(prepared(table(spark, sf_dir, "embeddings")))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.rid <> c.rid)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= {K}"""
