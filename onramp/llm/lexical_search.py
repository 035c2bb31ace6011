"""Operator 12: ranked lexical search by dual trees over items and documents.

An item is the vector of its terms' weights, a document the vector of its terms' saturated
frequencies, and a score their inner product, all in 64-bit integers.

Items come in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_BYTES`` of text, or one item),
of which the driver holds one; a block's terms are broadcast to one scan of all texts, which
are cut into terms there (a megabyte at a time, however long a text is) and written as
(doc_id, length, term numbers, occurrences), counts of other terms dropped. From that table
come N, L and the documents of each term, and two searches: first over a share of 1 /
``HOME`` of the documents, whose k-th scores start the search of all others.

In a task up to ``CHUNK`` documents are gathered into a binary tree (halved along the
direction of widest spread of a small random projection); every node holds the maximum of
each coordinate over its documents. The items of the block form such a tree too, whose nodes
hold the maxima of the weights, that is the weights of all their terms. A pair of nodes is
bounded by the inner product of the maxima; where that is below the weakest k-th score of
the items under the node, the whole batch of pairs is dropped, else both are split. Pairs
of leaves are scored exactly. A bound equal to the k-th score is followed, as the id may win.

Edge cases: a null or empty text has no terms and does not count; null item texts find
nothing; repeated documents are rows of their own and each takes a rank; equal scores go to
the smaller doc_id, a null doc_id comes last; items of equal item_id are rows of their own,
each with its own ranks; very long texts are read whole; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from onramp.session import materialize

from .common import pick, raw_bytes, table
from .vectors import NO_ID, best

K = 10
BLOCK_ITEMS, BLOCK_BYTES = 2048, 2 << 20
PIECE = 1 << 20
CHUNK = 2048                  # documents of one tree
CHUNK_ENTRIES = 1 << 20       # or so many (document, term) entries
DOC_LEAF, ITEM_LEAF = 32, 8
SKETCH = 8
HOME = 16

# terms are made of letters and digits of ASCII and of all other characters; A-Z in small letters
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for about every ``PIECE`` bytes."""
    at = 0
    while len(raw) - at > PIECE:
        cut = raw.rfind(b" ", at + 1, at + PIECE)
        if cut < 0:
            cut = raw.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def counted(text: bytes | None, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of all terms; numbers of the known ones, ascending, and their occurrences."""
    n, ids = 0, []
    for own in pieces((text or b"").translate(FOLD)):
        n += len(own)
        ids.append(np.fromiter((i for i in map(number.get, own) if i is not None), np.int64))
    got, tf = np.unique(np.concatenate(ids), return_counts=True)
    return n, got, tf


def item_blocks(items: DataFrame, most_items: int = BLOCK_ITEMS, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, distinct terms) of the items, block by block."""
    own, size = [], 0
    for r in items.toLocalIterator():
        raw = (r.text or "").encode("utf-8", "replace")
        if own and (len(own) >= most_items or size + len(raw) > most_bytes):
            yield own
            own, size = [], 0
        own.append((r.item_id, sorted({t for p in pieces(raw.translate(FOLD)) for t in p})))
        size += len(raw)
    if own:
        yield own


def term_vectors(docs: DataFrame, number) -> DataFrame:
    """(doc_id, n, ids, tf) of the documents with a term; ``number`` is broadcast."""
    def run(batches):
        for b in batches:
            got = [counted(t, number.value) for t in raw_bytes(b, "text")]
            some = [i for i, g in enumerate(got) if g[0]]
            offsets = pa.array(np.cumsum([0, *(len(got[i][1]) for i in some)]), pa.int32())

            def lists(j):
                return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(got[i][j] for i in some)]), pa.int64()))

            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some, pa.int64())), pa.array([got[i][0] for i in some], pa.int64()), lists(1), lists(2)],
                                             names=["doc_id", "n", "ids", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, ids array<long>, tf array<long>")


# --- trees -----------------------------------------------------------------------------

def halved(sketch: np.ndarray, rows: np.ndarray, leaf: int, cut: list) -> None:
    """Appends the leaves of a halving along the widest direction, near ones side by side."""
    if len(rows) <= leaf:
        cut.append(rows)
        return
    own = sketch[rows]
    along = own[:, (own.max(axis=0) - own.min(axis=0)).argmax()]
    order = np.argsort(along, kind="stable")
    half = len(rows) // 2
    halved(sketch, rows[order[:half]], leaf, cut)
    halved(sketch, rows[order[half:]], leaf, cut)


def sketched(ids: np.ndarray, values: np.ndarray, starts: np.ndarray, rows: int, signs: np.ndarray) -> np.ndarray:
    """Random projection of sparse rows, to unit length."""
    out = np.zeros((rows, SKETCH))
    held = np.flatnonzero(np.diff(starts))
    if len(held):
        out[held] = np.add.reduceat(values[:, None] * signs[ids], starts[held], axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Node:
    """Coordinate maxima (numbers and values) of what lies below; leaves hold their rows."""

    __slots__ = ("ids", "top", "left", "right", "rows", "first", "last")

    def __init__(self, ids, top, left=None, right=None, rows=None) -> None:
        self.ids, self.top, self.left, self.right, self.rows = ids, top, left, right, rows


def maxima(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    return ids[starts], (np.maximum.reduceat(values, starts) if len(starts) else values)


def built(leaves: list[np.ndarray], ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> Node:
    """The tree over leaves that lie side by side."""
    level = []
    for rows in leaves:
        at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
        level.append(Node(*maxima(ids[at], values[at]), rows=rows))
    while len(level) > 1:
        above = []
        for i in range(0, len(level) - 1, 2):
            a, b = level[i], level[i + 1]
            above.append(Node(*maxima(np.concatenate((a.ids, b.ids)), np.concatenate((a.top, b.top))), a, b))
        level = above + level[len(level) - len(level) % 2:]
    return level[0]


class Items:
    """The items of one block: weights by term number, and their tree; broadcast."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, least: np.ndarray, k: int) -> None:
        self.weight, self.n_docs, self.n_terms, self.least, self.k = weight, n_docs, n_terms, least, k
        starts = np.cumsum([0, *map(len, terms)])
        ids = np.concatenate([np.zeros(0, np.int64), *terms])
        self.signs = np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (len(weight), SKETCH))
        leaves: list[np.ndarray] = []
        halved(sketched(ids, weight[ids].astype(float), starts, len(terms), self.signs), np.arange(len(terms)), ITEM_LEAF, leaves)
        self.order = np.concatenate(leaves)  # items in the order of the leaves
        self.root = built(leaves, ids, weight[ids], starts)
        self.cells: dict[int, np.ndarray] = {}
        at = 0

        def numbered(node: Node) -> None:
            nonlocal at
            node.first, node.top = at, None  # the maxima of an item node are the weights of its terms
            if node.rows is None:
                numbered(node.left)
                numbered(node.right)
            else:
                # which of the leaf's terms (columns) each of its items has, with the weight
                held = np.zeros((len(node.rows), len(node.ids)), np.int64)
                for j, r in enumerate(node.rows):
                    held[j, np.searchsorted(node.ids, terms[r])] = weight[terms[r]]
                self.cells[at] = held
                at += len(node.rows)
            node.last = at

        numbered(self.root)


class Search:
    """The k best documents of every item so far, in the order of the item tree's leaves."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.kth = items.least[items.order].copy()
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.order)
        self.scored = self.pairs = 0

    def add(self, doc_ids: np.ndarray, n: np.ndarray, ids: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> None:
        """Documents by their entries, starts[d] to starts[d + 1] those of document d."""
        own = self.items
        m = 10 + (90 * n * own.n_docs) // own.n_terms
        x = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(starts)))
        self.doc_ids, self.ids, self.x, self.starts = doc_ids, ids, x, starts
        leaves: list[np.ndarray] = []
        halved(sketched(ids, (own.weight[ids] * x).astype(float), starts, len(n), own.signs), np.arange(len(n)), DOC_LEAF, leaves)
        self.pairs += len(n) * len(own.order)
        self.dense = np.zeros(len(own.weight), np.int64)
        self._visit(built(leaves, ids, x, starts), [own.root])

    def _open(self, doc: Node, nodes: list[Node]) -> list[Node]:
        """The item nodes that the bound against ``doc`` does not drop."""
        self.dense[doc.ids] = self.items.weight[doc.ids] * doc.top
        out = [i for i in nodes if int(self.dense[i.ids].sum()) >= self.kth[i.first:i.last].min()]
        self.dense[doc.ids] = 0
        return out

    def _visit(self, doc: Node, nodes: list[Node]) -> None:
        nodes = self._open(doc, nodes)
        if doc.rows is None:
            nodes = [c for i in nodes for c in ((i,) if i.rows is not None else (i.left, i.right))]
            if nodes:
                self._visit(doc.left, nodes)
                self._visit(doc.right, nodes)
            return
        while nodes:
            for leaf in nodes:
                if leaf.rows is not None:
                    self._score(doc, leaf)
            nodes = self._open(doc, [c for i in nodes if i.rows is None for c in (i.left, i.right)])

    def _score(self, doc: Node, leaf: Node) -> None:
        rows = doc.rows
        at = np.concatenate([np.arange(self.starts[r], self.starts[r + 1]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), self.starts[rows + 1] - self.starts[rows])
        ids = self.ids[at]
        column = np.minimum(np.searchsorted(leaf.ids, ids), len(leaf.ids) - 1)
        hit = leaf.ids[column] == ids
        at, owner, column = at[hit], owner[hit], column[hit]
        if not len(at):
            return
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        scores = np.add.reduceat(self.items.cells[leaf.first][:, column] * self.x[at], begins, axis=1)
        which = self.doc_ids[rows[owner[begins]]]
        self.scored += scores.size
        good = (scores >= self.kth[leaf.first:leaf.last, None]) & (scores > 0)
        for j in np.flatnonzero(good.any(axis=1)):
            item = leaf.first + j
            s, i = self.kept[item]
            s, i = np.concatenate((s, scores[j][good[j]])), np.concatenate((i, which[good[j]]))
            top = best(s, i, self.items.k)
            self.kept[item] = s[top], i[top]
            if len(top) == self.items.k:
                self.kth[item] = max(self.kth[item], s[top[-1]])


# --- Spark ------------------------------------------------------------------------------

FOUND = "item int, doc_id long, score long"


def searched(vectors: DataFrame, items) -> DataFrame:
    """(item, doc_id, score): the k best of every item in every part of ``vectors``."""
    def run(batches):
        search = Search(items.value)
        chunk, rows, entries = [], 0, 0

        def flush():
            column = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in chunk]) for c in ("doc_id", "n")}
            flat = [np.concatenate([b.column(c).flatten().to_numpy() for b in chunk]) for c in ("ids", "tf")]
            sizes = np.concatenate([np.diff(b.column("ids").offsets.to_numpy()) for b in chunk])
            search.add(column["doc_id"], column["n"], *flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))

        for b in batches:
            chunk.append(b)
            rows += b.num_rows
            entries += len(b.column("ids").flatten())
            if rows >= CHUNK or entries >= CHUNK_ENTRIES:
                flush()
                chunk, rows, entries = [], 0, 0
        if rows:
            flush()
        order = items.value.order
        out = [(order[i], s, d) for i, (s, d) in enumerate(search.kept) if len(s)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int32()),
                                              pa.array(np.concatenate([o[2] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for the items of one block."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    if not number:
        return None
    vectors = materialize(term_vectors(docs, sc.broadcast(number)), "term-vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        return None
    df = np.zeros(len(number), np.int64)
    for r in vectors.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most a row a term of the block
        df[r.t] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    terms = [np.array([number[t] for t in own], np.int64) for _, own in block]

    def spec(least):
        return sc.broadcast(Items(terms, weight, total.docs, total.terms, least, k))

    some = vectors.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).filter(F.size("ids") > 0)
    home = F.pmod(F.xxhash64("doc_id", "n"), F.lit(HOME)) == 0
    least = np.ones(len(block), np.int64)  # scores are above 0
    first = materialize(ranked(searched(some.filter(home), spec(least)), k), "lexical-home")
    reached = least.copy()
    for r in first.filter(F.col("rank") == k).collect():  # at most one an item
        reached[r["item"]] = r.score
    found = ranked(first.drop("rank").unionByName(searched(some.filter(~home), spec(reached))), k)
    kind = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "i int, item_id long")
    return found.join(F.broadcast(kind), F.col("item") == F.col("i")).select(  # a row an item of the block
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", most_items: int = BLOCK_ITEMS,
                  most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item."""
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = pick(items, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("long"))
    out = [search_block(d, block, k) for block in item_blocks(asked, most_items, most_bytes)]
    out = [o for o in out if o is not None]
    if len(out) > 1:
        out = [materialize(o, "lexical-block") for o in out]
    return reduce(DataFrame.unionByName, out) if out else d.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
c AS (SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM c),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM c) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
i AS (SELECT iid, item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '{_TERM}'))) AS term FROM (SELECT row_number() OVER () AS iid, * FROM benchmark)),
s AS (SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total.docs) // total.terms))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), total GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {K}"""
