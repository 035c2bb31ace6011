"""Operator 7: SimHash near-duplicates by deletion-variant signatures.

Fingerprints: words of the whole text (bytes outside space and \\x09-\\x0D, A-Z lower-cased),
shingles of ``shingle`` words, XXH64 with seed 42 of each; a bit is set if it is set in
over half the hashes.

Linking at ``distance`` or fewer differing bits: 64 bits are cut into distance // 2 + 1
segments, so two linked fingerprints differ by at most one bit in some segment. The index
holds each distinct fingerprint once per segment under the segment itself and once per
bit of it under the segment with that bit deleted (a one-wildcard variant; the bit itself
decides the side). An equality join meets fingerprints with the same segment, or with the
same variant and opposite deleted bits, so each pair is met once a segment; every met
pair is verified on all 64 bits.

A bucket of the index with more than ``HOT`` fingerprints (near-copies crowd there) is not
paired off. Its fingerprints go through an exact second index instead: each is listed under
itself and its 64 one-bit neighbours; within distance 2 share such a centre, and all under
one centre are within 2 of each other, so a star to the smallest replaces the pairs
(at most 65 fingerprints a centre). At distance 1 a centre must itself be a fingerprint
and is linked to its members. Larger distances than 2 are refused.

Components: links between distinct fingerprints are closed by alternating large-star and
small-star steps, each written to the shared folder; documents then take the smallest
doc_id of their component. Documents with equal fingerprints are one node, whatever their
number.

Edge cases: null and wordless texts have fingerprint zero and link like any other; a text
of fewer words than a shingle is one shingle; a null doc_id joins its class but is never
its smallest member unless all are null; repeated rows come back once per row; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onramp.session import materialize

from .common import packed, pick, raw_bytes, table, unpacked

SEED = 42
HOT = 12              # fingerprints of a bucket that are paired off; beyond, the centre index
HASHES_AT_ONCE = 1 << 14


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = n - shingle + 1
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[shingle - 1:].tolist())),
                       np.uint64, count)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash as a signed integer."""
    h = shingle_hashes(text, shingle)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), HASHES_AT_ONCE):
        part = h[at:at + HASHES_AT_ONCE].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(h)).tobytes() if len(h) else b"\0" * 8
    return int.from_bytes(bits, "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) per row."""
    d = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([fingerprint(t, shingle) for t in raw_bytes(b, "text")], pa.int64())], names=["id", "fp"])

    return d.mapInArrow(run, schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments (two at least: a signature packs 32 bits)."""
    n = max(2, distance // 2 + 1)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _index(fps: DataFrame, distance: int) -> DataFrame:
    """fp under every signature. ``sig`` packs segment number, deleted bit (63: none) and
    the rest of the segment (at most 32 bits); ``side`` is the deleted bit's value."""
    parts = []
    for s, (low, width) in enumerate(segments(distance)):
        seg = f"(shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L)"
        tag = s << 56
        parts.append(f"array(named_struct('sig', {tag | 63 << 48}L | {seg}, 'side', 0))")
        parts.append(f"transform(sequence(0, {width - 1}), b -> named_struct('sig', {tag}L | shiftleft(cast(b as bigint), 48) | "
                     f"({seg} & ~shiftleft(1L, b)), 'side', cast(shiftrightunsigned({seg}, b) & 1 as int)))")
    return fps.select("fp", F.expr(f"inline(concat({', '.join(parts)}))"))


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints within ``distance`` bits
    (every pair of cold buckets; stars where a bucket is hot).

    The joins are merge joins by hint: Spark takes an exploded table for as many rows as the
    one it came from, so the index and the flips, some 66 times that, would be broadcast."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    whole = (F.shiftrightunsigned("sig", 48).bitwiseAND(63)) == 63  # no bit deleted
    index = _index(fps, distance)
    # a bucket without a partner holds no link; a wildcard bucket needs both sides
    buckets = (index.groupBy("sig").agg(F.count("*").alias("n"), F.sum("side").alias("ones"))
               .filter((F.col("n") > 1) & (whole | ((F.col("ones") > 0) & (F.col("ones") < F.col("n"))))).select("sig", "n"))
    met = materialize(index.join(buckets.hint("merge"), "sig"), "simhash-buckets")
    cold = met.filter(F.col("n") <= HOT)
    left = cold.select("sig", "side", F.col("fp").alias("a"))
    right = cold.select("sig", F.col("side").alias("other"), F.col("fp").alias("b"))
    # a written table is taken for as small as its file, which packs repeated values far closer than rows
    pairs = (left.join(right.hint("merge"), "sig")
             .filter((F.col("side") < F.col("other")) | (whole & (F.col("a") < F.col("b"))))
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    hot = met.filter(F.col("n") > HOT).select("fp").distinct()
    flips = hot.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("centre"))
    if distance == 2:
        star = flips.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("centre", "a")
    else:
        star = hot.select(F.col("fp").alias("centre"), F.col("fp").alias("a"))
    stars = (flips.join(star.hint("merge"), "centre").filter("fp <> a")
             .select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that reaches a smaller one; root is the smallest reachable.

    Alternating large-star and small-star: rounds grow with the logarithm of the longest
    path; only the counts that tell the end come to the driver."""
    e = materialize(edges.select("a", "b"), "links")
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join deals out both sides anew and can split a node of many links
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
                 .filter("a <> b").distinct())
        e = materialize(small, "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def classes(rows: DataFrame, distance: int, least) -> DataFrame:
    """(fp, component) of the written ``rows``; component is the smallest value of the
    expression ``least`` among the rows reachable."""
    nodes = rows.groupBy("fp").agg(F.min(least).alias("least"))
    roots = components(links(nodes.select("fp"), distance))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "simhash-nodes")
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
    return joined.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) per row of ``docs``; component is the smallest id reachable."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return rows.join(classes(rows, distance, F.col("id")), "fp").select("id", "fp", "component")


def without_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null last),
    of equal ids the first. Rows are written once with their fingerprints and a number;
    only the numbers of the rows to drop are joined back."""
    d = packed(docs, id=id_col, text=text_col)
    schema = T.StructType([d.schema["row"], d.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array([fingerprint(t, shingle) for t in raw_bytes(b, "text")], pa.int64())],
                                             names=schema.names)

    whole = materialize(d.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "fingerprinted")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "rid")
    rows = whole.select("rid", "id", "fp")
    drop = rows.join(classes(rows, distance, rank), "fp").filter(F.col("rid") != F.col("component.rid")).select("rid")
    return unpacked(whole.join(drop, "rid", "left_anti"), docs)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))
