"""Operator 5: mixing sources to target weights with hash-threshold histograms.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
``SHARE`` of all words by weight; a source stops at ``MOST`` times its own size and the
excess is shared again among the others, until no target is above its stop.

Choice: a source whose target reaches its size takes every document once and spends the
rest on second copies; otherwise it spends all on first copies. Documents are taken in the
order of a hash of (doc_id, size) up to a threshold. The threshold is found without sorting
documents: words are summed by source and the next ``BITS`` hash bits; the bucket in which
the budget runs out becomes the next, finer histogram, until it holds one document (or the
bits are used up). Rows with equal hashes are told apart by the row number of the written
size table; since such rows have equal size and id it does not matter which is taken.
The last document is taken if that brings the source nearer to its target, so a source
misses its target by at most half of one document. Smaller budgets give thresholds nested
in larger ones.

Edge cases: null texts have size 0; a null source is a source of its own; sources without
words get target 0; repeated rows are separate documents; a null doc_id hashes like the
empty string; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from onramp.session import materialize

from .common import packed, pick, table, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5              # of all words
MOST = 2                 # copies of a document at most
BITS = 10                # hash bits resolved by one histogram
HASH_BITS = 60
ROW_BITS = 60            # row numbers, for rows with equal hashes
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def doc_hash(doc_id: Column, size: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``, the 0-based place of a source in code point order, null last: ranges
    are counted and each numbered on its own, so that no task sees all sources."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    ahead, total = {}, 0
    for p in sorted(counts):
        ahead[p], total = total, total + counts[p]
    if not ahead:
        return dealt.withColumn("place", F.lit(0)).drop("part")
    first = F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv])[F.col("part")]
    return dealt.withColumn("place", first + F.row_number().over(W.partitionBy("part").orderBy(order)) - 1).drop("part")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size)."""
    place = F.col("place") % len(weights)
    w = F.when(place == 0, F.lit(float(weights[0])))
    for i, x in enumerate(weights[1:], 1):
        w = w.when(place == i, F.lit(float(x)))
    s = materialize(ranked(sources).withColumn("weight", w), "source-weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    stop, level = F.col("source_size") * F.lit(float(most)), 0.0
    while True:  # the level only rises; ends when no further source stops
        stopped = stop <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(F.when(stopped, stop).otherwise(0.0)).alias("stopped"), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not r.weight:
            break
        now = (share * total - r.stopped) / r.weight
        if now <= level:
            break
        level = now
    return s.withColumn("target", F.least(stop, F.lit(level) * F.col("weight"))).drop("place")


def _bits(level: int) -> tuple[Column, Column, int]:
    """(digit of this level, bits before it, levels so far) of hash, then row number."""
    per = HASH_BITS // BITS
    col, used = ("h", level) if level < per else ("rid", level - per)
    total = HASH_BITS if level < per else ROW_BITS
    left = total - BITS * (used + 1)
    return F.shiftright(col, left).bitwiseAND((1 << BITS) - 1), F.shiftright(col, left + BITS), used


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, budget, before, hp, rp, level): the boundary bucket of each source and the
    words before it. ``hp`` are the hash bits, ``rp`` the row-number bits fixed so far.
    Sources whose budget covers all their words get no boundary (level 0, hp 1)."""
    per, levels = HASH_BITS // BITS, (HASH_BITS + ROW_BITS) // BITS
    state = goals.select("source", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("hp"),
                         F.lit(0).cast("long").alias("rp"), F.lit(True).alias("open"), F.lit(0).alias("level"))
    n_sources = goals.count()
    for level in range(levels):
        digit, sofar, used = _bits(level)
        mine = state.filter("open").select(F.col("source").alias("s"), "budget", "before", "hp", "rp")
        if n_sources <= BROADCAST_SOURCES:
            mine = F.broadcast(mine)
        at = F.col("source").eqNullSafe(F.col("s"))
        at = at & ((sofar == F.col("hp")) if level < per else ((F.col("h") == F.col("hp")) & (sofar == F.col("rp"))))
        hist = (rows.join(mine, at).groupBy("source", digit.alias("digit"))
                .agg(F.sum("size").alias("size"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("budget", "before", "hp", "rp")]))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("digit"))
        over = (hist.withColumn("upto", upto + F.col("before")).filter(F.col("upto") > F.col("budget"))
                .groupBy("source").agg(F.min(F.struct("digit", (F.col("upto") - F.col("size")).alias("before"), "n", "hp", "rp")).alias("b")))
        step = over.select(F.col("source").alias("s"), F.col("b.before").alias("nb"), F.col("b.n").alias("n"),
                           *([(F.shiftleft("b.hp", BITS) + F.col("b.digit")).alias("nh"), F.col("b.rp").alias("nr")] if level < per else
                             [F.col("b.hp").alias("nh"), (F.shiftleft("b.rp", BITS) + F.col("b.digit")).alias("nr")]))
        joined = state.join(step, F.col("source").eqNullSafe(F.col("s")), "left")
        was, hit = F.col("open"), F.col("open") & F.col("n").isNotNull()
        state = materialize(joined.select(
            "source", "budget", F.when(hit, F.col("nb")).otherwise(F.col("before")).alias("before"),
            # an open source whose budget is never exceeded takes everything
            F.when(hit, F.col("nh")).when(was, F.lit(1)).otherwise(F.col("hp")).cast("long").alias("hp"),
            F.when(hit, F.col("nr")).otherwise(F.col("rp")).alias("rp"),
            (hit & (F.col("n") > 1)).alias("open"),
            F.when(hit, F.lit(level + 1)).when(was, F.lit(0)).otherwise(F.col("level")).alias("level")), "thresholds")
        if not state.filter("open").limit(1).count():
            break
    return state.drop("open")


def _chosen(level_max: int) -> Column:
    """Whether a row lies before its source's threshold, or at it and near enough."""
    per = HASH_BITS // BITS
    near = 2 * F.col("before") + F.col("size") <= 2 * F.col("budget")
    out = F.when(F.col("budget") <= 0, F.lit(False)).when(F.col("level") == 0, F.lit(True))
    for level in range(1, level_max + 1):
        if level <= per:
            key = F.shiftright("h", HASH_BITS - BITS * level)
            ok = (key < F.col("hp")) | ((key == F.col("hp")) & near)
        else:
            key = F.shiftright("rid", ROW_BITS - BITS * (level - per))
            ok = (F.col("h") < F.col("hp")) | ((F.col("h") == F.col("hp")) & ((key < F.col("rp")) | ((key == F.col("rp")) & near)))
        out = out.when(F.col("level") == level, ok)
    return out


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``rows`` (a written table with source, size, h, rid and any others) with
    source_size, target and copies."""
    if most != 2:
        raise ValueError("a document is taken at most twice")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.col("target") >= F.col("source_size")
    goals = materialize(goals.withColumn("base", whole.cast("int")).withColumn(
        "budget", F.when(whole, F.col("target") - F.col("source_size")).otherwise(F.col("target"))), "targets")
    limits = thresholds(rows, goals)
    top = limits.agg(F.max("level")).first()[0] or 0
    g = goals.select(F.col("source").alias("s"), "source_size", "target", "base")
    lim = limits.select(F.col("source").alias("s2"), "budget", "before", "hp", "rp", "level")
    both = g.join(lim, F.col("s").eqNullSafe(F.col("s2")))
    if goals.count() <= BROADCAST_SOURCES:
        both = F.broadcast(both)
    joined = rows.join(both, F.col("source").eqNullSafe(F.col("s")))
    return joined.select(*rows.columns, "source_size", "target", (F.col("base") + _chosen(top).cast("int")).alias("copies"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The written size table: doc_id, source, size, h, rid."""
    d = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    d = d.select("doc_id", "source", words(F.col("text")).alias("size"))
    return materialize(d.withColumn("h", doc_hash(F.col("doc_id"), F.col("size"))).withColumn("rid", F.monotonically_increasing_id()), "sizes")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    mixed = plan(sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. The rows are written
    once beside their hashes; thresholds meet them by source, so no text is shuffled
    unless there are more than ``BROADCAST_SOURCES`` sources."""
    d = packed(docs, doc_id="doc_id", text="text", source="source")
    d = d.withColumn("size", words(F.col("text"))).withColumn("h", doc_hash(F.col("doc_id"), F.col("size")))
    whole = materialize(d.select("row", "source", "size", "h", F.monotonically_increasing_id().alias("rid")), "mix-rows")
    taken = plan(whole).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return unpacked(taken, docs)


_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"
_TAKEN_SQL = f"""
d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || size), 1, {HASH_BITS // 4}))::BIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {_WEIGHT} AS weight, {MOST}::DOUBLE * source_size AS stop FROM s),
o AS (SELECT *, stop / weight AS ratio,
        coalesce(sum(stop) OVER (ORDER BY stop / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
        sum(weight) OVER (ORDER BY stop / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT level FROM (SELECT ratio, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) - stopped) / rest AS level FROM o) WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1),
t AS (SELECT source, source_size, least(stop, level * weight) AS target FROM w, l),
m AS (SELECT h.*, source_size, target, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base,
        CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget,
        coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, base + CASE WHEN budget > 0 AND 2 * before + size <= 2 * budget THEN 1 ELSE 0 END AS copies FROM m)"""
ORACLE = f"WITH {_TAKEN_SQL} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c"
