"""Operator 1: hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight
with u a hash of (key, child) and the smallest draw wins, so a child is chosen in
proportion to its weight (the sum of the shard weights under it). A draw depends on the
key, the child's name and its own weight alone: when weights change, a row moves only if
a changed child wins or loses it, so movement stays inside subtrees whose weight changed.
A shard added as a region of its own changes no other weight and therefore takes rows
only into itself (law ``key``).

Edge cases: a null key draws like the empty string; rows with equal keys share a shard;
a null text has 0 bytes and the crc32 of the empty text (0); shards of weight 0 get no
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from onramp.session import materialize

from .common import pick, table

SLOT_BUCKETS = 4096      # sub-partitions of a shard in which rows are numbered
COPIES_PER_CHUNK = 1000  # identical rows that one generated chunk stands for
HASH_RANGE = float(1 << 52)


@dataclass(frozen=True)
class Node:
    """A region or rack with ``children``, or a shard with its number."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def rack_of(name: str, first: int, weights) -> Node:
    return Node(name, tuple(Node(f"s{first + i}", shard=first + i, own_weight=w) for i, w in enumerate(weights)))


def even_tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Node:
    """Regions of equal racks of equal shards, numbered from 0."""
    made, n = [], 0
    for r in range(regions):
        own = []
        for k in range(racks):
            own.append(rack_of(f"r{r}k{k}", n, [1.0] * shards))
            n += shards
        made.append(Node(f"r{r}", tuple(own)))
    return Node("root", tuple(made))


def shard_count(tree: Node) -> int:
    return sum(map(shard_count, tree.children)) if tree.children else 1


def grown(tree: Node, weight: float = 1.0) -> Node:
    """``tree`` with one more shard, in a region of its own: no other weight changes."""
    n, r = shard_count(tree), len(tree.children)
    return Node(tree.name, (*tree.children, Node(f"r{r}", (rack_of(f"r{r}k0", n, [weight]),))))


def uniform(key: Column, salt: Column) -> Column:
    """A draw in (0, 1) from 52 bits of the md5 of key and salt."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), salt).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(HASH_RANGE)


def _levels(tree: Node) -> list[list[Node]]:
    """Inner nodes of each level, from the root; every shard lies at the same depth."""
    out, nodes = [], [tree]
    while nodes and any(n.children for n in nodes):
        if not all(n.children for n in nodes):
            raise ValueError("shards must all lie at the same depth")
        out.append(nodes)
        nodes = [c for n in nodes for c in n.children if c.weight > 0]
    return out


def descend(rows: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Add ``out``, the shard number of ``key`` in ``tree``: one column per level holds the
    place of the chosen node, whose children (a literal table) draw for the next one."""
    if tree.weight <= 0:
        raise ValueError("the tree has no weight")
    place = F.lit(0)
    steps = []
    for i, nodes in enumerate(_levels(tree)):
        table_, n = [], 0
        for node in nodes:
            own = []
            for c in node.children:
                if c.weight > 0:
                    own.append(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"),
                                        F.lit(n if c.children else c.shard).alias("place")))
                    n += 1
            table_.append(F.array(*own))
        children = F.get(F.array(*table_), place)
        draws = F.transform(children, lambda c: F.struct(
            (-F.log(uniform(F.col(key), c["name"])) / c["weight"]).alias("draw"), c["place"].alias("place")))
        steps.append(f"__{out}_{i}")
        rows = rows.withColumn(steps[-1], F.array_min(draws)["place"])
        place = F.col(steps[-1])
    return rows.withColumn(out, place).drop(*steps)


def with_slots(rows: DataFrame, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number the rows (columns shard, key and any others) of each shard from 0 without
    gaps, in the order of a hash bucket of the key and the other columns and then those
    columns (rows of one key, null among them, lie in many buckets if they differ).

    Identical rows are counted before anything is sorted. A shard is numbered in
    ``buckets`` independent pieces, whose offsets come from a table of at most
    shards x buckets rows; copies of a row are generated in chunks dealt over all tasks."""
    names = [c for c in rows.columns if c != "key"]
    whole = F.concat_ws("|", "key", *[F.col(c).cast("string") for c in names if c != "shard"], F.lit("slot"))
    bucket = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 4), 16, 10).cast("int") % buckets
    kinds = rows.withColumn("bucket", bucket).groupBy("bucket", *names).agg(F.count("*").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in names if c != "shard"]
    within = W.partitionBy("shard", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    kinds = kinds.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    kinds = kinds.join(base, ["shard", "bucket"]).select(*names, "n", (F.col("base") + F.col("before")).alias("start"))
    few = kinds.filter(F.col("n") <= COPIES_PER_CHUNK)
    many = (kinds.filter(F.col("n") > COPIES_PER_CHUNK)
            .select(*names, "start", "n", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES_PER_CHUNK}L)")).alias("chunk"))
            .select(*names, (F.col("start") + F.col("chunk")).alias("start"),
                    F.least(F.col("n") - F.col("chunk"), F.lit(COPIES_PER_CHUNK)).alias("n"))
            .repartition("start"))
    slots = F.explode(F.expr("sequence(start, start + n - 1)")).alias("slot")
    return few.select(*names, slots).unionByName(many.select(*names, slots))


def assign_shards(docs: DataFrame, tree: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    d = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = d.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"))
    rows = descend(descend(rows, "key", tree, "shard"), "key", grown(tree), "grown_shard")
    # the rows without their texts are written once: the count, the offsets and the copies
    # below would each read the texts again
    return with_slots(materialize(rows, "sharded")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_shard_tree(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), even_tree(3, 2, 4))


def _sql_draw(name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5(key || '|{name}'), 1, 13))::BIGINT + 0.5) / {HASH_RANGE!r}) / {float(weight)!r} AS \"{name}\""


def _sql_pick(node: Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_pick(node.children[0])
    names = ", ".join(f'"{c.name}"' for c in node.children)
    return "CASE " + " ".join(f'WHEN "{c.name}" = least({names}) THEN {_sql_pick(c)}' for c in node.children) + " END"


def _sql() -> str:
    tree = even_tree(3, 2, 4)
    more = grown(tree)
    names: dict[str, float] = {}

    def add(node):
        for c in node.children:
            names[c.name] = c.weight
            add(c)

    add(more)
    draws = ", ".join(_sql_draw(n, w) for n, w in names.items())
    return f"""
WITH steps AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)),
         lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
b AS (SELECT doc_id, key, strlen(t) + 8 AS size,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
          lambda c, x: xor(c >> 8, steps.crc[(xor(c, x) & 255) + 1])) AS reg
      FROM d, steps),
w AS (SELECT *, {draws} FROM b),
s AS (SELECT doc_id, size, xor(reg, 4294967295::BIGINT) AS text_crc32, key,
        {_sql_pick(tree)} AS shard, {_sql_pick(more)} AS grown_shard FROM w),
p AS (SELECT *, ('0x' || substr(md5(concat_ws('|', key, doc_id, size, text_crc32, grown_shard, 'slot')), 1, 4))::BIGINT % {SLOT_BUCKETS} AS bucket FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM p"""


ORACLE = _sql()
