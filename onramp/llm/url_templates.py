"""Operator 4: URL filter on a path-template tree.

Rules decide the urls they fit (the longest one wins) and label them: blocked or allowed.
For all other urls the method decides. Per host, paths form a tree of segments that is
walked level by level: under each node, segments with at least ``SUPPORT`` urls and
``SHARE`` of the node's urls stay as they are, all others become a wildcard of their shape
(runs of digits, of hexadecimal digits and of letters; other characters stay). What is
folded into one wildcard must be alike in labels, counted in different paths: the labelled
of all and the blocked of the labelled. A segment whose counts its siblings' share makes
less likely than ``ALPHA`` (Chernoff bound, over the number of siblings) is kept apart; if
the counts of all siblings spread more than ``Z`` standard errors beyond chance, all are.
What is kept apart is folded by its own labels: none, or the same power of two of the
labelled share and the same fifth of the blocked share. Levels go on until no path has a
deeper segment; under a node of a single path, where nothing can differ, its remaining
segments are named at once by the same rule. Then, from the last segment to the
first, templates that differ only in that literal segment are ordered by their share of
blocked urls, and neighbours whose shares do not differ significantly (``Z`` standard
errors) are merged; templates without a labelled url are merged with each other only. A
template whose
smoothed share of blocked among labelled urls, (blocked + A) / (labelled + 2 A), reaches
``REJECT`` is rejected and its urls are blocked.

Work is done on distinct (host, path) pairs with counts; every step groups or joins on
host, node and segment, so a host may hold any share of the rows. Tables joined against
are written first, so that adaptive execution can split a hot key.

Edge cases: null urls and urls without ``://`` have empty host and path and are judged as
such (no rule fits; template without segments); repeated rows count each; a null page_id
is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from onramp.session import materialize

from .common import pick, table

# The contract's rules, verdict and rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

SUPPORT = 20
SHARE = 0.05
Z = 2.0
ALPHA = 0.05
A = 2.0
REJECT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, r in sorted(rules, key=lambda x: len(x[1])):
        h, p = r[: r.index("/")], r[r.index("/"):]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """Wildcard of a segment: runs of digits {n}, of mixed hexadecimal {h}, of letters {a}."""
    s = F.regexp_replace(segment, r"[{}]", "_")
    s = F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b", "{h}")
    s = F.regexp_replace(s, r"[0-9]+", "{n}")
    return F.regexp_replace(s, r"(?<!\{)\p{L}+(?!\})", "{a}")


def spread(squares: Column, hits: Column, n: Column, inverse: Column, k: Column) -> Column:
    """Whether the hits of ``k`` groups differ more than chance lets them: ``squares`` is the
    sum of hits^2 / n over the groups, ``inverse`` the sum of 1 / n."""
    pq = hits / n * (1 - hits / n)
    chi2 = (squares - hits * hits / n) / pq
    error = F.sqrt(F.greatest(k, 2 * k + (1 - 6 * pq) / pq * inverse))
    return F.when((hits > 0) & (hits < n), chi2 - (k - 1) * n / (n - 1) > Z * error).otherwise(False)


def unlike(hits: Column, n: Column, all_hits: Column, all_n: Column, k: Column) -> Column:
    """Whether ``hits`` of ``n`` are too unlikely at the share of the other groups."""
    p = (all_hits - hits + 0.5) / (all_n - n + 1)
    part = lambda x, q: F.when(x > 0, x * F.log(x / (n * q))).otherwise(0.0)
    return (n > 0) & (all_n > n) & (part(hits, p) + part(n - hits, 1 - p) > F.log(k / ALPHA))


def kept_apart(segments: DataFrame) -> DataFrame:
    """(h, t, s, name) of the segments (host, tmpl, seg, shape, paths, known, bad) that must
    not be folded with all siblings of their shape."""
    n, known, bad = F.col("paths"), F.col("known"), F.col("bad")
    some = known > 0
    sums = segments.groupBy(F.col("host").alias("h"), F.col("tmpl").alias("t"), F.col("shape").alias("sh")).agg(
        F.sum(n).alias("N"), F.sum(known).alias("L"), F.sum(bad).alias("B"), F.count("*").alias("k"), F.sum(some.cast("long")).alias("kl"),
        F.sum(known * known / n).alias("l2"), F.sum(1 / n).alias("n1"), F.sum(F.when(some, bad * bad / known)).alias("b2"), F.sum(F.when(some, 1 / known)).alias("l1"))
    c = F.col
    sums = sums.filter("k > 1 AND L > 0 AND (L < N OR (B > 0 AND B < L))").withColumn(
        "spread", spread(c("l2"), c("L"), c("N"), c("n1"), c("k")) | spread(c("b2"), c("B"), c("L"), c("l1"), c("kl")))
    sums = materialize(sums, "segment-groups")
    j = segments.join(sums, (c("host") == c("h")) & (c("tmpl") == c("t")) & (c("shape") == c("sh")))
    j = j.filter(c("spread") | unlike(known, n, c("L"), c("N"), c("k")) | unlike(bad, known, c("B"), c("L"), c("kl")))
    like = F.concat_ws("|", F.floor(F.log2(n / known)).cast("string"), F.least(F.lit(4), F.floor(5 * bad / known)).cast("string"))
    return j.select("h", "t", c("seg").alias("s"), F.concat(F.lit("~"), c("shape"), F.lit("|"), F.when(some, like).otherwise("?")).alias("name"))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, labelled, blocked) with ``tmpl``, the template's segments."""
    t = paths.withColumn("segs", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace("path", "^/", ""), "/"))).withColumn("tmpl", F.array().cast("array<string>"))
    t = materialize(t.withColumn("done", F.lit(False)), "paths")
    level = 0
    # one round a level that some node of several paths reaches
    while (t.filter("NOT done").agg(F.max(F.size("segs"))).first()[0] or 0) > level:
        d = t.withColumn("seg", F.when(~F.col("done"), F.get("segs", F.lit(level))))
        live = d.filter("seg IS NOT NULL")
        nodes = materialize(live.groupBy(F.col("host").alias("h"), F.col("tmpl").alias("t")).agg(F.sum("n").alias("node_n"), F.count("*").alias("node_paths")), "path-nodes")
        at_node = (F.col("host") == F.col("h")) & (F.col("tmpl") == F.col("t"))
        segments = live.groupBy("host", "tmpl", "seg").agg(
            F.sum("n").alias("seg_n"), F.count("*").alias("paths"), F.sum((F.col("labelled") > 0).cast("long")).alias("known"), F.sum((F.col("blocked") > 0).cast("long")).alias("bad"))
        segments = materialize(segments.join(nodes.filter("node_paths > 1"), at_node).withColumn(
            "often", (F.col("seg_n") >= SUPPORT) & (F.col("seg_n") >= SHARE * F.col("node_n"))).withColumn("shape", shape(F.col("seg"))).drop("h", "t", "node_paths"), "node-segments")
        often = segments.filter("often").select(F.col("host").alias("h"), F.col("tmpl").alias("t"), F.col("seg").alias("s"), F.concat(F.lit("="), F.col("seg")).alias("name"))
        named = materialize(often.unionByName(kept_apart(segments.filter("NOT often"))), "named-segments")
        alone = nodes.filter("node_paths = 1").select(F.col("h").alias("ah"), F.col("t").alias("at"))
        joined = d.join(named, at_node & (F.col("seg") == F.col("s")), "left").join(
            alone, (F.col("host") == F.col("ah")) & (F.col("tmpl") == F.col("at")) & F.col("seg").isNotNull(), "left")
        rest = F.transform(F.slice("segs", level + 1, F.greatest(F.lit(0), F.size("segs") - level)),
                           lambda x: F.when(F.col("n") >= SUPPORT, F.concat(F.lit("="), x)).otherwise(F.concat(F.lit("~"), shape(x))))
        grown = F.when(F.col("seg").isNull(), F.col("tmpl")).when(F.col("ah").isNotNull(), F.concat("tmpl", rest)).otherwise(
            F.concat("tmpl", F.array(F.coalesce("name", F.concat(F.lit("~"), shape(F.col("seg")))))))
        t = materialize(joined.select(*[F.col(c) for c in paths.columns], "segs", grown.alias("tmpl"),
                                      (F.col("done") | F.col("ah").isNotNull() | F.col("seg").isNull()).alias("done")), "paths")
        level += 1
    return t.drop("segs", "done")


def merged(own: DataFrame) -> DataFrame:
    """``own`` (host, tmpl, labelled, blocked) with ``cur``, the template it is merged into."""
    m = materialize(own.withColumn("cur", F.col("tmpl")), "templates")
    # only places that hold a literal somewhere can merge
    literal = m.select(F.posexplode("tmpl").alias("i", "name")).filter(F.col("name").startswith("=")).select("i").distinct()
    for i in sorted((r.i for r in literal.collect()), reverse=True):
        now = m.groupBy("host", "cur").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        at = F.get("cur", F.lit(i))
        # the literal at place i is blanked: what remains is the group
        around = F.concat(F.slice("cur", 1, i), F.array(F.lit("*")), F.slice("cur", i + 2, 1 << 30))
        now = now.filter(at.startswith("=")).withColumn("around", around).withColumn("known", F.col("l") > 0)
        # at most 1 / SHARE segments of a node are literal, so a group has as many members
        rate = F.try_divide("b", "l")
        sisters = W.partitionBy("host", "around", "known").orderBy(F.coalesce(rate, F.lit(0.0)), "cur")
        lb, ll = F.lag("b").over(sisters), F.lag("l").over(sisters)
        p = F.try_divide(F.col("b") + lb, F.col("l") + ll)
        error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), ll)))
        apart = F.col("known") & (F.abs(rate - F.try_divide(lb, ll)) > Z * error)
        now = now.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("cluster", F.sum("apart").over(sisters))
        now = now.withColumn("k", F.count("*").over(W.partitionBy("host", "around", "known", "cluster")))
        name = F.when(F.col("known"), F.concat(F.lit("*"), F.col("cluster").cast("string"))).otherwise(F.lit("*?"))
        into = F.concat(F.slice("cur", 1, i), F.array(name), F.slice("cur", i + 2, 1 << 30))
        moves = materialize(now.filter("k > 1").select(F.col("host").alias("mh"), F.col("cur").alias("mc"), into.alias("into")), "template-moves")
        m = m.join(moves, (F.col("host") == F.col("mh")) & (F.col("cur") == F.col("mc")), "left").select(
            *own.columns, F.coalesce("into", "cur").alias("cur"))
        m = materialize(m, "templates")
    return m


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    d = pick(pages, page_id=id_col, url=url_col)
    host, path = parts(F.col("url"))
    d = d.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    d = materialize(d.withColumn("rule", rule).withColumn("said", said), "pages")
    paths = d.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("said").alias("labelled"),
                                          F.sum((F.coalesce("said", F.lit("")) == "block").cast("long")).alias("blocked"))
    t = materialize(templates(paths), "templated")
    own = t.groupBy("host", "tmpl").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    m = merged(own)
    purity = (F.sum("blocked") + A) / (F.sum("labelled") + 2 * A)
    rated = materialize(m.groupBy("host", "cur").agg(purity.alias("purity")).select(F.col("host").alias("rh"), F.col("cur").alias("rc"), "purity"), "purity")
    verdicts = materialize(m.join(rated, (F.col("host") == F.col("rh")) & (F.col("cur") == F.col("rc"))).select(
        F.col("host").alias("vh"), F.col("tmpl").alias("vt"), F.array_join("cur", "/").alias("template"), "purity"), "verdicts")
    of = t.join(verdicts, (F.col("host") == F.col("vh")) & (F.col("tmpl") == F.col("vt"))).select(
        F.col("host").alias("ph"), F.col("path").alias("pp"), "template", "purity")
    of = materialize(of, "path-verdicts")
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return d.join(of, (F.col("host") == F.col("ph")) & (F.col("path") == F.col("pp"))).select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "purity")


def op4_url_templates(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
