"""Operator 9 (native): host-level quality rules.

Base figures of a text come from string and array functions inside its own row; nothing is
exploded, no text is shuffled. A document's method failures are rules on those figures;
they are counted by host (column ``source``), each host's failure rate is shrunk towards
the hosts' common rate by a beta prior fitted to all hosts (method of moments), and the
host's verdict is joined back: documents of a host whose shrunk rate exceeds
``HOST_RATE`` are dropped, others keep their own base verdict.

Windows of three words are told apart by their 64-bit xxHash within one text.

Host table: partial sums per task, then one row a host. It is broadcast only when the
counted hosts are at most ``BROADCAST_HOSTS``; beyond, the join shuffles and a hot host is
split by adaptive execution.

Edge cases: a null text has no words and fails the base rule (fewer than 50 words); null
sources are one host of their own; one host alone, or hosts that all agree, give a prior
of weight ``PRIOR_CAP`` (all hosts take the common rate); repeated rows count each; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onramp.session import materialize

from .common import pick, table

MIN_WORDS = 50
SYMBOL_SHARE = 0.1        # symbols per character of words above which a text fails
DUP_LINE_SHARE = 0.3      # repeated lines per line with a word above which a text fails
HOST_RATE = 0.5           # shrunk failure rate above which a host is dropped
PRIOR_CAP = 1e6           # largest prior weight (hosts that do not differ)
BROADCAST_HOSTS = 20_000  # of at most a few hundred bytes each

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words. Each step is a projection of its own, so that an array used several
    times is made once a row."""
    keep = [c for c in docs.columns if c != text]
    t = F.col("_t")
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select("*", F.filter(F.split(t, SPACE), lambda w: w != "").alias("_w"),
                 F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    d = d.select(*keep, "_w", F.size("_w").cast("long").alias("n_words"),
                 F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                 (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    return _repeat_words(d, "_w").drop("_w")


def _repeat_words(d: DataFrame, words: str) -> DataFrame:
    """Add n_repeat_words, the words that stand in a window of three found twice or more.

    Windows are hashed; where a hash occurs again they are sorted with their places, equal
    neighbours are repeats, and each repeated place adds the words that the place before
    it has not covered."""
    w, n = F.col(words), F.size(words)
    rest = F.greatest(n, F.lit(1))
    # arrays_zip pads the two shorter arrays with nulls: only the first n - 2 are windows
    windows = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), rest).alias("b"), F.slice(w, F.lit(3), rest).alias("c")),
                      F.lit(1), F.greatest(n - 2, F.lit(0)))
    d = d.withColumn("_h", F.when(n > 3, F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                                  F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                          lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def rules(d: DataFrame) -> DataFrame:
    """Add base_failed and failed (the base rule or a share of symbols or repeated lines)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    symbols = F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars")
    lines = F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines")
    return d.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | symbols | lines)


def beta_prior(sums) -> tuple[float, float]:
    """(mean, weight) of the hosts' beta prior from k hosts, n rows, f failures, n2 = sum of
    n squared and q = sum of f squared / n, by the moments of a beta-binomial sample."""
    k, n = sums["k"] or 0, float(sums["n"] or 0)
    if not n:
        return 0.0, PRIOR_CAP
    m = float(sums["f"]) / n
    spread = m * (1 - m)
    room = n - float(sums["n2"]) / n - (k - 1)
    if k < 2 or spread <= 0 or room <= 0:
        return m, PRIOR_CAP
    rho = (float(sums["q"]) - m * m * n - (k - 1) * spread) / (spread * room)
    return m, PRIOR_CAP if rho <= 1 / (1 + PRIOR_CAP) else max(0.0, 1 / rho - 1)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Figures, base_failed and kept of every row."""
    d = pick(docs, doc_id=id_col, text=text_col, host=host_col)
    d = materialize(rules(figures(d)), "host-rules")
    hosts = d.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    nd, fd = F.col("n").cast("double"), F.col("f").cast("double")
    sums = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(nd * nd).alias("n2"), F.sum(fd * fd / nd).alias("q")).first()
    mean, weight = beta_prior(sums)
    rate = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    verdict = hosts.select(F.col("host").alias("_host"), (rate <= HOST_RATE).alias("host_kept"))
    if sums["k"] <= BROADCAST_HOSTS:
        verdict = F.broadcast(verdict)
    return (d.join(verdict, F.col("host").eqNullSafe(F.col("_host")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.col("host_kept")).alias("kept")))


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
f AS (SELECT doc_id, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
r AS (SELECT *, base_failed OR n_symbols > {SYMBOL_SHARE}::DOUBLE * word_chars OR n_dup_lines > {DUP_LINE_SHARE}::DOUBLE * n_lines AS failed FROM b),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM r GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(n * n) AS n2, sum(f * f / n) AS q FROM h),
p AS (SELECT mean, CASE WHEN k < 2 OR mean * (1 - mean) <= 0 OR n - n2 / n - (k - 1) <= 0 THEN NULL
        ELSE (q - mean * mean * n - (k - 1) * mean * (1 - mean)) / (mean * (1 - mean) * (n - n2 / n - (k - 1))) END AS rho FROM m),
c AS (SELECT mean, CASE WHEN rho IS NULL OR rho <= 1 / (1 + {PRIOR_CAP!r}) THEN {PRIOR_CAP!r} ELSE greatest(0, 1 / rho - 1) END AS weight FROM p),
v AS (SELECT host, (f + mean * weight) / (n + weight) <= {HOST_RATE} AS host_kept FROM h, c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.host"""
