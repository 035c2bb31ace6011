"""Column-expression helpers. All of them stay JVM-side (codegen), no Python UDFs."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_HOUR = 3_600_000_000.0
US_PER_SECOND = 1_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """P1 for one value: text / null / NaN / non-numeric -> 0.0, ' 3 ' -> 3.0, 'inf' -> inf.

    ``try_cast`` keeps ANSI mode from failing on bad text; it maps 'NaN' to NaN (not
    NULL), hence the ``nanvl``.
    """
    if isinstance(c, str):  # one JVM call instead of four
        return F.expr(f"coalesce(nanvl(try_cast(`{c}` AS DOUBLE), {dlit(0.0)}), {dlit(0.0)})")
    x = col_(c).try_cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (no ANSI divide-by-zero error)."""
    return F.when(col_(den) != 0, col_(num) / col_(den))


def hours_between(later, earlier) -> Column:
    """Exact microsecond difference in hours (unix_timestamp would truncate to seconds)."""
    return (F.unix_micros(col_(later)) - F.unix_micros(col_(earlier))) / F.lit(US_PER_HOUR)


def dlit(x: float | str) -> str:
    """A DOUBLE literal in SQL text (exact: the shortest repr round-trips); text is SQL
    already (a per-app coefficient column)."""
    if isinstance(x, str):
        return x
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def linear_sql(coefs: dict[str, float], intercept: float, present: set[str] | None = None,
               extra: list[tuple[str, float]] | None = None) -> str:
    """SQL text of intercept + w1 * x1 + w2 * x2 + ... (left to right, listed order)."""
    z = dlit(intercept)
    for name, w in list(coefs.items()) + list(extra or []):
        if present is not None and name not in present:
            continue
        z = f"{z} + {dlit(w)} * `{name}`"
    return f"({z})"


def logistic(z) -> Column:
    if isinstance(z, str):
        return F.expr(f"{dlit(1.0)} / ({dlit(1.0)} + exp(-{z}))")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(z)))


def linear(coefs: dict[str, float], intercept: float, present: set[str] | None = None) -> Column:
    """intercept + sum(w * x) in the listed order. Names absent from ``present`` count as 0.

    Built as one SQL expression: a single call to the JVM instead of ~4 per term (a
    25-term model would otherwise cost hundreds of driver round trips per plan)."""
    return F.expr(linear_sql(coefs, intercept, present))


def uniform_draw(seed: str, *parts) -> Column:
    """Reproducible U[0,1) from a hash of (seed, parts...).

    Pure function of its inputs, so a task retry or a different partitioning never
    changes a draw (unlike rand()). The same value in SQL:
    ``('0x' || substr(md5(concat_ws('|', seed, ...)), 1, 8))::BIGINT / 4294967296``.
    """
    key = F.concat_ws("|", F.lit(seed), *[col_(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


# halvings that exhaust any array (its size is a 32-bit int)
SEARCH_STEPS = 32


def left_rank(sorted_arr, x) -> Column:
    """Number of elements of an ascending array strictly below x (numpy searchsorted 'left').

    Binary search as a higher-order ``aggregate``; one plan serves many apps with
    different arrays. NaN x sorts after every number in Spark, so it gets len(arr).
    """
    arr = col_(sorted_arr)
    n = F.size(arr)
    init = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.get(arr, mid) < col_(x)
        return F.when(lo >= hi, acc).otherwise(
            F.when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
             .otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))))

    # n elements are exhausted by as many halvings as n has binary digits
    halvings = F.least(F.lit(SEARCH_STEPS), F.length(F.bin(n.cast("bigint"))))
    return F.aggregate(F.sequence(F.lit(1), halvings), init, step)["lo"]


def first_matching_tier(tiers, score, default: str = "low") -> Column:
    """Tiers in listed order, first with score >= threshold; none (or NaN score) -> default."""
    hit = F.get(F.filter(col_(tiers), lambda t: col_(score) >= t["threshold"]), 0)["name"]
    return F.when(F.isnan(col_(score)) | col_(score).isNull(), F.lit(default)) \
            .otherwise(F.coalesce(hit, F.lit(default)))


def percentile_from_rank(idx, n) -> Column:
    """int(idx / n * 100) clamped to 0..99; empty quantile list -> 50.

    Evaluated in doubles in this order, then truncated (idx 290/570/580 of 1000 ->
    28/56/57, same as the service).
    """
    raw = F.floor(col_(idx).cast("double") / F.greatest(col_(n), F.lit(1)).cast("double") * F.lit(100.0))
    return F.when(col_(n) == 0, F.lit(50)).otherwise(
        F.least(F.greatest(raw, F.lit(0)), F.lit(99)).cast("int"))


def double_array(values) -> Column:
    """A constant array<double> built in one JVM call (foldable, e.g. for percentile lists)."""
    return F.expr("array(" + ", ".join(dlit(v) for v in values) + ")")


# (time, id) pairs packed into one DECIMAL(38,0) that orders like the pair: time in
# microseconds (any date in years 1-9999) times 10^20, plus the id shifted into
# [0, 2^64). min / max over it pick the same row as min / max over struct(time, id), but
# a decimal aggregate buffer is updatable in place, so Spark keeps a hash aggregate
# (with map-side combine) instead of sorting the rows.
_PAIR_SCALE = "100000000000000000000"       # 10^20 > 2^64
_ID_SHIFT = "9223372036854775808"           # 2^63


def pair_key(ts, ident) -> Column:
    return F.expr(
        f"CAST(unix_micros({ts}) AS DECIMAL(38,0)) * CAST({_PAIR_SCALE} AS DECIMAL(38,0)) "
        f"+ (CAST({ident} AS DECIMAL(38,0)) + CAST({_ID_SHIFT} AS DECIMAL(38,0)))")


def pair_ts(key: str) -> Column:
    return F.expr(f"timestamp_micros(CAST(floor({key} / CAST({_PAIR_SCALE} AS DECIMAL(38,0))) AS BIGINT))")


def pair_id(key: str) -> Column:
    return F.expr(f"CAST({key} - floor({key} / CAST({_PAIR_SCALE} AS DECIMAL(38,0))) "
                  f"* CAST({_PAIR_SCALE} AS DECIMAL(38,0)) - CAST({_ID_SHIFT} AS DECIMAL(38,0)) AS BIGINT)")
