"""Column helpers: identities, roundings, intervals of proportions, exact tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEFT, RIGHT = "Left", "Right"


# -- names and identities ------------------------------------------------------------------------------------


def family(reco: Column) -> Column:
    """Coarse corpus family of a recording id (prefixes and labels are fixed values)."""
    parts = F.split(reco, "_")
    return (
        F.when(reco.startswith("ta_IN_"), "IN_stereo")
        .when(reco.startswith("ta_CRESC_"), "CRESC")
        .when((F.size(parts) > 2) & (F.get(parts, F.lit(1)) == "SHA1P"), F.concat(F.lit("SHA1P_"), F.get(parts, F.lit(2))))
        .otherwise("other")
    )


def is_conversational(reco: Column) -> Column:
    return ~family(reco).isin("SHA1P_M", "other")


def leg_of(reco: Column) -> tuple[Column, Column]:
    """(base, side) of a stereo leg, cut at the last underscore; nulls for anything else."""
    pattern = "^(ta_IN_.*)_([^_]*)$"
    base, side = F.regexp_extract(reco, pattern, 1), F.regexp_extract(reco, pattern, 2)
    known = side.isin(LEFT, RIGHT)
    return F.when(known, base), F.when(known, side)


def leg_id(base: Column, side: Column) -> Column:
    return F.concat_ws("_", base, side)


def other_side(side: Column) -> Column:
    return F.when(side == LEFT, RIGHT).otherwise(LEFT)


def sample_id(base: Column, side: Column, t_ms: Column) -> Column:
    """base_S_00001234; format_string, for lpad would cut longer times."""
    return F.format_string("%s_%s_%08d", base, F.substring(side, 1, 1), t_ms)


def short_hash(text: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


# -- arithmetic ----------------------------------------------------------------------------------------------


def overlap(a0, a1, b0, b1) -> Column:
    """Length shared by two intervals, 0 when apart."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num / den as DOUBLE, `empty` where den is zero."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(empty))


def half_even(num: Column, den: Column) -> Column:
    """Integer nearest to num / den for non-negative integers, ties to even, in integer arithmetic."""
    r2 = 2 * (num % den)
    q = ((num - num % den) / den).cast("long")
    return q + F.when((r2 > den) | ((r2 == den) & (q % 2 == 1)), 1).otherwise(0)


def words_in(text: Column) -> Column:
    """Words of a text, cut at any Unicode white space, without empty ones."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_in(text)).cast("long")


def band(p: Column, edges: list[float]) -> Column:
    """Number of the band [lo, hi) that holds p; the last band is closed; null outside."""
    out = F.when(p == edges[-1], len(edges) - 2)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = out.when((p >= lo) & (p < hi), i)
    return out


def gap_speed(gap_ms: Column) -> Column:
    """fast under 350 ms, mid under 800 ms, else slow."""
    return F.when(gap_ms < 350, "fast").when(gap_ms < 800, "mid").otherwise("slow")


# -- proportions and tests -------------------------------------------------------------------------------------


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % score interval of k / n; (0, 0) at n = 0."""
    p = k / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = (mid - half) / scale, (mid + half) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), high)).otherwise(0.0)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of the discordant counts, at most 1; 1 without any.

    The tail is summed in logarithms of terms, so large counts neither overflow nor vanish early.
    """
    n, k = b + c, F.least(b, c)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step, lambda acc: acc["sum"])).otherwise(F.exp(-n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
