"""Distribution mapping and extremes (M)."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions.scalar import col
from squallframe.functions.stats import gamma
from squallframe.session import settle
from squallframe.operators.ordered import lookup_rows, running_counts, value_counts


def model_curve(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(x, p, p_left): P(X <= x) at each distinct value and the probability reached just from the left."""
    rc = running_counts(value_counts(rows, keys, value), keys, value)
    return rc.select(
        *keys, F.col(value).cast("double").alias("x"), (F.col("n_le") / F.col("n_total")).alias("p"),
        ((F.col("n_lt") + 1) / F.col("n_total")).alias("p_left"),
    )


def observed_curve(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(p, x): each distinct value at the probability of its first tied rank."""
    rc = running_counts(value_counts(rows, keys, value), keys, value)
    return rc.select(*keys, ((F.col("n_lt") + 1) / F.col("n_total")).alias("p"), F.col(value).cast("double").alias("x"))


def rank_curve(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(p, x): every rank of the sorted sample, a run of ties given by its two ends."""
    rc = running_counts(value_counts(rows, keys, value), keys, value)
    ends = F.array_distinct(F.array(F.col("n_lt") + 1, F.col("n_le")))
    return rc.withColumn("_r", F.explode(ends)).select(
        *keys, (F.col("_r") / F.col("n_total")).alias("p"), F.col(value).cast("double").alias("x")
    )


def quantile_map(
    rows: DataFrame, reference: DataFrame, observed: DataFrame, model_keys: Sequence[str], obs_keys: Sequence[str], value: str,
    out: str = "mapped", keep_zero: bool = True, pooled: bool = False, unique: bool = False,
) -> DataFrame:
    """Map ``rows`` through the model's reference distribution onto the observed one.

    ``reference`` gives the model distribution per ``model_keys``, ``observed`` the target per
    ``obs_keys`` (a subset).  Results stay inside the observed range; zeros stay zero if asked.
    ``pooled`` keeps every rank of the observed sample, else ties take their first rank.  Each distinct
    value is mapped once and joined back; ``unique`` says the rows hardly repeat values, and skips that.
    """
    curve = settle(model_curve(reference, model_keys, value))
    target = settle(rank_curve(observed, obs_keys, value) if pooled else observed_curve(observed, obs_keys, value))
    names = [*model_keys, value]
    asked = rows if unique else rows.select(*names).distinct()
    with_p = settle(lookup_rows(asked, curve, model_keys, value, "x", "p", "_p", fp_left="p_left"))
    found = lookup_rows(with_p, target, obs_keys, "_p", "p", "x", out).drop("_p")
    if keep_zero:
        found = found.withColumn(out, F.when(F.col(value) == 0, 0.0).otherwise(F.col(out)))
    if unique:
        return found
    found = found.select(*[F.col(c).alias(f"_k_{c}") for c in names], out)
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in names])
    return rows.join(found, match, "left").select(*rows.columns, out)


def empirical_return_levels(
    df: DataFrame, keys: Sequence[str], value: str, periods: Sequence[float], per_year: float = 365.25
) -> DataFrame:
    """Value exceeded on average every T years, from the sample's own distribution.

    The rank with F = 1 has no finite period; beyond the last finite one the largest value is used.
    """
    ranks = rank_curve(df, keys, value).where(F.col("p") < 1)
    knots = settle(ranks.groupBy(*keys, "p").agg(F.max("x").alias("x")).withColumn("T", 1.0 / (1.0 - F.col("p")) / per_year))
    top = df.groupBy(*keys).agg(F.max(value).alias("_max"))
    last = knots.groupBy(*keys).agg(F.max("T").alias("_last"))
    asked = top.join(last, list(keys), "left").withColumn("T", F.explode(F.array(*[F.lit(float(t)) for t in periods])))
    found = lookup_rows(asked, knots, keys, "T", "T", "x", "level")
    level = F.when(F.col("T") > F.coalesce("_last", F.lit(0.0)), F.col("_max").cast("double")).otherwise(F.col("level"))
    return found.select(*keys, "T", level.alias("level"))


def return_curve(df: DataFrame, keys: Sequence[str], value: str, per_year: float = 365.25) -> DataFrame:
    """(T, value) of every distinct value, without the unbounded last rank."""
    c = model_curve(df, keys, value).where(F.col("p") < 1)
    return c.select(*keys, (1.0 / (1.0 - F.col("p")) / per_year).alias("T"), F.col("x").alias(value))


def sample_l_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """l1, l2, t3 from probability-weighted moments.

    The samples are annual maxima (one row per year and key), so the rank window is short.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    x, j, n = F.col(value), F.col("_j"), F.col("_n")
    rows = df.where(x.isNotNull()).select(
        *keys, value, F.row_number().over(w).alias("_j"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n")
    )
    b = rows.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.avg(x).alias("b0"),
        F.avg(x * (j - 1) / F.nullif(n - 1, F.lit(0))).alias("b1"),
        F.avg(x * (j - 1) * (j - 2) / F.nullif((n - 1) * (n - 2), F.lit(0))).alias("b2"),
    )
    l2 = 2 * F.col("b1") - F.col("b0")
    l3 = 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    return b.select(*keys, "n", F.col("b0").alias("l1"), l2.alias("l2"), (l3 / F.nullif(l2, F.lit(0.0))).alias("t3"))


def _gev_from(l1, l2, t3) -> tuple[Column, Column, Column]:
    c = 2.0 / (3.0 + t3) - math.log(2) / math.log(3)
    k = 7.8590 * c + 2.9554 * c * c
    k = F.when(F.abs(k) < 1e-6, 1e-6).otherwise(k)
    g = gamma(1.0 + k)
    scale = l2 * k / ((1.0 - F.pow(F.lit(2.0), -k)) * g)
    return k, l1 - scale * (1.0 - g) / k, scale


def gev_by_l_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """GEV (c, loc, scale) per key by Hosking's closed form; ``fit_failed`` marks unusable samples."""
    m = sample_l_moments(df, keys, value)
    bad = F.col("l2").isNull() | (F.col("l2") <= 0) | F.col("t3").isNull() | (F.abs(F.col("t3")) >= 1)
    k, loc, scale = _gev_from(F.col("l1"), F.col("l2"), F.col("t3"))
    pick = lambda c: F.when(~bad, c)
    return m.select(*keys, "n", pick(k).alias("c"), pick(loc).alias("loc"), pick(scale).alias("scale"), bad.cast("int").alias("fit_failed"))


def weibull_by_l_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Weibull (c, loc, scale) per key: the GEV of the negated sample, turned round."""
    m = sample_l_moments(df, keys, value)
    bad = F.col("l2").isNull() | (F.col("l2") <= 0) | F.col("t3").isNull() | (F.abs(F.col("t3")) >= 1)
    k, loc, scale = _gev_from(-F.col("l1"), F.col("l2"), -F.col("t3"))
    bad = bad | (k <= 0)
    pick = lambda c: F.when(~bad, c)
    return m.select(
        *keys, "n", pick(1.0 / k).alias("c"), pick(-loc - scale / k).alias("loc"), pick(scale / k).alias("scale"), bad.cast("int").alias("fit_failed")
    )


def gev_return_level(c, loc, scale, period) -> Column:
    """Level exceeded once in ``period`` years; null up to one year."""
    c, loc, scale, t = col(c), col(loc), col(scale), col(period)
    y = -F.ln(1.0 - 1.0 / F.when(t > 1, t))
    shaped = loc + scale / F.nullif(c, F.lit(0.0)) * (1.0 - F.pow(y, c))
    return F.when(c == 0, loc - scale * F.ln(y)).otherwise(shaped)


def weibull_return_level(c, loc, scale, period) -> Column:
    c, loc, scale, t = col(c), col(loc), col(scale), col(period)
    return loc + scale * F.pow(F.ln(F.when(t > 1, t)), 1.0 / c)


def log_spaced(df: DataFrame, first: float, last: float, n: int, out: str = "T") -> DataFrame:
    """Repeat rows for n log-spaced values."""
    step = (math.log10(last) - math.log10(first)) / (n - 1)
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("_i", i).withColumn(out, F.pow(F.lit(10.0), math.log10(first) + F.col("_i") * step)).drop("_i")


def box_statistics(df: DataFrame, keys: Sequence[str], value: str, above: float) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers clipped to the data, outliers, and the count above a limit."""
    from squallframe.operators.ordered import quantiles

    q = quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    rows = df.join(q, list(keys))
    iqr = F.col("q75") - F.col("q25")
    low, high, v = F.col("q25") - 1.5 * iqr, F.col("q75") + 1.5 * iqr, F.col(value)
    return rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("q25", "q50", "q75")],
        F.min(F.when(v >= low, v)).alias("whisker_low"), F.max(F.when(v <= high, v)).alias("whisker_high"),
        F.sum(((v < low) | (v > high)).cast("int")).alias("outliers"), F.sum((v >= above).cast("int")).alias("n_above"),
    )
