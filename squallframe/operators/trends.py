"""Trends, significance and correlation (N)."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions.draws import counted, lot, pick, picks
from squallframe.functions.stats import student_two_sided
from squallframe.operators.ordered import quantiles, row_numbers
from squallframe.operators.skill import spearman
from squallframe.session import settle

DIGITS = 9  # float noise below this does not decide a comparison of resampled means


def _ratio(a, b):
    return a / F.nullif(b, F.lit(0.0))


def draw_counts(sizes: DataFrame, n_rep: int, label: str, size: str = "n") -> DataFrame:
    """(n, rep, pos, times): how often each position of a sample of size n is drawn in a replicate.

    Draws depend on the sample size only, so cells of equal size share them.
    """
    reps = sizes.select(F.col(size).cast("long").alias("n")).distinct().where("n > 0")
    reps = reps.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))).withColumn("_start", lot(label, "rep"))
    draws = counted(reps.withColumn("_n", F.col("n")), ["n", "rep"], "_start", "_n")
    return draws.withColumn("pos", F.col("pos") + 1)


def resampled_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], n_rep: int, label: str) -> DataFrame:
    """Per key and replicate: weighted sums over a resample with replacement; ``times`` is the draw count.

    Positions come from a two-level count, draws meet rows by an equi-join on (n, position), and the
    sums are combined map-side, so one large key is spread over tasks.
    """
    numbered = row_numbers(df, keys, order, "pos").withColumn("n", F.col("pos_total").cast("long"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    joined = numbered.join(draw_counts(sizes, n_rep, label), ["n", "pos"])
    return joined.groupBy(*keys, "rep").agg(*[F.sum(c * F.col("times")).alias(n) for n, c in sums.items()])


def bootstrap_mean_test(
    df: DataFrame, keys: Sequence[str], side: str, order: str, value: str, n_rep: int = 1000, seed: str = "n1"
) -> DataFrame:
    """Two-sided p that sides 'a' and 'b' differ in mean: both are shifted to the pooled mean and resampled.

    Null when a side has no values.  Resampling a shifted sample equals shifting the resampled mean.
    """
    keys = list(keys)
    v = F.col(value)
    of = lambda s, c: F.when(F.col(side) == s, c)
    base = df.groupBy(*keys).agg(
        F.avg(of("a", v)).alias("mean_a"), F.avg(of("b", v)).alias("mean_b"), F.avg(v).alias("_m"),
    )
    sums = {"_s": F.coalesce(v, F.lit(0.0)), "_c": v.isNotNull().cast("int")}
    parts = []
    for s in ("a", "b"):
        rows = df.where(F.col(side) == s).select(*keys, order, value)
        r = resampled_sums(rows, keys, order, sums, n_rep, f"{seed}-{s}")
        parts.append(r.select(*keys, "rep", _ratio(F.col("_s"), F.col("_c").cast("double")).alias(f"_r{s}")))
    return _shifted_p(base, parts, keys).select(*keys, "mean_a", "mean_b", "p")


def bootstrap_flag_test(df: DataFrame, keys: Sequence[str], side: str, flag: Column, n_rep: int = 10000, seed: str = "n2") -> DataFrame:
    """``bootstrap_mean_test`` of a yes or no (null is no) without numbering a row: a side's yes rows own its first positions, so
    a draw is a yes where it lies below their number, and sides of equal size and number share their draws."""
    keys, block = list(keys), 4096
    yes = F.coalesce(flag, F.lit(False)).cast("long")
    of = lambda s, c: F.when(F.col(side) == s, c)
    base = df.groupBy(*keys).agg(*[f(of(s, yes)).alias(f"{n}_{s}") for s in "ab" for f, n in ((F.avg, "mean"), (F.count, "_n"), (F.sum, "_y"))])
    base = settle(base)

    @F.pandas_udf("long")
    def hits(start: pd.Series, part: pd.Series, n: pd.Series, y: pd.Series) -> pd.Series:
        """How many draws of a block lie below y."""
        every = zip(start, part * block, np.minimum(part * block + block, n), n, y)
        return pd.Series([int((picks(s, np.arange(lo, hi), size) < below).sum()) for s, lo, hi, size, below in every], dtype="int64")

    parts = []
    for s in "ab":
        sizes = base.where(f"_n_{s} > 0").select(*keys, F.col(f"_n_{s}").alias("_n"), F.col(f"_y_{s}").alias("_y"))
        reps = sizes.select("_n", "_y").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))).withColumn("_start", lot(f"{seed}-{s}", "rep"))
        blocks = reps.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block)))).repartition("_n", "_y", "rep", "_b")
        sums = blocks.select("_n", "_y", "rep", hits("_start", "_b", "_n", "_y").alias("_s")).groupBy("_n", "_y", "rep").agg(F.sum("_s").alias("_s"))
        parts.append(sizes.join(sums, ["_n", "_y"]).select(*keys, "rep", (F.col("_s") / F.col("_n")).alias(f"_r{s}")))
    return _shifted_p(base, parts, keys).select(*keys, "mean_a", "mean_b", "p")


def _shifted_p(base: DataFrame, parts: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Adds p to the means of both sides, from the resampled means of each."""
    both = parts[0].join(parts[1], [*keys, "rep"]).join(base, keys)
    diff = F.round(F.col("mean_b") - F.col("mean_a"), DIGITS)
    shifted = F.round((F.col("_rb") - F.col("mean_b")) - (F.col("_ra") - F.col("mean_a")), DIGITS)
    counted = both.groupBy(*keys).agg(
        F.avg((shifted >= diff).cast("double")).alias("_up"), F.avg((shifted <= diff).cast("double")).alias("_low")
    )
    out = base.join(counted, keys, "left")
    return out.withColumn("p", 2 * F.least("_up", "_low"))


# The seasons of the trend table.
TREND_SEASONS = {"ANN": list(range(1, 13)), "ASO": [8, 9, 10], "NDJ": [11, 12, 1], "FMA": [2, 3, 4], "MJJ": [5, 6, 7]}


def in_seasons(df: DataFrame, time: str, seasons: dict[str, list[int]]) -> DataFrame:
    table = refs.period_months(df.sparkSession, seasons).withColumnsRenamed({"period": "season", "month": "_month"})
    return df.withColumn("_month", F.month(time)).join(table, "_month").drop("_month")


def halves(time: str, first: tuple[int, int], second: tuple[int, int]) -> Column:
    """'a' or 'b' by explicit year ranges."""
    y = F.year(time)
    return F.when(y.between(*first), "a").when(y.between(*second), "b")


def trend_table(
    daily: DataFrame, station: str, day: str, value: str, strong: float, first: tuple[int, int], second: tuple[int, int],
    n_rep: int = 0, order: str | None = None, strong_rep: int = 0,
) -> DataFrame:
    """Change of the mean and of strong days per year between two halves, per station and season, with N1 p of the values and,
    as ``strong_p``, of the flag of strong days."""
    rows = in_seasons(daily, day, TREND_SEASONS).withColumn("half", halves(day, first, second)).where("half IS NOT NULL")
    v = F.col(value)
    years = rows.groupBy(station, "season", "half", F.year(day).alias("_y")).agg(
        F.sum(v).alias("_s"), F.count(v).alias("_n"), F.sum((v >= strong).cast("int")).alias("_d")
    )
    g = years.groupBy(station, "season").agg(
        *[F.sum(F.when(F.col("half") == h, F.col("_s"))).alias(f"s{h}") for h in "ab"],
        *[F.sum(F.when(F.col("half") == h, F.col("_n"))).alias(f"n{h}") for h in "ab"],
        *[F.avg(F.when(F.col("half") == h, F.col("_d"))).alias(f"d{h}") for h in "ab"],
    )
    out = g.select(
        station, "season", (F.col("sb") / F.col("nb") - F.col("sa") / F.col("na")).alias("mean_change"), (F.col("db") - F.col("da")).alias("strong_change")
    )
    if n_rep:
        test = bootstrap_mean_test(rows, [station, "season"], "half", order or day, value, n_rep)
        out = out.join(test.select(station, "season", "p"), [station, "season"], "left")
    if strong_rep:
        test = bootstrap_flag_test(rows, [station, "season"], "half", v >= strong, strong_rep)
        out = out.join(test.select(station, "season", F.col("p").alias("strong_p")), [station, "season"], "left")
    return out


def grid_trend(
    days: DataFrame, cell: Sequence[str], day: str, flag: str, first: tuple[int, int], second: tuple[int, int], n_rep: int = 0
) -> DataFrame:
    """Percent change of flagged days per cell; null where either half has none.  Optional N1 p on yearly counts."""
    years = days.withColumn("half", halves(day, first, second)).where("half IS NOT NULL")
    years = years.groupBy(*cell, "half", F.year(day).alias("year")).agg(F.sum(F.col(flag).cast("double")).alias("_d"))
    g = years.groupBy(*cell).agg(*[F.coalesce(F.sum(F.when(F.col("half") == h, F.col("_d"))), F.lit(0.0)).alias(h) for h in "ab"])
    none = (F.col("a") == 0) | (F.col("b") == 0)
    out = g.select(*cell, F.col("a").alias("days_a"), F.col("b").alias("days_b"), F.when(~none, (F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0)) * 100).alias("change"))
    if n_rep:
        test = bootstrap_mean_test(years, cell, "half", "year", "_d", n_rep).select(*cell, "p")
        out = out.join(test, list(cell), "left").withColumn("p", F.when(F.col("change").isNotNull(), F.col("p")))
    return out


def regional_event_trend(
    days: DataFrame, day: str, flag: Column, first: tuple[int, int], second: tuple[int, int], n_rep: int, seed: str = "n4"
) -> DataFrame:
    """Days with any event in the rows per half, change per decade, and its bootstrap 95 % range."""
    decades = (second[1] - first[0] + 1) / 2.0 / 10.0
    any_day = days.groupBy(F.to_date(day).alias("_day")).agg(F.max(F.coalesce(flag, F.lit(False)).cast("int")).alias("_e"))
    rows = any_day.withColumn("half", halves("_day", first, second)).where("half IS NOT NULL").withColumn("_o", F.unix_date("_day"))
    total = rows.agg(*[F.sum(F.when(F.col("half") == h, F.col("_e"))).alias(f"days_{h}") for h in "ab"])
    parts = [
        resampled_sums(rows.where(F.col("half") == h), [], "_o", {f"_{h}": F.col("_e")}, n_rep, f"{seed}-{h}") for h in "ab"
    ]
    trend = parts[0].join(parts[1], "rep").select(((F.col("_b") - F.col("_a")) / decades).alias("_t"))
    # one number per replicate
    bounds = trend.agg(F.percentile("_t", F.lit(0.025)).alias("lower"), F.percentile("_t", F.lit(0.975)).alias("upper"))
    return total.crossJoin(F.broadcast(bounds)).select(  # one row each
        "days_a", "days_b", ((F.col("days_b") - F.col("days_a")) / decades).alias("trend"), "lower", "upper"
    )


def bootstrap_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, n_rep: int, seed: str = "n5") -> DataFrame:
    """OLS slope per key and its standard deviation over resamples of the points."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    centre = df.groupBy(*keys).agg(F.regr_slope(Y, X).alias("slope"), F.avg(X).alias("_x0"))
    rows = df.join(centre.select(*keys, "_x0"), list(keys)).withColumn("_x", X - F.col("_x0"))
    x_ = F.col("_x")
    r = resampled_sums(rows.select(*keys, x, "_x", Y.alias("_y")), keys, x, {"w": F.lit(1), "sx": x_, "sy": F.col("_y"), "sxy": x_ * F.col("_y"), "sxx": x_ * x_}, n_rep, seed)
    n = F.col("w")
    slope = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.round(n * F.col("sxx") - F.col("sx") * F.col("sx"), DIGITS), F.lit(0.0))
    std = r.withColumn("_s", slope).groupBy(*keys).agg(F.stddev_pop("_s").alias("slope_std"))
    return centre.drop("_x0").join(std, list(keys), "left")


def annual_summaries(df: DataFrame, keys: Sequence[str], time: str, value: str, above: float) -> DataFrame:
    """Per key and year: count at or above a value, mean, maximum and range."""
    v = F.col(value)
    return df.groupBy(*keys, F.year(time).alias("year")).agg(
        F.sum((v >= above).cast("int")).alias("n_above"), F.avg(v).alias("mean"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range")
    )


def interannual_series(df: DataFrame, keys: Sequence[str], time: str, value: str, prob: float) -> DataFrame:
    """Annual mean, and rows above the key's own percentile."""
    q = quantiles(df, keys, value, {"limit": prob})
    rows = df.join(q, list(keys))
    return rows.groupBy(*keys, F.year(time).alias("year")).agg(
        F.avg(value).alias("mean"), F.sum((F.col(value) > F.col("limit")).cast("int")).alias("n_above")
    )


def welch(groups: DataFrame, keys: Sequence[str], value: str, side: str, pooled: bool = False) -> DataFrame:
    """Mean difference b - a with t, degrees of freedom and p; unequal variances unless ``pooled``."""
    of = lambda s, f: f(F.when(F.col(side) == s, F.col(value).cast("double")))
    g = groups.groupBy(*keys).agg(
        *[of(s, f).alias(f"{n}{s}") for s in "ab" for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count), ("lo", F.min), ("hi", F.max))]
    )
    # merging partial variances of equal values can leave a trace above zero
    g = g.withColumns({f"v{s}": F.when((F.col(f"n{s}") > 1) & (F.col(f"lo{s}") == F.col(f"hi{s}")), 0.0).otherwise(F.col(f"v{s}")) for s in "ab"})
    va, vb = _ratio(F.col("va"), F.col("na").cast("double")), _ratio(F.col("vb"), F.col("nb").cast("double"))
    if pooled:
        dof = F.col("na") + F.col("nb") - 2.0
        sp = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(dof, F.lit(0.0))
        se2 = sp * (1.0 / F.col("na") + 1.0 / F.col("nb"))
    else:
        se2 = va + vb
        dof = _ratio(se2 * se2, va * va / F.nullif(F.col("na") - 1.0, F.lit(0.0)) + vb * vb / F.nullif(F.col("nb") - 1.0, F.lit(0.0)))
    t = (F.col("ma") - F.col("mb")) / F.nullif(F.sqrt(se2), F.lit(0.0))
    out = g.select(*keys, (F.col("mb") - F.col("ma")).alias("change"), t.alias("t"), dof.alias("dof"))
    return out.withColumn("p", student_two_sided("t", "dof"))


def yearly_exceedances(
    df: DataFrame, keys: Sequence[str], time: str, exceeds: Column, side: str, periods: dict[str, list[int]] = refs.PERIODS
) -> DataFrame:
    """Exceedances per key, period and calendar year, for N7; months are counted once, then joined to periods."""
    months = df.groupBy(*keys, side, F.year(time).alias("year"), F.month(time).alias("month")).agg(F.sum(exceeds.cast("int")).alias("_n"))
    joined = months.join(refs.period_months(df.sparkSession, periods), "month")
    return joined.groupBy(*keys, "period", side, "year").agg(F.sum("_n").alias("n"))


def ensemble_change(changes: DataFrame, keys: Sequence[str], value: str = "change", agree: int = 10) -> DataFrame:
    """Median change over models, mean, and 1 where at least ``agree`` models share the median's sign."""
    med = changes.groupBy(*keys).agg(
        F.median(value).alias("median"), F.avg(value).alias("mean"),  # one value per model
        F.sum((F.col(value) > 0).cast("int")).alias("_up"), F.sum((F.col(value) < 0).cast("int")).alias("_down"),
    )
    same = F.when(F.col("median") > 0, F.col("_up")).when(F.col("median") < 0, F.col("_down")).otherwise(0)
    return med.select(*keys, "median", "mean", (F.coalesce(same, F.lit(0)) >= agree).cast("int").alias("agreement"))


def index_correlation(series: DataFrame, index: DataFrame, cell: Sequence[str], on: Sequence[str], value: str, idx: str) -> DataFrame:
    """Spearman correlation of a cell's seasonal series with an index, with its p."""
    rows = series.join(index, list(on))
    rho = spearman(rows, cell, value, idx, "rho")
    n = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    out = rho.join(n, list(cell))
    r = F.least(F.greatest(F.col("rho"), F.lit(-1.0)), F.lit(1.0))
    t = r * F.sqrt((F.col("n") - 2.0) / F.nullif(F.round(1.0 - r * r, DIGITS + 3), F.lit(0.0)))
    return out.withColumn("_t", t).withColumn("_d", F.col("n") - 2.0).withColumn("p", student_two_sided("_t", "_d")).drop("_t", "_d")


def permuted_correlation(
    series: DataFrame, index: DataFrame, cell: Sequence[str], on: str, value: str, idx: str, n_perm: int, seed: str = "n9"
) -> DataFrame:
    """Pearson r and the share of permutations of the index with |r| at least as large.

    A permutation is the order of a hash of (permutation, year): a short table of years per permutation.
    """
    years = index.select(on, idx)  # one row per year
    perms = years.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))).withColumn("_u", lot(seed, "perm", on))
    shuffled = perms.select("perm", idx, F.row_number().over(Window.partitionBy("perm").orderBy("_u", on)).alias("_r"))
    places = years.select(on, F.row_number().over(Window.orderBy(on)).alias("_r"))
    table = places.join(shuffled, "_r").select(on, "perm", F.col(idx).alias("_pi"))
    real = series.join(years, on).groupBy(*cell).agg(F.corr(value, idx).alias("r"))
    fake = series.join(table, on).groupBy(*cell, "perm").agg(F.corr(value, "_pi").alias("_pr"))
    both = fake.join(real, list(cell))
    hit = F.round(F.abs(F.col("_pr")), DIGITS) >= F.round(F.abs(F.col("r")), DIGITS)
    return both.groupBy(*cell).agg(F.first("r").alias("r"), F.avg(hit.cast("double")).alias("p"))


def class_contrast(days: DataFrame, keys: Sequence[str], flag: str, active: str, inactive: str) -> DataFrame:
    """Relative difference of the flagged-day rate between active and inactive days, with Welch's test."""
    side = F.when(F.col(active) == 1, "a").when(F.col(inactive) == 1, "b")
    rows = days.withColumn("_side", side).where("_side IS NOT NULL")
    w = welch(rows, keys, flag, "_side")
    means = rows.groupBy(*keys).agg(*[F.avg(F.when(F.col("_side") == s, F.col(flag))).alias(f"rate_{s}") for s in "ab"])
    out = means.join(w.select(*keys, "t", "dof", "p"), list(keys))
    return out.withColumn("relative", (F.col("rate_a") - F.col("rate_b")) / F.nullif("rate_b", F.lit(0.0)))


def phase_pair_anomaly(days: DataFrame, keys: Sequence[str], flag: str, phase: str) -> DataFrame:
    """Rate in phase pairs (8-1, 2-3, 4-5, 6-7) minus the rate of all days."""
    pair = F.element_at(F.array(*[F.lit(p) for p in ("81", "23", "23", "45", "45", "67", "67", "81")]), F.col(phase))
    sums = days.groupBy(*keys, pair.alias("pair")).agg(F.sum(flag).alias("_s"), F.count(flag).alias("_n"))
    total = sums.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    return sums.join(total, list(keys)).select(*keys, "pair", (F.col("_s") / F.col("_n") - F.col("_all")).alias("anomaly"))


def resampled_correlation(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, n_rep: int, seed: str = "n11") -> DataFrame:
    """Pearson r and the share of replicates, each with its own draw of x, whose r is at least as large."""
    real = df.groupBy(*keys).agg(F.corr(x, y).alias("r"))
    numbered = row_numbers(df, keys, order, "pos").withColumn("n", F.col("pos_total").cast("long"))
    # x and y are drawn independently: the pair (k-th draw of x, k-th draw of y)
    reps = numbered.select(*keys, "n", "pos", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))).alias("rep"))
    asked = reps.select(*keys, "rep", *[(pick(lot(f"{seed}-{c}", "rep"), F.col("pos") - 1, F.col("n")) + 1).alias(f"_p{c}") for c in "xy"])
    xs = numbered.select(*keys, F.col("pos").alias("_px"), F.col(x).alias("_vx"))
    ys = numbered.select(*keys, F.col("pos").alias("_py"), F.col(y).alias("_vy"))
    fake = asked.join(xs, [*keys, "_px"]).join(ys, [*keys, "_py"]).groupBy(*keys, "rep").agg(F.corr("_vx", "_vy").alias("_r"))
    hit = F.round(F.col("_r"), DIGITS) >= F.round(F.col("r"), DIGITS)
    return fake.join(real, list(keys)).groupBy(*keys).agg(F.first("r").alias("r"), F.avg(hit.cast("double")).alias("p"))


def ensemble_median_trend(yearly: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """OLS line through the yearly ensemble medians (one value per model and year)."""
    med = yearly.groupBy(*keys, year).agg(F.median(value).alias("_m"))
    g = med.groupBy(*keys) if keys else med.groupBy()
    return g.agg(F.regr_slope("_m", year).alias("slope"), F.regr_intercept("_m", year).alias("intercept"), F.count(F.lit(1)).alias("years"))


def bootstrap_median_std(df: DataFrame, keys: Sequence[str], order: str, value: str, n_rep: int, seed: str = "n12") -> DataFrame:
    """Median over replicates of the resampled standard deviation."""
    v = F.col(value).cast("double")
    r = resampled_sums(df, keys, order, {"w": F.lit(1), "s": v, "q": v * v}, n_rep, seed)
    m = F.col("s") / F.col("w")
    std = F.sqrt(F.greatest(F.col("q") / F.col("w") - m * m, F.lit(0.0)))
    return r.withColumn("_s", std).groupBy(*keys).agg(F.median("_s").alias("std"))
