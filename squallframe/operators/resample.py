"""Time aggregation, frequencies, climatologies and histograms (D).

Every operator is a chain of partial aggregates; overlapping periods and classes are joined only after
rows have collapsed to (cell, month) or to distinct bins.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions import scalar as S
from squallframe.operators.ordered import quantiles


def daily(df: DataFrame, keys: Sequence[str], time: str, aggs: dict[str, Column]) -> DataFrame:
    """Per key and UTC day; every day is kept, also the last one."""
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(*[c.alias(n) for n, c in aggs.items()])


def monthly_means(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Per key and month: mean of all steps, mean of the daily maxima, and the step count."""
    days = daily(df, keys, time, {"_s": F.sum(value), "_n": F.count(value), "_m": F.max(value)})
    return days.groupBy(*keys, F.year("day").alias("year"), F.month("day").alias("month")).agg(
        (F.sum("_s") / F.sum("_n")).alias("mean"), F.avg("_m").alias("mean_daily_max"), F.sum("_n").alias("steps")
    )


def threshold_counts(df: DataFrame, keys: Sequence[str], time: str, exceeds: Column, days: DataFrame | None = None) -> DataFrame:
    """Per key and month: steps and days with an exceedance; with a ``days`` table (date, flags...) also days per flag."""
    hit = exceeds.cast("int")
    per_day = daily(df, keys, time, {"_steps": F.sum(hit), "_any": F.max(hit)})
    aggs = [F.sum("_steps").alias("steps"), F.sum("_any").alias("days")]
    if days is not None:
        flags = [c for c in days.columns if c != "day"]
        per_day = per_day.join(days, "day", "left")
        aggs += [F.sum(F.col("_any") * F.coalesce(F.col(f), F.lit(0))).alias(f"days_{f}") for f in flags]
    return per_day.groupBy(*keys, F.year("day").alias("year"), F.month("day").alias("month")).agg(*aggs)


def seasonal_annual_max(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Largest value per key, calendar year and season (DJF inside the calendar year)."""
    months = df.groupBy(*keys, F.year(time).alias("year"), F.month(time).alias("month")).agg(F.max(value).alias(value))
    seasons = refs.period_months(df.sparkSession, refs.SEASONS).withColumnRenamed("period", "season")
    return months.join(seasons, "month").groupBy(*keys, "year", "season").agg(F.max(value).alias(value))


def time_of_annual_max(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """The annual maximum and its time, the earliest on ties."""
    top = F.max_by(time, F.struct(F.col(value), -F.unix_micros(time)))
    return df.groupBy(*keys, F.year(time).alias("year")).agg(F.max(value).alias(value), top.alias(time))


def phase_counts(df: DataFrame, keys: Sequence[str], time: str, exceeds: Column, phases: DataFrame) -> DataFrame:
    """Days with an exceedance per phase of a daily oscillation, for days of amplitude >= 1."""
    per_day = daily(df, keys, time, {"_any": F.max(exceeds.cast("int"))})
    strong = phases.where("amplitude >= 1").select("day", "phase")
    return per_day.join(strong, "day").groupBy(*keys, "phase").agg(F.sum("_any").alias("days"), F.count(F.lit(1)).alias("days_in_phase"))


def period_frequency(
    df: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float, first_year: int, last_year: int
) -> DataFrame:
    """Days per year with a daily maximum >= threshold, for the 21 overlapping periods."""
    days = daily(df.where(F.year(time).between(first_year, last_year)), keys, time, {"_max": F.max(value)})
    months = days.groupBy(*keys, F.month("day").alias("month")).agg(F.sum((F.col("_max") >= threshold).cast("int")).alias("_n"))
    joined = months.join(refs.period_months(df.sparkSession), "month")
    return joined.groupBy(*keys, "period").agg((F.sum("_n") / (last_year + 1 - first_year)).alias("days_per_year"))


def period_share_and_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float) -> DataFrame:
    """Share of steps at or above the threshold and the mean, per period; nulls are left out."""
    months = df.groupBy(*keys, F.month(time).alias("month")).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum((F.col(value) >= threshold).cast("int")).alias("_h")
    )
    joined = months.join(refs.period_months(df.sparkSession), "month")
    n = F.nullif(F.sum("_n"), F.lit(0))
    return joined.groupBy(*keys, "period").agg((F.sum("_h") / n).alias("share"), (F.sum("_s") / n).alias("mean"))


def seasonal_climatology(df: DataFrame, keys: Sequence[str], time: str, value: str, above: float) -> DataFrame:
    """Per season: mean of all steps, and mean days per year with a daily maximum strictly above a value."""
    days = daily(df, keys, time, {"_s": F.sum(value), "_n": F.count(value), "_m": F.max(value)})
    months = days.groupBy(*keys, F.month("day").alias("month")).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum((F.col("_m") > above).cast("int")).alias("_d")
    )
    years = df.agg(F.countDistinct(F.year(time)).alias("_years"))
    seasons = refs.period_months(df.sparkSession, refs.SEASONS).withColumnRenamed("period", "season")
    out = months.join(seasons, "month").groupBy(*keys, "season").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_d").alias("_d")
    )
    out = out.crossJoin(F.broadcast(years))  # one row
    return out.select(
        *keys, "season", (F.col("_s") / F.nullif("_n", F.lit(0))).alias("mean"), (F.col("_d") / F.col("_years")).alias("days_per_year")
    )


WARM_MONTHS = (10, 11, 12, 1, 2, 3)  # fixed values


def mean_exceedance_hour(df: DataFrame, keys: Sequence[str], time: str, exceeds: Column) -> DataFrame:
    """Mean UTC hour of the steps that exceed, for all months, October to March, and the rest."""
    warm = S.month_in(time, WARM_MONTHS)
    hour = F.hour(time)
    return df.where(exceeds).groupBy(*keys).agg(
        F.avg(hour).alias("hour_all"), F.avg(F.when(warm, hour)).alias("hour_warm"), F.avg(F.when(~warm, hour)).alias("hour_cool")
    )


def hourly_counts(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows per hour 0..23 of each key, zeros included."""
    counts = df.groupBy(*keys, F.hour(time).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = counts.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.join(counts, [*keys, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def monthly_counts(df: DataFrame, keys: Sequence[str], time: str, keep: Column, mean: str) -> DataFrame:
    """Per month: rows in a range, and the mean of a column over all rows of the month."""
    return df.groupBy(*keys, F.month(time).alias("month")).agg(F.sum(keep.cast("int")).alias("n"), F.avg(mean).alias("mean"))


def monthly_shares(counts: DataFrame, keys: Sequence[str], month: str, n: str) -> DataFrame:
    """Share of each month in its key's total, in July-to-June order; at most twelve rows per key."""
    total = F.sum(n).over(Window.partitionBy(*keys))
    return counts.withColumns({"share": F.col(n) / F.nullif(total, F.lit(0)), "position": (F.col(month) + 5) % 12})


def hourly_share(df: DataFrame, keys: Sequence[str], time: str, exceeds: Column) -> DataFrame:
    """Share of each hour in a model's exceedances."""
    counts = df.where(exceeds).groupBy(*keys, F.hour(time).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))  # 24 rows per key


def wind_rose(df: DataFrame, keys: Sequence[str], direction: str) -> DataFrame:
    counts = df.where(F.col(direction).isNotNull()).groupBy(*keys, S.compass(direction).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))  # 16 rows per key


def gust_class_profile(
    df: DataFrame, gust: str, param: str, event: Column, prob: float, width: float = 5.0
) -> DataFrame:
    """Per gust class: rows, rows with the parameter at or above its event percentile, and its quartiles."""
    rows = df.where(F.col(gust).isNotNull()).withColumn("gust_class", (F.floor(F.col(gust) / width) * width).cast("double"))
    limit = quantiles(rows.where(event), [], param, {"limit": prob})
    marked = rows.crossJoin(F.broadcast(limit))  # one row
    counts = marked.groupBy("gust_class").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum((F.col(param) >= F.col("limit")).cast("int")).alias("n_high")
    )
    quart = quantiles(rows, ["gust_class"], param, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return counts.join(quart, "gust_class", "left")


def bin_index(value: str, low: str, high: str, bins: int) -> Column:
    """Index of an equal-width bin, the last one closed on the right; null outside."""
    v = F.col(value)
    raw = F.floor((v - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0)) * bins)
    return F.when(v.between(F.col(low), F.col(high)), F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))).cast("int")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int, counts: dict[str, Column]) -> DataFrame:
    """Counts of several row classes on one regular x-y grid over the range of all rows, with true bin centres."""
    span = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    rows = df.crossJoin(F.broadcast(span))  # one row
    rows = rows.withColumns({"ix": bin_index(x, "_x0", "_x1", bins), "iy": bin_index(y, "_y0", "_y1", bins)})
    centre = lambda i, a, b: F.col(a) + (F.col(i) + 0.5) * (F.col(b) - F.col(a)) / bins
    out = rows.where("ix IS NOT NULL AND iy IS NOT NULL").groupBy("ix", "iy").agg(
        *[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in counts.items()],
        F.first(centre("ix", "_x0", "_x1")).alias("x"),
        F.first(centre("iy", "_y0", "_y1")).alias("y"),
    )
    return out


def gaussian_smooth(grid: DataFrame, index: str, others: Sequence[str], values: Sequence[str], size: int, sigma: float = 1.0) -> DataFrame:
    """One-axis Gaussian smoothing with mirrored edges: each cell sends its weighted value to its neighbours."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    total = sum(weights)
    offs = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / total).alias("w")) for o, w in zip(range(-radius, radius + 1), weights, strict=True)])
    s = F.col(index)
    images = F.array(s, -s - 1, 2 * size - 1 - s)
    sent = grid.withColumn("_img", F.explode(images)).withColumn("_k", F.explode(offs))
    sent = sent.withColumn("_t", F.col("_img") - F.col("_k.o")).where(F.col("_t").between(0, size - 1))
    return sent.groupBy(*others, F.col("_t").cast("int").alias(index)).agg(*[F.sum(F.col(v) * F.col("_k.w")).alias(v) for v in values])


def spatial_extent(df: DataFrame, time: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Per time: cells flagged a and b, whether each occurs at all, and their joint count when both do."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = df.groupBy(*time).agg(F.sum(one(a)).alias("n_a"), F.sum(one(b)).alias("n_b"))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return out.withColumns(
        {"any_a": (F.col("n_a") > 0).cast("int"), "any_b": (F.col("n_b") > 0).cast("int"), "n_both": F.when(both, F.col("n_a") + F.col("n_b")).otherwise(0)}
    )


def interval_sums(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int) -> DataFrame:
    """Right-closed, right-labelled sums; each key's first interval is left out."""
    sums = df.groupBy(*keys, S.ceil_time(time, hours * 3600).alias(time)).agg(F.sum(value).alias(value))
    first = sums.groupBy(*keys).agg(F.min(time).alias("_first"))
    return sums.join(first, list(keys)).where(F.col(time) > F.col("_first")).drop("_first")


def ensemble_period_mean(df: DataFrame, keys: Sequence[str], model: str, value: str) -> DataFrame:
    """Infinities to null, mean over time within each model, then over models."""
    per = df.withColumn(value, S.finite(value)).groupBy(*keys, model).agg(F.avg(value).alias(value))
    return per.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("models"))


def station_event_rate(df: DataFrame, station: str, value: str, event: Column) -> DataFrame:
    """Events per year of valid observations."""
    years = F.count(value) / 365.0
    return df.groupBy(station).agg(
        F.sum(event.cast("int")).alias("events"), (F.sum(event.cast("int")) / F.nullif(years, F.lit(0.0))).alias("per_year")
    )


def quartile_panels(df: DataFrame, x: str, y: str, by: str, bins: int) -> DataFrame:
    """The 2-D histogram of ``histogram_2d`` split by the quartile class (1..4) of a third column."""
    q = quantiles(df, [], by, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    rows = df.crossJoin(F.broadcast(q))  # one row
    v = F.col(by)
    quartile = F.when(v <= F.col("_q1"), 1).when(v <= F.col("_q2"), 2).when(v <= F.col("_q3"), 3).when(v.isNotNull(), 4)
    rows = rows.withColumn("_c", quartile)
    return histogram_2d(rows, x, y, bins, {f"n{c}": F.col("_c") == c for c in (1, 2, 3, 4)})
