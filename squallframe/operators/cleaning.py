"""Projection, filtering and cleaning of observations and fields (B)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.operators.ordered import quantiles

BAD_FLAGS = ("S", "W", "I")  # fixed values: suspect, wrong, inconsistent


def null_bad_quality(value: str, flag: str, bad: Sequence[str] = BAD_FLAGS) -> Column:
    return F.when(F.col(flag).isin(*bad), None).otherwise(F.col(value))


def flag_incomplete_months(df: DataFrame, station: str, time: str, value: str, share: float = 0.9) -> DataFrame:
    """incomplete_month = 1 where a station-month has fewer than ``share`` non-null values.

    Counts are aggregated first and joined back, so no window holds a whole station.
    """
    keyed = df.withColumns({"year": F.year(time), "month": F.month(time)})
    keys = [station, "year", "month"]
    done = keyed.groupBy(*keys).agg((F.count(value) / F.count(F.lit(1))).alias("month_share"))
    return keyed.join(done, keys).withColumn("incomplete_month", (F.col("month_share") < share).cast("int"))


def drop_incomplete_years(df: DataFrame, station: str, time: str, loc, min_rows: int = 330) -> DataFrame:
    """For one station, drop calendar years with fewer than ``min_rows`` rows; others are untouched."""
    short = (
        df.where(F.col(station) == loc)
        .groupBy(station, F.year(time).alias("_year"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") < min_rows)
        .drop("_n")
    )
    return df.withColumn("_year", F.year(time)).join(short, [station, "_year"], "left_anti").drop("_year")


def event_label(gust="wind_gust", lightning="lightning", min_lightning: int = 2, min_gust: float = 25.0) -> Column:
    """1 for a convective gust event; a missing gust is never an event."""
    hit = (F.col(lightning) >= min_lightning) & (F.col(gust) >= min_gust)
    return F.when(hit, 1).otherwise(0)


def conditional_label(gust="wind_gust", lightning="lightning", min_lightning: int = 2, min_gust: float = 25.0) -> Column:
    """Among lightning cases only: 1 strong gust, 0 weak gust, null elsewhere."""
    lit = F.col(lightning) >= min_lightning
    return F.when(lit & (F.col(gust) >= min_gust), 1).when(lit & (F.col(gust) < min_gust), 0)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``; an aggregate, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def fill_levels(df: DataFrame, keys: Sequence[str], level: str, value: str) -> DataFrame:
    """Null level = mean of the nearest non-null above and below (one-sided at the ends).

    The window is one vertical column, so it is bounded by the number of model levels.
    """
    w = Window.partitionBy(*keys)
    back = lambda o: F.last(value, ignorenulls=True).over(w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1))
    below, above = back(F.col(level)), back(F.col(level).desc())
    gap = (F.coalesce(below, above) + F.coalesce(above, below)) / 2
    return df.withColumn(value, F.coalesce(F.col(value), gap))


def clip_to_percentiles(df: DataFrame, cols: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Clip each column to its own exact low and high percentile."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "param", "value")
    q = quantiles(long, ["param"], "value", {"lo": low, "hi": high})
    bounds = q.groupBy().agg(
        *[F.max(F.when(F.col("param") == c, F.col(b))).alias(f"_{b}_{c}") for c in cols for b in ("lo", "hi")]
    )
    wide = df.crossJoin(F.broadcast(bounds))  # exactly one row of bounds
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))) for c in cols
    }
    return wide.withColumns(clipped).select(*df.columns)


def null_empty_steps(df: DataFrame, time: Sequence[str], probe: str, cols: Sequence[str]) -> DataFrame:
    """Null every diagnostic at the times where ``probe`` is zero over the whole map."""
    top = df.groupBy(*time).agg(F.max(probe).alias("_top"))
    out = df.join(top, list(time))
    return out.withColumns({c: F.when(F.col("_top") != 0, F.col(c)) for c in cols}).drop("_top")


def null_outside_levels(value: str, pressure: str, min_p: float = 100.0, missing: float = -273.15) -> Column:
    """Null above the model top, below ground (p = 0), at infinities and at the fill temperature."""
    p, v = F.col(pressure), F.col(value)
    keep = (p >= min_p) & (p != 0) & (F.abs(v) != float("inf")) & (v != missing)
    return F.when(keep, v)


def checked_range(value: str, low: float, high: float) -> Column:
    """The column itself; the job fails when a value lies outside the physical range."""
    v = F.col(value)
    message = F.concat(F.lit(f"{value} outside {low}..{high}: "), v.cast("string"))
    return F.when(v.isNull() | v.between(low, high), v).otherwise(F.raise_error(message))


def predictors(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(keys)]


def land_only(df: DataFrame, grid: DataFrame, keys: Sequence[str], cols: Sequence[str], cutoff: float = 0.5) -> DataFrame:
    """Null the columns over sea; the grid is left for the optimiser to broadcast by its measured size."""
    out = df.join(grid.select(*keys, "lsm"), list(keys))
    return out.withColumns({c: F.when(F.col("lsm") > cutoff, F.col(c)) for c in cols}).drop("lsm")


def correct_points(
    df: DataFrame, station: str, date: str, swaps: Sequence[tuple], bad: Sequence[tuple], renames: dict
) -> DataFrame:
    """Swap day and month on listed station dates, drop listed bad dates, rename stations.

    The lists are hand-kept literals, so they become plain expressions, not joins.
    """
    def listed(rows):
        out = F.lit(False)
        for loc, day in rows:
            out = out | ((F.col(station) == loc) & (F.col(date) == F.lit(day).cast("date")))
        return out

    swapped = F.make_date(F.year(date), F.dayofmonth(date), F.month(date))
    kept = df.where(~listed(bad)).withColumn(date, F.when(listed(swaps), swapped).otherwise(F.col(date)))
    name = F.col(station)
    for old, new in renames.items():
        name = F.when(F.col(station) == old, F.lit(new)).otherwise(name)
    return kept.withColumn(station, name)
