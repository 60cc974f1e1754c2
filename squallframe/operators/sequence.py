"""Window and sequence operators (E) on series that may be far too long for one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions import scalar as S
from squallframe.operators.ordered import day_bucket, neighbours, running_counts, value_counts

HOUR = 3600


def fix_hourly_spikes(
    df: DataFrame, keys: Sequence[str], time: str, value: str, high: float = 40.0, low: float = 20.0
) -> DataFrame:
    """A value >= high whose exact previous and next hour are both < low becomes their mean.

    Spikes are few: each asks for its two neighbour hours by an equi-join on (key, hour).
    """
    keys = list(keys)
    spikes = df.where(F.col(value) >= high).select(*keys, F.col(time).alias("_at"))
    asked = spikes.withColumn("_step", F.explode(F.array(F.lit(-HOUR), F.lit(HOUR))))
    asked = asked.withColumn(time, F.timestamp_seconds(F.unix_timestamp("_at") + F.col("_step")))
    calm = df.where(F.col(value) < low).select(*keys, time, F.col(value).alias("_v"))
    fixes = (
        asked.join(calm, [*keys, time])
        .groupBy(*keys, "_at")
        .agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_fixed"))
        .where("_n = 2")
        .select(*keys, F.col("_at").alias(time), "_fixed")
    )
    out = df.join(fixes, [*keys, time], "left")
    return out.withColumn(value, F.coalesce("_fixed", value)).drop("_fixed").select(*df.columns)


def null_step_spikes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, high: float = 40.0, low: float = 20.0
) -> DataFrame:
    """Null a value >= high when the rows before and after it in the key's order are both < low."""
    near = neighbours(df, keys, order, day_bucket(order[0]), [value], 1, 1)
    spike = (F.col(value) >= high) & (F.col(f"{value}_prev1") < low) & (F.col(f"{value}_next1") < low)
    return near.withColumn(value, F.when(F.coalesce(spike, F.lit(False)), None).otherwise(F.col(value))).select(*df.columns)


def gust_ceiling(
    df: DataFrame, cell: Sequence[str], time: str, value: str, top: float = 60.0, high: float = 40.0, second: float = 30.0
) -> DataFrame:
    """Null values >= top; null values > high where the second largest of that cell-day is < second.

    The second largest is below ``second`` exactly when one value at most reaches it: a count, not a sort.
    """
    keys = [*cell, "_day"]
    daily = df.withColumn("_day", F.to_date(time))
    lone = daily.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.count(F.when(F.col(value) >= second, 1)).alias("_strong")
    )
    bad = (F.col(value) >= top) | ((F.col(value) > high) & (F.col("_n") >= 2) & (F.col("_strong") < 2))
    out = daily.join(lone, keys).withColumn(value, F.when(~bad, F.col(value)))
    return out.select(*df.columns)


def fix_spatial_spikes(
    df: DataFrame, step: Sequence[str], i: str, j: str, value: str, high: float = 25.0, ratio: float = 0.5
) -> DataFrame:
    """A value >= high with a diagonal neighbour below ratio x itself becomes the neighbours' median.

    Needs one row per (step, i, j).  Strong cells ask for their four diagonals; no edge wrap.
    """
    step = list(step)
    corners = [(a, b) for a in (-1, 1) for b in (-1, 1)]
    offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(n).alias("n")) for n, (a, b) in enumerate(corners)])
    strong = df.where(F.col(value) >= high).select(
        *step, F.col(i).alias("_i"), F.col(j).alias("_j"), F.col(value).alias("_pot"), F.explode(offsets).alias("_o")
    )
    asked = strong.withColumns({i: F.col("_i") + F.col("_o.di"), j: F.col("_j") + F.col("_o.dj"), "_n": F.col("_o.n")}).drop("_o")
    found = asked.join(df.select(*step, i, j, F.col(value).alias("_v")), [*step, i, j])
    # four neighbours at most: one plain aggregate each, then the middle of the sorted few
    around = F.sort_array(F.array_compact(F.array(*[F.col(f"_c{n}") for n in range(4)])))
    middle = (F.get(around, F.floor((F.size(around) - 1) / 2).cast("int")) + F.get(around, F.floor(F.size(around) / 2).cast("int"))) / 2
    fixes = (
        found.groupBy(*step, "_i", "_j")
        .agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(f"_c{n}") for n in range(4)], F.max("_pot").alias("_pot"))
        .where(F.least(*[F.col(f"_c{n}") for n in range(4)]) < ratio * F.col("_pot"))
        .select(*step, F.col("_i").alias(i), F.col("_j").alias(j), middle.alias("_fixed"))
    )
    out = df.join(fixes, [*step, i, j], "left")
    return out.withColumn(value, F.coalesce("_fixed", value)).drop("_fixed").select(*df.columns)


def sudden_gusts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gust: str,
    tc: str,
    min_gust: float = 25.0,
    min_daily: float = 20.0,
    ratio: float = 2.0,
) -> DataFrame:
    """Strong gusts that at least double the four observations before (or more than double those after)."""
    near = neighbours(df, keys, order, day_bucket(order[0]), [gust], 4, 4)
    near = near.withColumns(
        {
            "prev_max": F.greatest(*[F.col(f"{gust}_prev{k}") for k in range(1, 5)]),
            "next_max": F.greatest(*[F.col(f"{gust}_next{k}") for k in range(1, 5)]),
            "_day": F.to_date(order[0]),
        }
    )
    daily = df.groupBy(*keys, F.to_date(order[0]).alias("_day")).agg(
        F.max(gust).alias("daily_gust"), F.max(tc).alias("_tc")
    )
    rows = near.where(F.col(gust) >= min_gust).join(daily, [*keys, "_day"])
    jump = (F.col(gust) / F.nullif("prev_max", F.lit(0.0)) >= ratio) | (F.col(gust) / F.nullif("next_max", F.lit(0.0)) > ratio)
    rows = rows.where((F.col("daily_gust") >= min_daily) & (F.col("_tc") != 1) & jump)
    return rows.select(*df.columns, "daily_gust", "prev_max", "next_max")


def circular_month_mean(df: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Mean of months m-1, m and m+1 with December next to January."""
    target = (F.col(month) - 1 + F.col("_o") + 12) % 12 + 1
    spread = df.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_m", target.cast("int"))
    return spread.groupBy(*keys, "_m").agg(F.avg(value).alias(value)).withColumnRenamed("_m", month)


def trailing_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int = 3, out: str = "smooth") -> DataFrame:
    """Mean of this and the rows before; for short series such as the 24 hours of a diurnal cycle."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(out, F.avg(value).over(w))


def season_blocks(df: DataFrame, keys: Sequence[str], year: str, month: str, value: str) -> DataFrame:
    """Sums over complete three-month blocks, DJF counted to the year of its January."""
    season = F.element_at(F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")]), (F.floor(F.col(month) % 12 / 3) + 1).cast("int"))
    rows = df.withColumns({"season_year": S.season_year(year, month), "season": season})
    out = rows.groupBy(*keys, "season_year", "season").agg(F.sum(value).alias(value), F.countDistinct(month).alias("_n"))
    return out.where("_n = 3").drop("_n")


def to_utc(df: DataFrame, keys: Sequence[str], order: Sequence[str], local: str, zone: Column, out: str) -> DataFrame:
    """Local to UTC with a per-row zone; an ambiguous local time takes the offset of the key's next row."""
    df = df.withColumn("_zone", zone)
    t = F.col(local)
    guess = F.to_utc_timestamp(t, F.col("_zone"))
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(guess + hour, F.col("_zone")) == t) | (F.from_utc_timestamp(guess - hour, F.col("_zone")) == t)
    rows = df.withColumn("_off", F.when(~twice, F.unix_timestamp(t) - F.unix_timestamp(guess)))
    near = neighbours(rows, keys, order, day_bucket(order[0]), ["_off"], 0, 1)
    offset = F.coalesce(F.col("_off"), F.col("_off_next1"))
    return near.withColumn(out, F.timestamp_micros(F.unix_micros(t) - offset * 1000000)).select(*df.drop("_zone").columns, out)


def state_zone(state: str, station: str) -> Column:
    """Time zone of a station, from its state, with the listed exceptions."""
    states = F.create_map(*[F.lit(x) for pair in refs.STATE_ZONES.items() for x in pair])
    zone = F.try_element_at(states, F.trim(state))
    for name, value in refs.ZONE_EXCEPTIONS.items():
        zone = F.when(F.col(station) == name, F.lit(value)).otherwise(zone)
    return zone


def fixed_offset_local(time: str, station: str, offsets: dict, default: float = 10.0) -> Column:
    """UTC to local standard time by a fixed offset in hours per station."""
    hours = F.lit(default)
    for name, value in offsets.items():
        hours = F.when(F.col(station) == name, F.lit(value)).otherwise(hours)
    return F.timestamp_micros((F.unix_micros(time) + hours * 3600000000).cast("long"))


def level_trapezoid(df: DataFrame, keys: Sequence[str], level: str, value: str, coord: str, out: str) -> DataFrame:
    """Sum over adjacent levels of the mean value times the coordinate step; the window is one column."""
    w = Window.partitionBy(*keys).orderBy(level)
    area = (F.col(value) + F.lead(value).over(w)) / 2 * (F.lead(coord).over(w) - F.col(coord))
    return df.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias(out))


def first_run(df: DataFrame, keys: Sequence[str], level: str, cond: Column) -> DataFrame:
    """Levels of the first unbroken run that meets the condition; the window is one column."""
    w = Window.partitionBy(*keys).orderBy(level)
    rows = df.withColumn("_c", F.coalesce(cond, F.lit(False)))
    starts = F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("_c") & (F.col("_run") == 1)).select(*df.columns)


def ecdf(df: DataFrame, keys: Sequence[str], value: str, out: str = "p") -> DataFrame:
    """Distinct values with P(X <= x)."""
    rc = running_counts(value_counts(df, keys, value), keys, value)
    return rc.select(*keys, value, (F.col("n_le") / F.col("n_total")).alias(out))


def cumulative_contingency(df: DataFrame, keys: Sequence[str], value: str, event: str) -> DataFrame:
    """For each distinct value: hits and false alarms of the rule 'value >= this one'."""
    vc = value_counts(df.where(F.col(event).isNotNull()), keys, value, {"e": F.col(event).cast("long")})
    rc = running_counts(vc, keys, value, ("n", "e"))
    hits = F.col("e_total") - F.col("e_lt")
    return rc.select(
        *keys,
        value,
        hits.alias("hits"),
        ((F.col("n_total") - F.col("n_lt")) - hits).alias("false_alarms"),
        F.col("e_total").alias("n_events"),
        (F.col("n_total") - F.col("e_total")).alias("n_other"),
    )
