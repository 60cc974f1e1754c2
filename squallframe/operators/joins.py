"""Time alignment, spatial joins and set joins (C).

Spatial joins use map tiles: one side is repeated for the tiles it can reach, the other keeps its own
tile, and Spark runs an equi-join on the tile.  No row is compared with rows out of reach.
Small sides are left without a hint: the adaptive planner broadcasts them by their measured size.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.functions import scalar as S

ALIGN_SHIFT = {"floor": 0, "floor2": -3600, "ceil": 0}  # fixed values: seconds after rounding


def aligned_hour(time: str | Column, mode: str) -> Column:
    """Model hour an observation is compared with: the hour before, two before, or the next hour."""
    if mode not in ALIGN_SHIFT:
        raise ValueError(f"unknown alignment {mode!r}")
    hour = S.ceil_time(time, 3600) if mode == "ceil" else S.floor_time(time, 3600)
    return F.timestamp_seconds(F.unix_timestamp(hour) + ALIGN_SHIFT[mode])


def align_to_model(
    obs: DataFrame, model: DataFrame, station: str, time: str | Column, params: Sequence[str], mode: str = "floor"
) -> DataFrame:
    """Observations with the model row of their station and hour; rows without every predictor are left out."""
    keyed = obs.withColumn("_hour", aligned_hour(time, mode))
    full = model.dropna(subset=list(params)).withColumnRenamed("time", "_hour")
    return keyed.join(full, [station, "_hour"]).withColumnRenamed("_hour", "model_time")


def _tile(c: Column | float, width: float) -> Column:
    return F.floor(c / width).cast("int")


def near_pairs(
    left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", inclusive: bool = False
) -> DataFrame:
    """All (left, right) rows closer than ``km``; adds ``km_apart``.

    ``left`` should be the smaller side: each row goes to the tiles its circle touches.  Right-hand
    coordinates are renamed ``{lat}_r`` and ``{lon}_r``.
    """
    dlat = math.degrees(km / S.EARTH_KM) + 1e-9
    columns = max(1, math.floor(360.0 / max(dlat, 0.05)))
    width = 360.0 / columns
    reach = math.sin(min(km / S.EARTH_KM, math.pi / 2))
    y, x = F.col(lat), F.pmod(F.col(lon) + 180.0, F.lit(360.0))
    ratio = F.lit(reach) / F.greatest(F.cos(F.radians(y)), F.lit(1e-12))
    dlon = F.when((F.abs(y) + dlat >= 90) | (ratio >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    rows = F.sequence(_tile(y - dlat + 90.0, width), _tile(y + dlat + 90.0, width))
    first, last = _tile(x - dlon, width), _tile(x + dlon, width)
    cols = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + columns)), lambda c: F.pmod(c, F.lit(columns))))
    spread = left.withColumn("_ty", F.explode(rows)).withColumn("_tx", F.explode(cols))
    own = right.withColumnsRenamed({lat: f"{lat}_r", lon: f"{lon}_r"})
    own = own.withColumns(
        {
            "_ty": _tile(F.col(f"{lat}_r") + 90.0, width),
            "_tx": F.pmod(_tile(F.pmod(F.col(f"{lon}_r") + 180.0, F.lit(360.0)), width), F.lit(columns)),
        }
    )
    out = spread.join(own, ["_ty", "_tx"]).withColumn("km_apart", S.haversine_km(lat, lon, f"{lat}_r", f"{lon}_r"))
    limit = F.col("km_apart") <= km if inclusive else F.col("km_apart") < km
    return out.where(limit).drop("_ty", "_tx")


def nearest_cells(
    stations: DataFrame, grid: DataFrame, station: str, i: str = "i", j: str = "j", widths: Sequence[float] = (2.0, 16.0, 1024.0)
) -> DataFrame:
    """Nearest grid cell of each station by planar degree distance; ties go to the first in row order.

    Tiles widen in steps: a hit within one tile width is exact, so only stations without one go on
    to the wider tiles; the last width spans the globe.  Pass the grid already limited to land.
    """
    cells = grid.select(F.col(i).alias("_i"), F.col(j).alias("_j"), F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    left, found = stations.select(station, "lat", "lon"), None
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for width in widths:
        ask = left.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
        ask = ask.withColumns({"_ty": _tile(F.col("lat"), width) + F.col("_dy"), "_tx": _tile(F.col("lon"), width) + F.col("_dx")})
        own = cells.withColumns({"_ty": _tile(F.col("_y"), width), "_tx": _tile(F.col("_x"), width)})
        dist = F.sqrt(F.pow(F.col("_y") - F.col("lat"), 2) + F.pow(F.col("_x") - F.col("lon"), 2))
        best = (
            ask.join(own, ["_ty", "_tx"])
            .withColumn("_d", dist)
            .groupBy(station)
            .agg(F.min(F.struct("_d", "_i", "_j")).alias("_b"))
            .select(station, F.col("_b._i").alias(i), F.col("_b._j").alias(j), F.col("_b._d").alias("degrees"))
        )
        if width < 720:
            best = best.where(F.col("degrees") <= width)
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select(station), station, "left_anti")
    return found


def radius_reduce(
    pairs: DataFrame, cube: DataFrame, cell: Sequence[str], station: str, time: str, variables: Sequence[str]
) -> DataFrame:
    """Max, mean and sum of each variable over the cells paired with a station, per time."""
    near = cube.join(pairs.select(station, *cell), list(cell))
    aggs = [f(v).alias(f"{v}_{n}") for v in variables for n, f in (("max", F.max), ("mean", F.avg), ("sum", F.sum))]
    return near.groupBy(station, time).agg(*aggs)


def storm_days(stations: DataFrame, tracks: DataFrame, station: str, km: float = 500.0) -> DataFrame:
    """Distinct station-days with a track fix closer than ``km``."""
    fixes = tracks.select("lat", "lon", F.to_date("time").alias("date")).distinct()
    return near_pairs(stations, fixes, km).select(station, "date").distinct()


def flag_days(df: DataFrame, days: DataFrame, station: str, date: str, flag: str) -> DataFrame:
    marked = days.select(station, F.col(days.columns[1]).alias(date), F.lit(1).alias(flag))
    return df.join(marked, [station, date], "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def strongest_reports(
    stations: DataFrame, reports: DataFrame, station: str, km: float = 50.0
) -> DataFrame:
    """Each report goes to every station within ``km``; the strongest per station-day stays (an aggregate, no sort)."""
    near = near_pairs(stations.select(station, "lat", "lon"), reports, km, inclusive=True)
    rank = F.struct(F.col("sta_wind"), F.col("wind_id"))
    return near.groupBy(station, "sta_daily_date").agg(
        F.max(rank).alias("_r")
    ).select(station, "sta_daily_date", F.col("_r.sta_wind").alias("sta_wind"), F.col("_r.wind_id").alias("wind_id"))


def attach_reports(obs: DataFrame, best: DataFrame, station: str, date: str, order: str) -> DataFrame:
    """Left join of the strongest report by day; is_sta marks one row per station-day with a report."""
    joined = obs.join(best.withColumnRenamed("sta_daily_date", date), [station, date], "left")
    first = obs.groupBy(station, date).agg(F.min(order).alias("_first"))
    out = joined.join(first, [station, date])
    mark = F.col("wind_id").isNotNull() & (F.col(order) == F.col("_first"))
    return out.withColumn("is_sta", mark.cast("int")).drop("_first")


def outer_align(frames: Sequence[DataFrame], keys: Sequence[str], complete: bool = False) -> DataFrame:
    """Full outer alignment on the keys; ``complete`` keeps only rows with every value."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), "full")
    return out.dropna() if complete else out


def inner_sources(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of several sources; every value column gets its source's suffix."""
    out = None
    for name, f in frames.items():
        named = f.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in f.columns if c not in keys])
        out = named if out is None else out.join(named, list(keys))
    return out


def common_times(frames: Sequence[DataFrame], time: str = "time") -> DataFrame:
    """Times present in every frame."""
    out = frames[0].select(time).distinct()
    for f in frames[1:]:
        out = out.join(f.select(time), time, "left_semi")
    return out


def on_listed_days(df: DataFrame, days: DataFrame, date: str) -> DataFrame:
    return df.join(days.select(F.col(days.columns[0]).alias(date)), date, "left_semi")


def combinations(df: DataFrame, lists: dict[str, Sequence]) -> DataFrame:
    """Repeat each row for every combination of the short literal lists (an explode, not a join)."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def environment_means(
    env: DataFrame, flagged: DataFrame, site: str, env_time: str, flag_time: str, variables: Sequence[str], by_day: bool = False
) -> DataFrame:
    """Mean environment at flagged hours (or days), by hour and by month of each site, in one long table."""
    unit = (lambda c: F.to_date(c)) if by_day else (lambda c: F.date_trunc("hour", c))
    marks = flagged.select(site, unit(flag_time).alias("_u")).distinct()
    rows = env.withColumn("_u", unit(env_time)).join(marks, [site, "_u"], "left_semi")
    sums = rows.groupBy(site, F.hour(env_time).alias("hour"), F.month(env_time).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"_s_{v}") for v in variables], *[F.count(v).alias(f"_n_{v}") for v in variables]
    )
    parts = [
        sums.select(site, F.lit(kind).alias("kind"), F.col(kind).alias("slot"), "n", *[f"_{a}_{v}" for a in "sn" for v in variables])
        for kind in ("hour", "month")
    ]
    both = parts[0].unionByName(parts[1])
    return both.groupBy(site, "kind", "slot").agg(
        F.sum("n").alias("n"), *[(F.sum(f"_s_{v}") / F.nullif(F.sum(f"_n_{v}"), F.lit(0))).alias(v) for v in variables]
    )
