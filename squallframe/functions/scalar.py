"""Scalar column expressions: calendar, units, geometry, wind."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from squallframe import refs

EARTH_KM = 6373.0  # fixed value: radius used by every distance here


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(c: Column | str) -> Column:
    """Epoch seconds with the fraction kept."""
    return F.unix_micros(col(c)) / 1e6


def floor_time(c: Column | str, step: int) -> Column:
    """Start of the ``step``-second slot holding a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_micros(col(c)) / (step * 1e6)) * step)


def ceil_time(c: Column | str, step: int) -> Column:
    return F.timestamp_seconds(F.ceil(F.unix_micros(col(c)) / (step * 1e6)) * step)


def round_time(c: Column | str, step: int) -> Column:
    """Nearest slot; exact halves go to the even multiple."""
    return F.timestamp_seconds(F.bround(F.unix_micros(col(c)) / (step * 1e6), 0) * step)


def season_year(year: Column | str, month: Column | str) -> Column:
    """Year of a December-to-November season block: December counts to the next year."""
    return col(year) + (col(month) == 12).cast("int")


def to_celsius(c):
    return col(c) - refs.ZERO_C


def to_hpa(c):
    return col(c) / 100.0


def geopotential_height(c):
    return col(c) / refs.GRAVITY


def kmh_to_ms(c):
    return col(c) / refs.KMH_PER_MS


def knots_to_ms(c):
    return col(c) * refs.MS_PER_KNOT


def ms_to_knots(c):
    return col(c) * refs.KNOT_PER_MS


def wrap_longitude(c):
    """0..360 to -180..180."""
    return F.pmod(col(c) + 180.0, F.lit(360.0)) - 180.0


def clamp(c, lo, hi):
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(col(lon2)) - F.radians(col(lon1))) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def wind_u(speed, direction):
    return col(speed) * F.sin(F.radians(col(direction)))


def wind_v(speed, direction):
    return col(speed) * F.cos(F.radians(col(direction)))


def wind_direction(u, v):
    return 180.0 + F.degrees(F.atan2(col(u), col(v)))


def speed(u, v):
    return F.sqrt(F.pow(col(u), 2) + F.pow(col(v), 2))


@F.pandas_udf(DoubleType())
def angle(y: pd.Series, x: pd.Series) -> pd.Series:
    """atan2 of the C library, in degrees; null where a value is.

    It is right to the last bit nearly always, Spark's own is not: rules that ask which of two angles is larger fall either way
    where the angles are equal but for that bit.
    """
    ok = y.notna() & x.notna()
    return pd.Series([math.degrees(math.atan2(b, a)) for b, a in zip(y, x)], index=y.index, dtype="float64").where(ok, None)


@F.pandas_udf(DoubleType())
def power(x: pd.Series, e: pd.Series) -> pd.Series:
    """Power of a value that is not negative, by the C library, which is nearer than Spark's own; null where a value is."""
    ok = x.notna() & e.notna()
    out = [math.pow(b, n) if b >= 0 else math.nan for b, n in zip(x, e)]
    return pd.Series(out, index=x.index, dtype="float64").where(ok, None)


def sector(direction) -> Column:
    """Index 0..15 of the 16 compass sectors."""
    return (F.floor(col(direction) / 22.5 + 0.5) % 16).cast("int")


def compass(direction) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in refs.COMPASS]), sector(direction) + 1)


def logistic(z) -> Column:
    return 1.0 / (1.0 + F.exp(-col(z)))


def linear(terms: dict[str, float], intercept: float) -> Column:
    """Intercept plus coefficient times column, in the order given."""
    out = F.lit(float(intercept))
    for name, coef in terms.items():
        out = out + F.lit(float(coef)) * F.col(name)
    return out


def wmax(cape) -> Column:
    return F.sqrt(2.0 * col(cape))


def guarded_ln(c) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)))


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def finite(c) -> Column:
    v = col(c)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def share(part, whole) -> Column:
    """part / whole, null when whole is zero."""
    return col(part) / F.nullif(col(whole).cast("double"), F.lit(0.0))


def month_in(time, months) -> Column:
    return F.month(col(time)).isin(list(months))


def in_box(lat, lon, name: str) -> Column:
    y1, y2, x1, x2 = refs.box(name)
    return col(lat).between(y1, y2) & col(lon).between(x1, x2)
