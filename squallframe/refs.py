"""Fixed reference values: seasons, boxes, stations' time zones, unit factors."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Months of each season and of each of the 21 reporting periods.
SEASONS = {
    "ANN": list(range(1, 13)),
    "DJF": [12, 1, 2],
    "MAM": [3, 4, 5],
    "JJA": [6, 7, 8],
    "SON": [9, 10, 11],
}
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
PERIODS = {
    "Annual": list(range(1, 13)),
    **{name: [i + 1] for i, name in enumerate(MONTH_NAMES)},
    "MAM": [3, 4, 5],
    "JJA": [6, 7, 8],
    "SON": [9, 10, 11],
    "DJF": [12, 1, 2],
    "Warm1": [10, 11, 12, 1, 2, 3],
    "Cool1": [4, 5, 6, 7, 8, 9],
    "Warm2": [9, 10, 11, 12, 1, 2, 3, 4],
    "Cool2": [5, 6, 7, 8],
}

# Fixed values: (lat min, lat max, lon min, lon max) of the named boxes.
BOXES = {
    "aus": (-44.525, -9.975, 111.975, 156.275),
    "sa_small": (-38.0, -26.0, 132.0, 142.0),
    "sa_large": (-40.0, -24.0, 112.0, 156.0),
}

# State to time zone, with the one station that follows another state.
STATE_ZONES = {
    "WA": "Australia/Perth",
    "NT": "Australia/Darwin",
    "SA": "Australia/Adelaide",
    "QLD": "Australia/Brisbane",
    "NSW": "Australia/Sydney",
    "VIC": "Australia/Melbourne",
    "TAS": "Australia/Hobart",
}
ZONE_EXCEPTIONS = {"Giles": "Australia/Adelaide"}

# Unit factors.
KMH_PER_MS = 3.6
MS_PER_KNOT = 0.514444
KNOT_PER_MS = 1.944
ZERO_C = 273.15
GRAVITY = 9.8

COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def period_months(spark: SparkSession, periods: dict[str, list[int]] = PERIODS) -> DataFrame:
    """(period, month) rows; a fixed table of a few dozen rows, so it is always safe to broadcast."""
    rows = [(name, m) for name, months in periods.items() for m in months]
    return F.broadcast(literal_table(spark, rows, ["period", "month"]))


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A hand-written table as an inline relation; its size is that of the code that lists it."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def box(name: str) -> tuple[float, float, float, float]:
    if name not in BOXES:
        raise ValueError(f"unknown region {name!r}; one of {sorted(BOXES)}")
    return BOXES[name]
