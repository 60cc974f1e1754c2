"""Typed scans (A): each source has a schema, a reader and a cleaner that works on any raw frame."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions import scalar as S

DAILY_GUST_SCHEMA = (
    "record_id string, stn_no int, stn_name string, locality string, state string, lat double, lon double, "
    "height string, date_str string, wind_gust string, quality string, wind_dir string, wind_dir_quality string, "
    "max_gust_str_lt string, max_gust_time_quality string, eof string"
)
HALF_HOURLY_SCHEMA = (
    "record_id string, stn_no int, stn_name string, locality string, state string, lat double, lon double, "
    "height string, date_str string, wind_dir string, wind_dir_quality string, wind_gust string, quality string, "
    "aws_flag string, eof string"
)
STATION_DAILY_SCHEMA = (
    "hm string, stn_no int, stn_name string, lat double, lon double, date_str string, wind_gust string, "
    "quality string, eof string"
)
SOUNDING_SCHEMA = (
    "record_id string, stn_id string, date_time string, ta string, ta_quality string, dp string, dp_quality string, "
    "rh string, rh_quality string, ws string, ws_quality string, wd string, wd_quality string, p string, "
    "p_quality string, z string, z_quality string, symbol string"
)
REPORT_SCHEMA = "wind_id string, date_time string, lat double, lon double, gust_kt double, comments string"
TRACK_SCHEMA = (
    "name string, storm_no string, tm string, type string, sfc_code string, lat string, lon string, "
    "pressure string, wind_mps string, gust_mps string"
)
LIGHTNING_SCHEMA = "year int, step int, lat double, lon double, strokes double"


def number(c: str | Column, kind: str = "double") -> Column:
    """Text to number; blanks and junk become null."""
    return F.trim(S.col(c)).try_cast(kind)


def read_csv(spark: SparkSession, path, schema: str, header: bool = False, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=header, mode="PERMISSIVE", **options).csv(path)


def parse_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """CSV text lines (a frame column) to typed columns, in the JVM; the other columns are kept."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.from_csv(line, schema).alias("_r")).select(*rest, "_r.*")


def day_from_text(c: str) -> Column:
    """dd/MM/yyyy by position."""
    part = lambda a, n: F.substring(c, a, n).cast("int")
    return F.make_date(part(7, 4), part(4, 2), part(1, 2))


def station_names(c: str, renames: dict[str, str]) -> Column:
    name = F.trim(c)
    if not renames:
        return name
    table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def clean_daily_gusts(raw: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Daily station gusts: typed, blanks null, trimmed and renamed; a missing time means 00:00."""
    clock = F.when(F.trim("max_gust_str_lt") == "", None).otherwise(F.trim("max_gust_str_lt"))
    clock = F.coalesce(clock, F.lit("0000"))
    day = day_from_text("date_str")
    return raw.select(
        "record_id",
        "stn_no",
        station_names("stn_name", renames or {}).alias("stn_name"),
        F.trim("locality").alias("locality"),
        F.trim("state").alias("state"),
        "lat",
        "lon",
        number("wind_gust").alias("wind_gust"),
        "quality",
        number("wind_dir").alias("wind_dir"),
        day.alias("daily_date_lt"),
        F.make_timestamp(
            F.year(day), F.month(day), F.dayofmonth(day),
            F.substring(clock, 1, 2).cast("int"), F.substring(clock, 3, 2).cast("int"), F.lit(0),
        ).alias("gust_time_lt"),
    )


def read_daily_gusts(spark: SparkSession, path, renames: dict[str, str] | None = None) -> DataFrame:
    return clean_daily_gusts(read_csv(spark, path, DAILY_GUST_SCHEMA), renames)


def clean_half_hourly(raw: DataFrame) -> DataFrame:
    """Four columns, km/h to m/s."""
    return raw.select(
        F.trim("stn_name").alias("stn_name"),
        F.to_timestamp("date_str", "dd/MM/yyyy HH:mm").alias("time"),
        S.kmh_to_ms(number("wind_gust")).alias("wind_gust"),
        "quality",
    )


def read_half_hourly(spark: SparkSession, path) -> DataFrame:
    return clean_half_hourly(read_csv(spark, path, HALF_HOURLY_SCHEMA))


def clean_station_daily(raw: DataFrame, file: str, station_no: str | None = None) -> DataFrame:
    """Per-station daily files; the station number is the third part of the file name."""
    out = raw.select(
        F.split(F.element_at(F.split(file, "/"), -1), "_").getItem(2).alias("file_station"),
        F.trim("stn_name").alias("stn_name"),
        day_from_text("date_str").alias("date"),
        number("wind_gust").alias("wind_gust"),
        "quality",
    )
    return out if station_no is None else out.where(F.col("file_station") == station_no)


def read_station_daily(spark: SparkSession, folder: str, station_no: str | None = None) -> DataFrame:
    """One glob; with a station the file list itself is filtered, so other files are never opened."""
    path = f"{folder}/*_{station_no}_*" if station_no else folder
    raw = read_csv(spark, path, STATION_DAILY_SCHEMA).withColumn("_file", F.input_file_name())
    return clean_station_daily(raw, "_file", station_no)


def clean_soundings(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Sounding levels in a time range, with wind components; one row per level."""
    time = F.to_timestamp("date_time", "dd/MM/yyyy HH:mm")
    rows = raw.select(
        F.trim("stn_id").alias("stn_id"), time.alias("time"), *[number(c).alias(c) for c in ("p", "z", "ta", "dp", "ws", "wd")]
    )
    rows = rows.where((F.col("time") >= F.lit(start).cast("timestamp")) & (F.col("time") <= F.lit(end).cast("timestamp")))
    return rows.withColumns({"ua": S.wind_u("ws", "wd"), "va": S.wind_v("ws", "wd")})


def read_soundings(spark: SparkSession, paths, start: str, end: str) -> DataFrame:
    return clean_soundings(read_csv(spark, paths, SOUNDING_SCHEMA), start, end)


def clean_reports(raw: DataFrame) -> DataFrame:
    time = F.to_timestamp("date_time", "dd/MM/yyyy HH:mm")
    return raw.select(
        "wind_id",
        "lat",
        "lon",
        time.alias("sta_date"),
        S.floor_time(time, 3600).alias("sta_date_floor"),
        S.ceil_time(time, 3600).alias("sta_date_ceil"),
        F.to_date(time).alias("sta_daily_date"),
        F.lower("comments").alias("comments"),
        S.knots_to_ms("gust_kt").alias("sta_wind"),
    )


def read_reports(spark: SparkSession, path) -> DataFrame:
    return clean_reports(read_csv(spark, path, REPORT_SCHEMA, header=True))


def clean_tracks(raw: DataFrame) -> DataFrame:
    """Drop fixes without a time, coerce numbers, and name each storm year_number."""
    time = F.try_to_timestamp("tm", F.lit("yyyy-MM-dd HH:mm"))
    rows = raw.where(F.trim("tm") != "").withColumn("time", time)
    return rows.select(
        F.concat_ws("_", F.year("time"), F.trim("storm_no")).alias("storm_id"),
        F.trim("name").alias("name"),
        "time",
        "type",
        *[number(c).alias(c) for c in ("lat", "lon", "pressure", "sfc_code", "wind_mps", "gust_mps")],
    )


def read_tracks(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.schema(TRACK_SCHEMA).options(header=True, mode="DROPMALFORMED").csv(path)
    return clean_tracks(raw)


def clean_lightning(raw: DataFrame) -> DataFrame:
    """Yearly files count hours up to 2015 and six-hour steps from 2016 on."""
    hours = F.when(F.col("year") >= 2016, 6 * F.col("step")).otherwise(F.col("step"))
    start = F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return raw.select(F.timestamp_seconds(F.unix_timestamp(start) + hours * 3600).alias("time"), "lat", "lon", "strokes")


def monthly_index(wide: DataFrame, year: str = "year") -> DataFrame:
    """A year-by-month table (columns 1..12) to (year, month, value) rows."""
    months = [c for c in wide.columns if c != year]
    long = wide.unpivot([year], [F.col(f"`{c}`") for c in months], "month", "value")
    return long.select(year, F.col("month").cast("int").alias("month"), "value").where("value IS NOT NULL")


def seasonal_index(monthly: DataFrame, value: str = "value") -> DataFrame:
    """Season means per year; DJF of a year runs into January and February of the next; ANN is the mean of 12."""
    spark = monthly.sparkSession
    seasons = refs.period_months(spark, refs.SEASONS).withColumnRenamed("period", "season")
    late = (F.col("season") == "DJF") & F.col("month").isin(1, 2)
    rows = monthly.join(seasons, "month").withColumn("year", F.col("year") - late.cast("int"))
    out = rows.groupBy("year", "season").agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return out.where(F.col("n") == F.when(F.col("season") == "ANN", 12).otherwise(3)).drop("n")


ACTIVE_PHASES, INACTIVE_PHASES = (4, 5, 6, 7), (8, 1, 2, 3)  # fixed values


def oscillation_flags(daily: DataFrame, phase: str = "phase", amplitude: str = "amplitude") -> DataFrame:
    strong = F.col(amplitude) >= 1
    return daily.withColumns(
        {
            "active": (F.col(phase).isin(*ACTIVE_PHASES) & strong).cast("int"),
            "inactive": (F.col(phase).isin(*INACTIVE_PHASES) & strong).cast("int"),
        }
    )


def standard_units(profile: DataFrame, min_p: float = 100.0) -> DataFrame:
    """Model fields (K, Pa, m2/s2, %) to analysis units (C, hPa, m, % within 0..100), levels up to ``min_p``."""
    out = profile.withColumns(
        {
            "ta": S.to_celsius("ta"),
            "p": S.to_hpa("p"),
            "hgt": S.geopotential_height("z"),
            "hur": S.clamp("hur", 0.0, 100.0),
        }
    ).drop("z")
    return out.where(F.col("p") >= min_p)


def read_model(spark: SparkSession, path: str, model, years, box: str) -> DataFrame:
    """Gridded model rows: model and year prune partitions, the box is pushed to the files."""
    rows = spark.read.parquet(path).where((F.col("model") == model) & F.col("year").isin(list(years)))
    return rows.where(S.in_box("lat", "lon", box))


def nearest_level(df: DataFrame, level: str, target: float) -> DataFrame:
    """Rows on the pressure level closest to ``target`` (the higher pressure on ties)."""
    best = df.select(level).distinct().agg(
        F.min_by(level, F.struct(F.abs(F.col(level) - target), -F.col(level))).alias("_best")
    )
    return df.join(F.broadcast(best), F.col(level) == F.col("_best")).drop("_best")  # one row


def date_sequence(df: DataFrame, start: str, end: str, hours: int, out: str = "time") -> DataFrame:
    """Every ``hours`` from start to end, both inclusive, never past the end."""
    return df.withColumn(out, F.explode(F.sequence(start, end, F.expr(f"INTERVAL {int(hours)} HOURS"))))


def runs_covering(runs: DataFrame, times: DataFrame, run: str = "run_time", time: str = "time") -> DataFrame:
    """Forecast runs whose window (+6 h to +10 days) holds any wanted time.

    Runs are repeated for the days of their window, so the overlap is an equi-join on day.
    """
    first = F.col(run) + F.expr("INTERVAL 6 HOURS")
    last = F.col(run) + F.expr("INTERVAL 10 DAYS")
    days = runs.select(run).distinct().withColumn("_day", F.explode(F.sequence(F.to_date(first), F.to_date(last))))
    want = times.select(time).distinct().withColumn("_day", F.to_date(time))
    hit = days.join(want, "_day").where(F.col(time).between(first, last))
    return hit.select(run).distinct()


def drop_listed_times(df: DataFrame, time: str, listed: DataFrame) -> DataFrame:
    return df.join(listed.select(F.col(listed.columns[0]).alias(time)).distinct(), time, "left_anti")
