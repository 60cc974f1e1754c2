"""Scan queries (A): raw text rows derived from the events and orders tables, through the typed cleaners."""
import uuid

from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions import scalar as S
from squallframe.operators import cleaning as C
from squallframe.plans.registry import query, r6, sql
from squallframe.session import shared_folder
from squallframe.sources import scans, sinks

STATES = "array('WA','NT','SA','QLD','NSW','VIC','TAS')"


def _daily_lines(t):
    """CSV lines of the daily station source, with blanks where a value is missing."""
    e = t.events
    gust = F.when(F.col("event_id") % 50 == 0, F.lit("     ")).otherwise((F.col("value") / 10).cast("string"))
    clock = F.when(F.col("event_id") % 7 == 0, F.lit("    ")).otherwise(F.date_format("ts", "HHmm"))
    wdir = F.when(F.col("event_id") % 11 == 0, F.lit("CALM")).otherwise(((F.col("event_id") * 37) % 360).cast("string"))
    line = F.concat_ws(
        ",", F.col("event_id").cast("string"), (F.col("user_id") % 35).cast("string"),
        F.concat(F.lit("  STN "), (F.col("user_id") % 35).cast("string"), F.lit(" ")), F.lit("  town "),
        F.element_at(F.expr(STATES), (F.col("event_id") % 7 + 1).cast("int")), F.lit("-30.5"), F.lit("140.25"), F.lit("12"),
        F.date_format("ts", "dd/MM/yyyy"), gust, F.lit("Y"), wdir, F.lit("Y"), clock, F.lit("Y"), F.lit("#"),
    )
    return e.select(line.alias("line"))


@query("daily_gust_scan", "A1,H1,H16", """
SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN user_id % 35 = 3 THEN 'Renamed' ELSE 'STN ' || (user_id % 35) END AS stn_name,
 'town' AS locality, ['WA','NT','SA','QLD','NSW','VIC','TAS'][event_id % 7 + 1] AS state,
 CASE WHEN event_id % 50 <> 0 THEN value / 10 END AS wind_gust, CASE WHEN event_id % 11 <> 0 THEN CAST((event_id * 37) % 360 AS DOUBLE) END AS wind_dir,
 CAST(ts AS DATE) AS daily_date_lt, CASE WHEN event_id % 7 = 0 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END AS gust_time_lt FROM events""")
def _(t):
    raw = scans.parse_lines(_daily_lines(t), "line", scans.DAILY_GUST_SCHEMA)
    out = scans.clean_daily_gusts(raw, {"STN 3": "Renamed"})
    return out.select("record_id", "stn_name", "locality", "state", "wind_gust", "wind_dir", "daily_date_lt", "gust_time_lt")


@query("half_hourly_scan", "A2", """
SELECT 'STN ' || (user_id % 35) AS stn_name, date_trunc('minute', ts) AS time, ROUND(value / 3.6, 6) AS wind_gust, CAST(NULL AS VARCHAR) AS quality FROM events""")
def _(t):
    raw = t.events.select(
        F.concat(F.lit("STN "), (F.col("user_id") % 35).cast("string")).alias("stn_name"),
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("date_str"),
        F.col("value").cast("string").alias("wind_gust"),
        F.lit(None).cast("string").alias("quality"),
    )
    return scans.clean_half_hourly(raw).withColumn("wind_gust", r6("wind_gust"))


@query("station_daily_scan", "A3", """
SELECT '23' AS file_station, CAST(ts AS DATE) AS date, value AS wind_gust FROM events WHERE user_id % 35 = 23""")
def _(t):
    site = (F.col("user_id") % 35).cast("string")
    raw = t.events.select(
        F.concat(F.lit("/daily/DC02D_Data_"), site, F.lit("_999.txt")).alias("_file"),
        site.alias("stn_name"),
        F.date_format("ts", "dd/MM/yyyy").alias("date_str"),
        F.col("value").cast("string").alias("wind_gust"),
        F.lit("Y").alias("quality"),
    )
    return scans.clean_station_daily(raw, "_file", "23").select("file_station", "date", "wind_gust")


@query("sounding_scan", "A4,H6", """
SELECT CAST(user_id % 35 AS VARCHAR) AS stn_id, date_trunc('minute', ts) AS time, COUNT(*) AS n,
 COUNT(CASE WHEN event_id % 9 <> 0 THEN 1 END) AS n_ta, ROUND(SUM(value * SIN(RADIANS(event_id % 360))), 6) + 0.0 AS u_sum, ROUND(SUM(value * COS(RADIANS(event_id % 360))), 6) + 0.0 AS v_sum
FROM events WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""")
def _(t):
    raw = t.events.select(
        (F.col("user_id") % 35).cast("string").alias("stn_id"),
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("date_time"),
        F.lit("1000.0").alias("p"),
        F.lit("  ").alias("z"),
        F.when(F.col("event_id") % 9 == 0, "     ").otherwise("21.5").alias("ta"),
        F.lit("11.5").alias("dp"),
        F.col("value").cast("string").alias("ws"),
        (F.col("event_id") % 360).cast("string").alias("wd"),
    )
    rows = scans.clean_soundings(raw, "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return rows.groupBy("stn_id", "time").agg(
        F.count(F.lit(1)).alias("n"), F.count("ta").alias("n_ta"), r6(F.sum("ua")).alias("u_sum"), r6(F.sum("va")).alias("v_sum")
    )


@query("storm_report_scan", "A5,H2", """
a AS (SELECT event_id, date_trunc('minute', ts) m, event_type, value FROM events WHERE event_type = 'error')
SELECT CAST(event_id AS VARCHAR) AS wind_id, m AS sta_date, date_trunc('hour', m) AS sta_date_floor,
 CASE WHEN m = date_trunc('hour', m) THEN m ELSE date_trunc('hour', m) + INTERVAL 1 HOUR END AS sta_date_ceil, CAST(m AS DATE) AS sta_daily_date,
 'gust: error' AS comments, ROUND(value * 0.514444, 6) AS sta_wind FROM a""".replace("\na AS", "WITH a AS", 1))
def _(t):
    raw = t.events.where("event_type = 'error'").select(
        F.col("event_id").cast("string").alias("wind_id"),
        F.lit(-30.0).alias("lat"),
        F.lit(140.0).alias("lon"),
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("date_time"),
        F.concat(F.lit("GUST: "), F.upper("event_type")).alias("comments"),
        F.col("value").alias("gust_kt"),
    )
    return scans.clean_reports(raw).drop("lat", "lon").withColumn("sta_wind", r6("sta_wind"))


@query("cyclone_track_scan", "A6", """
SELECT YEAR(o_orderdate) || '_' || (o_custkey % 20) AS storm_id, COUNT(*) AS n, COUNT(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END) AS n_sfc,
 ROUND(SUM(CAST(-30 + (o_orderkey % 25) AS DOUBLE)), 6) AS lat_sum FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1""")
def _(t):
    key = F.col("o_orderkey")
    raw = t.raw("orders").select(
        F.lit("N").alias("name"),
        (F.col("o_custkey") % 20).cast("string").alias("storm_no"),
        F.when(key % 13 == 0, " ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("tm"),
        F.lit("T").alias("type"),
        F.when(key % 3 == 0, "x").otherwise("2").alias("sfc_code"),
        (-30 + key % 25).cast("string").alias("lat"),
        (112 + F.col("o_custkey") % 44).cast("string").alias("lon"),
        *[F.lit(" ").alias(c) for c in ("pressure", "wind_mps", "gust_mps")],
    )
    out = scans.clean_tracks(raw)
    return out.groupBy("storm_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("sfc_code").alias("n_sfc"), r6(F.sum("lat")).alias("lat_sum")
    )


@query("lightning_time_decoding", "A7", """
SELECT MAKE_TIMESTAMP(2014 + event_id % 5, 1, 1, 0, 0, 0.0) + (CASE WHEN 2014 + event_id % 5 >= 2016 THEN 6 ELSE 1 END) * INTERVAL 1 HOUR * (event_id % 1000) AS time,
 COUNT(*) AS n, ROUND(SUM(value), 6) AS strokes FROM events GROUP BY 1""")
def _(t):
    raw = t.events.select(
        (2014 + F.col("event_id") % 5).cast("int").alias("year"),
        (F.col("event_id") % 1000).cast("int").alias("step"),
        F.lit(0.0).alias("lat"),
        F.lit(0.0).alias("lon"),
        F.col("value").alias("strokes"),
    )
    rows = scans.clean_lightning(raw)
    return rows.groupBy("time").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("strokes")).alias("strokes"))


@query("seasonal_climate_index", "A8", sql("v_index", """
s AS (SELECT year + CASE WHEN month IN (1, 2) THEN -1 ELSE 0 END AS year,
 CASE WHEN month IN (12,1,2) THEN 'DJF' WHEN month < 6 THEN 'MAM' WHEN month < 9 THEN 'JJA' ELSE 'SON' END AS season, idx FROM v_index
 UNION ALL SELECT year, 'ANN', idx FROM v_index)
SELECT CAST(year AS INT) AS year, season, ROUND(AVG(idx), 6) AS idx FROM s GROUP BY 1, 2 HAVING COUNT(*) = CASE WHEN season = 'ANN' THEN 12 ELSE 3 END"""))
def _(t):
    wide = t.index.groupBy("year").pivot("month", list(range(1, 13))).agg(F.max("idx"))
    out = scans.seasonal_index(scans.monthly_index(wide))
    return out.select("year", "season", r6("value").alias("idx"))


@query("oscillation_phase_flags", "A8", """
SELECT event_id, CASE WHEN event_id % 8 + 1 IN (4,5,6,7) AND value / 50 >= 1 THEN 1 ELSE 0 END AS active,
 CASE WHEN event_id % 8 + 1 IN (8,1,2,3) AND value / 50 >= 1 THEN 1 ELSE 0 END AS inactive FROM events""")
def _(t):
    daily = t.events.select("event_id", (F.col("event_id") % 8 + 1).alias("phase"), (F.col("value") / 50).alias("amplitude"))
    return scans.oscillation_flags(daily).select("event_id", "active", "inactive")


@query("model_units_scan", "A9,H4,B6", sql("v_levels", """
SELECT col_id, lev, ROUND(ta, 6) AS ta, ROUND(p, 6) AS p, ROUND(hgt, 6) AS hgt, ROUND(LEAST(GREATEST(ua * 6, 0), 100), 6) AS hur FROM v_levels WHERE p >= 800"""))
def _(t):
    model = t.levels.select(
        "col_id", "lev", (F.col("ta") + refs.ZERO_C).alias("ta"), (F.col("p") * 100).alias("p"),
        (F.col("hgt") * refs.GRAVITY).alias("z"), (F.col("ua") * 6).alias("hur"),
    )
    out = scans.standard_units(model, 800.0 - 1e-9)
    return out.select("col_id", "lev", *[r6(c).alias(c) for c in ("ta", "p", "hgt", "hur")])


@query("nearest_pressure_level", "A11", sql("v_levels", """
b AS (SELECT p FROM (SELECT DISTINCT p FROM v_levels) ORDER BY ABS(p - 825), p DESC LIMIT 1)
SELECT col_id, lev, ta FROM v_levels WHERE p = (SELECT p FROM b)"""))
def _(t):
    out = scans.nearest_level(t.levels, "p", 825.0).select("col_id", "lev", "ta")
    return out


@query("gust_only_daily_loader", "A12", sql("v_field", """
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, MAX(v) AS v FROM v_field
 WHERE YEAR(time) BETWEEN 1996 AND 1999 AND lat BETWEEN -40 AND -34 AND MONTH(time) IN (12, 1, 2) GROUP BY 1, 2, 3, 4)
SELECT model, YEAR(day) AS year, CAST(i % 2 AS INT) AS region, MAX(v) AS annual_max, COUNT(*) AS n_days FROM d GROUP BY 1, 2, 3"""))
def _(t):
    rows = t.field.where(
        F.col("time").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1999-12-31 23:59:59").cast("timestamp"))
        & F.col("lat").between(-40, -34) & S.month_in("time", [12, 1, 2])
    )
    daily = rows.groupBy("model", "i", "j", F.to_date("time").alias("day")).agg(F.max("v").alias("v"))
    region = (F.col("i") % 2).alias("region")
    out = daily.groupBy("model", F.year("day").alias("year"), region).agg(F.max("v").alias("annual_max"), F.count(F.lit(1)).alias("n_days"))
    return out.withColumn("year", F.col("year").cast("long"))


@query("date_sequence", "A13", """
SELECT event_id, UNNEST(GENERATE_SERIES(date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR * (event_id % 4 * 5), INTERVAL 6 HOUR)) AS time FROM events""")
def _(t):
    e = t.events.select("event_id", F.date_trunc("hour", "ts").alias("a"))
    e = e.withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.col("event_id") % 4 * 5 * 3600))
    return scans.date_sequence(e, "a", "b", 6).select("event_id", "time")


@query("runs_covering_times", "A14", """
WITH r AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS run_time FROM orders),
q AS (SELECT DISTINCT ts AS time FROM (SELECT o_orderdate + INTERVAL 9 HOUR AS ts FROM orders WHERE o_totalprice > 400000))
SELECT run_time FROM r WHERE EXISTS (SELECT 1 FROM q WHERE q.time BETWEEN r.run_time + INTERVAL 6 HOUR AND r.run_time + INTERVAL 10 DAY)""")
def _(t):
    orders = t.raw("orders")
    runs = orders.select(F.date_trunc("day", "o_orderdate").alias("run_time"))
    times = orders.where("o_totalprice > 400000").select((F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")).alias("time"))
    return scans.runs_covering(runs, times)


@query("corrupt_time_removal", "A15,G3", """
SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (DATE '1996-05-05', DATE '1997-07-07', DATE '1998-01-09') GROUP BY 1""")
def _(t):
    bad = refs.literal_table(t.spark, [("1996-05-05",), ("1997-07-07",), ("1998-01-09",)], ["d"]).select(F.to_date("d").alias("d"))
    kept = scans.drop_listed_times(t.raw("orders").withColumn("day", F.to_date("o_orderdate")), "day", bad)
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _store(t, name):
    """A new folder for a query's own files, in the folder that all executors share."""
    return f"{shared_folder(t.spark)}/squallframe/{name}-{uuid.uuid4().hex}"


@query("append_derived_variable", "A17,J22", sql("v_levels", """
c AS (SELECT col_id, MAX(CASE WHEN p = 850 THEN ta END) t850, MAX(CASE WHEN p = 850 THEN dp END) d850, MAX(CASE WHEN p = 700 THEN ta END) t700 FROM v_levels GROUP BY 1)
SELECT col_id, CAST(col_id % 4 AS INT) AS part, ROUND(t850 + d850 - 1.7 * t700, 6) AS tq FROM c"""))
def _(t):
    at = lambda c, p: F.max(F.when(F.col("p") == p, F.col(c)))
    cols = t.levels.groupBy("col_id").agg(at("ta", 850).alias("t850"), at("dp", 850).alias("d850"), at("ta", 700).alias("t700"))
    stored, filled = _store(t, "cube"), _store(t, "filled")
    sinks.write_partitioned(cols.withColumn("part", (F.col("col_id") % 4).cast("int")), stored, ["part"])
    sinks.append_variable(t.spark, stored, filled, {"tq": F.col("t850") + F.col("d850") - 1.7 * F.col("t700")}, ["part"])
    return t.spark.read.parquet(filled).select("col_id", "part", r6("tq").alias("tq"))


@query("partitioned_write_and_overwrite", "A16", sql("v_obs", """
d AS (SELECT loc_id, CAST(gust_time AS DATE) AS day, MAX(wind_gust) AS g FROM v_obs GROUP BY 1, 2)
SELECT CAST(YEAR(day) AS INT) AS year, loc_id, COUNT(*) AS days, ROUND(MAX(CASE WHEN MONTH(day) = 1 THEN -g ELSE g END), 6) + 0E0 AS top FROM d GROUP BY 1, 2"""))
def _(t):
    days = t.obs.groupBy("loc_id", F.to_date("gust_time").alias("day")).agg(F.max("wind_gust").alias("g"))
    days = days.withColumns({"year": F.year("day"), "month": F.month("day")})
    path = _store(t, "days")
    sinks.write_partitioned(days, path, ["year", "month"], ["loc_id"], {"g": "m s-1"})
    # a second write replaces the January partitions and no others
    sinks.write_partitioned(days.where("month = 1").withColumn("g", -F.col("g")), path, ["year", "month"])
    back = t.spark.read.parquet(path)
    return back.groupBy("year", "loc_id").agg(F.count(F.lit(1)).alias("days"), r6(F.max("g")).alias("top"))


@query("text_table_export", "A19", sql("v_obs", """
SELECT loc_id, COUNT(*) AS n, CAST(SUM(CASE WHEN wind_gust IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, ROUND(SUM(wind_gust), 4) AS total FROM v_obs GROUP BY 1"""))
def _(t):
    path = _store(t, "text")
    sinks.write_text_table(t.obs.select("loc_id", "gust_time", "wind_gust"), path, ";", header=True)
    back = t.spark.read.schema("loc_id int, gust_time timestamp, wind_gust double").csv(path, sep=";", header=True, nullValue="NA")
    total = F.round(F.sum("wind_gust"), 4).alias("total")
    return back.groupBy("loc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wind_gust").isNull().cast("int")).alias("missing"), total)


@query("compute_or_load", "A20", sql("v_field", """
SELECT model, ROUND(AVG(v), 6) AS mean, COUNT(*) AS n FROM v_field GROUP BY 1"""))
def _(t):
    path = _store(t, "means")
    build = lambda: t.field.groupBy("model").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    sinks.load_or_build(t.spark, path, build)

    def again():
        raise RuntimeError("the stored table was not found")

    return sinks.load_or_build(t.spark, path, again).withColumn("mean", r6("mean"))


@query("homogenisation_export", "A18", sql("v_obs", """
d AS (SELECT loc_id, CAST(gust_time AS DATE) AS day, MAX(wind_gust) AS g FROM v_obs GROUP BY 1, 2),
a AS (SELECT DISTINCT day FROM d), s AS (SELECT station FROM RANGE(35) r(station))
SELECT a.day, CAST(station AS VARCHAR) AS station, g AS wind_gust FROM a CROSS JOIN s LEFT JOIN d ON d.day = a.day AND d.loc_id = station"""))
def _(t):
    stations = list(range(35))
    daily = t.obs.select("loc_id", F.to_date("gust_time").alias("day"), "wind_gust")
    wide = sinks.wide_gusts(daily, "loc_id", "day", "wind_gust", stations)
    return sinks.homogenisation_long(wide, "day", stations)


@query("keep_listed_rows", "G3", sql("v_obs", """
SELECT loc_id, COUNT(*) AS n FROM v_obs WHERE loc_id IN (SELECT loc_id FROM v_station WHERE lat > -30) GROUP BY 1""").replace("WITH ", "WITH v_station AS (SELECT DISTINCT CAST(user_id % 35 AS INT) AS loc_id, CAST(-44.0 + (user_id % 35) AS DOUBLE) AS lat FROM events), ", 1))
def _(t):
    north = t.station.where("lat > -30").select("loc_id")
    return t.obs.join(north, "loc_id", "left_semi").groupBy("loc_id").agg(F.count(F.lit(1)).alias("n"))


@query("quality_then_first_gust", "A1,B1,B11", sql("v_obs", """
SELECT loc_id, CAST(gust_time AS DATE) AS day, ARG_MIN(event_id, event_id) AS event_id FROM v_obs WHERE quality NOT IN ('S','W','I') AND wind_gust IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    good = t.obs.withColumn("wind_gust", C.null_bad_quality("wind_gust", "quality")).where("wind_gust IS NOT NULL")
    return C.keep_first(good.select("loc_id", F.to_date("gust_time").alias("day"), "event_id"), ["loc_id", "day"], "event_id")
