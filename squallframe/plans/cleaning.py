"""Cleaning and filtering queries (B)."""
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions import scalar as S
from squallframe.operators import cleaning as C
from squallframe.plans.registry import query, r6, sql


@query("quality_flag_nulling", "B1", sql("v_obs", """
SELECT event_id, CASE WHEN quality IN ('S','W','I') THEN NULL ELSE wind_gust END AS wind_gust FROM v_obs"""))
def _(t):
    return t.obs.select("event_id", C.null_bad_quality("wind_gust", "quality").alias("wind_gust"))


@query("incomplete_month_flag", "B2", sql("v_obs", """
a AS (SELECT loc_id, YEAR(gust_time) y, MONTH(gust_time) m, event_id,
  CASE WHEN quality IN ('S','W','I') THEN NULL ELSE wind_gust END g FROM v_obs)
SELECT event_id, CAST(CASE WHEN CAST(COUNT(g) OVER w AS DOUBLE) / COUNT(*) OVER w < 0.93 THEN 1 ELSE 0 END AS INT) AS incomplete_month,
ROUND(CAST(COUNT(g) OVER w AS DOUBLE) / COUNT(*) OVER w, 6) AS month_share FROM a WINDOW w AS (PARTITION BY loc_id, y, m)"""))
def _(t):
    obs = t.obs.withColumn("wind_gust", C.null_bad_quality("wind_gust", "quality"))
    out = C.flag_incomplete_months(obs, "loc_id", "gust_time", "wind_gust", 0.93)
    return out.select("event_id", "incomplete_month", r6("month_share").alias("month_share"))


@query("drop_incomplete_years", "B3", sql("v_track", """
SELECT storm_id, CAST(YEAR(time) AS INT) AS year, COUNT(*) AS n FROM v_track a
WHERE storm_id <> 3 OR YEAR(time) NOT IN (SELECT YEAR(time) FROM v_track WHERE storm_id = 3 GROUP BY 1 HAVING COUNT(*) < 114)
GROUP BY 1, 2"""))
def _(t):
    kept = C.drop_incomplete_years(t.track, "storm_id", "time", 3, 114)
    return kept.groupBy("storm_id", F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("convective_event_label", "B4", sql("v_obs", """
SELECT event_id, CASE WHEN lightning >= 2 AND wind_gust >= 25 THEN 1 ELSE 0 END AS is_conv FROM v_obs WHERE tc_affected = 0"""))
def _(t):
    return t.obs.where("tc_affected = 0").select("event_id", C.event_label().alias("is_conv"))


@query("conditional_event_label", "B5", sql("v_obs", """
SELECT event_id, CASE WHEN lightning >= 2 AND wind_gust >= 25 THEN 1 WHEN lightning >= 2 AND wind_gust < 25 THEN 0 END AS is_conv_given_lightning
FROM v_obs"""))
def _(t):
    return t.obs.select("event_id", C.conditional_label().alias("is_conv_given_lightning"))


@query("domain_box_filter", "B6", sql("v_field", """
SELECT model, COUNT(*) AS n, ROUND(SUM(v), 6) AS v_sum FROM v_field
WHERE lat BETWEEN -38 AND -26 AND lon BETWEEN 132 AND 142 OR lat BETWEEN -40 AND -24 AND lon BETWEEN 112 AND 156 AND i >= 2 GROUP BY 1"""))
def _(t):
    keep = S.in_box("lat", "lon", "sa_small") | (S.in_box("lat", "lon", "sa_large") & (F.col("i") >= 2))
    return t.field.where(keep).groupBy("model").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("v_sum"))


@query("season_subset", "B7", sql("v_field", """
s(season, month) AS (VALUES ('DJF',12),('DJF',1),('DJF',2),('MAM',3),('MAM',4),('MAM',5),('JJA',6),('JJA',7),('JJA',8),('SON',9),('SON',10),('SON',11))
SELECT model, season, COUNT(*) AS n, ROUND(SUM(v), 6) AS v_sum FROM v_field JOIN s ON MONTH(time) = s.month GROUP BY 1, 2
UNION ALL SELECT model, 'ANN', COUNT(*), ROUND(SUM(v), 6) FROM v_field GROUP BY 1"""))
def _(t):
    # collapse to model-months before the rows are repeated per season
    months = t.field.groupBy("model", F.month("time").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    seasons = refs.period_months(t.spark, refs.SEASONS).withColumnRenamed("period", "season")
    return months.join(seasons, "month").groupBy("model", "season").agg(F.sum("n").alias("n"), r6(F.sum("s")).alias("v_sum"))


@query("synoptic_hour_subset", "B8", sql("v_points", """
SELECT loc_id, time, t_totals FROM v_points WHERE HOUR(time) IN (0, 6, 12, 18)"""))
def _(t):
    return t.points.where(F.hour("time").isin(0, 6, 12, 18)).select("loc_id", "time", "t_totals")


@query("land_mask", "B9", sql("v_field", """
SELECT i, j, COUNT(CASE WHEN (i * 5 + j) % 3 > 0 THEN v END) AS n_land, ROUND(SUM(CASE WHEN (i * 5 + j) % 3 > 0 THEN v END), 6) AS v_sum FROM v_field GROUP BY 1, 2"""))
def _(t):
    grid = t.field.select("i", "j").distinct().withColumn("lsm", ((F.col("i") * 5 + F.col("j")) % 3 > 0).cast("double"))
    masked = C.land_only(t.field, grid, ["i", "j"], ["v"])
    return masked.groupBy("i", "j").agg(F.count("v").alias("n_land"), r6(F.sum("v")).alias("v_sum"))


@query("longitude_wrap", "B10", sql("v_track", """
SELECT fix_id, ROUND(((lon * 2 + 180) % 360 + 360) % 360 - 180, 6) AS lon FROM v_track"""))
def _(t):
    return t.track.select("fix_id", r6(S.wrap_longitude(F.col("lon") * 2)).alias("lon"))


@query("first_row_per_time", "B11", sql("v_obs", """
SELECT loc_id, hour_floor, event_id, wind_gust FROM v_obs QUALIFY ROW_NUMBER() OVER (PARTITION BY loc_id, hour_floor ORDER BY event_id) = 1"""))
def _(t):
    rows = t.obs.select("loc_id", "hour_floor", "event_id", "wind_gust")
    return C.keep_first(rows, ["loc_id", "hour_floor"], "event_id")


@query("dewpoint_gap_fill", "B12", sql("v_levels", """
a AS (SELECT col_id, lev, CASE WHEN (col_id + lev) % 3 <> 0 THEN dp END AS dp FROM v_levels),
b AS (SELECT col_id, lev, dp, LAST_VALUE(dp IGNORE NULLS) OVER (PARTITION BY col_id ORDER BY lev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
 FIRST_VALUE(dp IGNORE NULLS) OVER (PARTITION BY col_id ORDER BY lev ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM a)
SELECT col_id, lev, ROUND(COALESCE(dp, (COALESCE(lo, hi) + COALESCE(hi, lo)) / 2), 6) AS dp FROM b"""))
def _(t):
    gappy = t.levels.select("col_id", "lev", F.when((F.col("col_id") + F.col("lev")) % 3 != 0, F.col("dp")).alias("dp"))
    return C.fill_levels(gappy, ["col_id"], "lev", "dp").select("col_id", "lev", r6("dp").alias("dp"))


@query("percentile_clipping", "B13", sql("v_points", """
q AS (SELECT QUANTILE_CONT(ml_cape, 0.001) a1, QUANTILE_CONT(ml_cape, 0.999) a2, QUANTILE_CONT(dcape, 0.001) b1, QUANTILE_CONT(dcape, 0.999) b2 FROM v_points)
SELECT loc_id, time, ROUND(LEAST(GREATEST(ml_cape, a1), a2), 6) AS ml_cape, ROUND(LEAST(GREATEST(dcape, b1), b2), 6) AS dcape FROM v_points, q"""))
def _(t):
    out = C.clip_to_percentiles(t.points.select("loc_id", "time", "ml_cape", "dcape"), ["ml_cape", "dcape"])
    return out.select("loc_id", "time", r6("ml_cape").alias("ml_cape"), r6("dcape").alias("dcape"))


@query("empty_step_nulling", "B14", sql("v_field", """
a AS (SELECT model, time, CASE WHEN v > 45 THEN v ELSE 0 END AS u1, v FROM v_field),
b AS (SELECT model, time, v, MAX(u1) OVER (PARTITION BY model, time) AS top FROM a)
SELECT model, time, COUNT(CASE WHEN top <> 0 THEN v END) AS n, ROUND(SUM(CASE WHEN top <> 0 THEN v END), 6) AS v_sum FROM b GROUP BY 1, 2"""))
def _(t):
    f = t.field.select("model", "time", F.when(F.col("v") > 45, F.col("v")).otherwise(0.0).alias("u1"), "v")
    out = C.null_empty_steps(f, ["model", "time"], "u1", ["v"])
    return out.groupBy("model", "time").agg(F.count("v").alias("n"), r6(F.sum("v")).alias("v_sum"))


@query("below_surface_masking", "B15", sql("v_levels", """
SELECT lev, COUNT(CASE WHEN p >= 800 AND p <> 0 AND ta <> -273.15 THEN ta END) AS n, COUNT(*) AS n_all FROM v_levels GROUP BY 1"""))
def _(t):
    masked = t.levels.select("lev", C.null_outside_levels("ta", "p", 800.0).alias("ta"))
    return masked.groupBy("lev").agg(F.count("ta").alias("n"), F.count(F.lit(1)).alias("n_all"))


@query("physical_range_check", "B16", sql("v_levels", """
SELECT MIN(hgt) AS hgt_min, MAX(hgt) AS hgt_max, MIN(p) AS p_min, MAX(p) AS p_max FROM v_levels"""))
def _(t):
    ok = t.levels.select(
        C.checked_range("hgt", -1000.0, 100000.0).alias("hgt"), C.checked_range("p", 0.0, 200000.0).alias("p")
    )
    return ok.agg(*[f(c).alias(f"{c}_{n}") for c in ("hgt", "p") for n, f in (("min", F.min), ("max", F.max))])


@query("predictor_columns", "B17", sql("v_points", """
SELECT 't_totals' AS param, SUM(t_totals) AS total FROM v_points UNION ALL SELECT 'ml_cape', ROUND(SUM(ml_cape), 4) FROM v_points
UNION ALL SELECT 's06', SUM(s06) FROM v_points UNION ALL SELECT 'dcape', SUM(dcape) FROM v_points UNION ALL SELECT 'umean06', ROUND(SUM(umean06), 4) FROM v_points"""))
def _(t):
    cols = C.predictors(t.points, ["loc_id", "time"])
    return t.points.unpivot([], cols, "param", "v").groupBy("param").agg(F.round(F.sum("v"), 4).alias("total"))


@query("station_outlier_drop", "B18,G3", sql("v_obs", """
SELECT loc_id, COUNT(*) AS n FROM v_obs WHERE loc_id NOT IN (4, 11, 30) GROUP BY 1"""))
def _(t):
    return t.obs.where(~F.col("loc_id").isin(4, 11, 30)).groupBy("loc_id").agg(F.count(F.lit(1)).alias("n"))


@query("point_corrections", "B19", sql("v_obs", """
a AS (SELECT event_id, loc_id, CAST(gust_time AS DATE) AS day FROM v_obs)
SELECT event_id, CAST(CASE WHEN loc_id = 4 THEN 104 ELSE loc_id END AS INT) AS loc_id,
 CASE WHEN (loc_id = 3 AND day = DATE '2024-01-05') OR (loc_id = 7 AND day = DATE '2024-01-09') THEN MAKE_DATE(YEAR(day), DAY(day), MONTH(day)) ELSE day END AS day
FROM a WHERE NOT (loc_id = 5 AND day = DATE '2024-01-11')"""))
def _(t):
    days = t.obs.select("event_id", "loc_id", F.to_date("gust_time").alias("day"))
    return C.correct_points(
        days, "loc_id", "day", [(3, "2024-01-05"), (7, "2024-01-09")], [(5, "2024-01-11")], {4: 104}
    )
