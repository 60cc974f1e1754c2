"""Window and sequence queries (E)."""
from pyspark.sql import functions as F

from squallframe.functions import scalar as S
from squallframe.operators import sequence as E
from squallframe.plans.registry import query, r6, sql


@query("hourly_spike_fix", "E1", sql("v_points", """
g AS (SELECT loc_id, time, ml_cape / 10 AS g FROM v_points)
SELECT a.loc_id, a.time, ROUND(CASE WHEN a.g >= 40 AND b.g < 20 AND c.g < 20 THEN (b.g + c.g) / 2 ELSE a.g END, 6) AS gust
FROM g a LEFT JOIN g b ON b.loc_id = a.loc_id AND b.time = a.time - INTERVAL 1 HOUR LEFT JOIN g c ON c.loc_id = a.loc_id AND c.time = a.time + INTERVAL 1 HOUR"""))
def _(t):
    gusts = t.points.select("loc_id", "time", (F.col("ml_cape") / 10).alias("gust"))
    return E.fix_hourly_spikes(gusts, ["loc_id"], "time", "gust").withColumn("gust", r6("gust"))


@query("half_hourly_spike_nulling", "E2", sql("v_obs", """
a AS (SELECT event_id, wind_gust, LAG(wind_gust) OVER w AS p, LEAD(wind_gust) OVER w AS n FROM v_obs WINDOW w AS (PARTITION BY loc_id ORDER BY gust_time, event_id))
SELECT event_id, CASE WHEN wind_gust >= 15 AND p < 5 AND n < 5 THEN NULL ELSE wind_gust END AS wind_gust FROM a"""))
def _(t):
    out = E.null_step_spikes(t.obs, ["loc_id"], ["gust_time", "event_id"], "wind_gust", 15.0, 5.0)
    return out.select("event_id", "wind_gust")


@query("gridded_gust_ceiling", "E3", sql("v_field", """
a AS (SELECT model, i, j, CAST(time AS DATE) AS day, v, ROW_NUMBER() OVER (PARTITION BY model, i, j, CAST(time AS DATE) ORDER BY v DESC) AS rn FROM v_field),
s AS (SELECT model, i, j, day, MAX(CASE WHEN rn = 2 THEN v END) AS second FROM a GROUP BY 1, 2, 3, 4),
f AS (SELECT a.model, CASE WHEN v >= 50 OR (v > 40 AND second < 30) THEN NULL ELSE v END AS v FROM a JOIN s USING (model, i, j, day))
SELECT model, COUNT(v) AS n, SUM(v) AS v_sum FROM f GROUP BY 1"""))
def _(t):
    out = E.gust_ceiling(t.field, ["model", "i", "j"], "time", "v", top=50.0)
    return out.groupBy("model").agg(F.count("v").alias("n"), F.sum("v").alias("v_sum"))


@query("spatial_spike_fix", "E4", sql("v_field", """
d AS (SELECT model, CAST(time AS DATE) AS day, i, j, MAX(v) AS v FROM v_field GROUP BY 1, 2, 3, 4),
n AS (SELECT a.model, a.day, a.i, a.j, a.v, MIN(b.v) AS lo, MEDIAN(b.v) AS med FROM d a JOIN d b ON a.model = b.model AND a.day = b.day AND ABS(a.i - b.i) = 1 AND ABS(a.j - b.j) = 1
 GROUP BY 1, 2, 3, 4, 5)
SELECT d.model, d.day, d.i, d.j, CASE WHEN d.v >= 25 AND n.lo < 0.5 * d.v THEN n.med ELSE d.v END AS v FROM d LEFT JOIN n ON d.model = n.model AND d.day = n.day AND d.i = n.i AND d.j = n.j"""))
def _(t):
    daily = t.field.groupBy("model", F.to_date("time").alias("day"), "i", "j").agg(F.max("v").alias("v"))
    return E.fix_spatial_spikes(daily, ["model", "day"], "i", "j", "v")


@query("sudden_gust_detection", "E5", sql("v_obs", """
a AS (SELECT event_id, loc_id, gust_time, wind_gust, tc_affected, MAX(wind_gust) OVER (PARTITION BY loc_id ORDER BY gust_time, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p,
 MAX(wind_gust) OVER (PARTITION BY loc_id ORDER BY gust_time, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS n,
 MAX(wind_gust) OVER (PARTITION BY loc_id, CAST(gust_time AS DATE)) AS dmax, MAX(tc_affected) OVER (PARTITION BY loc_id, CAST(gust_time AS DATE)) AS tc FROM v_obs)
SELECT event_id, dmax AS daily_gust, p AS prev_max, n AS next_max FROM a
WHERE wind_gust >= 15 AND dmax >= 12 AND tc <> 1 AND (wind_gust / p >= 2 OR wind_gust / n > 2)"""))
def _(t):
    out = E.sudden_gusts(t.obs, ["loc_id"], ["gust_time", "event_id"], "wind_gust", "tc_affected", 15.0, 12.0)
    return out.select("event_id", "daily_gust", "prev_max", "next_max")


@query("circular_three_month_mean", "E6", sql("v_field", """
m AS (SELECT model, MONTH(time) AS month, AVG(v) AS v FROM v_field GROUP BY 1, 2)
SELECT a.model, CAST(a.month AS INT) AS month, ROUND(AVG(b.v), 6) AS v FROM m a JOIN m b ON a.model = b.model AND ((b.month - a.month + 12) % 12) IN (0, 1, 11) GROUP BY 1, 2"""))
def _(t):
    months = t.field.groupBy("model", F.month("time").alias("month")).agg(F.avg("v").alias("v"))
    return E.circular_month_mean(months, ["model"], "month", "v").withColumn("v", r6("v"))


@query("trailing_diurnal_mean", "E7", sql("v_points", """
h AS (SELECT loc_id, HOUR(time) AS hour, COUNT(*) AS n FROM v_points WHERE t_totals >= 45 GROUP BY 1, 2)
SELECT loc_id, CAST(hour AS INT) AS hour, ROUND(AVG(n) OVER (PARTITION BY loc_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM h"""))
def _(t):
    hours = t.points.where("t_totals >= 45").groupBy("loc_id", F.hour("time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return E.trailing_mean(hours, ["loc_id"], "hour", "n").select("loc_id", "hour", r6("smooth").alias("smooth"))


@query("seasonal_block_sums", "E8", sql("v_field", """
m AS (SELECT model, YEAR(time) AS y, MONTH(time) AS m, SUM(v) AS v FROM v_field GROUP BY 1, 2, 3)
SELECT model, CAST(y + CASE WHEN m = 12 THEN 1 ELSE 0 END AS INT) AS season_year, CASE WHEN m IN (12,1,2) THEN 'DJF' WHEN m < 6 THEN 'MAM' WHEN m < 9 THEN 'JJA' ELSE 'SON' END AS season,
 SUM(v) AS v FROM m GROUP BY 1, 2, 3 HAVING COUNT(*) = 3"""))
def _(t):
    months = t.field.groupBy("model", F.year("time").alias("y"), F.month("time").alias("m")).agg(F.sum("v").alias("v"))
    return E.season_blocks(months, ["model"], "y", "m", "v")


@query("utc_conversion", "E9,H3", sql("v_obs", """
l AS (SELECT event_id, loc_id, gust_time + INTERVAL 90 DAY AS local FROM v_obs),
o AS (SELECT *, CASE WHEN loc_id % 2 = 0 THEN 10 WHEN local < TIMESTAMP '2024-04-07 02:00:00' THEN 11 WHEN local >= TIMESTAMP '2024-04-07 03:00:00' THEN 10 END AS off FROM l),
n AS (SELECT *, LEAD(off) OVER (PARTITION BY loc_id ORDER BY local, event_id) AS nxt FROM o)
SELECT event_id, local - COALESCE(off, nxt) * INTERVAL 1 HOUR AS utc FROM n"""))
def _(t):
    local = t.obs.select(
        "event_id", "loc_id", (F.col("gust_time") + F.expr("INTERVAL 90 DAYS")).alias("local"),
        F.when(F.col("loc_id") % 2 == 0, "QLD").otherwise("NSW").alias("state"), F.col("loc_id").cast("string").alias("stn_name"),
    )
    out = E.to_utc(local, ["loc_id"], ["local", "event_id"], "local", E.state_zone("state", "stn_name"), "utc")
    return out.select("event_id", "utc")


@query("fixed_offset_local_time", "E10", sql("v_obs", """
SELECT event_id, gust_time + INTERVAL 1 MINUTE * CAST(CASE loc_id WHEN 1 THEN 480 WHEN 2 THEN 570 ELSE 600 END AS INT) AS local FROM v_obs"""))
def _(t):
    return t.obs.select("event_id", E.fixed_offset_local("gust_time", "loc_id", {1: 8.0, 2: 9.5}).alias("local"))


@query("nearest_analysis_time", "E11,H2", sql("v_obs", """
a AS (SELECT event_id, date_trunc('hour', gust_time) + INTERVAL 30 MINUTE * (event_id % 2) AS t FROM v_obs),
b AS (SELECT event_id, t, epoch(t) / 3600 AS h, epoch(t) / 21600 AS s FROM a)
SELECT event_id, make_timestamp(CAST(CASE WHEN h - FLOOR(h) = 0.5 THEN 2 * ROUND(h / 2) ELSE ROUND(h) END * 3600 * 1000000 AS BIGINT)) AS hourly,
 make_timestamp(CAST(CASE WHEN s - FLOOR(s) = 0.5 THEN 2 * ROUND(s / 2) ELSE ROUND(s) END * 21600 * 1000000 AS BIGINT)) AS six_hourly,
 make_timestamp(CAST(FLOOR(h) * 3600 * 1000000 AS BIGINT)) AS hour_floor, make_timestamp(CAST(CEIL(h) * 3600 * 1000000 AS BIGINT)) AS hour_ceil FROM b"""))
def _(t):
    step = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("hour", "gust_time")) + 1800 * (F.col("event_id") % 2))
    rows = t.obs.select("event_id", step.alias("t"))
    return rows.select(
        "event_id", S.round_time("t", 3600).alias("hourly"), S.round_time("t", 21600).alias("six_hourly"),
        S.floor_time("t", 3600).alias("hour_floor"), S.ceil_time("t", 3600).alias("hour_ceil"),
    )


@query("vertical_trapezoid", "E12", sql("v_levels", """
a AS (SELECT col_id, (ta + LEAD(ta) OVER w) / 2 * (LEAD(hgt) OVER w - hgt) AS a FROM v_levels WINDOW w AS (PARTITION BY col_id ORDER BY lev))
SELECT col_id, ROUND(SUM(a), 6) AS area FROM a GROUP BY 1"""))
def _(t):
    return E.level_trapezoid(t.levels, ["col_id"], "lev", "ta", "hgt", "area").withColumn("area", r6("area"))


@query("first_effective_run", "E13", sql("v_levels", """
a AS (SELECT col_id, lev, ua >= 10 AND dp > 0 AS c FROM v_levels),
b AS (SELECT *, CASE WHEN c AND NOT COALESCE(LAG(c) OVER (PARTITION BY col_id ORDER BY lev), FALSE) THEN 1 ELSE 0 END AS s FROM a),
d AS (SELECT *, SUM(s) OVER (PARTITION BY col_id ORDER BY lev ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT col_id, lev FROM d WHERE c AND run = 1"""))
def _(t):
    cond = (F.col("ua") >= 10) & (F.col("dp") > 0)
    return E.first_run(t.levels, ["col_id"], "lev", cond).select("col_id", "lev")


@query("ecdf_rank", "E14", sql("v_field", """
SELECT DISTINCT model, v, ROUND(CUME_DIST() OVER (PARTITION BY model ORDER BY v), 6) AS p FROM v_field"""))
def _(t):
    return E.ecdf(t.field, ["model"], "v").withColumn("p", r6("p"))


@query("cumulative_contingency", "E15", sql("v_obs", """
a AS (SELECT quality, wind_gust, is_sta FROM v_obs WHERE wind_gust IS NOT NULL),
c AS (SELECT quality, wind_gust, COUNT(*) n, SUM(is_sta) e FROM a GROUP BY 1, 2)
SELECT quality, wind_gust, CAST(SUM(e) OVER w AS BIGINT) AS hits, CAST(SUM(n - e) OVER w AS BIGINT) AS false_alarms,
 CAST(SUM(e) OVER (PARTITION BY quality) AS BIGINT) AS n_events, CAST(SUM(n - e) OVER (PARTITION BY quality) AS BIGINT) AS n_other
FROM c WINDOW w AS (PARTITION BY quality ORDER BY wind_gust DESC ROWS UNBOUNDED PRECEDING)"""))
def _(t):
    return E.cumulative_contingency(t.obs, ["quality"], "wind_gust", "is_sta")
