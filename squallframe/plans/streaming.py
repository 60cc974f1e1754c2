"""Streams replayed from stored tables; the twins are the batch results."""
from pyspark.sql import functions as F

from squallframe.plans.registry import query, r6, sql
from squallframe.streaming import gusts
from squallframe.streaming.replay import closing, in_order, replay


@query("streaming_daily_maximum", "D1", sql("v_obs", """
SELECT loc_id, CAST(hour_floor AS DATE) AS day, MAX(wind_gust) AS gust_max FROM v_obs WHERE hour_floor IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    rows = t.obs.select("loc_id", F.col("hour_floor").cast("timestamp").alias("time"), F.col("wind_gust").alias("gust_max"))
    daily, _ = replay([*in_order(rows, "time"), closing(rows, "time")], lambda s: gusts.daily_maximum(s, ["loc_id"], "time", "gust_max"))
    return daily.where(F.col("loc_id").isNotNull())


@query("streaming_spike_fix", "E1", sql("v_points", """
g AS (SELECT loc_id, time, ml_cape / 10 AS g FROM v_points WHERE time IS NOT NULL)
SELECT a.loc_id, a.time, ROUND(CASE WHEN a.g >= 40 AND b.g < 20 AND c.g < 20 THEN (b.g + c.g) / 2 ELSE a.g END, 6) AS gust
FROM g a LEFT JOIN g b ON b.loc_id = a.loc_id AND b.time = a.time - INTERVAL 1 HOUR LEFT JOIN g c ON c.loc_id = a.loc_id AND c.time = a.time + INTERVAL 1 HOUR"""))
def _(t):
    rows = t.points.select("loc_id", F.col("time").cast("timestamp").alias("time"), (F.col("ml_cape") / 10).alias("gust"))
    fixed, _ = replay([*in_order(rows, "time"), closing(rows, "time")], lambda s: gusts.fix_hourly_spikes(s, ["loc_id"], "time", "gust"))
    return fixed.where(F.col("loc_id").isNotNull()).withColumn("gust", r6("gust"))


@query("streaming_first_rows", "B11", sql("v_obs", """
SELECT event_id, loc_id, hour_floor, wind_gust FROM v_obs WHERE hour_floor IS NOT NULL"""))
def _(t):
    rows = t.obs.select("event_id", "loc_id", F.col("hour_floor").cast("timestamp").alias("hour_floor"), "wind_gust")
    # every delivery comes twice
    twice = [part for part in in_order(rows, "hour_floor") for _ in range(2)]
    return replay(twice, lambda s: gusts.first_of_each(s, ["event_id"], "hour_floor"))[0]
