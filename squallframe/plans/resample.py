"""Aggregation and resampling queries (D)."""
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.operators import cleaning as C
from squallframe.operators import resample as R
from squallframe.plans.registry import query, r6, sql

CELL = ["model", "i", "j"]
SEASON_VALUES = ", ".join(f"('{s}',{m})" for s, ms in refs.SEASONS.items() for m in ms)
PERIOD_VALUES = ", ".join(f"('{s}',{m})" for s, ms in refs.PERIODS.items() for m in ms)


@query("daily_maximum_resample", "D1", sql("v_field", """
SELECT model, i, j, CAST(time AS DATE) AS day, MAX(v) AS v_max, ROUND(AVG(v), 6) AS v_mean FROM v_field GROUP BY 1, 2, 3, 4"""))
def _(t):
    return R.daily(t.field, CELL, "time", {"v_max": F.max("v"), "v_mean": r6(F.avg("v"))})


@query("monthly_mean_of_daily_maximum", "D2", sql("v_field", """
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, SUM(v) s, COUNT(v) n, MAX(v) m FROM v_field GROUP BY 1, 2, 3, 4)
SELECT model, i, j, CAST(YEAR(day) AS INT) AS year, CAST(MONTH(day) AS INT) AS month, ROUND(SUM(s) / SUM(n), 6) AS mean, ROUND(AVG(m), 6) AS mean_daily_max, CAST(SUM(n) AS BIGINT) AS steps FROM d GROUP BY 1, 2, 3, 4, 5"""))
def _(t):
    out = R.monthly_means(t.field, CELL, "time", "v")
    return out.withColumns({"mean": r6("mean"), "mean_daily_max": r6("mean_daily_max")})


def _phases(t):
    """A daily oscillation made from the track table: one phase and amplitude per day."""
    days = t.track.groupBy(F.to_date("time").alias("day")).agg(F.min("fix_id").alias("f"))
    return days.select("day", (F.col("f") % 8 + 1).cast("int").alias("phase"), ((F.col("f") % 40) / 20.0).alias("amplitude"))


PHASES = "ph AS (SELECT CAST(time AS DATE) AS day, CAST(MIN(fix_id) % 8 + 1 AS INT) AS phase, (MIN(fix_id) % 40) / 20E0 AS amplitude FROM v_track GROUP BY 1)"


@query("threshold_exceedance_counts", "D3", sql("v_field v_track", f"""
{PHASES},
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) s, MAX(CASE WHEN v >= 40 THEN 1 ELSE 0 END) a FROM v_field GROUP BY 1, 2, 3, 4)
SELECT model, i, j, CAST(YEAR(d.day) AS INT) AS year, CAST(MONTH(d.day) AS INT) AS month, CAST(SUM(s) AS BIGINT) AS steps, CAST(SUM(a) AS BIGINT) AS days,
 CAST(SUM(CASE WHEN phase IN (4,5,6,7) AND amplitude >= 1 THEN a ELSE 0 END) AS BIGINT) AS days_active, CAST(SUM(CASE WHEN phase IN (8,1,2,3) AND amplitude >= 1 THEN a ELSE 0 END) AS BIGINT) AS days_inactive
FROM d LEFT JOIN ph ON d.day = ph.day GROUP BY 1, 2, 3, 4, 5"""))
def _(t):
    from squallframe.sources.scans import oscillation_flags

    flags = oscillation_flags(_phases(t)).select("day", "active", "inactive")
    return R.threshold_counts(t.field, CELL, "time", F.col("v") >= 40, flags)


@query("seasonal_annual_maximum", "D4", sql("v_field", f"""
s(season, month) AS (VALUES {SEASON_VALUES})
SELECT model, i, j, CAST(YEAR(time) AS INT) AS year, season, MAX(v) AS v FROM v_field JOIN s ON s.month = MONTH(time) GROUP BY 1, 2, 3, 4, 5"""))
def _(t):
    return R.seasonal_annual_max(t.field, CELL, "time", "v")


@query("time_of_annual_maximum", "D5", sql("v_field", """
SELECT model, i, j, CAST(YEAR(time) AS INT) AS year, v, time FROM v_field QUALIFY ROW_NUMBER() OVER (PARTITION BY model, i, j, YEAR(time) ORDER BY v DESC, time) = 1"""))
def _(t):
    return R.time_of_annual_max(t.field, CELL, "time", "v")


@query("oscillation_phase_counts", "D6", sql("v_field v_track", f"""
{PHASES},
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, MAX(CASE WHEN v >= 40 THEN 1 ELSE 0 END) a FROM v_field GROUP BY 1, 2, 3, 4)
SELECT model, i, j, phase, CAST(SUM(a) AS BIGINT) AS days, COUNT(*) AS days_in_phase FROM d JOIN ph ON d.day = ph.day WHERE amplitude >= 1 GROUP BY 1, 2, 3, 4"""))
def _(t):
    return R.phase_counts(t.field, CELL, "time", F.col("v") >= 40, _phases(t))


@query("period_exceedance_frequency", "D7", sql("v_field", f"""
s(period, month) AS (VALUES {PERIOD_VALUES}),
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, MAX(v) m FROM v_field WHERE YEAR(time) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3, 4)
SELECT model, i, j, period, ROUND(SUM(CASE WHEN m >= 40 THEN 1 ELSE 0 END) / 5E0, 6) AS days_per_year FROM d JOIN s ON s.month = MONTH(day) GROUP BY 1, 2, 3, 4"""))
def _(t):
    out = R.period_frequency(t.field, CELL, "time", "v", 40.0, 1996, 2000)
    return out.withColumn("days_per_year", r6("days_per_year"))


@query("period_share_and_mean", "D8", sql("v_field", f"""
s(period, month) AS (VALUES {PERIOD_VALUES})
SELECT model, i, j, period, ROUND(AVG(CASE WHEN v >= 40 THEN 1E0 ELSE 0E0 END), 6) AS share, ROUND(AVG(v), 6) AS mean FROM v_field JOIN s ON s.month = MONTH(time) GROUP BY 1, 2, 3, 4"""))
def _(t):
    out = R.period_share_and_mean(t.field, CELL, "time", "v", 40.0)
    return out.withColumns({"share": r6("share"), "mean": r6("mean")})


@query("seasonal_climatology", "D9", sql("v_field", f"""
s(season, month) AS (VALUES {SEASON_VALUES}),
y AS (SELECT COUNT(DISTINCT YEAR(time)) AS n FROM v_field),
d AS (SELECT i, j, CAST(time AS DATE) AS day, MAX(v) m, SUM(v) sv, COUNT(v) nv FROM v_field GROUP BY 1, 2, 3)
SELECT i, j, season, ROUND(SUM(sv) / SUM(nv), 6) AS mean, ROUND(SUM(CASE WHEN m > 45 THEN 1 ELSE 0 END) / CAST(MAX(y.n) AS DOUBLE), 6) AS days_per_year FROM d JOIN s ON s.month = MONTH(day), y GROUP BY 1, 2, 3"""))
def _(t):
    out = R.seasonal_climatology(t.field, ["i", "j"], "time", "v", 45.0)
    return out.withColumns({"mean": r6("mean"), "days_per_year": r6("days_per_year")})


@query("mean_exceedance_hour", "D10", sql("v_points", """
SELECT loc_id, ROUND(AVG(HOUR(time)), 6) AS hour_all, ROUND(AVG(CASE WHEN MONTH(time) IN (10,11,12,1,2,3) THEN HOUR(time) END), 6) AS hour_warm,
 ROUND(AVG(CASE WHEN MONTH(time) NOT IN (10,11,12,1,2,3) THEN HOUR(time) END), 6) AS hour_cool FROM v_points WHERE t_totals >= 50 GROUP BY 1"""))
def _(t):
    out = R.mean_exceedance_hour(t.points, ["loc_id"], "time", F.col("t_totals") >= 50)
    return out.select("loc_id", *[r6(c).alias(c) for c in ("hour_all", "hour_warm", "hour_cool")])


@query("hourly_event_counts", "D11", sql("v_obs", """
e AS (SELECT * FROM v_obs WHERE wind_gust >= 15)
SELECT loc_id, CAST(h AS INT) AS hour, (SELECT COUNT(*) FROM e WHERE e.loc_id = s.loc_id AND HOUR(e.gust_time) = h) AS n FROM (SELECT DISTINCT loc_id FROM e) s CROSS JOIN RANGE(24) r(h)"""))
def _(t):
    return R.hourly_counts(t.obs.where("wind_gust >= 15"), ["loc_id"], "gust_time")


@query("monthly_event_counts", "D11", sql("v_field", """
SELECT model, CAST(MONTH(time) AS INT) AS month, CAST(SUM(CASE WHEN v >= 20 AND v < 30 THEN 1 ELSE 0 END) AS BIGINT) AS n, ROUND(AVG(v), 6) AS mean FROM v_field GROUP BY 1, 2"""))
def _(t):
    out = R.monthly_counts(t.field, ["model"], "time", (F.col("v") >= 20) & (F.col("v") < 30), "v")
    return out.withColumn("mean", r6("mean"))


@query("normalised_monthly_share", "D12", sql("v_field", """
c AS (SELECT model, MONTH(time) AS month, COUNT(*) AS n FROM v_field WHERE v >= 40 GROUP BY 1, 2)
SELECT model, CAST(month AS INT) AS month, n, ROUND(n / CAST(SUM(n) OVER (PARTITION BY model) AS DOUBLE), 6) AS share, CAST((month + 5) % 12 AS INT) AS position FROM c"""))
def _(t):
    counts = t.field.where("v >= 40").groupBy("model", F.month("time").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    out = R.monthly_shares(counts, ["model"], "month", "n")
    return out.withColumn("share", r6("share"))


@query("ensemble_hourly_share", "D13", sql("v_points", """
c AS (SELECT loc_id % 7 AS model, HOUR(time) AS hour, COUNT(*) AS n FROM v_points WHERE s06 >= 20 GROUP BY 1, 2),
p AS (SELECT model, hour, n / CAST(SUM(n) OVER (PARTITION BY model) AS DOUBLE) AS share FROM c)
SELECT CAST(hour AS INT) AS hour, ROUND(MEDIAN(share), 6) AS share, COUNT(*) AS models FROM p GROUP BY 1"""))
def _(t):
    rows = t.points.withColumn("model", F.col("loc_id") % 7)
    share = R.hourly_share(rows, ["model"], "time", F.col("s06") >= 20)
    # one value per model: the ensemble is small, so the exact median is too
    return share.groupBy("hour").agg(r6(F.median("share")).alias("share"), F.count(F.lit(1)).alias("models"))


@query("wind_rose", "D14,H8", sql("v_obs", """
c AS (SELECT loc_id, CAST(FLOOR(wind_dir / 22.5 + 0.5) AS INT) % 16 AS k, COUNT(*) AS n FROM v_obs WHERE wind_gust >= 10 GROUP BY 1, 2)
SELECT loc_id, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][k + 1] AS sector, n, ROUND(n / CAST(SUM(n) OVER (PARTITION BY loc_id) AS DOUBLE), 6) AS share FROM c"""))
def _(t):
    return R.wind_rose(t.obs.where("wind_gust >= 10"), ["loc_id"], "wind_dir").withColumn("share", r6("share"))


@query("gust_class_profile", "D15", sql("v_obs", """
a AS (SELECT FLOOR(wind_gust / 5) * 5 AS gust_class, wind_dir, is_sta FROM v_obs WHERE wind_gust IS NOT NULL),
l AS (SELECT QUANTILE_CONT(wind_dir, 0.3) AS lim FROM a WHERE is_sta = 1)
SELECT CAST(gust_class AS DOUBLE) AS gust_class, COUNT(*) AS n_all, CAST(SUM(CASE WHEN wind_dir >= lim THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
 ROUND(QUANTILE_CONT(wind_dir, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(wind_dir, 0.5), 6) AS q50, ROUND(QUANTILE_CONT(wind_dir, 0.75), 6) AS q75 FROM a, l GROUP BY 1"""))
def _(t):
    out = R.gust_class_profile(t.obs, "wind_gust", "wind_dir", F.col("is_sta") == 1, 0.3)
    return out.select("gust_class", "n_all", "n_high", *[r6(c).alias(c) for c in ("q25", "q50", "q75")])


KERNEL = ", ".join(f"({o}, {2.718281828459045 ** (-0.5 * o * o)!r})" for o in range(-4, 5))
HIST = """
s AS (SELECT MIN(ml_cape) x0, MAX(ml_cape) x1, MIN(s06) y0, MAX(s06) y1 FROM v_points),
b AS (SELECT CAST(LEAST(FLOOR((ml_cape - x0) / (x1 - x0) * 19), 18) AS INT) ix, CAST(LEAST(FLOOR((s06 - y0) / (y1 - y0) * 19), 18) AS INT) iy, t_totals, x0, x1, y0, y1 FROM v_points, s),
h AS (SELECT ix, iy, COUNT(*) AS n_all, CAST(SUM(CASE WHEN t_totals >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_event, MIN(x0 + (ix + 0.5) * (x1 - x0) / 19) AS x, MIN(y0 + (iy + 0.5) * (y1 - y0) / 19) AS y FROM b GROUP BY 1, 2)"""


@query("conditional_probability_grid", "D16", sql("v_points", HIST + """
SELECT ix, iy, n_all, n_event, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(n_event / CAST(n_all AS DOUBLE), 6) AS probability FROM h"""))
def _(t):
    h = R.histogram_2d(t.points, "ml_cape", "s06", 19, {"n_all": F.lit(True), "n_event": F.col("t_totals") >= 50})
    return h.select("ix", "iy", "n_all", "n_event", r6("x").alias("x"), r6("y").alias("y"), r6(F.col("n_event") / F.col("n_all")).alias("probability"))


@query("smoothed_density_grid", "D16", sql("v_points", HIST + f""",
k(o, w0) AS (VALUES {KERNEL}), k2 AS (SELECT o, w0 / (SELECT SUM(w0) FROM k) AS w FROM k),
t1 AS (SELECT t.t, k2.w, CASE WHEN t.t + o < 0 THEN -(t.t + o) - 1 WHEN t.t + o > 18 THEN 37 - (t.t + o) ELSE t.t + o END AS src FROM RANGE(19) t(t) CROSS JOIN k2),
a AS (SELECT t1.t AS ix, iy, SUM(w * n_event) AS e, SUM(w * n_all) AS a FROM t1 JOIN h ON h.ix = t1.src GROUP BY 1, 2),
b2 AS (SELECT ix, t1.t AS iy, SUM(w * e) AS e, SUM(w * a) AS a FROM t1 JOIN a ON a.iy = t1.src GROUP BY 1, 2)
SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, ROUND(e, 6) AS n_event, ROUND(a, 6) AS n_all FROM b2 WHERE a > 0.001"""))
def _(t):
    h = R.histogram_2d(t.points, "ml_cape", "s06", 19, {"n_all": F.lit(True), "n_event": F.col("t_totals") >= 50})
    out = h.select("ix", "iy", "n_all", "n_event")
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        out = R.gaussian_smooth(out, axis, [other], ["n_all", "n_event"], 19)
    return out.where("n_all > 0.001").select("ix", "iy", r6("n_event").alias("n_event"), r6("n_all").alias("n_all"))


@query("event_spatial_extent", "D17", sql("v_field", """
c AS (SELECT time, SUM(CASE WHEN v >= 48 THEN 1 ELSE 0 END) a, SUM(CASE WHEN v <= 3 THEN 1 ELSE 0 END) b FROM v_field GROUP BY 1)
SELECT time, CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, CASE WHEN a > 0 THEN 1 ELSE 0 END AS any_a, CASE WHEN b > 0 THEN 1 ELSE 0 END AS any_b, CAST(CASE WHEN a > 0 AND b > 0 THEN a + b ELSE 0 END AS BIGINT) AS n_both FROM c"""))
def _(t):
    return R.spatial_extent(t.field, ["time"], F.col("v") >= 48, F.col("v") <= 3)


@query("rain_interval_sums", "D18", sql("v_points", """
s AS (SELECT loc_id, make_timestamp(CAST(CEIL(epoch(time) / 21600) * 21600 * 1000000 AS BIGINT)) AS time, SUM(s06) AS rain FROM v_points GROUP BY 1, 2)
SELECT loc_id, time, rain FROM s WHERE time > (SELECT MIN(time) FROM s b WHERE b.loc_id = s.loc_id)"""))
def _(t):
    return R.interval_sums(t.points.select("loc_id", "time", F.col("s06").alias("rain")), ["loc_id"], "time", "rain", 6)


@query("ensemble_period_mean", "D19", sql("v_field", """
m AS (SELECT i, j, model, AVG(CASE WHEN v <> 7 THEN v END) AS v FROM v_field GROUP BY 1, 2, 3)
SELECT i, j, ROUND(AVG(v), 6) AS v, COUNT(v) AS models FROM m GROUP BY 1, 2"""))
def _(t):
    rows = t.field.withColumn("v", F.when(F.col("v") == 7, F.lit(float("inf"))).otherwise(F.col("v")))
    return R.ensemble_period_mean(rows, ["i", "j"], "model", "v").withColumn("v", r6("v"))


@query("station_event_rate", "D20,B4", sql("v_obs", """
SELECT loc_id, CAST(SUM(CASE WHEN lightning >= 2 AND wind_gust >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS events,
 ROUND(SUM(CASE WHEN lightning >= 2 AND wind_gust >= 25 THEN 1 ELSE 0 END) / (COUNT(wind_gust) / 365E0), 6) AS per_year FROM v_obs GROUP BY 1"""))
def _(t):
    return R.station_event_rate(t.obs, "loc_id", "wind_gust", C.event_label()).withColumn("per_year", r6("per_year"))


@query("quartile_conditioned_density", "D16", sql("v_points", """
s AS (SELECT MIN(ml_cape) x0, MAX(ml_cape) x1, MIN(s06) y0, MAX(s06) y1, QUANTILE_CONT(dcape, 0.25) q1, QUANTILE_CONT(dcape, 0.5) q2, QUANTILE_CONT(dcape, 0.75) q3 FROM v_points),
b AS (SELECT CAST(LEAST(FLOOR((ml_cape - x0) / (x1 - x0) * 12), 11) AS INT) ix, CAST(LEAST(FLOOR((s06 - y0) / (y1 - y0) * 12), 11) AS INT) iy, CASE WHEN dcape <= q1 THEN 1 WHEN dcape <= q2 THEN 2 WHEN dcape <= q3 THEN 3 ELSE 4 END AS c FROM v_points, s)
SELECT ix, iy, COUNT(CASE WHEN c = 1 THEN 1 END) AS n1, COUNT(CASE WHEN c = 2 THEN 1 END) AS n2, COUNT(CASE WHEN c = 3 THEN 1 END) AS n3, COUNT(CASE WHEN c = 4 THEN 1 END) AS n4 FROM b GROUP BY 1, 2"""))
def _(t):
    return R.quartile_panels(t.points, "ml_cape", "s06", "dcape", 12).drop("x", "y")


@query("gust_parameter_means_by_month", "D15,D12", sql("v_obs v_points", """
a AS (SELECT o.loc_id % 5 AS grp, MONTH(o.gust_time) AS month, HOUR(o.gust_time) AS hour, m.ml_cape / 0.7E0 AS ml_cape, CASE WHEN o.wind_gust >= 15 THEN 1 ELSE 0 END AS strong FROM v_obs o JOIN v_points m ON o.loc_id = m.loc_id AND m.time = o.hour_floor)
SELECT CAST(grp AS INT) AS grp, CAST(month AS INT) AS month, CAST(hour AS INT) AS hour, COUNT(*) AS n, CAST(SUM(strong) AS BIGINT) AS n_strong, ROUND(AVG(ml_cape), 6) AS mean_cape, ROUND(AVG(CASE WHEN strong = 1 THEN ml_cape END), 6) AS strong_cape FROM a GROUP BY 1, 2, 3"""))
def _(t):
    from squallframe.operators.joins import align_to_model

    # the factor keeps means off exact rounding ties, which float sums would decide by chance
    ev = align_to_model(t.obs, t.points, "loc_id", "gust_time", ["ml_cape"]).withColumn("ml_cape", F.col("ml_cape") / 0.7)
    strong = F.coalesce(F.col("wind_gust") >= 15, F.lit(False))
    return ev.groupBy((F.col("loc_id") % 5).alias("grp"), F.month("gust_time").alias("month"), F.hour("gust_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(strong.cast("int")).alias("n_strong"), r6(F.avg("ml_cape")).alias("mean_cape"),
        r6(F.avg(F.when(strong, F.col("ml_cape")))).alias("strong_cape"),
    )
