"""Join queries (C)."""
from pyspark.sql import functions as F

from squallframe.operators import joins as J
from squallframe.operators.ordered import interp_lookup
from squallframe.plans.registry import query, r6, sql
from squallframe.session import settle

PARAMS = ["t_totals", "ml_cape", "s06", "dcape", "umean06"]
HAVERSINE = """2 * 6373.0 * ATAN2(SQRT(POW(SIN((RADIANS({b}.lat) - RADIANS({a}.lat)) / 2), 2) + COS(RADIANS({a}.lat)) * COS(RADIANS({b}.lat)) * POW(SIN((RADIANS({b}.lon) - RADIANS({a}.lon)) / 2), 2)),
 SQRT(1 - (POW(SIN((RADIANS({b}.lat) - RADIANS({a}.lat)) / 2), 2) + COS(RADIANS({a}.lat)) * COS(RADIANS({b}.lat)) * POW(SIN((RADIANS({b}.lon) - RADIANS({a}.lon)) / 2), 2))))"""


def hav(a, b):
    return HAVERSINE.format(a=a, b=b)


def _align(mode, shift):
    hour = "date_trunc('hour', gust_time)" if mode != "ceil" else "date_trunc('hour', gust_time) + INTERVAL 1 HOUR"
    return sql("v_obs v_points", f"""
a AS (SELECT *, {hour} + INTERVAL ({shift}) HOUR AS h FROM v_obs)
SELECT a.event_id, a.h AS model_time, a.wind_gust, m.t_totals, m.ml_cape, m.s06 FROM a JOIN v_points m ON a.loc_id = m.loc_id AND a.h = m.time""")


for _mode, _shift in (("floor", 0), ("floor2", -1), ("ceil", 0)):

    @query(f"event_model_alignment_{_mode}", "C1", _align(_mode, _shift))
    def _(t, mode=_mode):
        out = J.align_to_model(t.obs, t.points, "loc_id", "gust_time", PARAMS, mode)
        return out.select("event_id", "model_time", "wind_gust", "t_totals", "ml_cape", "s06")


def _cells(t):
    return t.field.select("i", "j", "lat", "lon").distinct()


@query("nearest_land_cell", "C2,A10", sql("v_station v_field", """
g AS (SELECT DISTINCT i, j, lat, lon FROM v_field WHERE (i * 5 + j) % 3 > 0),
d AS (SELECT loc_id, i, j, SQRT(POW(g.lat - s.lat, 2) + POW(g.lon - s.lon, 2)) AS degrees FROM v_station s CROSS JOIN g)
SELECT loc_id, i, j, ROUND(degrees, 6) AS degrees FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY loc_id ORDER BY degrees, i, j) = 1"""))
def _(t):
    land = _cells(t).where("(i * 5 + j) % 3 > 0")
    return J.nearest_cells(t.station, land, "loc_id").withColumn("degrees", r6("degrees"))


@query("station_point_extraction", "A10,C2", sql("v_station v_field", """
g AS (SELECT DISTINCT i, j, lat, lon FROM v_field),
d AS (SELECT loc_id, i, j FROM v_station s CROSS JOIN g QUALIFY ROW_NUMBER() OVER (PARTITION BY loc_id ORDER BY SQRT(POW(g.lat - s.lat, 2) + POW(g.lon - s.lon, 2)), i, j) = 1)
SELECT loc_id, model, COUNT(*) AS n, MAX(v) AS v_max, ROUND(AVG(v), 6) AS v_mean FROM d JOIN v_field USING (i, j) GROUP BY 1, 2"""))
def _(t):
    near = J.nearest_cells(t.station, _cells(t), "loc_id").select("loc_id", "i", "j")
    points = t.field.join(near, ["i", "j"])
    return points.groupBy("loc_id", "model").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v_max"), r6(F.avg("v")).alias("v_mean"))


@query("radius_reduction", "C3,A7,H5", sql("v_station v_field", f"""
g AS (SELECT DISTINCT i, j, lat, lon FROM v_field),
p AS (SELECT loc_id, i, j FROM v_station s CROSS JOIN g WHERE {hav('s', 'g')} < 600)
SELECT loc_id, time, MAX(v) AS v_max, ROUND(AVG(v), 6) AS v_mean, ROUND(SUM(v), 6) AS v_sum FROM p JOIN v_field USING (i, j) GROUP BY 1, 2"""))
def _(t):
    pairs = J.near_pairs(t.station, _cells(t), 600.0)
    out = J.radius_reduce(pairs, t.field, ["i", "j"], "loc_id", "time", ["v"])
    return out.select("loc_id", "time", "v_max", r6("v_mean").alias("v_mean"), r6("v_sum").alias("v_sum"))


@query("cyclone_proximity_days", "C4", sql("v_station v_track", f"""
SELECT DISTINCT s.loc_id, CAST(k.time AS DATE) AS date FROM v_station s JOIN v_track k ON {hav('s', 'k')} < 500"""))
def _(t):
    return J.storm_days(t.station, t.track, "loc_id", 500.0)


@query("cyclone_affected_flag", "C4", sql("v_obs v_station v_track", f"""
d AS (SELECT DISTINCT s.loc_id, CAST(k.time AS DATE) AS date FROM v_station s JOIN v_track k ON {hav('s', 'k')} < 500)
SELECT o.event_id, CASE WHEN d.loc_id IS NULL THEN 0 ELSE 1 END AS near_storm FROM v_obs o LEFT JOIN d ON d.loc_id = o.loc_id AND d.date = CAST(CAST(o.gust_time AS DATE) - INTERVAL 26 YEAR AS DATE)"""))
def _(t):
    days = J.storm_days(t.station, t.track, "loc_id", 500.0)
    obs = t.obs.withColumn("date", F.add_months(F.to_date("gust_time"), -312))
    return J.flag_days(obs, days, "loc_id", "date", "near_storm").select("event_id", "near_storm")


@query("storm_report_attachment", "C5", sql("v_obs v_station", f"""
r AS (SELECT event_id AS wind_id, CAST(gust_time AS DATE) AS d, -44 + event_id % 35 + 0.3 AS lat, 112 + ((event_id % 35) * 13) % 44 + 0.2 AS lon, wind_gust AS w FROM v_obs WHERE is_sta = 1),
p AS (SELECT s.loc_id, r.d, r.wind_id, r.w FROM r JOIN v_station s ON {hav('s', 'r')} <= 50),
b AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY loc_id, d ORDER BY w DESC NULLS LAST, wind_id DESC) = 1),
f AS (SELECT event_id, loc_id, CAST(gust_time AS DATE) AS d, MIN(event_id) OVER (PARTITION BY loc_id, CAST(gust_time AS DATE)) AS first FROM v_obs)
SELECT f.event_id, b.wind_id, b.w AS sta_wind, CASE WHEN b.wind_id IS NOT NULL AND f.event_id = f.first THEN 1 ELSE 0 END AS is_sta FROM f LEFT JOIN b ON f.loc_id = b.loc_id AND f.d = b.d"""))
def _(t):
    site = F.col("event_id") % 35
    reports = t.obs.where("is_sta = 1").select(
        F.col("event_id").alias("wind_id"), F.to_date("gust_time").alias("sta_daily_date"),
        (site - 44 + 0.3).alias("lat"), (112 + (site * 13) % 44 + 0.2).alias("lon"), F.col("wind_gust").alias("sta_wind"),
    )
    best = J.strongest_reports(t.station, reports, "loc_id", 50.0)
    obs = t.obs.select("event_id", "loc_id", F.to_date("gust_time").alias("day"))
    return J.attach_reports(obs, best, "loc_id", "day", "event_id").select("event_id", "wind_id", "sta_wind", "is_sta")


@query("outer_source_alignment", "C6", sql("v_points v_obs", """
a AS (SELECT loc_id, time, t_totals FROM v_points WHERE t_totals > 40), b AS (SELECT loc_id, hour_floor AS time, MAX(wind_gust) AS gust FROM v_obs WHERE lightning > 1 GROUP BY 1, 2)
SELECT loc_id, time, t_totals, gust FROM a FULL JOIN b USING (loc_id, time)"""))
def _(t):
    a = t.points.where("t_totals > 40").select("loc_id", "time", "t_totals")
    b = t.obs.where("lightning > 1").groupBy("loc_id", F.col("hour_floor").alias("time")).agg(F.max("wind_gust").alias("gust"))
    return J.outer_align([a, b], ["loc_id", "time"])


@query("multi_source_inner_join", "C7", sql("v_field", """
d AS (SELECT model, i, j, time, MAX(v) AS v FROM v_field GROUP BY 1, 2, 3, 4)
SELECT a.i, a.j, a.time, a.v AS v_a, b.v AS v_b, c.v AS v_c FROM d a JOIN d b USING (i, j, time) JOIN d c USING (i, j, time) WHERE a.model = 1 AND b.model = 2 AND c.model = 3"""))
def _(t):
    daily = t.field.groupBy("model", "i", "j", "time").agg(F.max("v").alias("v"))
    one = lambda m: daily.where(F.col("model") == m).drop("model")
    return J.inner_sources({"a": one(1), "b": one(2), "c": one(3)}, ["i", "j", "time"])


@query("common_time_intersection", "C8,G2", sql("v_field", """
SELECT DISTINCT time FROM v_field WHERE model = 5 AND time IN (SELECT time FROM v_field WHERE model = 6) AND time IN (SELECT time FROM v_field WHERE model = 7)"""))
def _(t):
    return J.common_times([t.field.where(F.col("model") == m) for m in (5, 6, 7)])


@query("phase_day_subset", "C9", sql("v_field v_track", """
p AS (SELECT CAST(time AS DATE) AS day FROM v_track GROUP BY 1 HAVING MIN(fix_id) % 8 IN (4, 5, 6, 7))
SELECT model, COUNT(*) AS n, SUM(v) AS v_sum FROM v_field WHERE CAST(time AS DATE) IN (SELECT day FROM p) GROUP BY 1"""))
def _(t):
    days = t.track.groupBy(F.to_date("time").alias("day")).agg(F.min("fix_id").alias("f")).where("f % 8 IN (4, 5, 6, 7)").select("day")
    rows = J.on_listed_days(t.field.withColumn("day", F.to_date("time")), days, "day")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v_sum"))


@query("sorted_curve_lookup", "C11", sql("v_points v_obs", """
k AS (SELECT CAST(loc_id AS INT) AS loc_id, ROUND(wind_gust, 1) AS xp, AVG(wind_dir) AS fp FROM v_obs WHERE wind_gust IS NOT NULL GROUP BY 1, 2),
c AS (SELECT loc_id, xp, fp, LEAD(xp) OVER w AS xn, LEAD(fp) OVER w AS fn FROM k WINDOW w AS (PARTITION BY loc_id ORDER BY xp)),
q AS (SELECT loc_id, time, umean06 AS x FROM v_points),
m AS (SELECT loc_id, ARG_MIN(fp, xp) AS f0, MIN(xp) AS x0 FROM k GROUP BY 1)
SELECT q.loc_id, q.time, ROUND(CASE WHEN q.x < m.x0 THEN m.f0 WHEN c.xn IS NULL OR c.xp = q.x THEN c.fp ELSE c.fp + (c.fn - c.fp) / (c.xn - c.xp) * (q.x - c.xp) END, 6) AS f
FROM q JOIN m ON q.loc_id = m.loc_id ASOF LEFT JOIN c ON q.loc_id = c.loc_id AND q.x >= c.xp"""))
def _(t):
    knots = t.obs.where("wind_gust IS NOT NULL").groupBy("loc_id", F.round("wind_gust", 1).alias("xp")).agg(F.avg("wind_dir").alias("fp"))
    asked = t.points.select("loc_id", "time", F.col("umean06").alias("x"))
    out = interp_lookup(asked, settle(knots), ["loc_id"], "x", "xp", "fp", "f")
    return out.select("loc_id", "time", r6("f").alias("f"))


@query("threshold_combinations", "C12", sql("v_points", """
a AS (SELECT * FROM (VALUES (40.0), (45.0), (50.0)) t1(tt_min) CROSS JOIN (VALUES (10.0), (20.0)) t2(s06_min))
SELECT CAST(tt_min AS DOUBLE) AS tt_min, CAST(s06_min AS DOUBLE) AS s06_min, COUNT(*) AS n FROM v_points, a WHERE t_totals >= tt_min AND s06 >= s06_min GROUP BY 1, 2"""))
def _(t):
    # rows collapse to distinct value pairs before they are repeated per combination
    pairs = t.points.groupBy("t_totals", "s06").agg(F.count(F.lit(1)).alias("k"))
    grid = J.combinations(pairs, {"tt_min": [40.0, 45.0, 50.0], "s06_min": [10.0, 20.0]})
    return grid.where("t_totals >= tt_min AND s06 >= s06_min").groupBy("tt_min", "s06_min").agg(F.sum("k").alias("n"))


def _env_sql(unit):
    return sql("v_points v_obs", f"""
f AS (SELECT DISTINCT loc_id, {unit.format('gust_time')} AS u FROM v_obs WHERE lightning >= 3),
r AS (SELECT p.loc_id, p.time, p.ml_cape / 0.7E0 AS ml_cape, p.s06, HOUR(time) AS h, MONTH(time) AS m FROM v_points p SEMI JOIN f ON p.loc_id = f.loc_id AND {unit.format('p.time')} = f.u)
SELECT loc_id, 'hour' AS kind, CAST(h AS INT) AS slot, COUNT(*) AS n, ROUND(AVG(ml_cape), 6) AS ml_cape, ROUND(AVG(s06), 6) AS s06 FROM r GROUP BY 1, 2, 3
UNION ALL SELECT loc_id, 'month', CAST(m AS INT), COUNT(*), ROUND(AVG(ml_cape), 6), ROUND(AVG(s06), 6) FROM r GROUP BY 1, 2, 3""")


def _env(t):
    # the factor keeps means off exact rounding ties, which float sums would decide by chance
    return t.points.withColumn("ml_cape", F.col("ml_cape") / 0.7)


@query("flagged_hour_environment", "C13", _env_sql("date_trunc('hour', {})"))
def _(t):
    out = J.environment_means(_env(t), t.obs.where("lightning >= 3"), "loc_id", "time", "gust_time", ["ml_cape", "s06"])
    return out.select("loc_id", "kind", "slot", "n", r6("ml_cape").alias("ml_cape"), r6("s06").alias("s06"))


@query("flagged_day_environment", "C13", _env_sql("CAST({} AS DATE)"))
def _(t):
    out = J.environment_means(_env(t), t.obs.where("lightning >= 3"), "loc_id", "time", "gust_time", ["ml_cape", "s06"], True)
    return out.select("loc_id", "kind", "slot", "n", r6("ml_cape").alias("ml_cape"), r6("s06").alias("s06"))
