"""Grid, region and ensemble queries (O)."""
from pyspark.sql import functions as F

from squallframe.operators import profile as P
from squallframe.operators import space as O
from squallframe.operators import trends as N
from squallframe.operators.resample import daily
from squallframe.plans.registry import query, r6, sql


def _monthly(t):
    """One row per model, month and cell."""
    return t.field.groupBy("model", F.month("time").alias("month"), "i", "j", "lat", "lon").agg(F.avg("v").alias("v"))


MONTHLY = "mm AS (SELECT model, CAST(MONTH(time) AS INT) AS month, i, j, lat, lon, AVG(v) AS v FROM v_field GROUP BY 1, 2, 3, 4, 5, 6)"
# the target grid: cell centres between the source cells, some outside
TARGET = "tg AS (SELECT -40.5E0 + a.a AS lat, 114.6E0 + b.b * 0.8E0 AS lon FROM RANGE(10) a(a) CROSS JOIN RANGE(10) b(b))"


def _target(t):
    lats = t.spark.range(10).select((F.col("id") - 40.5).alias("lat"))
    return lats.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("lat", (F.lit(114.6) + F.col("b") * 0.8).alias("lon"))


@query("bilinear_regrid", "O1,C10", sql("v_field", f"""{MONTHLY}, {TARGET},
x AS (SELECT lat, lon, FLOOR((lat + 40) / 1.5) AS i0, FLOOR((lon - 115) / 1.5E0) AS j0, (lat + 40) / 1.5E0 - FLOOR((lat + 40) / 1.5E0) AS fy, (lon - 115) / 1.5E0 - FLOOR((lon - 115) / 1.5E0) AS fx FROM tg WHERE lat BETWEEN -40 AND -32.5 AND lon BETWEEN 115 AND 121),
g AS (SELECT lat, lon, i0 + di AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN dj = 1 THEN fx ELSE 1 - fx END) AS w FROM x CROSS JOIN RANGE(2) a(di) CROSS JOIN RANGE(2) b(dj)),
k AS (SELECT * FROM g WHERE w > 0), c AS (SELECT lat, lon, COUNT(*) AS n FROM k GROUP BY 1, 2),
r AS (SELECT model, month, k.lat, k.lon, SUM(w * v) AS v, COUNT(v) AS nv FROM k JOIN mm USING (i, j) GROUP BY 1, 2, 3, 4)
SELECT model, month, ROUND(r.lat, 6) AS lat, ROUND(r.lon, 6) AS lon, ROUND(CASE WHEN nv = c.n THEN v END, 5) AS v FROM r JOIN c ON r.lat = c.lat AND r.lon = c.lon"""))
def _(t):
    cube = _monthly(t).drop("i", "j")
    w = O.bilinear_weights(t.field.select("lat", "lon").distinct(), _target(t))
    out = O.regrid(cube, w, ["model", "month"], "v")
    return out.select("model", "month", r6("lat").alias("lat"), r6("lon").alias("lon"), r6("v", 5).alias("v"))


@query("coarsened_grid", "O2", sql("v_field", f"""{MONTHLY}
SELECT model, month, CAST(i // 2 AS INT) AS bi, CAST(j // 2 AS INT) AS bj, ROUND(AVG(v), 6) AS v FROM mm GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = 4"""))
def _(t):
    return O.coarsen(_monthly(t), ["model", "month"], "i", "j", "v", 2).withColumn("v", r6("v"))


# Two overlapping hand-made regions (lon, lat): a triangle and a rectangle.
REGIONS = {1: [(114.0, -41.0), (122.0, -41.0), (114.0, -33.0)], 2: [(117.0, -36.2), (121.5, -36.2), (121.5, -32.0), (117.0, -32.0)]}


def region_sql(name="rg"):
    edges = []
    for rid, pts in REGIONS.items():
        for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1]):
            edges.append(f"({rid}, {xa}E0, {ya}E0, {xb}E0, {yb}E0)")
    return f"""ed(region_id, x1, y1, x2, y2) AS (VALUES {', '.join(edges)}),
{name} AS (SELECT i, j, MAX(region_id) AS region_id FROM (SELECT i, j, region_id FROM (SELECT DISTINCT i, j, lat, lon FROM v_field) c JOIN ed ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1) GROUP BY 1, 2)"""


def _regions(t):
    return O.tag_regions(t.field.select("i", "j", "lat", "lon").distinct(), O.polygon_edges(t.spark, REGIONS), ["i", "j"])


@query("region_tagging", "O3", sql("v_field", region_sql() + " SELECT i, j, region_id FROM rg"))
def _(t):
    return _regions(t)


@query("regional_relative_change", "O4", sql("v_field", region_sql() + """,
g AS (SELECT region_id, model, MONTH(time) AS month, AVG(CASE WHEN experiment = 'historical' THEN v END) AS hist, AVG(CASE WHEN experiment = 'scenario' THEN v END) AS scen FROM v_field JOIN rg USING (i, j) GROUP BY 1, 2, 3)
SELECT region_id, model, CAST(month AS INT) AS month, ROUND(hist, 6) AS hist, ROUND(scen, 6) AS scen, ROUND((scen - hist) / hist * 100, 6) + 0E0 AS change FROM g"""))
def _(t):
    rows = t.field.join(_regions(t), ["i", "j"]).withColumn("month", F.month("time"))
    out = O.regional_change(rows, ["region_id", "model", "month"], "experiment", "v")
    return out.withColumns({c: r6(c) for c in ("hist", "scen", "change")})


@query("ensemble_change_agreement", "O5", sql("v_field", """
c AS (SELECT model, i, j, AVG(CASE WHEN experiment = 'scenario' THEN v END) - AVG(CASE WHEN experiment = 'historical' THEN v END) AS change FROM v_field GROUP BY 1, 2, 3),
m AS (SELECT i, j, MEDIAN(change) AS median, AVG(change) AS mean, SUM(CASE WHEN change > 0 THEN 1 ELSE 0 END) up, SUM(CASE WHEN change < 0 THEN 1 ELSE 0 END) dn FROM c GROUP BY 1, 2)
SELECT i, j, ROUND(median, 6) + 0E0 AS median, ROUND(mean, 6) + 0E0 AS mean, CASE WHEN (CASE WHEN median > 0 THEN up WHEN median < 0 THEN dn ELSE 0 END) >= 5 THEN 1 ELSE 0 END AS agreement FROM m"""))
def _(t):
    c = O.regional_change(t.field, ["model", "i", "j"], "experiment", "v", relative=False)
    out = N.ensemble_change(c, ["i", "j"], "change", 5)
    return out.withColumns({"median": r6("median"), "mean": r6("mean")})


@query("model_bias_maps", "O6", sql("v_field", """
m AS (SELECT model, i, j, AVG(v) AS mean FROM v_field GROUP BY 1, 2, 3)
SELECT a.model, a.i, a.j, ROUND(a.mean - b.mean, 6) + 0E0 AS bias, ROUND((a.mean - b.mean) / b.mean * 100, 6) + 0E0 AS relative FROM m a JOIN m b ON a.i = b.i AND a.j = b.j AND b.model = 1 WHERE a.model <> 1"""))
def _(t):
    out = O.model_bias(t.field, ["i", "j"], "model", 1, "v")
    return out.select("model", "i", "j", r6("bias").alias("bias"), r6("relative").alias("relative"))


@query("pattern_correlation", "O6", sql("v_field", """
m AS (SELECT model, i, j, AVG(v) AS mean FROM v_field GROUP BY 1, 2, 3)
SELECT a.model, ROUND(CORR(a.mean, b.mean), 6) + 0E0 AS r, ROUND(SQRT(AVG((a.mean - b.mean) * (a.mean - b.mean))), 6) AS rmse, COUNT(*) AS cells FROM m a JOIN m b ON a.i = b.i AND a.j = b.j AND b.model = 1 WHERE a.model <> 1 GROUP BY 1"""))
def _(t):
    out = O.pattern_correlation(O.model_bias(t.field, ["i", "j"], "model", 1, "v"), "model")
    return out.withColumns({"r": r6("r"), "rmse": r6("rmse")})


@query("threshold_days_by_model", "O6", sql("v_field", """
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, MAX(v) AS m FROM v_field GROUP BY 1, 2, 3, 4)
SELECT model, i, j, CAST(SUM(CASE WHEN m >= 45 THEN 1 ELSE 0 END) AS BIGINT) AS days FROM d GROUP BY 1, 2, 3"""))
def _(t):
    days = daily(t.field, ["model", "i", "j"], "time", {"m": F.max("v")})
    return days.groupBy("model", "i", "j").agg(F.sum((F.col("m") >= 45).cast("int")).alias("days"))


@query("scenario_model_selection", "O7,B11", sql("v_field", """
SELECT model, time, i, j, MIN(v) AS v, ARG_MIN(experiment, v) AS experiment FROM v_field WHERE model IN (2, 5) AND YEAR(time) BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3, 4"""))
def _(t):
    rows = t.field.select("model", "experiment", "i", "j", "time", "v")
    out = O.select_models(rows, "model", "time", [2, 5], 1996, 1999, ["v"], ["i", "j"])
    return out.select("model", "time", "i", "j", "v", "experiment")


@query("annual_cycle_change", "O8", sql("v_field", """
g AS (SELECT model, MONTH(time) AS month, AVG(CASE WHEN experiment = 'historical' THEN v END) AS hist, AVG(CASE WHEN experiment = 'scenario' THEN v END) AS scen FROM v_field WHERE (i * 5 + j) % 3 > 0 GROUP BY 1, 2)
SELECT model, CAST(month AS INT) AS month, ROUND(hist, 6) AS hist, ROUND(scen, 6) AS scen, ROUND(scen - hist, 6) + 0E0 AS change FROM g"""))
def _(t):
    out = O.annual_cycle_change(t.field.where("(i * 5 + j) % 3 > 0"), ["model"], "time", "experiment", "v")
    return out.withColumns({c: r6(c) for c in ("hist", "scen", "change")})


@query("case_window", "O9,B6", sql("v_field", """
SELECT model, time, lat, lon, v FROM v_field WHERE time BETWEEN TIMESTAMP '1997-03-01 00:00:00' AND TIMESTAMP '1997-04-15 00:00:00' AND lat BETWEEN -38 AND -34 AND lon BETWEEN 116 AND 120"""))
def _(t):
    out = O.case_window(t.field, "time", "1997-03-01", "1997-04-15", (-38, -34), (116, 120))
    return out.select("model", "time", "lat", "lon", "v")


@query("case_height_slice", "O9,I2", sql("v_levels", """
a AS (SELECT col_id, hgt AS z, ua, LEAD(hgt) OVER w AS z_up, LEAD(ua) OVER w AS ua_up, ROW_NUMBER() OVER w AS k FROM v_levels WINDOW w AS (PARTITION BY col_id ORDER BY p DESC))
SELECT col_id % 100 AS site, ROUND(AVG(u), 6) AS u, COUNT(u) AS n FROM (SELECT col_id, COALESCE(MAX(CASE WHEN z = 1100 THEN ua END), MAX(CASE WHEN k = 1 AND z >= 1100 THEN ua END), MAX(CASE WHEN z < 1100 AND z_up > 1100 THEN ua + (ua_up - ua) * (1100 - z) / (z_up - z) END)) AS u FROM a GROUP BY 1) GROUP BY 1"""))
def _(t):
    up = P.prepare(t.levels.select("col_id", "lev", "p", F.col("hgt").alias("z"), "ua"), ["col_id"], ["ua"])
    u = up.groupBy("col_id").agg(P.at_height("ua", 1100.0).alias("u"))
    return u.groupBy((F.col("col_id") % 100).alias("site")).agg(r6(F.avg("u")).alias("u"), F.count("u").alias("n"))


@query("experiment_concatenation", "G1,G5", sql("v_field", """
SELECT experiment, COUNT(*) AS n, SUM(v) AS v_sum FROM v_field GROUP BY 1"""))
def _(t):
    parts = [t.field.where(F.col("experiment") == e).drop("experiment").withColumn("experiment", F.lit(e)) for e in ("historical", "scenario")]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v_sum"))


@query("wide_to_long_gusts", "G4", sql("v_points", """
SELECT loc_id, time, 'g1' AS slot, umean06 AS gust FROM v_points UNION ALL SELECT loc_id, time, 'g2', s06 FROM v_points WHERE s06 >= 20 UNION ALL SELECT loc_id, time, 'g3', dcape FROM v_points WHERE dcape < 100"""))
def _(t):
    wide = t.points.select(
        "loc_id", "time", F.col("umean06").alias("g1"), F.when(F.col("s06") >= 20, F.col("s06")).alias("g2"), F.when(F.col("dcape") < 100, F.col("dcape")).alias("g3")
    )
    return wide.unpivot(["loc_id", "time"], ["g1", "g2", "g3"], "slot", "gust").where("gust IS NOT NULL")
