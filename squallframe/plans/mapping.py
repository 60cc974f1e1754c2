"""Distribution mapping and return level queries (M)."""
from pyspark.sql import functions as F

from squallframe.operators import mapping as M
from squallframe.plans.registry import query, r6, sql
from squallframe.session import settle

CELL = ["i", "j", "month"]


def _hist(t):
    return t.field.withColumn("month", F.month("time")).select("model", "experiment", *CELL, "time", "v")


def curve_sql(src, keys, name):
    """CTE of distinct values with p, left p, and the next knot."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    group = f"{k}, v" if keys else "v"
    sel = f"{k}, " if keys else ""
    return f"""{name}0 AS (SELECT {sel}v AS x, COUNT(*) AS n FROM {src} GROUP BY {group}),
{name}1 AS (SELECT {sel}x, SUM(n) OVER ({part} ORDER BY x) / CAST(SUM(n) OVER ({part}) AS DOUBLE) AS p, (SUM(n) OVER ({part} ORDER BY x) - n + 1) / CAST(SUM(n) OVER ({part}) AS DOUBLE) AS pl FROM {name}0),
{name} AS (SELECT *, LEAD(x) OVER w AS xn, LEAD(pl) OVER w AS pn, FIRST_VALUE(pl) OVER w AS p0, FIRST_VALUE(x) OVER w AS x0 FROM {name}1 WINDOW w AS ({part} ORDER BY x))"""


MAP_CELL = f"""
f AS (SELECT model, experiment, i, j, CAST(MONTH(time) AS INT) AS month, time, v FROM v_field),
ob AS (SELECT * FROM f WHERE model = 1 AND experiment = 'historical'), hi AS (SELECT * FROM f WHERE model <> 1 AND experiment = 'historical'),
{curve_sql('hi', ['model', 'i', 'j', 'month'], 'mc')}, {curve_sql('ob', ['i', 'j', 'month'], 'oc')},
o2 AS (SELECT i, j, month, pl AS p, x, LEAD(pl) OVER w AS pn, LEAD(x) OVER w AS xn, FIRST_VALUE(x) OVER w AS x0 FROM oc1 WINDOW w AS (PARTITION BY i, j, month ORDER BY pl)),
fl AS (SELECT model, i, j, month, MIN(pl) AS p0, MIN(x) AS x0 FROM mc1 GROUP BY ALL), ol AS (SELECT i, j, month, MIN(x) AS x0 FROM oc1 GROUP BY ALL),
q AS (SELECT model, experiment, i, j, month, time, v FROM f WHERE model <> 1),
a AS (SELECT q.*, CASE WHEN q.v < fl.x0 THEN fl.p0 WHEN mc.xn IS NULL OR mc.x = q.v THEN mc.p ELSE mc.p + (mc.pn - mc.p) / (mc.xn - mc.x) * (q.v - mc.x) END AS pr
 FROM q LEFT JOIN fl USING (model, i, j, month) ASOF LEFT JOIN mc ON q.model = mc.model AND q.i = mc.i AND q.j = mc.j AND q.month = mc.month AND q.v >= mc.x)
SELECT a.model, a.experiment, a.i, a.j, a.time, a.v, ROUND(CASE WHEN a.v = {{zero}} THEN {{zero}} WHEN a.pr IS NULL THEN NULL WHEN o2.p IS NULL THEN ol.x0 WHEN o2.pn IS NULL OR o2.p = a.pr THEN o2.x ELSE o2.x + (o2.xn - o2.x) / (o2.pn - o2.p) * (a.pr - o2.p) END, 6) AS mapped
FROM a LEFT JOIN ol USING (i, j, month) ASOF LEFT JOIN o2 ON a.i = o2.i AND a.j = o2.j AND a.month = o2.month AND a.pr >= o2.p"""


@query("quantile_map_by_cell_and_month", "M1,M3,G5", sql("v_field", MAP_CELL.format(zero="0E0")))
def _(t):
    f = _hist(t)
    hist = F.col("experiment") == "historical"
    observed = f.where((F.col("model") == 1) & hist)
    models = f.where(F.col("model") != 1)
    # a cell's month hardly repeats a value, so every row is looked up
    out = M.quantile_map(models, models.where(hist), observed, ["model", *CELL], CELL, "v", unique=True)
    return out.select("model", "experiment", "i", "j", "time", "v", r6("mapped").alias("mapped"))


POOL = f"""
f AS (SELECT model, experiment, i, j, time, v FROM v_field), ob AS (SELECT v FROM f WHERE model = 1 AND experiment = 'historical'), hi AS (SELECT model, v FROM f WHERE model <> 1),
{curve_sql('hi', ['model'], 'mc')},
o1 AS (SELECT ROW_NUMBER() OVER (ORDER BY v) / CAST(COUNT(*) OVER () AS DOUBLE) AS p, v AS x FROM ob),
o2 AS (SELECT p, x, LEAD(p) OVER w AS pn, LEAD(x) OVER w AS xn FROM o1 WINDOW w AS (ORDER BY p)),
q AS (SELECT DISTINCT model, experiment, v FROM f WHERE model <> 1),
a AS (SELECT q.*, mc.p AS pr FROM q JOIN mc ON q.model = mc.model AND q.v = mc.x)
SELECT a.model, a.experiment, a.v, ROUND(CASE WHEN o2.p IS NULL THEN (SELECT MIN(v) FROM ob) WHEN o2.pn IS NULL OR o2.p = a.pr THEN o2.x ELSE o2.x + (o2.xn - o2.x) / (o2.pn - o2.p) * (a.pr - o2.p) END, 6) AS mapped
FROM a ASOF LEFT JOIN o2 ON a.pr >= o2.p"""


@query("quantile_map_pooled", "M2,G5", sql("v_field", POOL))
def _(t):
    f = _hist(t)
    model = f.where("model <> 1")
    observed = f.where("model = 1 AND experiment = 'historical'")
    asked = model.select("model", "experiment", "v").distinct()
    out = M.quantile_map(asked, model, observed, ["model"], [], "v", keep_zero=False, pooled=True, unique=True)
    return out.select("model", "experiment", "v", r6("mapped").alias("mapped"))




@query("quantile_map_zero_preservation", "M3", sql("v_field", """
f AS (SELECT model, i, CASE WHEN v < 10 THEN 0E0 ELSE v END AS v FROM v_field), ob AS (SELECT i, v FROM f WHERE model = 1), hi AS (SELECT model, i, v FROM f WHERE model <> 1),
""" + curve_sql("hi", ["model", "i"], "mc") + ", " + curve_sql("ob", ["i"], "oc") + """,
o2 AS (SELECT i, pl AS p, x, LEAD(pl) OVER w AS pn, LEAD(x) OVER w AS xn FROM oc1 WINDOW w AS (PARTITION BY i ORDER BY pl)),
a AS (SELECT DISTINCT hi.model, hi.i, hi.v, mc.p AS pr FROM hi JOIN mc ON hi.model = mc.model AND hi.i = mc.i AND hi.v = mc.x)
SELECT a.model, a.i, a.v, ROUND(CASE WHEN a.v = 0 THEN 0 WHEN o2.pn IS NULL OR o2.p = a.pr THEN o2.x ELSE o2.x + (o2.xn - o2.x) / (o2.pn - o2.p) * (a.pr - o2.p) END, 6) AS mapped FROM a ASOF JOIN o2 ON a.i = o2.i AND a.pr >= o2.p"""))
def _(t):
    f = t.field.select("model", "i", F.when(F.col("v") < 10, 0.0).otherwise(F.col("v")).alias("v"))
    model, observed = f.where("model <> 1"), f.where("model = 1")
    out = M.quantile_map(model.select("model", "i", "v").distinct(), model, observed, ["model", "i"], ["i"], "v", unique=True)
    return out.select("model", "i", "v", r6("mapped").alias("mapped"))


@query("station_gust_quantile_match", "M4", sql("v_obs v_points", """
c AS (SELECT o.event_id, o.wind_gust AS obs, m.umean06 AS v FROM v_obs o JOIN v_points m ON o.loc_id = m.loc_id AND m.time = o.hour_floor WHERE o.wind_gust IS NOT NULL),
p AS (SELECT event_id, CUME_DIST() OVER (ORDER BY v) AS pr FROM c), o1 AS (SELECT ROW_NUMBER() OVER (ORDER BY obs) / CAST(COUNT(*) OVER () AS DOUBLE) AS p, obs AS x FROM c),
o2 AS (SELECT p, x, LEAD(p) OVER w AS pn, LEAD(x) OVER w AS xn FROM o1 WINDOW w AS (ORDER BY p))
SELECT event_id, ROUND(CASE WHEN o2.pn IS NULL OR o2.p = pr THEN o2.x ELSE o2.x + (o2.xn - o2.x) / (o2.pn - o2.p) * (pr - o2.p) END, 6) AS matched FROM p ASOF JOIN o2 ON pr >= o2.p"""))
def _(t):
    from squallframe.operators import joins as J

    pairs = settle(
        J.align_to_model(t.obs.where("wind_gust IS NOT NULL"), t.points, "loc_id", "gust_time", ["umean06"]).select("event_id", "wind_gust", "umean06")
    )
    rows = pairs.select("event_id", F.col("umean06").alias("v"))
    observed = pairs.select(F.col("wind_gust").alias("v"))
    out = M.quantile_map(rows, rows, observed, [], [], "v", "matched", keep_zero=False, pooled=True)
    return out.select("event_id", r6("matched").alias("matched"))


@query("station_distribution_check", "M5", sql("v_obs", """
q AS (SELECT loc_id, QUANTILE_CONT(wind_gust, 0.25) q25, QUANTILE_CONT(wind_gust, 0.5) q50, QUANTILE_CONT(wind_gust, 0.75) q75 FROM v_obs GROUP BY 1)
SELECT loc_id, ROUND(ANY_VALUE(q25), 6) AS q25, ROUND(ANY_VALUE(q50), 6) AS q50, ROUND(ANY_VALUE(q75), 6) AS q75, MIN(CASE WHEN wind_gust >= q25 - 1.5 * (q75 - q25) THEN wind_gust END) AS whisker_low,
 MAX(CASE WHEN wind_gust <= q75 + 1.5 * (q75 - q25) THEN wind_gust END) AS whisker_high, CAST(SUM(CASE WHEN wind_gust < q25 - 1.5 * (q75 - q25) OR wind_gust > q75 + 1.5 * (q75 - q25) THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
 CAST(SUM(CASE WHEN wind_gust >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_above FROM v_obs JOIN q USING (loc_id) WHERE wind_gust IS NOT NULL GROUP BY 1"""))
def _(t):
    out = M.box_statistics(t.obs.where("wind_gust IS NOT NULL"), ["loc_id"], "wind_gust", 20.0)
    return out.withColumns({c: r6(c) for c in ("q25", "q50", "q75")})


def _ret_sql(src, per_year, periods):
    return f"""{src},
r AS (SELECT i, j, ROW_NUMBER() OVER (PARTITION BY i, j ORDER BY v) / CAST(COUNT(*) OVER (PARTITION BY i, j) AS DOUBLE) AS p, v AS x FROM s),
k AS (SELECT i, j, 1.0 / (1.0 - p) / {per_year} AS T, x FROM r WHERE p < 1),
k2 AS (SELECT *, LEAD(T) OVER w AS tn, LEAD(x) OVER w AS xn FROM k WINDOW w AS (PARTITION BY i, j ORDER BY T)),
m AS (SELECT i, j, MAX(v) AS vmax, MIN(v) AS vmin FROM s GROUP BY 1, 2), l AS (SELECT i, j, MAX(T) AS last FROM k GROUP BY 1, 2),
q AS (SELECT m.*, l.last, t.T AS period FROM m LEFT JOIN l USING (i, j) CROSS JOIN (VALUES {', '.join(f'({p}E0)' for p in periods)}) t(T))
SELECT q.i, q.j, q.period AS "T", ROUND(CASE WHEN q.period > q.last THEN q.vmax WHEN k2.T IS NULL THEN q.vmin WHEN k2.tn IS NULL OR k2.T = q.period THEN k2.x ELSE k2.x + (k2.xn - k2.x) / (k2.tn - k2.T) * (q.period - k2.T) END, 5) AS level
FROM q ASOF LEFT JOIN k2 ON q.i = k2.i AND q.j = k2.j AND q.period >= k2.T"""


@query("empirical_return_levels", "M6", sql("v_field", _ret_sql("s AS (SELECT i, j, CAST(time AS DATE) AS day, AVG(v) AS v FROM v_field GROUP BY 1, 2, 3)", 365.25, [0.5, 2, 5, 10])))
def _(t):
    days = t.field.groupBy("i", "j", F.to_date("time").alias("day")).agg(F.avg("v").alias("v"))
    out = M.empirical_return_levels(days, ["i", "j"], "v", [0.5, 2, 5, 10])
    return out.select("i", "j", "T", r6("level", 5).alias("level"))


ANNUAL = "s AS (SELECT model, i, j, YEAR(time) AS year, AVG(v) + MAX(v) / 10 AS v FROM v_field GROUP BY 1, 2, 3, 4)"


def _annual(t):
    return t.field.groupBy("model", "i", "j", F.year("time").alias("year")).agg((F.avg("v") + F.max("v") / 10).alias("v"))


@query("annual_maximum_return_levels", "M6", sql("v_field", _ret_sql(ANNUAL, 1, [2, 5, 10, 20])))
def _(t):
    out = M.empirical_return_levels(_annual(t), ["i", "j"], "v", [2, 5, 10, 20], 1.0)
    return out.select("i", "j", "T", r6("level", 5).alias("level"))


LMOM = f"""{ANNUAL},
r AS (SELECT i, j, v AS x, ROW_NUMBER() OVER (PARTITION BY i, j ORDER BY v) AS k, COUNT(*) OVER (PARTITION BY i, j) AS n FROM s),
b AS (SELECT i, j, ANY_VALUE(n) AS n, AVG(x) b0, AVG(x * (k - 1) / (n - 1)) b1, AVG(x * (k - 1) * (k - 2) / ((n - 1) * (n - 2))) b2 FROM r GROUP BY 1, 2),
l AS (SELECT i, j, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM b)"""
GEV = """c AS (SELECT *, 2 / (3 + {s}t3) - LN(2) / LN(3) AS c0 FROM l), k AS (SELECT *, 7.8590E0 * c0 + 2.9554E0 * c0 * c0 AS k FROM c),
g AS (SELECT *, l2 * k / ((1 - POW(2, -k)) * GAMMA(1 + k)) AS scale FROM k), h AS (SELECT *, {s}l1 - scale * (1 - GAMMA(1 + k)) / k AS loc FROM g)"""


@query("gev_fit_by_l_moments", "M7", sql("v_field", f"{LMOM}, {GEV.format(s='')} SELECT i, j, n, ROUND(k, 5) AS c, ROUND(loc, 5) AS loc, ROUND(scale, 5) AS scale, 0 AS fit_failed FROM h"))
def _(t):
    out = M.gev_by_l_moments(_annual(t), ["i", "j"], "v")
    return out.select("i", "j", "n", *[r6(c, 5).alias(c) for c in ("c", "loc", "scale")], "fit_failed")


@query("weibull_fit_by_l_moments", "M7", sql("v_field", f"""{LMOM}, {GEV.format(s='-')}
SELECT i, j, n, ROUND(CASE WHEN k > 0 THEN 1 / k END, 4) AS c, ROUND(CASE WHEN k > 0 THEN -loc - scale / k END, 4) AS loc, ROUND(CASE WHEN k > 0 THEN scale / k END, 4) AS scale, CASE WHEN k > 0 THEN 0 ELSE 1 END AS fit_failed FROM h"""))
def _(t):
    out = M.weibull_by_l_moments(_annual(t), ["i", "j"], "v")
    return out.select("i", "j", "n", *[r6(c, 4).alias(c) for c in ("c", "loc", "scale")], "fit_failed")


@query("gev_return_levels", "M8", sql("v_field", f"""{LMOM}, {GEV.format(s='')}
SELECT i, j, "T", ROUND(loc + scale / k * (1 - POW(-LN(1 - 1 / "T"), k)), 4) AS level FROM h CROSS JOIN (VALUES (2E0), (5E0), (20E0), (100E0)) t("T")"""))
def _(t):
    fit = M.gev_by_l_moments(_annual(t), ["i", "j"], "v").withColumn("T", F.explode(F.array(*[F.lit(x) for x in (2.0, 5.0, 20.0, 100.0)])))
    return fit.select("i", "j", "T", r6(M.gev_return_level("c", "loc", "scale", "T"), 4).alias("level"))


@query("gev_return_curve", "M8", sql("v_field", f"""{LMOM}, {GEV.format(s='')}
SELECT i, j, ROUND(POW(10, -1 + n2.i2 * (4E0 / 999)), 5) AS "T", ROUND(CASE WHEN POW(10, -1 + n2.i2 * (4E0 / 999)) > 1 THEN loc + scale / k * (1 - POW(-LN(1 - 1 / GREATEST(POW(10, -1 + n2.i2 * (4E0 / 999)), 1.0000001E0)), k)) END, 4) AS level
FROM h CROSS JOIN RANGE(1000) n2(i2)"""))
def _(t):
    fit = M.log_spaced(M.gev_by_l_moments(_annual(t), ["i", "j"], "v"), 0.1, 1000.0, 1000)
    return fit.select("i", "j", r6("T", 5).alias("T"), r6(M.gev_return_level("c", "loc", "scale", "T"), 4).alias("level"))


@query("weibull_return_levels", "M9", sql("v_field", f"""{LMOM}, {GEV.format(s='-')}
SELECT i, j, "T", ROUND(CASE WHEN k > 0 THEN -loc - scale / k + scale / k * POW(LN("T"), k) END, 4) AS level FROM h CROSS JOIN (VALUES (2E0), (5E0), (20E0), (100E0)) t("T")"""))
def _(t):
    fit = M.weibull_by_l_moments(_annual(t), ["i", "j"], "v").withColumn("T", F.explode(F.array(*[F.lit(x) for x in (2.0, 5.0, 20.0, 100.0)])))
    return fit.select("i", "j", "T", r6(M.weibull_return_level("c", "loc", "scale", "T"), 4).alias("level"))


@query("regional_return_curve", "M6,D17", sql("v_field", """
s AS (SELECT i % 2 AS region, CAST(time AS DATE) AS day, AVG(v) + MAX(v) / 7 AS v FROM v_field GROUP BY 1, 2),
c AS (SELECT region, v, CUME_DIST() OVER (PARTITION BY region ORDER BY v) AS p FROM s)
SELECT DISTINCT region, ROUND(1 / (1 - p) / 365.25, 6) AS "T", ROUND(v, 6) AS v FROM c WHERE p < 1"""))
def _(t):
    days = t.field.groupBy((F.col("i") % 2).alias("region"), F.to_date("time").alias("day")).agg((F.avg("v") + F.max("v") / 7).alias("v"))
    out = M.return_curve(days, ["region"], "v")
    return out.select("region", r6("T").alias("T"), r6("v").alias("v")).distinct()
