"""Trend, significance and correlation queries (N)."""
from pyspark.sql import functions as F

from squallframe.functions.draws import lot_sql, pick_sql
from squallframe.operators import trends as N
from squallframe.operators.resample import daily
from squallframe.plans.registry import query, r6, sql
from squallframe.plans.resample import PERIOD_VALUES, PHASES, _phases
from squallframe.sources.scans import oscillation_flags, seasonal_index

def draws_sql(label, reps, src):
    """(n, rep, pos, times) of the sample sizes in ``src``; ``label`` is a quoted text."""
    starts = f"(SELECT n, rep, {lot_sql(f"{label} || ':' || rep")} AS st FROM (SELECT DISTINCT n FROM {src}) CROSS JOIN RANGE({reps}) r(rep))"
    asked = f"(SELECT n, rep, st, UNNEST(RANGE(n)) AS k FROM {starts})"
    return f"SELECT n, rep, pos + 1 AS pos, COUNT(*) AS times FROM ({pick_sql(asked, 'st', 'k', 'n', 'pos', 'n, rep')}) GROUP BY 1, 2, 3"


def mean_test_ctes(src, keys, order, value, reps, seed="n1"):
    """CTEs ending in tst(keys, mean_a, mean_b, p); ``src`` has a ``half`` column."""
    k = ", ".join(keys)
    sides = []
    for s in "ab":
        sides.append(f"""nm{s} AS (SELECT {k}, {value} AS v, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY {order}) AS pos, COUNT(*) OVER (PARTITION BY {k}) AS n FROM {src} WHERE half = '{s}'),
dr{s} AS ({draws_sql(f"'{seed}-{s}'", reps, f'nm{s}')}),
rs{s} AS (SELECT {k}, rep, SUM(COALESCE(v, 0) * times) / NULLIF(SUM(CASE WHEN v IS NOT NULL THEN times ELSE 0 END), 0) AS r FROM nm{s} JOIN dr{s} USING (n, pos) GROUP BY {k}, rep)""")
    return f"""{', '.join(sides)},
bs AS (SELECT {k}, AVG(CASE WHEN half = 'a' THEN {value} END) AS mean_a, AVG(CASE WHEN half = 'b' THEN {value} END) AS mean_b FROM {src} GROUP BY {k}),
pp AS (SELECT {k}, AVG(CASE WHEN ROUND((rsb.r - mean_b) - (rsa.r - mean_a), 9) >= ROUND(mean_b - mean_a, 9) THEN 1E0 ELSE 0E0 END) AS up, AVG(CASE WHEN ROUND((rsb.r - mean_b) - (rsa.r - mean_a), 9) <= ROUND(mean_b - mean_a, 9) THEN 1E0 ELSE 0E0 END) AS low
 FROM rsa JOIN rsb USING ({k}, rep) JOIN bs USING ({k}) GROUP BY {k}),
tst AS (SELECT {k}, mean_a, mean_b, 2 * LEAST(up, low) AS p FROM bs LEFT JOIN pp USING ({k}))"""


def flag_test_ctes(src, keys, flag, reps, seed="n2"):
    """CTEs ending in ftst(keys, p): as ``mean_test_ctes`` for a 0/1 flag, whose ones own the first positions of their side."""
    k = ", ".join(keys)
    sides = []
    for s in "ab":
        starts = f"(SELECT n, rep, {lot_sql(f"'{seed}-{s}:' || rep")} AS st FROM (SELECT DISTINCT n FROM y{s}) CROSS JOIN RANGE({reps}) r(rep))"
        sides.append(f"""y{s} AS MATERIALIZED (SELECT {k}, COUNT(*) AS n, SUM({flag}) AS y FROM {src} WHERE half = '{s}' GROUP BY {k}),
p{s} AS MATERIALIZED ({pick_sql(f"(SELECT n, rep, st, UNNEST(RANGE(n)) AS k FROM {starts})", 'st', 'k', 'n', 'pos', 'n, rep')}),
q{s} AS MATERIALIZED (SELECT n, y, rep, SUM(CASE WHEN pos < y THEN 1E0 ELSE 0E0 END) / n AS r FROM (SELECT DISTINCT n, y FROM y{s}) JOIN p{s} USING (n) GROUP BY n, y, rep)""")
    up, low = (f"AVG(CASE WHEN ROUND((b.r - yb.y / yb.n::DOUBLE) - (a.r - ya.y / ya.n::DOUBLE), 9) {op} ROUND(yb.y / yb.n::DOUBLE - ya.y / ya.n::DOUBLE, 9) THEN 1E0 ELSE 0E0 END)" for op in (">=", "<="))
    return f"""{', '.join(sides)},
ftst AS (SELECT {k}, 2 * LEAST({up}, {low}) AS p FROM ya JOIN yb USING ({k}) JOIN qa a ON a.n = ya.n AND a.y = ya.y JOIN qb b ON b.n = yb.n AND b.y = yb.y AND b.rep = a.rep GROUP BY {k})"""


HALF = "CASE WHEN YEAR({t}) BETWEEN 1995 AND 1997 THEN 'a' WHEN YEAR({t}) BETWEEN 1998 AND 2000 THEN 'b' END"
A, B = (1995, 1997), (1998, 2000)


@query("bootstrap_mean_test", "N1", sql("v_field", f"""
y AS (SELECT model, i, YEAR(time) * 12 + MONTH(time) AS ym, AVG(v) AS v, {HALF.format(t='MIN(time)')} AS half FROM v_field GROUP BY 1, 2, 3), s AS (SELECT * FROM y WHERE half IS NOT NULL),
{mean_test_ctes('s', ['model', 'i'], 'ym', 'v', 1000)} SELECT model, i, ROUND(mean_a, 6) AS mean_a, ROUND(mean_b, 6) AS mean_b, ROUND(p, 6) AS p FROM tst"""))
def _(t):
    months = t.field.groupBy("model", "i", (F.year("time") * 12 + F.month("time")).alias("ym")).agg(F.avg("v").alias("v"), F.min("time").alias("t"))
    rows = months.withColumn("half", N.halves("t", A, B)).where("half IS NOT NULL").drop("t")
    out = N.bootstrap_mean_test(rows, ["model", "i"], "half", "ym", "v", 1000)
    return out.select("model", "i", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "p")])


SEASON_VALUES = ", ".join(f"('{s}',{m})" for s, ms in N.TREND_SEASONS.items() for m in ms)


@query("station_trend_table", "N2", sql("v_field", f"""
sv(season, month) AS (VALUES {SEASON_VALUES}),
d AS (SELECT model, CAST(time AS DATE) AS day, AVG(v) AS v FROM v_field GROUP BY 1, 2),
s AS (SELECT model, season, day, v, {HALF.format(t='day')} AS half FROM d JOIN sv ON sv.month = MONTH(day) WHERE YEAR(day) BETWEEN 1995 AND 2000),
y AS (SELECT model, season, half, YEAR(day) AS y, SUM(CASE WHEN v >= 30 THEN 1 ELSE 0 END) AS dd FROM s GROUP BY 1, 2, 3, 4),
c AS (SELECT model, season, AVG(CASE WHEN half = 'b' THEN dd END) - AVG(CASE WHEN half = 'a' THEN dd END) AS strong_change FROM y GROUP BY 1, 2),
{mean_test_ctes('s', ['model', 'season'], 'day', 'v', 1000)}, {flag_test_ctes('s', ['model', 'season'], 'CASE WHEN v >= 30 THEN 1 ELSE 0 END', 10000)}
SELECT model, season, ROUND(mean_b - mean_a, 6) AS mean_change, ROUND(strong_change, 6) AS strong_change, ROUND(tst.p, 6) AS p, ROUND(ftst.p, 6) AS strong_p FROM tst JOIN c USING (model, season) LEFT JOIN ftst USING (model, season)"""))
def _(t):
    days = daily(t.field, ["model"], "time", {"v": F.avg("v")}).withColumn("o", F.unix_date("day"))
    out = N.trend_table(days, "model", "day", "v", 30.0, A, B, 1000, "o", 10000)
    return out.select("model", "season", *[r6(c).alias(c) for c in ("mean_change", "strong_change", "p", "strong_p")])


@query("grid_exceedance_trend", "N3", sql("v_field", f"""
d AS (SELECT i, j, CAST(time AS DATE) AS day, MAX(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS f FROM v_field GROUP BY 1, 2, 3),
s AS (SELECT i, j, half, y, SUM(f) AS v FROM (SELECT *, {HALF.format(t='day')} AS half, YEAR(day) AS y FROM d) WHERE half IS NOT NULL GROUP BY 1, 2, 3, 4),
c AS (SELECT i, j, CAST(SUM(CASE WHEN half = 'a' THEN v END) AS DOUBLE) AS a, CAST(SUM(CASE WHEN half = 'b' THEN v END) AS DOUBLE) AS b FROM s GROUP BY 1, 2),
{mean_test_ctes('s', ['i', 'j'], 'y', 'v', 1000)}
SELECT i, j, a AS days_a, b AS days_b, ROUND((b - a) / a * 100, 6) + 0E0 AS change, ROUND(p, 6) AS p FROM c JOIN tst USING (i, j)"""))
def _(t):
    days = daily(t.field, ["i", "j"], "time", {"f": F.max((F.col("v") >= 40).cast("int"))})
    out = N.grid_trend(days, ["i", "j"], "day", "f", A, B, 1000)
    return out.withColumns({"change": r6("change"), "p": r6("p")})


@query("regional_event_trend", "N4", sql("v_field", f"""
d AS (SELECT CAST(time AS DATE) AS day, MAX(CASE WHEN v >= 49 THEN 1 ELSE 0 END) AS e FROM v_field WHERE lat BETWEEN -38 AND -34 AND lon BETWEEN 116 AND 120 GROUP BY 1),
s AS (SELECT *, {HALF.format(t='day')} AS half FROM d WHERE YEAR(day) BETWEEN 1995 AND 2000),
{', '.join(f"n{h} AS (SELECT e, ROW_NUMBER() OVER (ORDER BY day) AS pos, COUNT(*) OVER () AS n FROM s WHERE half = '{h}'), d{h} AS ({draws_sql(f"'n4-{h}'", 1000, f'n{h}')}), r{h} AS (SELECT rep, SUM(e * times) AS x FROM n{h} JOIN d{h} USING (n, pos) GROUP BY 1)" for h in 'ab')},
t AS (SELECT (rb.x - ra.x) / 0.3E0 AS t FROM ra JOIN rb USING (rep)), z AS (SELECT SUM(CASE WHEN half = 'a' THEN e END) AS a, SUM(CASE WHEN half = 'b' THEN e END) AS b FROM s)
SELECT CAST(ANY_VALUE(a) AS BIGINT) AS days_a, CAST(ANY_VALUE(b) AS BIGINT) AS days_b, ROUND(ANY_VALUE((b - a) / 0.3E0), 5) + 0E0 AS trend, ROUND(QUANTILE_CONT(t, 0.025), 5) + 0E0 AS lower, ROUND(QUANTILE_CONT(t, 0.975), 5) + 0E0 AS upper FROM t, z"""))
def _(t):
    box = t.field.where(F.col("lat").between(-38, -34) & F.col("lon").between(116, 120))
    out = N.regional_event_trend(box, "time", F.col("v") >= 49, A, B, 1000)
    return out.select("days_a", "days_b", *[r6(c, 5).alias(c) for c in ("trend", "lower", "upper")])


@query("slope_with_bootstrap_error", "N5", sql("v_field", f"""
y AS (SELECT model, YEAR(time) AS year, AVG(v) AS v FROM v_field GROUP BY 1, 2),
c AS (SELECT model, REGR_SLOPE(v, year) AS slope, AVG(year) AS x0 FROM y GROUP BY 1),
n AS (SELECT model, year - x0 AS x, v, ROW_NUMBER() OVER (PARTITION BY model ORDER BY year) AS pos, COUNT(*) OVER (PARTITION BY model) AS n FROM y JOIN c USING (model)),
d AS ({draws_sql("'n5'", 1000, 'n')}),
r AS (SELECT model, rep, SUM(times) w, SUM(x * times) sx, SUM(v * times) sy, SUM(x * v * times) sxy, SUM(x * x * times) sxx FROM n JOIN d USING (n, pos) GROUP BY 1, 2),
e AS (SELECT model, STDDEV_POP((w * sxy - sx * sy) / NULLIF(ROUND(w * sxx - sx * sx, 9), 0)) AS slope_std FROM r GROUP BY 1)
SELECT model, ROUND(slope, 6) AS slope, ROUND(slope_std, 6) AS slope_std FROM c JOIN e USING (model)"""))
def _(t):
    y = N.annual_summaries(t.field, ["model"], "time", "v", 40.0)
    out = N.bootstrap_slope(y, ["model"], "year", "mean", 1000)
    return out.select("model", r6("slope").alias("slope"), r6("slope_std").alias("slope_std"))


@query("annual_summaries", "N5", sql("v_field", """
SELECT model, i, j, CAST(YEAR(time) AS INT) AS year, CAST(SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_above, ROUND(AVG(v), 6) AS mean, MAX(v) AS max, MAX(v) - MIN(v) AS range FROM v_field GROUP BY 1, 2, 3, 4"""))
def _(t):
    return N.annual_summaries(t.field, ["model", "i", "j"], "time", "v", 40.0).withColumn("mean", r6("mean"))


@query("interannual_series", "N6", sql("v_field", """
q AS (SELECT model, QUANTILE_CONT(v, 0.9) AS lim FROM v_field GROUP BY 1)
SELECT model, CAST(YEAR(time) AS INT) AS year, ROUND(AVG(v), 6) AS mean, CAST(SUM(CASE WHEN v > lim THEN 1 ELSE 0 END) AS BIGINT) AS n_above FROM v_field JOIN q USING (model) GROUP BY 1, 2"""))
def _(t):
    return N.interannual_series(t.field, ["model"], "time", "v", 0.9).withColumn("mean", r6("mean"))


WELCH = """g AS (SELECT {k}, AVG(CASE WHEN side = 'a' THEN n END) ma, AVG(CASE WHEN side = 'b' THEN n END) mb, VAR_SAMP(CASE WHEN side = 'a' THEN n END) va, VAR_SAMP(CASE WHEN side = 'b' THEN n END) vb, COUNT(CASE WHEN side = 'a' THEN n END) na, COUNT(CASE WHEN side = 'b' THEN n END) nb FROM y GROUP BY {k}),
w AS (SELECT *, va / na AS sa, vb / nb AS sb FROM g)"""
YEARLY = f"""s(period, month) AS (VALUES {PERIOD_VALUES}),
y AS (SELECT i, j, period, CASE WHEN experiment = 'historical' THEN 'a' ELSE 'b' END AS side, YEAR(time) AS year, CAST(SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM v_field JOIN s ON s.month = MONTH(time) GROUP BY 1, 2, 3, 4, 5)"""


def _yearly(t):
    rows = t.field.withColumn("side", F.when(F.col("experiment") == "historical", "a").otherwise("b"))
    return N.yearly_exceedances(rows, ["i", "j"], "time", F.col("v") >= 40, "side")


@query("welch_test_of_yearly_counts", "N7", sql("v_field", f"""{YEARLY}, {WELCH.format(k='i, j, period')}
SELECT i, j, period, ROUND(mb - ma, 6) + 0E0 AS change, ROUND((ma - mb) / NULLIF(SQRT(sa + sb), 0), 6) + 0E0 AS t, ROUND((sa + sb) * (sa + sb) / NULLIF(sa * sa / NULLIF(na - 1, 0) + sb * sb / NULLIF(nb - 1, 0), 0), 6) AS dof FROM w"""))
def _(t):
    out = N.welch(_yearly(t), ["i", "j", "period"], "n", "side")
    return out.select("i", "j", "period", *[r6(c).alias(c) for c in ("change", "t", "dof")])


def student_p(t, dof):
    """Two-sided p of Student's t in SQL: Simpson's rule over the angle, at which the density is a power of the cosine."""
    area = f"list_sum(list_transform(range(2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(k * atan(abs({t}) / sqrt({dof})) / 2000), {dof} - 1)))"
    return f"1 - 2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * {area} * atan(abs({t}) / sqrt({dof})) / 6000"


@query("welch_test_p_values", "N7", sql("v_field", f"""{YEARLY}, {WELCH.format(k='i, j, period')},
td AS (SELECT i, j, period, (ma - mb) / NULLIF(SQRT(sa + sb), 0) AS t, (sa + sb) * (sa + sb) / NULLIF(sa * sa / NULLIF(na - 1, 0) + sb * sb / NULLIF(nb - 1, 0), 0) AS dof FROM w)
SELECT i, j, period, ROUND(CASE WHEN t IS NOT NULL AND dof IS NOT NULL THEN {student_p('t', 'dof')} END, 5) + 0E0 AS p FROM td"""))
def _(t):
    out = N.welch(_yearly(t), ["i", "j", "period"], "n", "side")
    return out.select("i", "j", "period", r6("p", 5).alias("p"))


@query("historical_trend_agreement", "N8,O5", sql("v_field", f"""
y AS (SELECT model, i, j, {HALF.format(t='time')} AS side, YEAR(time) AS year, SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS n FROM v_field GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT model, i, j, AVG(CASE WHEN side = 'b' THEN n END) - AVG(CASE WHEN side = 'a' THEN n END) AS change FROM y GROUP BY 1, 2, 3),
m AS (SELECT i, j, MEDIAN(change) AS median, AVG(change) AS mean, SUM(CASE WHEN change > 0 THEN 1 ELSE 0 END) up, SUM(CASE WHEN change < 0 THEN 1 ELSE 0 END) dn FROM c GROUP BY 1, 2)
SELECT i, j, ROUND(median, 6) + 0E0 AS median, ROUND(mean, 6) + 0E0 AS mean, CASE WHEN (CASE WHEN median > 0 THEN up WHEN median < 0 THEN dn ELSE 0 END) >= 5 THEN 1 ELSE 0 END AS agreement FROM m"""))
def _(t):
    rows = t.field.withColumn("side", N.halves("time", A, B)).where("side IS NOT NULL")
    y = N.yearly_exceedances(rows, ["model", "i", "j"], "time", F.col("v") >= 40, "side", {"Annual": list(range(1, 13))})
    of = lambda s: F.avg(F.when(F.col("side") == s, F.col("n")))
    c = y.groupBy("model", "i", "j").agg((of("b") - of("a")).alias("change"))
    out = N.ensemble_change(c, ["i", "j"], "change", 5)
    return out.withColumns({"median": r6("median"), "mean": r6("mean")})


@query("pooled_trend_test", "N8", sql("v_field", f"""
y AS (SELECT i, j, {HALF.format(t='time')} AS side, YEAR(time) AS year, CAST(SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM v_field WHERE YEAR(time) BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3, 4), {WELCH.format(k='i, j')}
SELECT i, j, ROUND(mb - ma, 6) + 0E0 AS change, ROUND((ma - mb) / NULLIF(SQRT(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1E0 / na + 1E0 / nb)), 0), 6) + 0E0 AS t, CAST(na + nb - 2 AS DOUBLE) AS dof FROM w"""))
def _(t):
    rows = t.field.withColumn("side", N.halves("time", A, B)).where("side IS NOT NULL")
    y = N.yearly_exceedances(rows, ["i", "j"], "time", F.col("v") >= 40, "side", {"Annual": list(range(1, 13))})
    out = N.welch(y, ["i", "j"], "n", "side", pooled=True)
    return out.select("i", "j", r6("change").alias("change"), r6("t").alias("t"), "dof")


SEASONAL = """
si AS (SELECT year + CASE WHEN month IN (1, 2) THEN -1 ELSE 0 END AS year, CASE WHEN month IN (12,1,2) THEN 'DJF' WHEN month < 6 THEN 'MAM' WHEN month < 9 THEN 'JJA' ELSE 'SON' END AS season, idx FROM v_index),
ix AS (SELECT year, season, AVG(idx) AS idx FROM si GROUP BY 1, 2 HAVING COUNT(*) = 3),
sr AS (SELECT i, j, YEAR(time) - CASE WHEN MONTH(time) IN (1, 2) THEN 1 ELSE 0 END AS year, CASE WHEN MONTH(time) IN (12,1,2) THEN 'DJF' WHEN MONTH(time) < 6 THEN 'MAM' WHEN MONTH(time) < 9 THEN 'JJA' WHEN TRUE THEN 'SON' END AS season, SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS n FROM v_field GROUP BY 1, 2, 3, 4)"""


def _seasonal(t):
    m = F.month("time")
    season = F.when(m.isin(12, 1, 2), "DJF").when(m < 6, "MAM").when(m < 9, "JJA").otherwise("SON")
    series = t.field.groupBy("i", "j", (F.year("time") - m.isin(1, 2).cast("int")).alias("year"), season.alias("season")).agg(
        F.sum((F.col("v") >= 40).cast("int")).alias("n")
    )
    index = seasonal_index(t.index.withColumnRenamed("idx", "value")).where("season <> 'ANN'")
    return series, index.withColumnRenamed("value", "idx")


@query("climate_index_rank_correlation", "N9,A8", sql("v_field v_index", SEASONAL + """,
j AS (SELECT i, j, season, n, idx FROM sr JOIN ix USING (year, season)),
r AS (SELECT i, j, season, RANK() OVER (PARTITION BY i, j, season ORDER BY n) + (COUNT(*) OVER (PARTITION BY i, j, season, n) - 1) / 2E0 AS a, RANK() OVER (PARTITION BY i, j, season ORDER BY idx) + (COUNT(*) OVER (PARTITION BY i, j, season, idx) - 1) / 2E0 AS b FROM j),
c AS (SELECT i, j, season, CORR(a, b) AS rho, COUNT(*) AS n FROM r GROUP BY 1, 2, 3), d AS (SELECT *, rho * SQRT((n - 2) / NULLIF(ROUND(1 - rho * rho, 12), 0)) AS t, n - 2E0 AS dof FROM c)
SELECT i, j, season, ROUND(rho, 6) + 0E0 AS rho, n, ROUND(CASE WHEN t IS NOT NULL AND dof > 0 THEN """ + student_p("t", "dof") + """ END, 5) + 0E0 AS p FROM d"""))
def _(t):
    series, index = _seasonal(t)
    out = N.index_correlation(series, index, ["i", "j", "season"], ["year", "season"], "n", "idx")
    return out.select("i", "j", "season", r6("rho").alias("rho"), "n", r6("p", 5).alias("p"))


@query("climate_index_permutation_test", "N9", sql("v_field v_index", f"""
ix AS (SELECT year, AVG(idx) AS idx FROM v_index GROUP BY 1 HAVING COUNT(*) = 12), sr AS (SELECT i, j, YEAR(time) AS year, AVG(v) AS v FROM v_field GROUP BY 1, 2, 3),
pm AS (SELECT perm, idx, ROW_NUMBER() OVER (PARTITION BY perm ORDER BY {lot_sql("'n9:' || perm || ':' || year")}, year) AS r FROM ix CROSS JOIN RANGE(1000) p(perm)),
pl AS (SELECT year, ROW_NUMBER() OVER (ORDER BY year) AS r FROM ix), tb AS (SELECT year, perm, idx AS pi FROM pl JOIN pm USING (r)),
re AS (SELECT i, j, CORR(v, idx) AS r FROM sr JOIN ix USING (year) GROUP BY 1, 2), fk AS (SELECT i, j, perm, CORR(v, pi) AS pr FROM sr JOIN tb USING (year) GROUP BY 1, 2, 3)
SELECT i, j, ROUND(ANY_VALUE(r), 6) + 0E0 AS r, ROUND(AVG(CASE WHEN ROUND(ABS(pr), 9) >= ROUND(ABS(r), 9) THEN 1E0 ELSE 0E0 END), 6) AS p FROM fk JOIN re USING (i, j) GROUP BY 1, 2"""))
def _(t):
    index = seasonal_index(t.index.withColumnRenamed("idx", "value")).where("season = 'ANN'").select("year", F.col("value").alias("idx"))
    series = t.field.groupBy("i", "j", F.year("time").alias("year")).agg(F.avg("v").alias("v"))
    out = N.permuted_correlation(series, index, ["i", "j"], "year", "v", "idx", 1000)
    return out.select("i", "j", r6("r").alias("r"), r6("p").alias("p"))


FLAGGED = f"""{PHASES}, d AS (SELECT i, j, CAST(time AS DATE) AS day, MAX(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS f FROM v_field GROUP BY 1, 2, 3)"""


def _flagged(t):
    days = daily(t.field, ["i", "j"], "time", {"f": F.max((F.col("v") >= 40).cast("int"))})
    return days.join(oscillation_flags(_phases(t)), "day")


@query("oscillation_contrast", "N10", sql("v_field v_track", f"""{FLAGGED},
y AS (SELECT i, j, CAST(f AS DOUBLE) AS n, CASE WHEN amplitude >= 1 AND phase IN (4,5,6,7) THEN 'a' WHEN amplitude >= 1 THEN 'b' END AS side FROM d JOIN ph USING (day)), {WELCH.format(k='i, j')}
SELECT i, j, ROUND(ma, 6) AS rate_a, ROUND(mb, 6) AS rate_b, ROUND((ma - mb) / NULLIF(mb, 0), 6) + 0E0 AS relative, ROUND((ma - mb) / NULLIF(SQRT(sa + sb), 0), 6) + 0E0 AS t,
 ROUND(CASE WHEN sa + sb > 0 THEN {student_p('((ma - mb) / SQRT(sa + sb))', '((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)))')} END, 5) + 0E0 AS p FROM w"""))
def _(t):
    out = N.class_contrast(_flagged(t), ["i", "j"], "f", "active", "inactive")
    return out.select("i", "j", *[r6(c).alias(c) for c in ("rate_a", "rate_b", "relative", "t")], r6("p", 5).alias("p"))


@query("oscillation_phase_pairs", "N10", sql("v_field v_track", f"""{FLAGGED},
y AS (SELECT i, j, f, CASE phase WHEN 1 THEN '81' WHEN 8 THEN '81' WHEN 2 THEN '23' WHEN 3 THEN '23' WHEN 4 THEN '45' WHEN 5 THEN '45' ELSE '67' END AS pair FROM d JOIN ph USING (day)), a AS (SELECT i, j, AVG(f) AS al FROM y GROUP BY 1, 2)
SELECT i, j, pair, ROUND(AVG(f) - ANY_VALUE(al), 6) + 0E0 AS anomaly FROM y JOIN a USING (i, j) GROUP BY 1, 2, 3"""))
def _(t):
    return N.phase_pair_anomaly(_flagged(t), ["i", "j"], "f", "phase").withColumn("anomaly", r6("anomaly"))


@query("oscillation_monthly_correlation", "N10", sql("v_field v_track", f"""{FLAGGED},
m AS (SELECT i, j, YEAR(day) * 12 + MONTH(day) AS ym, SUM(f) AS n FROM d GROUP BY 1, 2, 3), a AS (SELECT YEAR(day) * 12 + MONTH(day) AS ym, SUM(CASE WHEN amplitude >= 1 AND phase IN (4,5,6,7) THEN 1 ELSE 0 END) AS act FROM ph GROUP BY 1)
SELECT i, j, ROUND(CORR(n, act), 6) + 0E0 AS r FROM m JOIN a USING (ym) GROUP BY 1, 2"""))
def _(t):
    ym = (F.year("day") * 12 + F.month("day")).alias("ym")
    days = daily(t.field, ["i", "j"], "time", {"f": F.max((F.col("v") >= 40).cast("int"))})
    m = days.groupBy("i", "j", ym).agg(F.sum("f").alias("n"))
    a = oscillation_flags(_phases(t)).groupBy(ym).agg(F.sum("active").alias("act"))
    return m.join(a, "ym").groupBy("i", "j").agg(r6(F.corr("n", "act")).alias("r"))


@query("annual_variability_correlation", "N11", sql("v_field", f"""
y AS (SELECT model, YEAR(time) AS year, AVG(v) AS x, SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS c FROM v_field GROUP BY 1, 2),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY year) AS pos, COUNT(*) OVER (PARTITION BY model) AS n FROM y),
q0 AS (SELECT model, rep, n, pos - 1 AS k, {lot_sql("'n11-x:' || rep")} AS sx, {lot_sql("'n11-y:' || rep")} AS sy FROM n CROSS JOIN RANGE(1000) r(rep)),
q1 AS ({pick_sql('q0', 'sx', 'k', 'n', 'px', 'model, rep, n, k, sy')}), q AS (SELECT model, rep, px + 1 AS px, py + 1 AS py FROM ({pick_sql('q1', 'sy', 'k', 'n', 'py', 'model, rep, px')})),
f AS (SELECT q.model, rep, CORR(a.x, b.c) AS rr FROM q JOIN n a ON a.model = q.model AND a.pos = px JOIN n b ON b.model = q.model AND b.pos = py GROUP BY 1, 2), e AS (SELECT model, CORR(x, c) AS r FROM y GROUP BY 1)
SELECT model, ROUND(ANY_VALUE(r), 6) AS r, ROUND(AVG(CASE WHEN ROUND(rr, 9) >= ROUND(r, 9) THEN 1E0 ELSE 0E0 END), 6) AS p FROM f JOIN e USING (model) WHERE rr IS NOT NULL AND NOT isnan(rr) GROUP BY 1"""))
def _(t):
    y = N.annual_summaries(t.field, ["model"], "time", "v", 40.0)
    out = N.resampled_correlation(y, ["model"], "year", "mean", "n_above", 1000)
    return out.select("model", r6("r").alias("r"), r6("p").alias("p"))


@query("ensemble_median_trend", "N12,N13", sql("v_field", """
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, MAX(v) AS v FROM v_field GROUP BY 1, 2, 3, 4), c AS (SELECT model, i, j, YEAR(day) AS year, SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS n FROM d WHERE (i * 5 + j) % 3 > 0 GROUP BY 1, 2, 3, 4),
y AS (SELECT model, year, AVG(n) AS n FROM c GROUP BY 1, 2), m AS (SELECT year, MEDIAN(n) AS n FROM y GROUP BY 1)
SELECT ROUND(REGR_SLOPE(n, year), 6) AS slope, ROUND(REGR_INTERCEPT(n, year), 4) AS intercept, COUNT(*) AS years FROM m"""))
def _(t):
    out = N.ensemble_median_trend(_regional(t), [], "year", "n")
    return out.select(r6("slope").alias("slope"), r6("intercept", 4).alias("intercept"), "years")


def _regional(t):
    days = daily(t.field.where("(i * 5 + j) % 3 > 0"), ["model", "i", "j"], "time", {"v": F.max("v")})
    cells = days.groupBy("model", "i", "j", F.year("day").alias("year")).agg(F.sum((F.col("v") >= 40).cast("int")).alias("n"))
    return cells.groupBy("model", "year").agg(F.avg("n").alias("n"))


@query("ensemble_spread", "N12", sql("v_field", f"""
y AS (SELECT model, YEAR(time) AS year, AVG(v) AS v FROM v_field GROUP BY 1, 2), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY year) AS pos, COUNT(*) OVER (PARTITION BY model) AS n FROM y),
d AS ({draws_sql("'n12'", 1000, 'n')}), r AS (SELECT model, rep, SUM(times) w, SUM(v * times) s, SUM(v * v * times) q FROM n JOIN d USING (n, pos) GROUP BY 1, 2)
SELECT model, ROUND(MEDIAN(SQRT(GREATEST(q / w - (s / w) * (s / w), 0))), 5) AS std FROM r GROUP BY 1"""))
def _(t):
    y = t.field.groupBy("model", F.year("time").alias("year")).agg(F.avg("v").alias("v"))
    return N.bootstrap_median_std(y, ["model"], "year", "v", 1000).withColumn("std", r6("std", 5))


@query("regional_annual_series", "N13,D3", sql("v_field", """
d AS (SELECT model, i, j, CAST(time AS DATE) AS day, MAX(v) AS v FROM v_field GROUP BY 1, 2, 3, 4), c AS (SELECT model, i, j, YEAR(day) AS year, SUM(CASE WHEN v >= 40 THEN 1 ELSE 0 END) AS n FROM d WHERE (i * 5 + j) % 3 > 0 GROUP BY 1, 2, 3, 4)
SELECT model, CAST(year AS INT) AS year, ROUND(AVG(n), 6) AS n FROM c GROUP BY 1, 2"""))
def _(t):
    return _regional(t).withColumn("n", r6("n"))
