"""Verification queries (K), best-of picks (F1, F2, F5)."""
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions import composites as X
from squallframe.functions.draws import lot_sql, pick_sql
from squallframe.operators import cleaning as C
from squallframe.operators import joins as J
from squallframe.operators import sequence as E
from squallframe.operators import skill as K
from squallframe.operators.resample import daily
from squallframe.plans.registry import query, r6, sql

PARAMS = ["t_totals", "ml_cape", "s06", "dcape", "umean06"]


def _hour(mode):
    if mode == "ceil":
        return "date_trunc('hour', o.gust_time) + INTERVAL 1 HOUR"
    return "date_trunc('hour', o.gust_time)" + (" - INTERVAL 1 HOUR" if mode == "floor2" else "")


def events_cte(mode="floor", name="ev"):
    return (
        f"{name} AS (SELECT o.event_id, o.loc_id, o.is_sta, o.wind_gust, o.lightning, CASE WHEN o.lightning >= 2 AND o.wind_gust >= 25 THEN 1 ELSE 0 END AS is_conv, "
        f"m.time, {', '.join('m.' + p for p in PARAMS)} FROM v_obs o JOIN v_points m ON o.loc_id = m.loc_id AND m.time = {_hour(mode)} WHERE o.tc_affected = 0 AND o.wind_gust IS NOT NULL)"
    )


def long_cte(event, src="ev", name="lg"):
    parts = [f"SELECT event_id, loc_id, '{p}' AS param, CAST({p} AS DOUBLE) AS value, {event} AS event FROM {src}" for p in PARAMS]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


SCORES = {
    "hss": ("CASE WHEN {h} / {ne} > 0.66 THEN 2E0 * ({h} * ({no} - {f}) - ({ne} - {h}) * {f}) / (({ne} - {h}) * ({ne} - {h}) + {f} * {f} + 2 * {h} * ({no} - {f}) + (({ne} - {h}) + {f}) * ({h} + ({no} - {f}))) ELSE 0E0 END"),
    "pss": "{h} / {ne} - {f} / ({f} + ({no} - {f}))",
    "csi": "CASE WHEN {h} / {ne} > 0.66 THEN {h} / ({h} + ({ne} - {h}) + {f}) ELSE 0E0 END",
    "edi": "COALESCE((CASE WHEN {f} > 0 THEN LN({f} / {no}) END - CASE WHEN {h} > 0 THEN LN({h} / {ne}) END) / (CASE WHEN {f} > 0 THEN LN({f} / {no}) END + CASE WHEN {h} > 0 THEN LN({h} / {ne}) END), -1)",
}


def sweep_ctes(score, rows="lg", keys="param", tag="", steps=1000):
    """CTEs b, t, vc, c, s: scores at every threshold, by brute force over distinct values."""
    s = SCORES[score]
    up = s.format(h="CAST(hg AS DOUBLE)", f="CAST(fg AS DOUBLE)", ne="CAST(ne AS DOUBLE)", no="CAST(no AS DOUBLE)")
    down = s.format(h="CAST(hl AS DOUBLE)", f="CAST(fl AS DOUBLE)", ne="CAST(ne AS DOUBLE)", no="CAST(no AS DOUBLE)")
    return f"""b{tag} AS (SELECT {keys}, MIN(value) lo, QUANTILE_CONT(value, 0.9995) hi, SUM(event) ne, COUNT(*) - SUM(event) no FROM {rows} GROUP BY {keys}),
t{tag} AS (SELECT {keys}, i, lo + i * ((hi - lo) / {steps - 1}) AS t, ne, no FROM b{tag} CROSS JOIN RANGE({steps}) r(i)),
vc{tag} AS (SELECT {keys}, value, COUNT(*) n, SUM(event) e FROM {rows} GROUP BY {keys}, value),
c{tag} AS (SELECT {keys}, i, t, ANY_VALUE(ne) ne, ANY_VALUE(no) no, COALESCE(SUM(CASE WHEN value > t THEN e END), 0) hg, COALESCE(SUM(CASE WHEN value > t THEN n - e END), 0) fg,
 COALESCE(SUM(CASE WHEN value < t THEN e END), 0) hl, COALESCE(SUM(CASE WHEN value < t THEN n - e END), 0) fl FROM t{tag} JOIN vc{tag} USING ({keys}) GROUP BY {keys}, i, t),
s{tag} AS (SELECT {keys}, i, t, GREATEST({up}, {down}) AS score FROM c{tag}),
best{tag} AS (SELECT {keys}, t AS threshold, score FROM s{tag} QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY score DESC, i) = 1)"""


def _events(t, mode="floor"):
    obs = t.obs.where("tc_affected = 0 AND wind_gust IS NOT NULL")
    ev = J.align_to_model(obs, t.points, "loc_id", "gust_time", PARAMS, mode)
    return ev.withColumn("is_conv", C.event_label())


def _long(ev, event="is_conv", keep=()):
    return K.to_long(ev.withColumnRenamed(event, "event"), PARAMS, [*keep, "event"])


def _sweep_query(name, covers, score, event, mode="floor"):
    body = f"{events_cte(mode)}, {long_cte(event)}, {sweep_ctes(score)} SELECT param, ROUND(threshold, 6) AS threshold, ROUND(score, 6) + 0E0 AS score FROM best"

    @query(name, covers, sql("v_obs v_points", body))
    def _(t):
        best = K.best_thresholds(_long(_events(t, mode), event), ["param"], "value", "event", score)
        return best.select("param", r6("threshold").alias("threshold"), r6("score").alias("score"))


_sweep_query("best_gust_threshold", "C1,B4,K1,K2,F2", "hss", "is_conv")
_sweep_query("best_report_threshold", "K1,K2,F2", "hss", "is_sta")
_sweep_query("best_threshold_pss", "K1,K2", "pss", "is_conv")
_sweep_query("best_threshold_csi", "K2", "csi", "is_sta", "ceil")
_sweep_query("best_threshold_edi", "K2", "edi", "is_sta")


@query("threshold_contingency_table", "K1,K2", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')}, {sweep_ctes('pss')}
SELECT param, CAST(i AS INT) AS i, ROUND(t, 6) AS threshold, CAST(hg AS BIGINT) AS hits_gt, CAST(fg AS BIGINT) AS fa_gt, CAST(hl AS BIGINT) AS hits_lt, CAST(fl AS BIGINT) AS fa_lt FROM c"""))
def _(t):
    c = K.threshold_counts(_long(_events(t), "is_sta"), ["param"], "value", "event")
    return c.select("param", "i", r6("threshold").alias("threshold"), "hits_gt", "fa_gt", "hits_lt", "fa_lt")


@query("product_threshold_sweep", "K3", sql("v_obs v_points", f"""{events_cte()}, lg AS (SELECT 'ml_cape*s06' AS param, ml_cape * s06 AS value, is_sta AS event FROM ev), {sweep_ctes('pss')}
SELECT param, ROUND(threshold, 4) AS threshold, ROUND(score, 6) AS score FROM best"""))
def _(t):
    ev = _events(t).select((F.col("ml_cape") * F.col("s06")).alias("value"), F.col("is_sta").alias("event"))
    best = K.best_thresholds(ev, [], "value", "event", "pss")
    return best.select(F.lit("ml_cape*s06").alias("param"), r6("threshold", 4).alias("threshold"), r6("score").alias("score"))


def _pair_sql(rule):
    op = "AND" if rule == "and" else "OR"
    return sql("v_obs v_points", f"""{events_cte()},
b AS (SELECT MIN(ml_cape) la, QUANTILE_CONT(ml_cape, 0.9995) ha, MIN(s06) lb, QUANTILE_CONT(s06, 0.9995) hb, SUM(is_sta) ne, COUNT(*) - SUM(is_sta) no FROM ev),
p AS (SELECT ml_cape a, s06 b, COUNT(*) n, SUM(is_sta) e FROM ev GROUP BY 1, 2),
g AS (SELECT x.i ia, y.i ib, la + x.i * ((ha - la) / 49) ta, lb + y.i * ((hb - lb) / 49) tb, ne, no FROM b CROSS JOIN RANGE(50) x(i) CROSS JOIN RANGE(50) y(i)),
c AS (SELECT ia, ib, ta, tb, COALESCE(SUM(e), 0) / CAST(ANY_VALUE(ne) AS DOUBLE) - COALESCE(SUM(n - e), 0) / CAST(ANY_VALUE(no) AS DOUBLE) AS score FROM g LEFT JOIN p ON a >= ta {op} b >= tb GROUP BY 1, 2, 3, 4)
SELECT ROUND(ta, 6) AS ta, ROUND(tb, 6) AS tb, ROUND(score, 6) AS score FROM c ORDER BY c.score DESC, ia, ib LIMIT 1""")


for _rule in ("and", "or"):

    @query(f"pair_threshold_sweep_{_rule}", "K3", _pair_sql(_rule))
    def _(t, rule=_rule):
        best = K.best_pair(K.pair_sweep(_events(t), "ml_cape", "s06", "is_sta", rule))
        return best.select(r6("ta").alias("ta"), r6("tb").alias("tb"), r6("score").alias("score"))


# Fixed thresholds of the stand-in diagnostics, for the operators that score given limits.
LIMITS = {"t_totals": 45.0, "ml_cape": 200.0, "s06": 25.0, "dcape": 600.0, "umean06": 5.0}
LIMIT_CTE = "lim(param, threshold) AS (VALUES " + ", ".join(f"('{p}', {v}E0)" for p, v in LIMITS.items()) + ")"


def _limits(t):
    return F.broadcast(refs.literal_table(t.spark, list(LIMITS.items()), ["param", "threshold"]))


@query("station_scores_at_national_threshold", "K4", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')}, {LIMIT_CTE},
c AS (SELECT loc_id, param, SUM(event) ne, COUNT(*) - SUM(event) no, SUM(CASE WHEN value > threshold THEN event ELSE 0 END) hg, SUM(CASE WHEN value > threshold THEN 1 - event ELSE 0 END) fg,
 SUM(CASE WHEN value < threshold THEN event ELSE 0 END) hl, SUM(CASE WHEN value < threshold THEN 1 - event ELSE 0 END) fl FROM lg JOIN lim USING (param) GROUP BY 1, 2)
SELECT loc_id, param, CAST(ne AS BIGINT) AS events, ROUND(CASE WHEN ne > 1 THEN GREATEST(hg / CAST(ne AS DOUBLE) - fg / CAST(no AS DOUBLE), hl / CAST(ne AS DOUBLE) - fl / CAST(no AS DOUBLE)) END, 6) + 0E0 AS score FROM c"""))
def _(t):
    long = _long(_events(t), "is_sta", ["loc_id"])
    out = K.station_scores(long, "loc_id", _limits(t))
    return out.withColumn("score", r6("score"))


@query("false_alarms_at_two_thirds_hits", "K5", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')},
l2 AS (SELECT param, value, event FROM lg UNION ALL SELECT 'rule', CASE WHEN t_totals >= 47.4E0 AND s06 >= 25 THEN 1E0 ELSE 0E0 END, is_sta FROM ev),
q AS (SELECT param, CASE WHEN param = 'rule' THEN 1E0 ELSE QUANTILE_CONT(value, 0.33) END AS threshold FROM l2 WHERE event = 1 GROUP BY 1),
c AS (SELECT param, threshold, SUM(CASE WHEN event = 1 AND value >= threshold THEN 1 ELSE 0 END) h, SUM(CASE WHEN event = 0 AND value >= threshold THEN 1 ELSE 0 END) f, SUM(CASE WHEN event = 0 THEN 1 ELSE 0 END) o FROM l2 JOIN q USING (param) GROUP BY 1, 2)
SELECT param, ROUND(threshold, 6) AS threshold, ROUND(f / CAST(h + f AS DOUBLE), 6) AS fa_ratio, ROUND(f / CAST(o AS DOUBLE), 6) AS fa_rate FROM c"""))
def _(t):
    ev = _events(t).withColumn("rule", ((F.col("t_totals") >= 47.4) & (F.col("s06") >= 25)).cast("double"))
    long = K.to_long(ev.withColumnRenamed("is_sta", "event"), [*PARAMS, "rule"], ["event"])
    out = K.far_at_two_thirds(long, ["param"], yes_no=["rule"])
    return out.select("param", *[r6(c).alias(c) for c in ("threshold", "fa_ratio", "fa_rate")])


FAR_KINDS = {"report": "is_sta = 1", "strong": "wind_gust >= 12 AND wind_gust < 18", "extreme": "wind_gust >= 18"}


@query("false_alarm_table", "K5,F5", sql("v_obs v_points", f"""{events_cte()},
k AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, CASE WHEN {c} THEN 1 ELSE 0 END AS event, {', '.join(PARAMS)} FROM ev" for k, c in FAR_KINDS.items())}),
lg AS ({' UNION ALL '.join(f"SELECT kind, '{p}' AS param, CAST({p} AS DOUBLE) AS value, event FROM k" for p in PARAMS)}),
q AS (SELECT kind, param, QUANTILE_CONT(value, 0.33) AS threshold FROM lg WHERE event = 1 GROUP BY 1, 2),
c AS (SELECT kind, param, threshold, SUM(CASE WHEN event = 0 AND value >= threshold THEN 1 ELSE 0 END) f, SUM(CASE WHEN event = 0 THEN 1 ELSE 0 END) o FROM lg JOIN q USING (kind, param) GROUP BY 1, 2, 3)
SELECT param, ROUND(MAX(CASE WHEN kind = 'report' THEN f / CAST(o AS DOUBLE) END), 6) AS report_rate, ROUND(MAX(CASE WHEN kind = 'strong' THEN f / CAST(o AS DOUBLE) END), 6) AS strong_rate,
 ROUND(MAX(CASE WHEN kind = 'extreme' THEN f / CAST(o AS DOUBLE) END), 6) AS extreme_rate, ROUND(MAX(CASE WHEN kind = 'report' THEN threshold END), 6) AS report_threshold FROM c GROUP BY 1"""))
def _(t):
    ev = _events(t)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(f"CAST(coalesce({c}, false) AS INT)").alias("event")) for k, c in FAR_KINDS.items()])
    rows = ev.select(*PARAMS, F.inline(kinds))
    far = K.far_at_two_thirds(K.to_long(rows, PARAMS, ["kind", "event"]), ["kind", "param"])
    of = lambda k, c: r6(F.max(F.when(F.col("kind") == k, F.col(c))))
    out = far.groupBy("param").agg(
        of("report", "fa_rate").alias("report_rate"), of("strong", "fa_rate").alias("strong_rate"), of("extreme", "fa_rate").alias("extreme_rate"),
        of("report", "threshold").alias("report_threshold"),
    )
    return out.orderBy("report_rate")


COUNTS = """c AS (SELECT param, SUM(CASE WHEN event = 1 AND value {ge} threshold THEN 1 ELSE 0 END) h, SUM(CASE WHEN event = 1 AND NOT value {ge} threshold THEN 1 ELSE 0 END) m,
 SUM(CASE WHEN event = 0 AND value {ge} threshold THEN 1 ELSE 0 END) f, SUM(CASE WHEN event = 0 AND NOT value {ge} threshold THEN 1 ELSE 0 END) n FROM lg JOIN lim USING (param) GROUP BY 1)"""
HSS = "2E0 * ({h} * {n} - {m} * {f}) / NULLIF({m} * {m} + {f} * {f} + 2 * {h} * {n} + ({m} + {f}) * ({h} + {n}), 0)"


@query("detection_and_false_alarm_rates", "K6", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')}, {LIMIT_CTE}, {COUNTS.format(ge='>=')}
SELECT param, CAST(h AS BIGINT) AS hits, CAST(m AS BIGINT) AS misses, CAST(f AS BIGINT) AS false_alarms, CAST(n AS BIGINT) AS correct_negatives, ROUND(h / CAST(h + m AS DOUBLE), 6) AS pod, ROUND(f / CAST(h + f AS DOUBLE), 6) AS far FROM c"""))
def _(t):
    rows = _long(_events(t), "is_sta").join(_limits(t), "param")
    out = K.rates(K.counts_at(rows, ["param"], F.col("value") >= F.col("threshold"), "event"))
    return out.select("param", "hits", "misses", "false_alarms", "correct_negatives", r6("pod").alias("pod"), r6("far").alias("far"))


@query("skill_at_given_thresholds", "K7", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')}, {LIMIT_CTE}, {COUNTS.format(ge='>')}
SELECT param, ROUND(GREATEST({HSS.format(h='h', m='m', f='f', n='n')}, {HSS.format(h='m', m='h', f='n', n='f')}), 6) + 0E0 AS hss FROM c"""))
def _(t):
    return K.hss_at(_long(_events(t), "is_sta"), [], _limits(t)).select("param", r6("hss").alias("hss"))


@query("area_under_roc", "K8", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')},
f AS (SELECT param, value, CASE WHEN param IN ('dcape') THEN 1 - event ELSE event END AS event FROM lg),
r AS (SELECT param, event, RANK() OVER (PARTITION BY param ORDER BY value) + (COUNT(*) OVER (PARTITION BY param, value) - 1) / 2E0 AS rk FROM f)
SELECT param, ROUND((SUM(CASE WHEN event = 1 THEN rk END) - SUM(event) * (SUM(event) + 1) / 2E0) / (SUM(event) * CAST(COUNT(*) - SUM(event) AS DOUBLE)), 6) AS auc FROM r GROUP BY 1"""))
def _(t):
    long = K.flip_low(_long(_events(t), "is_sta"), ["dcape"])
    return K.auc(long, ["param"]).withColumn("auc", r6("auc"))


@query("roc_curve", "K8,E15", sql("v_obs v_points", f"""{events_cte()},
c AS (SELECT t_totals AS value, COUNT(*) n, SUM(is_sta) e FROM ev GROUP BY 1)
SELECT value, ROUND(SUM(e) OVER w / CAST(SUM(e) OVER () AS DOUBLE), 6) AS pod, ROUND(SUM(n - e) OVER w / CAST(SUM(n - e) OVER () AS DOUBLE), 6) AS pofd FROM c WINDOW w AS (ORDER BY value DESC ROWS UNBOUNDED PRECEDING)"""))
def _(t):
    ev = _events(t).select(F.col("t_totals").alias("value"), F.col("is_sta").alias("event"))
    c = E.cumulative_contingency(ev, [], "value", "event")
    return c.select("value", r6(F.col("hits") / F.col("n_events")).alias("pod"), r6(F.col("false_alarms") / F.col("n_other")).alias("pofd"))


def draw_ctes(event, reps, m, op, shares=None, base="ev"):
    """CTEs that group rows by what they exceed, give each group positions in order, and look up draws by the hash of (label, replicate, k)."""
    flags = ", ".join(f"f_{p}" for p in PARAMS)
    ask = ", ".join(f"CASE WHEN {p} {op} {LIMITS[p]}E0 THEN 1 ELSE 0 END AS f_{p}" for p in PARAMS)
    share_col = ", share" if shares else ""
    label = "'k9-' || c" + (" || '-' || CAST(share AS VARCHAR)" if shares else "")
    share_src = f" CROSS JOIN (VALUES {', '.join(f'({s!r}::DOUBLE)' for s in shares)}) sh(share)" if shares else ""
    want_e = "ne" if m is None else str(m)
    want_o = "ROUND_EVEN(no * share, 0)" if shares else f"{want_e} * ROUND_EVEN((ne + no) / CAST(ne AS DOUBLE), 0)"
    cells = ", ".join(f"SUM(CASE WHEN event = {e} AND f_{p} = {y} THEN times ELSE 0 END) AS {n}_{p}" for p in PARAMS for n, e, y in (("h", 1, 1), ("m", 1, 0), ("f", 0, 1), ("n", 0, 0)))
    return f"""gr AS (SELECT {event} AS event, {ask}, COUNT(*) AS n FROM {base} GROUP BY ALL),
rg AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY event ORDER BY {flags}) AS BIGINT) - n AS lo FROM gr),
sz AS (SELECT SUM({event}) ne, COUNT(*) - SUM({event}) no FROM {base}),
ask AS (SELECT rep{share_col}, 1 AS c, CAST({want_e} AS BIGINT) AS want, ne AS size FROM sz CROSS JOIN RANGE({reps}) r(rep){share_src} UNION ALL SELECT rep{share_col}, 0, CAST({want_o} AS BIGINT), no FROM sz CROSS JOIN RANGE({reps}) r(rep){share_src}),
dr AS (SELECT rep{share_col}, c, size, {lot_sql(f"{label} || ':' || rep")} AS st, UNNEST(RANGE(want)) AS k FROM ask),
pk AS ({pick_sql('dr', 'st', 'k', 'size', 'pos', f'rep{share_col}, c')}),
smp AS (SELECT pk.rep{', pk.share' if shares else ''}, rg.event, {flags}, COUNT(*) AS times FROM pk ASOF JOIN rg ON pk.c = rg.event AND pk.pos >= rg.lo GROUP BY ALL),
wd AS (SELECT rep{share_col}, {cells} FROM smp GROUP BY ALL),
c AS ({' UNION ALL '.join(f"SELECT rep{share_col}, '{p}' AS param, h_{p} AS h, m_{p} AS m, f_{p} AS f, n_{p} AS n FROM wd" for p in PARAMS)})"""


_BEST_HSS = f"GREATEST({HSS.format(h='h', m='m', f='f', n='n')}, {HSS.format(h='m', m='h', f='n', n='f')})"


@query("bootstrap_skill_bounds", "K9", sql("v_obs v_points", f"""{events_cte()}, {draw_ctes('is_sta', 1000, 100, '>')}
SELECT param, ROUND(QUANTILE_CONT({_BEST_HSS}, 0.025), 6) + 0E0 AS lower, ROUND(QUANTILE_CONT({_BEST_HSS}, 0.975), 6) + 0E0 AS upper, COUNT(*) AS replicates FROM c GROUP BY 1"""))
def _(t):
    out = K.bootstrap_hss_bounds(_events(t), PARAMS, "is_sta", _limits(t), 1000, 100)
    return out.select("param", r6("lower").alias("lower"), r6("upper").alias("upper"), "replicates")


NULL_SHARES = [round(10 ** (-3 * i / 19), 6) for i in range(20)]  # 1 down to a thousandth, evenly on a log scale


@query("skill_by_share_of_null_events", "K10", sql("v_obs v_points", f"""{events_cte()}, {draw_ctes('is_sta', 1000, None, '>', NULL_SHARES)}
SELECT share, param, ROUND(QUANTILE_CONT({_BEST_HSS}, 0.025), 6) + 0E0 AS lower, ROUND(QUANTILE_CONT({_BEST_HSS}, 0.975), 6) + 0E0 AS upper FROM c GROUP BY 1, 2"""))
def _(t):
    out = K.bootstrap_hss_bounds(_events(t), PARAMS, "is_sta", _limits(t), 1000, None, by=NULL_SHARES)
    return out.select("share", "param", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("bootstrap_detection_bounds", "K11", sql("v_obs v_points", f"""{events_cte()}, {draw_ctes('is_sta', 1000, 100, '>=')}
SELECT param, ROUND(QUANTILE_CONT(h / CAST(h + m AS DOUBLE), 0.025), 6) AS lower, ROUND(QUANTILE_CONT(h / CAST(h + m AS DOUBLE), 0.975), 6) AS upper FROM c GROUP BY 1"""))
def _(t):
    out = K.bootstrap_pod_bounds(_events(t), PARAMS, "is_sta", _limits(t), 1000, 100)
    return out.select("param", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("bootstrap_auc_bounds", "K8")  # binomial draws have no SQL; the tests compare them with plain resampling
def _(t):
    out = K.bootstrap_auc(_events(t), PARAMS, "is_sta", 1000)
    return out.select("param", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("daily_condition_test", "K12,J24", sql("v_points v_obs", """
d AS (SELECT loc_id, CAST(time AS DATE) AS day, MAX(s06) s06, MAX(dcape) dcape, MAX(ml_cape) ml_cape, MAX(umean06 * 3) mlm FROM v_points GROUP BY 1, 2),
e AS (SELECT loc_id, CAST(gust_time AS DATE) AS day, MAX(is_sta) AS event FROM v_obs GROUP BY 1, 2),
r AS (SELECT event, (s06 >= 30 AND dcape < 500 AND mlm >= 26) OR (ml_cape > 120 AND dcape > 350 AND mlm < 26) AS cond FROM d JOIN e USING (loc_id, day)),
c AS (SELECT SUM(CASE WHEN event = 1 AND cond THEN 1 ELSE 0 END) h, SUM(CASE WHEN event = 1 AND NOT cond THEN 1 ELSE 0 END) m, SUM(CASE WHEN event = 0 AND cond THEN 1 ELSE 0 END) f, SUM(CASE WHEN event = 0 AND NOT cond THEN 1 ELSE 0 END) n FROM r)
SELECT CAST(h AS BIGINT) AS hits, CAST(f AS BIGINT) AS false_alarms, ROUND(h / CAST(h + m AS DOUBLE), 6) AS pod, ROUND(f / CAST(f + n AS DOUBLE), 6) AS pofd, ROUND(h / CAST(h + m + f AS DOUBLE), 6) AS csi FROM c"""))
def _(t):
    env = t.points.withColumn("mlm", F.col("umean06") * 3)
    d = daily(env, ["loc_id"], "time", {c: F.max(c) for c in ("s06", "dcape", "ml_cape", "mlm")})
    e = daily(t.obs, ["loc_id"], "gust_time", {"event": F.max("is_sta")})
    rows = d.join(e, ["loc_id", "day"])
    out = K.rates(K.counts_at(rows, [], X.conditional_wind("s06", "ml_cape", "dcape", "mlm") == 1, "event"))
    return out.select("hits", "false_alarms", *[r6(c).alias(c) for c in ("pod", "pofd", "csi")])


def _steps(first, stop, by):
    return [first + by * i for i in range(round((stop - first) / by))]


GRID = {
    "sf": {"ml_cape": [-1, 0], "s06": _steps(25, 40, 5), "dcape_below": _steps(250, 800, 50), "dcape_above": [-1, 0]},
    "mf": {"ml_cape": _steps(0, 425, 25), "dcape": _steps(0, 525, 25)},
    "w": _steps(20, 32.5, 2.5),
}


@query("conditional_threshold_search", "K13", sql("v_obs v_points", f"""{events_cte()}, r AS (SELECT ml_cape, s06, dcape, umean06 * 3 AS mlm, is_sta AS e FROM ev),
g AS (SELECT * FROM {' CROSS JOIN '.join(f"(VALUES {', '.join(f'({v}E0)' for v in vs)}) t{n}({n})" for n, vs in (('wind', GRID['w']), ('sf_ml', GRID['sf']['ml_cape']), ('sf_s06', GRID['sf']['s06']), ('sf_dcape_below', GRID['sf']['dcape_below']), ('sf_dcape_above', GRID['sf']['dcape_above']), ('mf_ml', GRID['mf']['ml_cape']), ('mf_dcape', GRID['mf']['dcape'])))}),
z AS (SELECT SUM(e) ne, COUNT(*) - SUM(e) no FROM r),
h AS (SELECT wind, sf_ml, sf_s06, sf_dcape_below, sf_dcape_above, mf_ml, mf_dcape, SUM(e) hits, SUM(1 - e) fa FROM g JOIN r ON (ml_cape > sf_ml AND s06 >= sf_s06 AND dcape < sf_dcape_below AND mlm >= wind AND dcape > sf_dcape_above) OR (ml_cape > mf_ml AND dcape > mf_dcape AND mlm < wind) GROUP BY ALL),
o AS (SELECT g.*, CAST(COALESCE(hits, 0) AS BIGINT) AS hits, CAST(COALESCE(fa, 0) AS BIGINT) AS false_alarms, COALESCE(hits, 0) / CAST(ne AS DOUBLE) AS hit_rate, COALESCE(fa, 0) / CAST(no AS DOUBLE) AS fa_rate, COALESCE(hits, 0) / CAST(ne + COALESCE(fa, 0) AS DOUBLE) AS csi
FROM g LEFT JOIN h USING (wind, sf_ml, sf_s06, sf_dcape_below, sf_dcape_above, mf_ml, mf_dcape), z)
SELECT * REPLACE (ROUND(hit_rate, 6) AS hit_rate, ROUND(fa_rate, 6) AS fa_rate, ROUND(csi, 6) AS csi), csi = MAX(csi) OVER () AS best, hit_rate > 0.6E0 AND fa_rate < 0.1E0 AS passes FROM o"""))
def _(t):
    ev = _events(t).withColumn("mlm", F.col("umean06") * 3)
    out = K.conditional_grid_search(ev, "is_sta", GRID["sf"], GRID["mf"], GRID["w"])
    return out.withColumns({c: r6(c) for c in ("hit_rate", "fa_rate", "csi")})


@query("discriminant_curve_counts", "K14", sql("v_obs v_points", f"""{events_cte()}, l AS (SELECT s06, is_sta AS e, CASE WHEN ml_cape > 0 THEN -4 / LN(10) * LN(ml_cape) + 26 ELSE CAST('inf' AS DOUBLE) END AS y FROM ev)
SELECT CAST(SUM(CASE WHEN s06 > y AND e = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(SUM(CASE WHEN s06 < y AND e = 1 THEN 1 ELSE 0 END) AS BIGINT) AS misses,
 CAST(SUM(CASE WHEN s06 > y AND e = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms, CAST(SUM(CASE WHEN s06 < y AND e = 0 THEN 1 ELSE 0 END) AS BIGINT) AS correct_negatives FROM l"""))
def _(t):
    return K.curve_counts(_events(t), "ml_cape", "s06", "is_sta", (10.0, 26.0), (100.0, 22.0), "log")


CLASS = "CASE WHEN tc = 1 THEN 'cyclone' WHEN lightning >= 2 THEN 'convective' ELSE 'other' END"
PAIRS = f"pr AS (SELECT {CLASS} AS kind, o.wind_gust AS obs, m.umean06 + m.s06 / 7E0 AS model FROM (SELECT *, tc_affected AS tc FROM v_obs) o JOIN v_points m ON o.loc_id = m.loc_id AND m.time = date_trunc('hour', o.gust_time) WHERE o.wind_gust IS NOT NULL)"


def _pairs(t):
    ev = J.align_to_model(t.obs.where("wind_gust IS NOT NULL"), t.points, "loc_id", "gust_time", ["umean06", "s06"])
    kind = F.when(F.col("tc_affected") == 1, "cyclone").when(F.col("lightning") >= 2, "convective").otherwise("other")
    return ev.select(kind.alias("kind"), F.col("wind_gust").alias("obs"), (F.col("umean06") + F.col("s06") / 7.0).alias("model"))


@query("model_observation_statistics", "K15", sql("v_obs v_points", f"""{PAIRS}
SELECT kind, COUNT(*) AS n, ROUND(CORR(obs, model), 6) AS r, ROUND(AVG(model) / AVG(obs), 6) AS bias, ROUND(AVG(model - obs), 6) AS mean_difference, ROUND(SQRT(AVG((model - obs) * (model - obs))), 6) AS rmse,
 ROUND(REGR_SLOPE(model, obs), 6) AS slope, ROUND(REGR_INTERCEPT(model, obs), 6) AS intercept FROM pr GROUP BY 1"""))
def _(t):
    out = K.comparison_stats(_pairs(t), ["kind"], "obs", "model")
    return out.select("kind", "n", *[r6(c).alias(c) for c in ("r", "bias", "mean_difference", "rmse", "slope", "intercept")])


@query("quadratic_model_fit", "K15", sql("v_obs v_points", f"""{PAIRS},
a AS (SELECT kind, obs - AVG(obs) OVER (PARTITION BY kind) AS x, AVG(obs) OVER (PARTITION BY kind) AS mx, model AS y FROM pr),
s AS (SELECT kind, ANY_VALUE(mx) mx, CAST(COUNT(*) AS DOUBLE) n, SUM(x * x) s2, SUM(x * x * x) s3, SUM(x * x * x * x) s4, SUM(y) t0, SUM(x * y) t1, SUM(x * x * y) t2 FROM a GROUP BY 1),
q AS (SELECT *, (t2 * s2 * n - t0 * s2 * s2 - t1 * s3 * n) / (s4 * s2 * n - s2 * s2 * s2 - s3 * s3 * n) AS a FROM s), w AS (SELECT *, (t1 - a * s3) / s2 AS b, (t0 - a * s2) / n AS k FROM q)
SELECT kind, ROUND(a, 5) AS quad_2, ROUND(b - 2 * a * mx, 5) AS quad_1, ROUND(k - b * mx + a * mx * mx, 5) AS quad_0 FROM w"""))
def _(t):
    out = K.comparison_stats(_pairs(t), ["kind"], "obs", "model")
    return out.select("kind", *[r6(c, 5).alias(c) for c in ("quad_2", "quad_1", "quad_0")])


@query("rank_correlation", "K15", sql("v_obs v_points", f"""{PAIRS},
r AS (SELECT kind, RANK() OVER (PARTITION BY kind ORDER BY obs) + (COUNT(*) OVER (PARTITION BY kind, obs) - 1) / 2E0 AS a, RANK() OVER (PARTITION BY kind ORDER BY model) + (COUNT(*) OVER (PARTITION BY kind, model) - 1) / 2E0 AS b FROM pr)
SELECT kind, ROUND(CORR(a, b), 6) AS rho FROM r GROUP BY 1"""))
def _(t):
    return K.spearman(_pairs(t), ["kind"], "obs", "model").withColumn("rho", r6("rho"))


@query("proximity_definition_comparison", "K16", sql("v_obs v_points", ", ".join(
    f"{events_cte(m, 'ev' + m)}, {long_cte('is_sta', 'ev' + m, 'lg' + m)}, {sweep_ctes('pss', 'lg' + m, 'param', m, 1000)}" for m in ("floor", "floor2", "ceil")) + """
SELECT param, ROUND(a.score, 6) AS score_floor, ROUND(b.score, 6) AS score_floor2, ROUND(c.score, 6) AS score_ceil, CAST(ROW_NUMBER() OVER (ORDER BY a.score DESC NULLS LAST, param) AS INT) AS place
FROM bestfloor a FULL JOIN bestfloor2 b USING (param) FULL JOIN bestceil c USING (param)"""))
def _(t):
    tables = {m: K.best_thresholds(_long(_events(t, m), "is_sta"), ["param"], "value", "event", "pss") for m in ("floor", "floor2", "ceil")}
    out = K.join_scores(tables, ["param"], "floor")
    return out.select("param", *[r6(f"score_{m}").alias(f"score_{m}") for m in tables], "place")


@query("ranked_skill_table", "K17,F5", sql("v_obs v_points", ", ".join(
    f"{events_cte(m, 'ev' + m)}, {long_cte('is_sta', 'ev' + m, 'lg' + m)}, {sweep_ctes('pss', 'lg' + m, 'param', m, 1000)}" for m in ("floor", "ceil")) + """
SELECT param, ROUND(CASE WHEN param = 'umean06' THEN c.score ELSE a.score END, 6) AS score, ROUND(a.threshold, 6) AS threshold FROM bestfloor a FULL JOIN bestceil c USING (param)"""))
def _(t):
    a = K.best_thresholds(_long(_events(t), "is_sta"), ["param"], "value", "event", "pss")
    c = K.best_thresholds(_long(_events(t, "ceil"), "is_sta"), ["param"], "value", "event", "pss").select("param", F.col("score").alias("ceil_score"))
    out = a.join(c, "param", "full")
    s = F.when(F.col("param") == "umean06", F.col("ceil_score")).otherwise(F.col("score"))
    return out.select("param", r6(s).alias("score"), r6("threshold").alias("threshold")).orderBy(F.col("score").desc())


@query("top_predictors_union", "F1", sql("v_obs v_points", f"""{events_cte()}, {long_cte('is_sta')},
a AS (SELECT 'corr' AS s, param, ABS(CORR(value, event)) AS x FROM lg GROUP BY 2 UNION ALL SELECT 'gap', param, ABS(AVG(CASE WHEN event = 1 THEN value END) / AVG(value) - 1) FROM lg GROUP BY 2)
SELECT DISTINCT param FROM (SELECT * FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY s ORDER BY x DESC, param) <= 2)"""))
def _(t):
    from squallframe.operators.learn import top_by_score

    long = _long(_events(t), "is_sta")
    g = long.groupBy("param").agg(
        F.abs(F.corr("value", "event")).alias("corr"), F.abs(F.avg(F.when(F.col("event") == 1, F.col("value"))) / F.avg("value") - 1).alias("gap")
    )
    return top_by_score(g.unpivot(["param"], ["corr", "gap"], "s", "x"), "s", "x", "param", 2)
