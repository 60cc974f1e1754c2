"""Vertical-profile queries (I) and the sorts on levels (F3, F4, F6)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from squallframe.functions import composites as X
from squallframe.functions import thermo as T
from squallframe.operators import profile as P
from squallframe.operators import sequence as E
from squallframe.plans.registry import query, r6, sql

VARS = ["ta", "dp", "ua", "va", "te", "q", "vo"]
_ES = "(6.112E0 * EXP(17.67E0 * {t} / ({t} + 243.5E0)))"
_ED = _ES.format(t="dp")
_R = f"(0.622E0 * {_ED} / (p - {_ED}))"
_LCL = "(56 + 1 / (1 / (dp + 273.15E0 - 56) + LN((ta + 273.15E0) / (dp + 273.15E0)) / 800E0))"
_TE = f"(ta + 273.15E0) * POW(1000 / (p - {_ED}), 0.2857142857142857E0) * POW((ta + 273.15E0) / {_LCL}, 0.28E0 * {_R}) * EXP({_R} * (1 + 0.448E0 * {_R}) * (3036 / {_LCL} - 1.78E0))"
LV = f"lv AS (SELECT col_id, lev, p, hgt AS z, ta, dp, ua, va, {_TE} AS te, {_R} AS q, (va + 3) * 1E-5 / 1.1E0 AS vo FROM v_levels)"
UP = (
    LV + ", up AS (SELECT *, LEAD(p) OVER w AS p_up, LEAD(z) OVER w AS z_up, "
    + ", ".join(f"LEAD({c}) OVER w AS {c}_up" for c in VARS)
    + ", ROW_NUMBER() OVER w AS k, LEAD(p) OVER w IS NULL AS top FROM lv WINDOW w AS (PARTITION BY col_id ORDER BY p DESC))"
)


def _levels(t):
    return t.levels.select(
        "col_id", "lev", "p", F.col("hgt").alias("z"), "ta", "dp", "ua", "va",
        T.equivalent_potential_temperature("ta", "dp", "p").alias("te"),
        T.mixing_ratio_from_dewpoint("dp", "p").alias("q"),
        ((F.col("va") + 3) * 1e-5 / 1.1).alias("vo"),
    )


def _up(t):
    return P.mark_extremes(P.prepare(_levels(t), ["col_id"], VARS), ["col_id"], "te", 0.0, 2500.0)


def z_sql(v, h, top=False, low=True):
    parts = [f"MAX(CASE WHEN z = {h} THEN {v} END)"]
    if low:
        parts.append(f"MAX(CASE WHEN k = 1 AND z >= {h} THEN {v} END)")
    if top:
        parts.append(f"MAX(CASE WHEN top AND z <= {h} THEN {v} END)")
    parts.append(f"MAX(CASE WHEN z < {h} AND z_up > {h} THEN {v} + ({v}_up - {v}) * ({h} - z) / (z_up - z) END)")
    return f"COALESCE({', '.join(parts)})"


def p_sql(v, h, top=False):
    tops = f"MAX(CASE WHEN top AND p >= {h} THEN {v} END), " if top else ""
    return (
        f"COALESCE(MAX(CASE WHEN p = {h} THEN {v} END), MAX(CASE WHEN k = 1 AND p <= {h} THEN {v} END), {tops}"
        f"MAX(CASE WHEN p > {h} AND p_up < {h} THEN {v} + ({v}_up - {v}) * ({h} - p) / (p_up - p) END))"
    )


def m_sql(v, cond):
    """Mass-weighted mean; ``cond`` uses {z} and {p}."""
    a, b = cond.format(z="z", p="p"), cond.format(z="z_up", p="p_up")
    return (
        f"CASE WHEN COUNT(CASE WHEN {a} THEN 1 END) = 1 THEN MAX(CASE WHEN {a} THEN {v} END) ELSE COALESCE(SUM(CASE WHEN {a} AND {b} THEN ({v} + {v}_up) * (p_up - p) END), 0)"
        f" / (2 * NULLIF(MIN(CASE WHEN {a} THEN p END) - MAX(CASE WHEN {a} THEN p END), 0)) END"
    )


def profile(name, covers, outputs):
    """One query of per-column aggregates; outputs {column: (function giving the Spark aggregate, SQL aggregate)}."""
    body = ", ".join(f"ROUND(CAST({s} AS DOUBLE), 6) + 0E0 AS {n}" for n, (_, s) in outputs.items())

    @query(name, covers, sql("v_levels", f"{UP} SELECT col_id, {body} FROM up GROUP BY 1"))
    def _(t):
        return _up(t).groupBy("col_id").agg(*[r6(c().cast("double")).alias(n) for n, (c, _) in outputs.items()])


@query("surface_row_insertion", "I1,F6,G1", sql("v_levels", """
s AS (SELECT col_id, 0 AS lev, 950E0 AS p, MAX(ta) + 1 AS ta FROM v_levels GROUP BY 1),
a AS (SELECT col_id, lev, p, ta FROM v_levels UNION ALL SELECT * FROM s)
SELECT col_id, CAST(lev AS INT) AS lev, p, ROUND(ta, 6) AS ta, CAST(ROW_NUMBER() OVER (PARTITION BY col_id ORDER BY p DESC, lev DESC) AS INT) AS k FROM a"""))
def _(t):
    levels = t.levels.select("col_id", "lev", "p", "ta")
    surface = levels.groupBy("col_id").agg(F.lit(950.0).alias("p"), (F.max("ta") + 1).alias("ta"))
    rows = P.insert_surface(levels, surface, ["col_id"])
    return rows.select("col_id", "lev", "p", r6("ta").alias("ta"), F.row_number().over(P.column_window(["col_id"], "lev")).alias("k"))


profile("interpolation_to_height", "I2", {
    "ta_500": (lambda: P.at_height("ta", 500.0), z_sql("ta", 500)),
    "ua_1050": (lambda: P.at_height("ua", 1050.0), z_sql("ua", 1050)),
    "va_1777": (lambda: P.at_height("va", 1777.0), z_sql("va", 1777)),
    "dp_0": (lambda: P.at_height("dp", 0.0), z_sql("dp", 0)),
})
profile("interpolation_to_pressure", "I3,I12", {
    "ta_850": (lambda: P.at_pressure("ta", 850.0), p_sql("ta", 850)),
    "ua_925": (lambda: P.at_pressure("ua", 925.0), p_sql("ua", 925)),
    "dpd_800": (lambda: P.at_pressure("ta", 800.0) - P.at_pressure("dp", 800.0), f"{p_sql('ta', 800)} - {p_sql('dp', 800)}"),
})
_H = "MIN(CASE WHEN {v} = {x} THEN z WHEN ({v} - {x}) * ({v}_up - {x}) <= 0 AND {v} <> {v}_up THEN z + (z_up - z) * ({x} - {v}) / ({v}_up - {v}) END)"
profile("height_of_value", "I4", {
    "melting": (lambda: P.height_of("ta", 15.0), _H.format(v="ta", x="15")),
    "dry": (lambda: P.height_of("dp", 8.0), _H.format(v="dp", x="8")),
})
_C1 = "({z} >= 300 AND {z} <= 2000)"
_C2 = "({p} <= 950 AND {p} >= 760 AND {p} <= 1000)"
profile("layer_means", "I5,I6", {
    "ta_mass": (lambda: P.mass_mean("ta", P.between_heights(300.0, 2000.0)), m_sql("ta", _C1)),
    "ua_plain": (lambda: P.plain_mean("ua", P.between_heights(300.0, 2000.0)), "AVG(CASE WHEN z >= 300 AND z <= 2000 THEN ua END)"),
    "dp_mass_p": (lambda: P.mass_mean("dp", P.between_pressures(950.0, 760.0, 1000.0)), m_sql("dp", _C2)),
    "va_plain_p": (lambda: P.plain_mean("va", P.between_pressures(950.0, 760.0, 1000.0)), "AVG(CASE WHEN p <= 950 AND p >= 760 AND p <= 1000 THEN va END)"),
})
profile("layer_minimum", "I7", {
    "dp_min": (lambda: P.layer_min("dp", P.between_heights(0.0, 1500.0)), "MIN(CASE WHEN z >= 0 AND z <= 1500 THEN dp END)"),
})


def _du(c, b, t):
    return f"({z_sql(c, t)} - {z_sql(c, b)})"


profile("bulk_shear", "I8", {
    "s02": (lambda: P.shear("ua", "va", 0.0, 2000.0), f"SQRT(POW({_du('ua', 0, 2000)}, 2) + POW({_du('va', 0, 2000)}, 2))"),
    "u_part": (lambda: P.shear_components("ua", "va", 500.0, 1500.0)[0], _du("ua", 500, 1500)),
    "pressure_form": (lambda: P.shear_pressure("ua", "va", 1000.0, 800.0),
                      f"SQRT(POW({p_sql('ua', 800)} - {p_sql('ua', 1000)}, 2) + POW({p_sql('va', 800)} - {p_sql('va', 1000)}, 2))"),
})

_MU, _MV = "AVG(CASE WHEN z >= 0 AND z <= 2000 THEN ua END)", "AVG(CASE WHEN z >= 0 AND z <= 2000 THEN va END)"
_SU, _SV = _du("ua", 0, 2000), _du("va", 0, 2000)
_SC = f"(7.5E0 / NULLIF(SQRT(POW({_SU}, 2) + POW({_SV}, 2)), 0))"
_PAIR = "z >= 0 AND z <= 1500 AND z_up >= 0 AND z_up <= 1500"


profile("storm_motion", "I10", {
    "u_right": (lambda: P.storm_motion("ua", "va", 2000.0)["u_right"], f"{_MU} + {_SC} * {_SV}"),
    "v_right": (lambda: P.storm_motion("ua", "va", 2000.0)["v_right"], f"{_MV} - {_SC} * {_SU}"),
    "u_left": (lambda: P.storm_motion("ua", "va", 2000.0)["u_left"], f"{_MU} - {_SC} * {_SV}"),
    "v_left": (lambda: P.storm_motion("ua", "va", 2000.0)["v_left"], f"{_MV} + {_SC} * {_SU}"),
})


@query("lapse_rates", "I9", sql("v_levels", f"""{UP},
g AS (SELECT col_id, {z_sql('ta', 0)} AS t0, {z_sql('ta', 3000, True, False)} AS t3, {z_sql('ta', 1500, True, False)} AS t15, {p_sql('ta', 775)} AS tp, {p_sql('ta', 975)} AS tb, {p_sql('z', 775)} AS zp, {p_sql('z', 975)} AS zb FROM up GROUP BY 1)
SELECT col_id, ROUND(-(t3 - t0) / 3000E0 * 1000, 6) + 0E0 AS lr_03, ROUND(-(t15 - t0) / 1500E0 * 1000, 6) + 0E0 AS lr_0_15, ROUND(-(tp - tb) / NULLIF((zp - zb) / 1000, 0), 6) + 0E0 AS lr_p FROM g"""))
def _(t):
    up = _up(t)
    a = up.groupBy("col_id").agg(
        r6(P.lapse_rate_height("ta", 0.0, 3000.0)).alias("lr_03"),
        r6(P.lapse_rate_height("ta", 0.0, 1500.0)).alias("lr_0_15"),
        P.at_pressure("ta", 775.0).alias("tp"), P.at_pressure("ta", 975.0).alias("tb"),
        P.at_pressure("z", 775.0).alias("zp"), P.at_pressure("z", 975.0).alias("zb"),
    )
    lr = -(F.col("tp") - F.col("tb")) / F.nullif((F.col("zp") - F.col("zb")) / 1000, F.lit(0.0))
    return a.select("col_id", "lr_03", "lr_0_15", r6(lr).alias("lr_p"))


@query("storm_relative_helicity", "I11,J19", sql("v_levels", f"""{UP}, g AS (SELECT col_id, {_MU} + {_SC} * {_SV} AS ur, {_MV} - {_SC} * {_SU} AS vr, {_MU} - {_SC} * {_SV} AS ul, {_MV} + {_SC} * {_SU} AS vl FROM up GROUP BY 1)
SELECT up.col_id, ROUND(ABS(SUM(CASE WHEN {_PAIR} THEN (ua_up - ul) * (va - vl) - (ua - ul) * (va_up - vl) END)), 6) + 0E0 AS srh_left,
 ROUND(ABS(SUM(CASE WHEN {_PAIR} THEN (ua_up - ur) * (va - vr) - (ua - ur) * (va_up - vr) END)), 6) + 0E0 AS srh_right FROM up JOIN g ON up.col_id = g.col_id GROUP BY 1"""))
def _(t):
    h = P.storm_helicity("ua", "va", 0.0, 1500.0, 2000.0)
    return _up(t).groupBy("col_id").agg(r6(h["left"]).alias("srh_left"), r6(h["right"]).alias("srh_right"))


@query("totals_and_k_index", "I13", sql("v_levels", f"""{UP}, g AS (SELECT col_id, {p_sql('ta', 950)} AS a, {p_sql('ta', 775)} AS b, {p_sql('ta', 725)} AS c, {p_sql('dp', 950)} AS d, {p_sql('dp', 775)} AS e FROM up GROUP BY 1)
SELECT col_id, ROUND(a - c, 6) + 0E0 AS v_totals, ROUND(d - c, 6) + 0E0 AS c_totals, ROUND((a - c) + (d - c), 6) + 0E0 AS t_totals, ROUND(CASE WHEN a - c + d - (b - e) < 0 THEN 0 ELSE a - c + d - (b - e) END, 6) + 0E0 AS k_index FROM g"""))
def _(t):
    g = _up(t).groupBy("col_id").agg(
        P.at_pressure("ta", 950.0).alias("a"), P.at_pressure("ta", 775.0).alias("b"), P.at_pressure("ta", 725.0).alias("c"),
        P.at_pressure("dp", 950.0).alias("d"), P.at_pressure("dp", 775.0).alias("e"),
    )
    return g.select(
        "col_id", r6(F.col("a") - F.col("c")).alias("v_totals"), r6(F.col("d") - F.col("c")).alias("c_totals"),
        r6(X.total_totals("a", "d", "c")).alias("t_totals"), r6(X.k_index("a", "c", "d", F.col("b") - F.col("e"))).alias("k_index"),
    )


profile("precipitable_water", "I14", {
    "pwat": (lambda: P.precipitable_water("q", 760.0), "SUM(CASE WHEN p >= 760 AND p_up >= 760 THEN (q + q_up) * 1000 / 2 * (p - p_up) * 0.00040173E0 END)"),
})
_IN = "z >= 0 AND z <= 2500"
profile("theta_e_difference", "I15", {
    "te_diff": (lambda: P.theta_e_difference("te", 2500.0),
                f"CASE WHEN ARG_MIN(k, te) FILTER ({_IN}) < ARG_MAX(k, te) FILTER ({_IN}) THEN 0E0 ELSE MAX(te) FILTER ({_IN}) - MIN(te) FILTER ({_IN}) END"),
})
profile("theta_e_index", "I16", {
    "tei": (lambda: P.theta_e_index("te", P.at_height("te", 0.0), 1000.0, 200.0),
            f"CASE WHEN {z_sql('te', 0)} IS NULL AND MIN(te) FILTER (p <= 1000 AND p >= 800) IS NULL THEN NULL ELSE GREATEST({z_sql('te', 0)} - MIN(te) FILTER (p <= 1000 AND p >= 800), 0E0) END"),
})


@query("theta_e_gradient_times_omega", "I17", sql("v_levels", f"""{LV}
SELECT c.col_id, m.maxtevv FROM (SELECT DISTINCT col_id FROM lv) c LEFT JOIN (
 SELECT a.col_id, ROUND(MAX((b.te - a.te) / ((b.z - a.z) / 1000) * b.va), 6) + 0E0 AS maxtevv FROM lv a JOIN lv b ON a.col_id = b.col_id
 WHERE a.z >= 0 AND a.z <= 1000 AND b.z >= 0 AND b.z <= 2600 AND (b.z - a.z) / 1000 >= 0.25 GROUP BY 1) m ON c.col_id = m.col_id"""))
def _(t):
    return _levels(t).groupBy("col_id").agg(r6(P.max_theta_e_gradient("te", "va", 1000.0, 2600.0)).alias("maxtevv"))


_L = "({{z}} >= {a} AND {{z}} <= {b})"
profile("updraft_helicity", "I18", {
    "uh": (lambda: P.updraft_helicity("vo", "va", 0, 3000),
           "(" + " + ".join(f"({m_sql('vo', _L.format(a=a, b=a + 1000))}) * ({m_sql('va', _L.format(a=a, b=a + 1000))})" for a in (0, 1000, 2000)) + ") * 1000"),
})


def _surface(t):
    """One row per (model, month, i, j): a dense small grid for horizontal derivatives."""
    return t.field.groupBy("model", F.month("time").alias("month"), "i", "j", "lat", "lon").agg(
        F.avg("v").alias("u"), F.max("v").alias("w"), F.avg(F.col("v") * F.col("v")).alias("te")
    )


GRID = """
g AS (SELECT model, CAST(MONTH(time) AS INT) AS month, i, j, lat, lon, AVG(v) AS u, MAX(v) AS w, AVG(v * v) AS te, RADIANS(lon) * 6373000E0 * COS(RADIANS(lat)) AS mx, RADIANS(lat) * 6373000E0 AS my FROM v_field GROUP BY 1, 2, 3, 4, 5, 6)"""


def _d_sql(v, x, w, n):
    """Uniform spacing: central inside, three-point one-sided at the two ends of a line of n points."""
    step = f"((MAX({x}) OVER {w}p - MIN({x}) OVER {w}p) / {n - 1})"
    order = "j" if w == "r" else "i"
    return (
        f"CASE WHEN {order} = 0 THEN (-3 * {v} + 4 * LEAD({v}, 1) OVER {w} - LEAD({v}, 2) OVER {w}) / (2 * {step}) "
        f"WHEN {order} = {n - 1} THEN (3 * {v} - 4 * LAG({v}, 1) OVER {w} + LAG({v}, 2) OVER {w}) / (2 * {step}) ELSE (LEAD({v}) OVER {w} - LAG({v}) OVER {w}) / (2 * {step}) END"
    )


DERIV = GRID + ", d AS (SELECT *, " + ", ".join(
    f"{_d_sql(v, x, w, n)} AS {v}_{s}" for v in ("u", "w", "te") for x, w, n, s in (("mx", "r", 5, "dx"), ("my", "c", 6, "dy"))
) + " FROM g WINDOW r AS (PARTITION BY model, month, i ORDER BY j), c AS (PARTITION BY model, month, j ORDER BY i), rp AS (PARTITION BY model, month, i), cp AS (PARTITION BY model, month, j))"


@query("horizontal_derivatives", "I19", sql("v_field", DERIV + """
SELECT model, month, i, j, ROUND((u_dx + w_dy) * 1E5, 5) + 0E0 AS div5, ROUND((w_dx - u_dy) * 1E5, 5) + 0E0 AS vo5, ROUND((u_dx - w_dy) * 1E5, 5) + 0E0 AS stretch5, ROUND((w_dx + u_dy) * 1E5, 5) + 0E0 AS shear5 FROM d"""))
def _(t):
    d = P.horizontal_derivatives(_surface(t), ["model", "month"], "i", "j", ["u", "w"])
    k = P.kinematic_terms("u", "w")
    names = {"div5": "divergence", "vo5": "vorticity", "stretch5": "stretching", "shear5": "shearing"}
    return d.select("model", "month", "i", "j", *[r6(k[c] * 1e5, 5).alias(n) for n, c in names.items()])


@query("frontogenesis_terms", "J21", sql("v_field", DERIV + """,
e AS (SELECT *, u_dx + w_dy AS div, w_dx - u_dy AS vor, u_dx - w_dy AS st, w_dx + u_dy AS sh, SQRT(te_dx * te_dx + te_dy * te_dy) AS mag FROM d),
f AS (SELECT *, SQRT(st * st + sh * sh) AS tot, 0.5 * ATAN2(sh, st) AS psi FROM e),
h AS (SELECT *, ASIN(LEAST(GREATEST((-te_dx * COS(psi) - te_dy * SIN(psi)) / NULLIF(mag, 0), -1), 1)) AS beta FROM f)
SELECT model, month, i, j, ROUND(0.5 * (tot - div) * 1E5, 4) + 0E0 AS icon, ROUND(SQRT(div * div + vor * vor + tot * tot) * 1E5, 4) + 0E0 AS vgt,
 ROUND(0.5 * mag * (tot * COS(2 * beta) - div) * 1.08E4 * 1E5, 4) + 0E0 AS f, ROUND(0.5 * mag * (vor + tot * SIN(2 * beta)) * 1.08E4 * 1E5, 4) + 0E0 AS fs FROM h"""))
def _(t):
    d = P.horizontal_derivatives(_surface(t), ["model", "month"], "i", "j", ["u", "w", "te"])
    d = d.withColumns(P.kinematic_terms("u", "w"))
    f = X.frontogenesis("te_dx", "te_dy", "divergence", "stretching", "shearing", "vorticity")
    return d.select("model", "month", "i", "j", *[r6(f[c], 4).alias(c) for c in ("icon", "vgt", "f", "fs")])


PARCEL = LV + ", pl AS (SELECT *, ua * 80 AS cape, (dp + 20) * 9 AS cin, z * 2 + lev AS el FROM lv)"


def _parcels(t):
    return _levels(t).withColumns(
        {"cape": F.col("ua") * 80, "cin": (F.col("dp") + 20) * 9, "el": F.col("z") * 2 + F.col("lev")}
    )


@query("most_unstable_parcel", "I20,F3", sql("v_levels", PARCEL + """
SELECT c.col_id, m.cape AS mu_cape, ROUND(m.cin, 6) AS mu_cin, m.el AS mu_el, COALESCE(s.cape, 0E0) AS sb_cape FROM (SELECT DISTINCT col_id FROM pl) c
LEFT JOIN (SELECT * FROM pl WHERE p <= 1000 AND p >= 800 QUALIFY ROW_NUMBER() OVER (PARTITION BY col_id ORDER BY cape DESC, p DESC) = 1) m ON c.col_id = m.col_id
LEFT JOIN (SELECT * FROM pl WHERE p = 1000) s ON c.col_id = s.col_id"""))
def _(t):
    rows = P.prepare(_parcels(t), ["col_id"], [])
    top = rows.groupBy("col_id").agg(
        P.most_unstable("cape", ["cin", "el"], F.lit(1000.0), 200.0).alias("m"),
        F.coalesce(F.max(F.when(F.col("p") == 1000.0, F.col("cape"))), F.lit(0.0)).alias("sb_cape"),
    )
    return top.select("col_id", F.col("m.cape").alias("mu_cape"), r6("m.cin").alias("mu_cin"), F.col("m.el").alias("mu_el"), "sb_cape")


@query("effective_layer_parcel", "I20,E13", sql("v_levels", PARCEL + f""",
a AS (SELECT *, cape >= 900 AND cin <= 370 AS c FROM pl), b AS (SELECT *, CASE WHEN c AND NOT COALESCE(LAG(c) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY col_id ORDER BY p DESC)),
r AS (SELECT *, c AND SUM(s) OVER (PARTITION BY col_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING) = 1 AS eff FROM b),
up AS (SELECT *, LEAD(eff) OVER w AS eff_up, LEAD(p) OVER w AS p_up, LEAD(ta) OVER w AS ta_up FROM r WINDOW w AS (PARTITION BY col_id ORDER BY p DESC))
SELECT col_id, (MIN(CASE WHEN eff THEN p END) + MAX(CASE WHEN eff THEN p END)) / 2 AS p_mid, (MIN(CASE WHEN eff THEN z END) + MAX(CASE WHEN eff THEN z END)) / 2 AS z_mid,
 ROUND({m_sql('ta', '{z}').replace('z_up', 'eff_up').replace('WHEN z ', 'WHEN eff ')}, 6) + 0E0 AS ta_mean, COUNT(CASE WHEN eff THEN 1 END) AS levels FROM up GROUP BY 1"""))
def _(t):
    rows = _parcels(t)
    run = E.first_run(rows.withColumn("_o", -F.col("p")), ["col_id"], "_o", (F.col("cape") >= 900) & (F.col("cin") <= 370))
    marked = rows.join(run.select("col_id", "lev", F.lit(True).alias("eff")), ["col_id", "lev"], "left").fillna({"eff": False})
    up = P.prepare(marked, ["col_id"], ["ta", "eff"])
    eff = lambda c: F.when(F.col("eff"), F.col(c))
    return up.groupBy("col_id").agg(
        ((F.min(eff("p")) + F.max(eff("p"))) / 2).alias("p_mid"), ((F.min(eff("z")) + F.max(eff("z"))) / 2).alias("z_mid"),
        r6(P.mass_mean_where("ta", F.col("eff"), F.col("eff_up"))).alias("ta_mean"), F.count(eff("p")).alias("levels"),
    )


@query("least_theta_e_level", "F4", sql("v_levels", LV + """
SELECT col_id, p AS level_p, ROUND(ta - dp, 6) AS spread FROM lv WHERE p <= 1000 AND 1000 - p <= 200 QUALIFY ROW_NUMBER() OVER (PARTITION BY col_id ORDER BY te, p DESC) = 1"""))
def _(t):
    rows = P.prepare(_levels(t), ["col_id"], []).withColumn("spread", F.col("ta") - F.col("dp"))
    picked = rows.groupBy("col_id").agg(P.least_theta_e("te", ["p", "spread"], F.lit(1000.0), 200.0).alias("m")).where("m IS NOT NULL")
    return picked.select("col_id", F.col("m.p").alias("level_p"), r6("m.spread").alias("spread"))


@query("buoyancy_integration", "I21", sql("v_levels", """
a AS (SELECT col_id, lev, p, hgt AS z, 9.81E0 * (dp + 8 - ta + ua / 4) / (ta + 273.15E0) AS b FROM v_levels),
c AS (SELECT *, GREATEST(b, 0) AS pos, LEAST(b, 0) AS neg, CASE WHEN p < 960 THEN LEAST(b, 0) ELSE 0 END AS down, MIN(CASE WHEN b > 0 THEN z END) OVER (PARTITION BY col_id) AS z0 FROM a),
d AS (SELECT *, LEAD(z) OVER w AS z_up, LEAD(pos) OVER w AS pos_up, LEAD(neg) OVER w AS neg_up, LEAD(down) OVER w AS down_up FROM c WINDOW w AS (PARTITION BY col_id ORDER BY p DESC))
SELECT col_id, ROUND(SUM((pos + pos_up) / 2 * (z_up - z)), 6) + 0E0 AS cape, ROUND(COALESCE(SUM(CASE WHEN z_up <= z0 THEN (neg + neg_up) / 2 * (z_up - z) END), 0), 6) + 0E0 AS cin, ROUND(-SUM((down + down_up) / 2 * (z_up - z)), 6) + 0E0 AS dcape FROM d GROUP BY 1"""))
def _(t):
    rows = _levels(t).select("col_id", "lev", "p", "z", "ta", (F.col("dp") + 8 + F.col("ua") / 4).alias("tp"))
    out = P.buoyancy_areas(rows, ["col_id"], "tp", "ta", F.lit(960.0))
    return out.select("col_id", *[r6(c).alias(c) for c in ("cape", "cin", "dcape")])


_ML = "({p} <= 1000 AND {p} >= 900)"
profile("mixed_layer_averages", "I22", {
    "ml_ta": (lambda: P.mass_mean("ta", P.between_pressures(1000.0, 900.0)), m_sql("ta", _ML)),
    "ml_q": (lambda: 1000 * P.mass_mean("q", P.between_pressures(1000.0, 900.0)), f"1000 * ({m_sql('q', _ML)})"),
    "ml_p": (lambda: P.mid_range("p", P.between_pressures(1000.0, 900.0)), "(MIN(CASE WHEN p <= 1000 AND p >= 900 THEN p END) + MAX(CASE WHEN p <= 1000 AND p >= 900 THEN p END)) / 2"),
    "ml_z": (lambda: P.mid_range("z", P.between_pressures(1000.0, 900.0)), "(MIN(CASE WHEN p <= 1000 AND p >= 900 THEN z END) + MAX(CASE WHEN p <= 1000 AND p >= 900 THEN z END)) / 2"),
})

ACCEPT = """ok AS (SELECT col_id FROM (SELECT col_id, p, LAG(p) OVER (PARTITION BY col_id ORDER BY p DESC) - p AS gap FROM v_levels) GROUP BY 1 HAVING COUNT(*) > 3 AND MIN(p) < 800 AND MAX(p) > 850 AND MAX(gap) < 120)"""


@query("sounding_acceptance", "I23", sql("v_levels", ACCEPT + " SELECT col_id FROM ok"))
def _(t):
    return P.accepted_soundings(t.levels, ["col_id"], 3, 800.0, 850.0, 120.0).select("col_id").distinct()


@query("sounding_indices", "I24", sql("v_levels", f"""{UP}, {ACCEPT},
g AS (SELECT up.col_id, {m_sql('ua', '({z} <= 1000)')} AS mu, {m_sql('va', '({z} <= 1000)')} AS mv, {z_sql('ua', 2500, True)} - {z_sql('ua', 0, True)} AS su, {z_sql('va', 2500, True)} - {z_sql('va', 0, True)} AS sv,
 {p_sql('ta', 850, True)} AS a, {p_sql('ta', 700, True)} AS c, {p_sql('dp', 850, True)} AS d FROM up JOIN ok ON up.col_id = ok.col_id GROUP BY 1)
SELECT col_id, ROUND(SQRT(mu * mu + mv * mv), 6) AS umean01, ROUND(SQRT(su * su + sv * sv), 6) AS shear, ROUND((a - c) + (d - c), 6) + 0E0 AS totals FROM g"""))
def _(t):
    good = P.accepted_soundings(_levels(t), ["col_id"], 3, 800.0, 850.0, 120.0)
    low = lambda z, p: z <= 1000.0
    diff = lambda c: P.at_height(c, 2500.0, True) - P.at_height(c, 0.0, True)
    g = P.prepare(good, ["col_id"], VARS).groupBy("col_id").agg(
        P.mass_mean("ua", low).alias("mu"), P.mass_mean("va", low).alias("mv"), diff("ua").alias("su"), diff("va").alias("sv"),
        P.at_pressure("ta", 850.0, True).alias("a"), P.at_pressure("ta", 700.0, True).alias("c"), P.at_pressure("dp", 850.0, True).alias("d"),
    )
    return g.select(
        "col_id", r6(P.speed("mu", "mv")).alias("umean01"), r6(P.speed("su", "sv")).alias("shear"), r6(X.total_totals("a", "d", "c")).alias("totals")
    )


@query("older_wind_means", "I25", sql("v_levels", f"""{UP},
n AS (SELECT col_id, ARG_MIN(k, ABS(z - 300) * 100 + k) AS kb, ARG_MIN(k, ABS(z - 2000) * 100 + k) AS kt FROM up GROUP BY 1),
g AS (SELECT up.col_id, AVG(CASE WHEN k BETWEEN kb AND kt THEN ua END) AS near, SUM(CASE WHEN z <= 2000 THEN ua * p / (ta + 273.15E0) END) / NULLIF(SUM(CASE WHEN z <= 2000 THEN p / (ta + 273.15E0) END), 0) AS dense FROM up JOIN n ON up.col_id = n.col_id GROUP BY 1)
SELECT col_id, ROUND(near, 6) AS nearest_mean, ROUND(dense, 6) AS density_mean FROM g"""))
def _(t):
    up = _up(t).withColumn("rho", T.density("ta", "p"))
    return up.groupBy("col_id").agg(
        r6(P.mean_between_nearest("ua", 300.0, 2000.0)).alias("nearest_mean"),
        r6(P.density_mean("ua", "rho", lambda z, p: z <= 2000.0)).alias("density_mean"),
    )


@query("critical_angle", "I25", sql("v_levels", f"""{UP},
g AS (SELECT col_id, {z_sql('ua', 800)} - {z_sql('ua', 0)} AS su, {z_sql('va', 800)} - {z_sql('va', 0)} AS sv, {_MU} - {z_sql('ua', 0)} AS ru, {_MV} - {z_sql('va', 0)} AS rv FROM up GROUP BY 1)
SELECT col_id, ROUND(DEGREES(ACOS(LEAST(GREATEST((su * ru + sv * rv) / NULLIF(SQRT(su * su + sv * sv) * SQRT(ru * ru + rv * rv), 0), -1), 1))), 4) + 0E0 AS angle FROM g"""))
def _(t):
    deep = P.between_heights(0.0, 2000.0)
    angle = P.critical_angle("ua", "va", P.plain_mean("ua", deep), P.plain_mean("va", deep), P.at_height("ua", 0.0), P.at_height("va", 0.0), 800.0)
    return _up(t).groupBy("col_id").agg(F.round(angle, 4).alias("angle"))


def _column_diagnostics():
    """A column's diagnostics in one pass: every output is an aggregate over the same pairs of levels."""
    deep = P.between_heights(0.0, 2500.0)
    motion = P.storm_motion("ua", "va", 2500.0)
    srh = P.storm_helicity("ua", "va", 0.0, 1500.0, 2500.0)
    out = {
        "melting": P.height_of("ta", 15.0), "q_melting": P.at_height("q", 1000.0), "pwat": P.precipitable_water("q", 760.0),
        "s01": P.shear("ua", "va", 0.0, 1000.0), "s03": P.shear("ua", "va", 0.0, 2500.0),
        "lr01": P.lapse_rate_height("ta", 0.0, 1000.0), "lr03": P.lapse_rate_height("ta", 0.0, 2500.0),
        "umean": P.speed(P.mass_mean("ua", deep), P.mass_mean("va", deep)), "te_mean": P.mass_mean("te", deep),
        "rh_low": P.layer_min("dp", P.between_heights(0.0, 1500.0)), "te_diff": P.theta_e_difference("te", 2500.0),
        "t850": P.at_pressure("ta", 850.0), "d850": P.at_pressure("dp", 850.0), "t725": P.at_pressure("ta", 725.0),
        "srh_left": srh["left"], "srh_right": srh["right"], "storm_speed": P.speed(motion["u_right"], motion["v_right"]),
    }
    return out


_UM, _VM = (m_sql(c, "({z} >= 0 AND {z} <= 2500)") for c in ("ua", "va"))
_M5, _N5 = (f"AVG(CASE WHEN z >= 0 AND z <= 2500 THEN {c} END)" for c in ("ua", "va"))
_S5U, _S5V = _du("ua", 0, 2500), _du("va", 0, 2500)
_K5 = f"(7.5E0 / NULLIF(SQRT(POW({_S5U}, 2) + POW({_S5V}, 2)), 0))"


@query("column_diagnostics", "I2,I3,I4,I6,I7,I8,I9,I10,I11,I14,I15,J19", sql("v_levels", f"""{UP},
g AS (SELECT col_id, {_H.format(v='ta', x='15')} AS melting, {z_sql('q', 1000)} AS q_melting, SUM(CASE WHEN p >= 760 AND p_up >= 760 THEN (q + q_up) * 1000 / 2 * (p - p_up) * 0.00040173E0 END) AS pwat,
 SQRT(POW({_du('ua', 0, 1000)}, 2) + POW({_du('va', 0, 1000)}, 2)) AS s01, SQRT(POW({_S5U}, 2) + POW({_S5V}, 2)) AS s03,
 -({z_sql('ta', 1000, True, False)} - {z_sql('ta', 0)}) AS lr01, -({z_sql('ta', 2500, True, False)} - {z_sql('ta', 0)}) / 2500E0 * 1000 AS lr03,
 SQRT(POW({_UM}, 2) + POW({_VM}, 2)) AS umean, {m_sql('te', '({z} >= 0 AND {z} <= 2500)')} AS te_mean, MIN(CASE WHEN z >= 0 AND z <= 1500 THEN dp END) AS rh_low,
 CASE WHEN ARG_MIN(k, te) FILTER ({_IN}) < ARG_MAX(k, te) FILTER ({_IN}) THEN 0E0 ELSE MAX(te) FILTER ({_IN}) - MIN(te) FILTER ({_IN}) END AS te_diff,
 {p_sql('ta', 850)} AS t850, {p_sql('dp', 850)} AS d850, {p_sql('ta', 725)} AS t725,
 {_M5} + {_K5} * {_S5V} AS ur, {_N5} - {_K5} * {_S5U} AS vr, {_M5} - {_K5} * {_S5V} AS ul, {_N5} + {_K5} * {_S5U} AS vl FROM up GROUP BY 1),
h AS (SELECT up.col_id, ABS(SUM(CASE WHEN {_PAIR} THEN (ua_up - ul) * (va - vl) - (ua - ul) * (va_up - vl) END)) AS srh_left, ABS(SUM(CASE WHEN {_PAIR} THEN (ua_up - ur) * (va - vr) - (ua - ur) * (va_up - vr) END)) AS srh_right FROM up JOIN g ON up.col_id = g.col_id GROUP BY 1)
SELECT g.col_id, {', '.join(f'ROUND(g.{c}, 5) + 0E0 AS {c}' for c in ('melting', 'q_melting', 'pwat', 's01', 's03', 'lr01', 'lr03', 'umean', 'te_mean', 'rh_low', 'te_diff', 't850', 'd850', 't725'))},
 ROUND(h.srh_left, 5) + 0E0 AS srh_left, ROUND(h.srh_right, 5) + 0E0 AS srh_right, ROUND(SQRT(ur * ur + vr * vr), 5) AS storm_speed FROM g JOIN h ON g.col_id = h.col_id"""))
def _(t):
    return _up(t).groupBy("col_id").agg(*[r6(c, 5).alias(n) for n, c in _column_diagnostics().items()])


@query("column_dependent_layers", "I2,I5,I6,I9", sql("v_levels", f"""{UP},
m AS (SELECT col_id, {_H.format(v='ta', x='15')} AS mh FROM up GROUP BY 1), u2 AS (SELECT up.*, mh FROM up JOIN m ON up.col_id = m.col_id),
g AS (SELECT col_id, ANY_VALUE(mh) AS mh, {z_sql('ta', 0)} AS t0, {z_sql('ta', 'mh', True, False)} AS t1, {z_sql('q', 'mh')} AS q, {m_sql('dp', '({z} >= 0 AND {z} <= mh)')} AS dp FROM u2 GROUP BY 1)
SELECT col_id, ROUND(mh, 5) + 0E0 AS melting, ROUND(-(t1 - t0) / NULLIF(mh, 0) * 1000, 5) + 0E0 AS lr_freezing, ROUND(q * 1000, 5) + 0E0 AS q_melting, ROUND(dp, 5) + 0E0 AS dp_mean FROM g"""))
def _(t):
    # the melting height is one value per column, put on its levels by a window on the same keys
    up = _up(t).withColumn("mh", P.height_of("ta", 15.0).over(Window.partitionBy("col_id")))
    top = F.col("mh")
    return up.groupBy("col_id").agg(
        r6(F.max(top), 5).alias("melting"), r6(P.lapse_rate_height("ta", 0.0, top), 5).alias("lr_freezing"),
        r6(P.at_height("q", top) * 1000, 5).alias("q_melting"), r6(P.mass_mean("dp", P.between_heights(0.0, top)), 5).alias("dp_mean"),
    )
