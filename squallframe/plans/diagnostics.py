"""From levels to indices: the registry of named diagnostics (section 2.17, I and J)."""
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.operators import diagnostics as D
from squallframe.plans.profile import _ED, _H, _R, _TE, m_sql, p_sql, z_sql
from squallframe.plans.registry import query, r6, sql

# The stand-in levels reach 3 km; these stretch them to 12 km and 280 hPa, and add parcels that start cooler and end warmer.
TALL = {
    "p": "1000E0 - 120E0 * (lev - 1)", "z": "500E0 * (lev - 1) + 250E0 * (lev - 1) * (lev - 1)", "ta": "ta - 8E0 * (lev - 1)", "dp": "dp - 8E0 * (lev - 1)", "ua": "ua + lev", "va": "va",
    "parcel_sb": "ta - 8E0 * (lev - 1) - 2E0 + 1.5E0 * (lev - 1)", "parcel_ml": "ta - 8E0 * (lev - 1) - 1E0 + lev - 1", "parcel_mu": "ta - 8E0 * (lev - 1) - 0.5E0 + 1.7E0 * (lev - 1)",
    "parcel_down": "ta - 8E0 * (lev - 1) - 3E0 + 0.25E0 * lev",
}
PAIRED = ["ta", "dp", "ua", "va", "te", "q", "rh", *[f"{k}_{x}" for x in (*D.PARCELS, "down") for k in ("lift", "sink")]]


def _lift(x):
    return f"9.81E0 * (parcel_{x} - ta) / (ta + 273.15E0)"


_ES_T, _ES_D = ("6.112E0 * EXP(17.67E0 * {t} / ({t} + 243.5E0))".format(t=c) for c in ("ta", "dp"))
UP = f"""raw AS (SELECT col_id, lev, {', '.join(f'{e} AS {c}' for c, e in TALL.items())} FROM v_levels),
lv AS (SELECT *, {_TE} AS te, {_R} * 1000 AS q, {{rh}} AS rh, {', '.join(f'GREATEST({_lift(x)}, 0E0) AS lift_{x}, LEAST({_lift(x)}, 0E0) AS sink_{x}' for x in (*D.PARCELS, 'down'))} FROM raw),
pr AS (SELECT *, LEAD(p) OVER w AS p_up, LEAD(z) OVER w AS z_up, {', '.join(f'LEAD({c}) OVER w AS {c}_up' for c in PAIRED)}, ROW_NUMBER() OVER w AS k, LEAD(p) OVER w IS NULL AS top FROM lv WINDOW w AS (PARTITION BY col_id ORDER BY p DESC)),
mk AS (SELECT col_id AS c_, MAX(p) AS ps, {_H.format(v='ta', x='0')} AS melting_at, MAX(CASE WHEN k = 1 THEN 125 * (ta - dp) END) AS cloud_base, {', '.join(f'MIN(CASE WHEN lift_{x} > 0 THEN z END) AS free_{x}' for x in D.PARCELS)} FROM pr GROUP BY 1),
up AS (SELECT * FROM pr JOIN mk ON col_id = c_)"""


def _mean(c, low, high):
    return m_sql(c, f"({{z}} >= {low} AND {{z}} <= {high})")


def _speed(u, v):
    return f"SQRT(POW({u}, 2) + POW({v}, 2))"


def _wind(of):
    return _speed(of("ua"), of("va"))


def _shear(b, t):
    return _wind(lambda c: f"{z_sql(c, t)} - {z_sql(c, b)}")


def _lapse(b, t):
    return f"-({z_sql('ta', t, True, False)} - {z_sql('ta', b)}) / NULLIF({t} - {b}, 0) * 1000"


def _motion(side):
    mean = {c: f"AVG(CASE WHEN z >= 0 AND z <= 6000 THEN {c} END)" for c in ("ua", "va")}
    du, dv = (f"({z_sql(c, 6000)} - {z_sql(c, 0)})" for c in ("ua", "va"))
    k = f"(7.5E0 / NULLIF({_shear(0, 6000)}, 0))"
    a, b = ("+", "-") if side == "right" else ("-", "+")
    return f"({mean['ua']} {a} {k} * {dv})", f"({mean['va']} {b} {k} * {du})"


def _helicity(top, side):
    pair = f"z >= 0 AND z <= {top} AND z_up >= 0 AND z_up <= {top}"
    u, v = _motion(side)
    total = lambda e: f"SUM(CASE WHEN {pair} THEN {e} END)"
    return f"ABS({total('ua_up * va - ua * va_up')} - {v} * {total('ua_up - ua')} + {u} * {total('va_up - va')})"


def _lapse_p(b, t):
    return f"-({p_sql('ta', t)} - {p_sql('ta', b)}) / NULLIF(({p_sql('z', t)} - {p_sql('z', b)}) / 1000, 0)"


def _area(c):
    return f"({c} + {c}_up) / 2 * (z_up - z)"


def _columns():
    """SQL of the aggregates, by name."""
    out = {f"lr{b}{t}": _lapse(b * 1000, t * 1000) for b, t in ((0, 1), (0, 3), (1, 3), (2, 4), (3, 6), (3, 8))}
    out |= {f"lr{b}_{t}": _lapse_p(b, t) for b, t in ((700, 500), (850, 670), (750, 500))}
    out |= {"melting": "MAX(melting_at)", "lcl": "MAX(cloud_base)", "pwat": "SUM(CASE WHEN p >= 400 AND p_up >= 400 THEN (q + q_up) * 1000 / 2 * (p - p_up) * 0.00040173E0 END) / 1000"}
    for t in (1, 3, 6):
        out |= {f"q_mean0{t}": _mean("q", 0, t * 1000), f"q{t}": z_sql("q", t * 1000), f"umean0{t}": _wind(lambda c, t=t: _mean(c, 0, t * 1000)), f"wind{t}": _wind(lambda c, t=t: z_sql(c, t * 1000))}
        out |= {f"srh0{t}_{s}": _helicity(t * 1000, s) for s in ("left", "right")}
    out |= {"umean3_12": _wind(lambda c: _mean(c, 3000, 12000)), "umean800_600": _wind(lambda c: m_sql(c, "({p} <= 800 AND {p} >= 600)"))}
    out |= {f"rhmin{b}{t}": f"MIN(CASE WHEN z >= {b * 1000} AND z <= {t * 1000} THEN rh END)" for b, t in ((0, 1), (0, 3), (1, 3))}
    out |= {f"s{b}{t}": _shear(b * 1000, t * 1000) for b, t in ((0, 1), (0, 3), (0, 6), (0, 10), (1, 3), (3, 6))}
    out |= {f"storm_{s}": _speed(*_motion(s)) for s in ("left", "right")}
    out["max_shear"] = f"GREATEST({', '.join(_shear(b, t) for b in D.SHEAR_LOWS for t in D.SHEAR_TOPS)})"
    out |= {f"{c}{t}": p_sql(c, t) for c in ("ta", "dp") for t in (850, 700, 670, 500)} | {f"{c}{t}": p_sql(f"{c}a", t) for c in ("u", "v") for t in (850, 500)}
    low = "FILTER (z >= 0 AND z <= 3000)"
    out |= {"sfc_te": z_sql("te", 0), "te_diff": f"CASE WHEN ARG_MIN(k, te) {low} < ARG_MAX(k, te) {low} THEN 0E0 ELSE MAX(te) {low} - MIN(te) {low} END", "te_low": "MIN(CASE WHEN p >= ps - 400 THEN te END)"}
    for name, at in (("freezing", "melting_at"), ("subcloud", "cloud_base")):
        # heights of a column: the same on all its levels
        out[f"lr_{name}"] = f"-({z_sql('ta', at, True, False)} - {z_sql('ta', 0)}) / NULLIF(MAX({at}), 0) * 1000"
    out |= {"q_melting": z_sql("q", "melting_at"), "q_mean_subcloud": _mean("q", 0, "cloud_base"), "rhmin_subcloud": "MIN(CASE WHEN z >= 0 AND z <= cloud_base THEN rh END)"}
    for x in D.PARCELS:
        out |= {f"{x}_cape": f"COALESCE(SUM({_area(f'lift_{x}')}), 0)", f"{x}_cin": f"COALESCE(ABS(SUM(CASE WHEN z_up <= free_{x} THEN {_area(f'sink_{x}')} END)), 0)"}
    return out | {"dcape": f"COALESCE(-SUM({_area('sink_down')}), 0)"}


def _floor0(e):
    return f"CASE WHEN {e} < 0 THEN 0E0 ELSE {e} END"


_LCL = "(CASE WHEN lcl < 1000 THEN 1E0 WHEN lcl > 2000 THEN 0E0 ELSE (2000 - lcl) / 1000 END)"
_CAP = "(CASE WHEN s06 > 20 THEN 20E0 WHEN s06 < 10 THEN 0E0 ELSE s06 END)"
_WET, _KN = "melting / 1000 * (q_mean01 / 12) * (POW(lr_freezing, 2) - 30 + q_mean01 - 2 * q_melting)", f"{refs.KNOT_PER_MS}E0"
_MP = "POW(melting, 2) * (lr_freezing / 1000 - 5.5E-3) + melting * (q1 - 1.5E0 * q_melting) / 3"
_A850, _A500 = "DEGREES(ATAN2(v850, u850))", "DEGREES(ATAN2(v500, u500))"
_S850, _S500 = "SQRT(u850 * u850 + v850 * v850)", "SQRT(u500 * u500 + v500 * v500)"
_OFF = f"({_A850} BETWEEN 130 AND 250 OR {_A500} BETWEEN 210 AND 310 OR {_A500} - {_A850} > 0 OR ({_S850} >= 7.71E0 AND {_S500} >= 7.71E0))"
_STP_CIN = f"ml_cape / 1500 * {_LCL} * srh01_left / 150 * (CASE WHEN s06 < 12.5 THEN 0E0 WHEN s06 > 30 THEN 1.5E0 ELSE s06 / 20 END) * (CASE WHEN ml_cin < 50 THEN 1E0 WHEN ml_cin > 200 THEN 0E0 ELSE (200 - ml_cin) / 150 END)"
# SQL of the indices: those of the first step are inputs of the second
FIRST = {f"dpd{t}": f"ta{t} - dp{t}" for t in (850, 700, 670, 500)} | {
    "v_totals": "ta850 - ta500", "c_totals": "dp850 - ta500", "t_totals": "(ta850 - ta500) + (dp850 - ta500)", "tei": "GREATEST(sfc_te - te_low, 0E0)", "tq": "ta850 + dp850 - 1.7E0 * ta700",
    "windex": f"CASE WHEN {_WET} >= 0 THEN 5 * SQRT(ABS({_WET})) ELSE 0E0 END",
}
SECOND = {
    "k_index": _floor0("(ta850 - ta500 + dp850 - dpd700)"), "gustex": "0.5E0 * windex + 0.5E0 * umean06",
    "sweat": f"12 * ({_floor0('dp850')}) + CASE WHEN t_totals < 49 THEN 0E0 ELSE 20 * (t_totals - 49) END + 2 * {_KN} * {_S850} + {_KN} * {_S500} + CASE WHEN {_OFF} THEN 0E0 ELSE {_floor0(f'(125 * (SIN(RADIANS({_A500} - {_A850})) + 0.2E0))')} END",
    "stp_fixed": f"sb_cape / 1500 * {_LCL} * srh01_left / 150 * LEAST(GREATEST(s06, 12.5E0), 30E0) / 20", "stp_cin": _floor0(f"({_STP_CIN})"),
    "scp": f"mu_cape / 1000 * srh03_left / 50 * {_CAP} / 20", "scp_fixed": f"mu_cape / 1000 * srh01_left / 50 * {_CAP} / 20",
    "ship": "-(mu_cape * LEAST(GREATEST(q_mean01, 11E0), 13.6E0) * lr700_500 * LEAST(ta500, -5.5E0) * LEAST(GREATEST(s06, 7E0), 27E0)) / 42E6 * CASE WHEN mu_cape < 1300 THEN mu_cape / 1300 ELSE 1E0 END * CASE WHEN lr700_500 < 5.8 THEN lr700_500 / 5.8E0 ELSE 1E0 END * CASE WHEN melting < 2400 THEN melting / 2400 ELSE 1E0 END",
    "mmp": "CASE WHEN mu_cape < 100 THEN 0E0 ELSE 1 / (1 + EXP(13 - 0.0459E0 * max_shear - 1.16E0 * lr38 - 6.17E-4 * mu_cape - 0.17E0 * umean3_12)) END",
    "sherb": "s03 / 27 * (lr03 / 5.2E0) * (lr700_500 / 5.6E0)",
    "wndg": "ml_cape / 2000 * (CASE WHEN lr03 < 7 THEN 0E0 ELSE lr03 END / 9) * (umean800_600 / 15) * ((50 + GREATEST(-ml_cin, -50E0)) / 40)",
    "esp": "CASE WHEN lr03 < 7 OR ml_cape < 250 THEN 0E0 ELSE ml_cape / 50 * (lr03 - 7) END",
    "mburst": "GREATEST(CASE WHEN sfc_te >= 355 THEN 1 ELSE 0 END + CASE WHEN sb_cape >= 3300 THEN 4 WHEN sb_cape >= 2700 THEN 2 WHEN sb_cape >= 2300 THEN 1 WHEN sb_cape >= 1000 THEN 0 ELSE -5 END + CASE WHEN pwat < 1.5 THEN -3 ELSE 0 END"
    " + CASE WHEN pwat > 1.7 AND dcape > 900 THEN 1 ELSE 0 END + CASE WHEN lr03 > 8.4 THEN 1 ELSE 0 END + CASE WHEN v_totals >= 29 THEN 3 WHEN v_totals >= 28 THEN 2 WHEN v_totals >= 27 THEN 1 ELSE 0 END + CASE WHEN tei >= 35 THEN 1 ELSE 0 END, 0)",
    "dcp": f"dcape / 980 * (mu_cape / 2000) * (s06 * {_KN} / 20) * (umean06 * {_KN} / 16)",
    "hmi": _floor0("(lr850_670 + dpd850 - dpd670)"), "dmi": _floor0("(lr750_500 + dpd700 - dpd500)"), "wmsi": _floor0("(ml_cape * te_diff / 1000)"),
    "mwpi": "ml_cape / 100 + (lr850_670 + dpd850 - dpd670)", "wmpi": f"CASE WHEN {_MP} >= 0 THEN SQRT(ABS({_MP})) / 5 END",
    **{f"{x}_cape_s06": f"{x}_cape * POW(s06, 1.67E0)" for x in D.PARCELS},
    "dmgwind": "dcape / 800 * (umean800_600 / 8)", "convgust_wet": "SQRT(POW(umean06, 2) + 2 * dcape)", "convgust_dry": "SQRT(POW(umean06, 2) + dcape)",
}


def twin(names):
    """SQL of the named diagnostics, straight from the levels."""
    columns = _columns()
    rh = f"100 * ({_ES_D}) / ({_ES_T})"
    steps = f"g AS (SELECT col_id, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM up GROUP BY 1), h AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in FIRST.items())} FROM g)"
    final = f"x AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in SECOND.items())} FROM h)"
    return sql("v_levels", f"{UP.format(rh=rh)}, {steps}, {final} SELECT col_id, {', '.join(f'ROUND(CAST({n} AS DOUBLE), 6) + 0E0 AS {n}' for n in names)} FROM x")


def tall_levels(t):
    return t.levels.selectExpr("col_id", "lev", *[f"{e} AS {c}" for c, e in TALL.items()])


def _named(t, names):
    out = D.diagnose(tall_levels(t), ["col_id"], names)
    return out.select("col_id", *[r6(F.col(n).cast("double"), 6).alias(n) for n in names])


@query("named_diagnostics", "I2,I3,I4,I5,I6,I7,I8,I9,I10,I11,I12,I13,I14,I15,I16,I21,J1,J2,J3,J4,J5,J6,J7,J8,J9,J10,J11,J12,J13,J14,J16,J17,J18,J19,J22", twin(D.FULL))
def _(t):
    return _named(t, D.FULL)


@query("reduced_diagnostics", "J4,J8,J10,I6,I9", twin(D.REDUCED))
def _(t):
    return _named(t, D.REDUCED)
