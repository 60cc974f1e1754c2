"""Composite index queries (J) and scalar functions (H) over one wide diagnostics row per station-hour."""
from pyspark.sql import functions as F

from squallframe.functions import composites as X
from squallframe.functions import scalar as S
from squallframe.functions import thermo as T
from squallframe.plans.registry import query, r6, sql

# A wide row from the five stand-in diagnostics; portable SQL, so both engines build the same inputs.
WIDE = {
    "ml_cape": "ml_cape", "mu_cape": "ml_cape * 2", "sb_cape": "ml_cape * 1.2E0 + dcape * 2", "dcape": "dcape",
    "t_totals": "t_totals", "s06": "s06", "s03": "s06 / 1.43E0", "s01": "s06 / 2.1E0", "ebwd": "s06 / 1.3E0",
    "umean06": "umean06", "umean800_600": "umean06 * 0.9E0 + SQRT(2E0)", "umean01": "umean06 + 6", "uwindinf": "SQRT(s06 + 0.37E0)",
    "ml_lcl": "dcape * 2.5E0", "ml_cin": "t_totals * 5 - 120", "srh01": "s06 * 4 / 0.93E0", "srhe_left": "s06 * 3 / 0.97E0",
    "lr03": "t_totals / 6.5E0", "lr13": "t_totals / 7.5E0", "lr75": "t_totals / 8E0", "lr36": "t_totals / 7E0", "lr38": "t_totals / 7.7E0",
    "lr_freezing": "t_totals / 6E0", "lr850_670": "t_totals / 7E0", "lr750_500": "t_totals / 7.2E0", "mu_q": "s06 / 3E0 + 8",
    "t500": "2 - t_totals / 4E0", "freezing": "dcape * 3 + 500", "q_mean01": "t_totals / 4E0", "q_melting": "s06 / 10E0", "q1": "t_totals / 4.5E0",
    "dpd850": "s06 / 4E0", "dpd670": "dcape / 100E0", "dpd700": "dcape / 90E0", "dpd500": "s06 / 3E0", "te_diff": "s06 - 10",
    "max_tevv": "s06 / 2E0 - 5", "pwat": "t_totals / 30E0", "tei": "s06", "sfc_te": "325 + s06", "v_totals": "t_totals - 22",
    "td850": "t_totals - 45", "ta850": "t_totals / 2E0", "dp850": "t_totals / 3E0", "u850": "umean06 - 5", "v850": "s06 / 3E0 - 4", "u500": "umean06 + 3", "v500": "s06 / 4E0 - 7",
    "max_shear": "s06 * 1.3E0", "mean_wind": "umean06 * 1.2E0", "vo": "(s06 - 20) * 1E-5 / 1.1E0", "k_index": "t_totals - 20", "ml_el": "dcape * 10",
    "mlm": "umean06 * 3", "rhmin13": "t_totals + 10", "eff_lcl": "dcape * 2", "rh": "t_totals + s06 / 2E0", "ta": "t_totals - 25", "dp": "t_totals - 30 - s06 / 5E0",
    "p": "1000 - dcape / 4E0", "q": "(t_totals - 20) / 4000E0", "w": "(s06 - 20) / 10E0", "ps": "1013 - s06 / 4E0", "z": "dcape * 3", "tv": "255 + t_totals",
}
WIDE_CTE = "d AS (SELECT loc_id, time, " + ", ".join(f"{e} AS {n}" for n, e in WIDE.items()) + " FROM v_points)"


def _wide(t):
    return t.points.selectExpr("loc_id", "time", *[f"{e} AS {n}" for n, e in WIDE.items()])


def index(name, covers, outputs):
    """Register one query with outputs {column: (function giving the Spark expression, SQL expression)}; integers stay unrounded."""
    body = ", ".join(f"ROUND(CAST({s} AS DOUBLE), 6) + 0E0 AS {n}" for n, (_, s) in outputs.items())

    @query(name, covers, sql("v_points", f"{WIDE_CTE} SELECT loc_id, time, {body} FROM d"))
    def _(t):
        return _wide(t).select("loc_id", "time", *[r6(c().cast("double")).alias(n) for n, (c, _) in outputs.items()])


def _lcl(c):
    return f"CASE WHEN {c} < 1000 THEN 1E0 WHEN {c} > 2000 THEN 0E0 ELSE (2000 - {c}) / 1000E0 END"


def _cap(c):
    return f"CASE WHEN {c} > 20 THEN 20E0 WHEN {c} < 10 THEN 0E0 ELSE {c} END"


index("tornado_parameters", "J1", {
    "stp_fixed": (lambda: X.stp_fixed("sb_cape", "ml_lcl", "srh01", "s06"), f"sb_cape / 1500E0 * ({_lcl('ml_lcl')}) * srh01 / 150E0 * LEAST(GREATEST(s06, 12.5E0), 30E0) / 20E0"),
    "stp_cin": (lambda: X.stp_cin("ml_cape", "ml_lcl", "srhe_left", "ebwd", "ml_cin"),
                f"ml_cape / 1500E0 * ({_lcl('ml_lcl')}) * srhe_left / 150E0 * (CASE WHEN ebwd < 12.5 THEN 0E0 WHEN ebwd > 30 THEN 1.5E0 ELSE ebwd / 20E0 END) * (CASE WHEN ml_cin < 50 THEN 1E0 WHEN ml_cin > 200 THEN 0E0 ELSE (200 - ml_cin) / 150E0 END)"),
})
index("supercell_parameters", "J2,J26", {
    "scp": (lambda: X.scp("mu_cape", "srhe_left", "ebwd"), f"mu_cape / 1000E0 * srhe_left / 50E0 * ({_cap('ebwd')}) / 20E0"),
    "scp_fixed": (lambda: X.scp_fixed("mu_cape", "srh01", "s06"), f"mu_cape / 1000E0 * srh01 / 50E0 * ({_cap('s06')}) / 20E0"),
})
index("hail_parameter", "J3", {
    "ship": (lambda: X.ship("mu_cape", "mu_q", "lr75", "t500", "s06", "freezing"),
             "-(mu_cape * LEAST(GREATEST(mu_q, 11E0), 13.6E0) * lr75 * LEAST(t500, -5.5E0) * LEAST(GREATEST(s06, 7E0), 27E0)) / 42E6 * CASE WHEN mu_cape < 1300 THEN mu_cape / 1300E0 ELSE 1E0 END * CASE WHEN lr75 < 5.8 THEN lr75 / 5.8E0 ELSE 1E0 END * CASE WHEN freezing < 2400 THEN freezing / 2400E0 ELSE 1E0 END"),
})
index("mcs_maintenance_probability", "J4", {
    "mmp": (lambda: X.mmp("max_shear", "lr38", "mu_cape", "mean_wind"), "CASE WHEN mu_cape < 100 THEN 0E0 ELSE 1 / (1 + EXP(13 - 0.0459E0 * max_shear - 1.16E0 * lr38 - 6.17E-4 * mu_cape - 0.17E0 * mean_wind)) END"),
})
index("shear_lapse_index", "J5,J26", {
    "sherb": (lambda: X.sherb("s03", "lr03", "lr75"), "s03 / 27E0 * (lr03 / 5.2E0) * (lr75 / 5.6E0)"),
    "eff_sherb": (lambda: X.sherb("ebwd", "lr03", "lr75"), "ebwd / 27E0 * (lr03 / 5.2E0) * (lr75 / 5.6E0)"),
})
index("wind_damage_index", "J6", {
    "wndg": (lambda: X.wndg("ml_cape", "ml_cin", "lr03", "mean_wind"), "ml_cape / 2000E0 * ((CASE WHEN lr03 < 7 THEN 0E0 ELSE lr03 END) / 9E0) * (mean_wind / 15E0) * ((50 + GREATEST(-ml_cin, -50)) / 40E0)"),
})
index("enhanced_stretching_potential", "J7", {
    "esp": (lambda: X.esp("ml_cape", "lr03"), "CASE WHEN lr03 < 7 OR ml_cape < 250 THEN 0E0 ELSE ml_cape / 50E0 * (lr03 - 7) END"),
})
_S8, _S5 = "SQRT(u850 * u850 + v850 * v850)", "SQRT(u500 * u500 + v500 * v500)"
_D8, _D5 = "DEGREES(ATAN2(v850, u850))", "DEGREES(ATAN2(v500, u500))"
index("sweat_index", "J8", {
    "sweat": (lambda: X.sweat("td850", "t_totals", "u850", "v850", "u500", "v500"),
              f"12 * GREATEST(td850, 0E0) + CASE WHEN t_totals < 49 THEN 0E0 ELSE 20 * (t_totals - 49) END + 2 * {_S8} * 1.944E0 + {_S5} * 1.944E0 + CASE WHEN {_D8} BETWEEN 130 AND 250 OR {_D5} BETWEEN 210 AND 310 OR {_D5} - {_D8} > 0 OR ({_S8} >= 7.71 AND {_S5} >= 7.71) THEN 0E0 ELSE GREATEST(125 * (SIN(RADIANS({_D5} - {_D8})) + 0.2E0), 0E0) END"),
})
index("microburst_score", "J9", {
    "mburst": (lambda: X.mburst("sfc_te", "sb_cape", "pwat", "dcape", "lr03", "v_totals", "tei"),
               "GREATEST((CASE WHEN sfc_te >= 355 THEN 1 ELSE 0 END) + (CASE WHEN sb_cape < 1000 THEN -5 WHEN sb_cape < 2300 THEN 0 WHEN sb_cape < 2700 THEN 1 WHEN sb_cape < 3300 THEN 2 ELSE 4 END) + (CASE WHEN pwat < 1.5 THEN -3 ELSE 0 END) + (CASE WHEN pwat > 1.7 AND dcape > 900 THEN 1 ELSE 0 END) + (CASE WHEN lr03 > 8.4 THEN 1 ELSE 0 END) + (CASE WHEN v_totals < 27 THEN 0 WHEN v_totals < 28 THEN 1 WHEN v_totals < 29 THEN 2 ELSE 3 END) + (CASE WHEN tei >= 35 THEN 1 ELSE 0 END), 0)"),
})
index("derecho_parameter", "J10,J26", {
    "dcp_knots": (lambda: X.dcp("dcape", "mu_cape", "s06", "umean06"), "dcape / 980E0 * (mu_cape / 2000E0) * (s06 * 1.944E0 / 20E0) * (umean06 * 1.944E0 / 16E0)"),
    "dcp_ms": (lambda: X.dcp("dcape", "mu_cape", "s06", "umean06", "ms"), "dcape / 980E0 * (mu_cape / 2000E0) * (s06 / 20E0) * (umean06 / 16E0)"),
})
_WX = "freezing / 1000E0 * (q_mean01 / 12E0) * (lr_freezing * lr_freezing - 30 + q_mean01 - 2 * q_melting)"
_WXV = f"CASE WHEN {_WX} >= 0 THEN 5 * SQRT(GREATEST({_WX}, 0)) ELSE 0E0 END"
index("windex_and_gustex", "J11", {
    "windex": (lambda: X.windex("freezing", "q_mean01", "lr_freezing", "q_melting"), _WXV),
    "gustex": (lambda: X.gustex(X.windex("freezing", "q_mean01", "lr_freezing", "q_melting"), "umean06"), f"0.5E0 * ({_WXV}) + 0.5E0 * umean06"),
})
index("hybrid_and_dry_microburst", "J12", {
    "hmi": (lambda: X.hmi("lr850_670", "dpd850", "dpd670"), "GREATEST(lr850_670 + dpd850 - dpd670, 0E0)"),
    "dmi": (lambda: X.dmi("lr750_500", "dpd700", "dpd500"), "GREATEST(lr750_500 + dpd700 - dpd500, 0E0)"),
})
index("wet_microburst_severity", "J13", {
    "wmsi": (lambda: X.wmsi("ml_cape", "te_diff"), "GREATEST(ml_cape * te_diff / 1000E0, 0E0)"),
    "mwpi": (lambda: X.mwpi("ml_cape", "lr850_670", "dpd850", "dpd670"), "ml_cape / 100E0 + (lr850_670 + dpd850 - dpd670)"),
})
_WP = "freezing * freezing * (lr_freezing / 1000E0 - 5.5E-3) + freezing * (q1 - 1.5E0 * q_melting) / 3E0"
index("wind_microburst_potential", "J14", {
    "wmpi": (lambda: X.wmpi("freezing", "lr_freezing", "q1", "q_melting"), f"CASE WHEN {_WP} >= 0 THEN SQRT(GREATEST({_WP}, 0)) / 5E0 END"),
})
index("severe_hazard_parameters", "J15", {
    "mosh": (lambda: X.mosh("lr03", "s01", "max_tevv"), "GREATEST((lr03 - 4) / 4E0 * ((s01 - 8) / 10E0) * ((max_tevv + 10) / 9E0), 0E0)"),
    "moshe": (lambda: X.moshe("lr03", "s01", "ebwd", "max_tevv"), "GREATEST((lr03 - 4) / 4E0 * ((s01 - 8) / 10E0) * ((ebwd - 8) / 10E0) * ((max_tevv + 10) / 9E0), 0E0)"),
})
index("cape_times_shear", "J16,J26", {
    c: (lambda a=a: X.cape_shear(a, "s06"), f"{a} * POW(s06, 1.67E0)") for c, a in (("mlcs6", "ml_cape"), ("mucs6", "mu_cape"), ("sbcs6", "sb_cape"))
})
index("damaging_wind", "J17", {
    "dmgwind": (lambda: X.dmgwind("dcape", "uwindinf"), "dcape / 800E0 * (uwindinf / 8E0)"),
    "dmgwind_fixed": (lambda: X.dmgwind("dcape", "umean800_600"), "dcape / 800E0 * (umean800_600 / 8E0)"),
})
index("convective_gust", "J18", {
    "wet": (lambda: X.convgust_wet("umean800_600", "dcape"), "SQRT(umean800_600 * umean800_600 + 2 * dcape)"),
    "dry": (lambda: X.convgust_dry("umean800_600", "dcape"), "SQRT(umean800_600 * umean800_600 + dcape)"),
})
index("level_wind_speeds", "J19,H7", {
    "u850_speed": (lambda: S.speed("u850", "v850"), _S8),
    "storm_relative": (lambda: S.speed(F.col("u850") - F.col("u500"), F.col("v850") - F.col("v500")), "SQRT((u850 - u500) * (u850 - u500) + (v850 - v500) * (v850 - v500))"),
    "direction": (lambda: S.wind_direction("u850", "v850"), "180 + DEGREES(ATAN2(u850, v850))"),
})
index("non_supercell_tornado", "J20", {
    "nst": (lambda: X.non_supercell_tornado("lr03", "ml_cape", "ml_cin", "s06", "ml_lcl", "vo"),
            "ABS(lr03) / 9E0 * (ml_cape / 100E0) * ((225 - ml_cin) / 200E0) * ((18 - s06) / 5E0) * ((2000 - ml_lcl) / 1500E0) * (ABS(vo) / 8E-5)"),
})
index("downdraft_shear_product", "J23", {
    "ducs3": (lambda: X.ducs3("mlm", "dcape", "ml_cape", "s03"), "(mlm + dcape) / 30E0 * (ml_cape * POW(s03, 1.67E0) / 20000E0)"),
})
_SF = "CASE WHEN s06 >= 30 AND dcape < 500 AND mlm >= 26 THEN 1E0 ELSE 0E0 END"
_MF = "CASE WHEN ml_cape > 120 AND dcape > 350 AND mlm < 26 THEN 1E0 ELSE 0E0 END"
index("forcing_conditions", "J24", {
    "sf": (lambda: X.strong_forcing("s06", "dcape", "mlm"), _SF),
    "mf": (lambda: X.moderate_forcing("ml_cape", "dcape", "mlm"), _MF),
    "cond": (lambda: X.conditional_wind("s06", "ml_cape", "dcape", "mlm"), f"GREATEST({_SF}, {_MF})"),
})
index("deep_or_shallow_rule", "J25", {
    "flag": (lambda: X.deep_or_shallow("ml_el", "umean800_600", "t_totals", "k_index", "umean01", "s03"),
             "CASE WHEN (ml_el >= 6000 AND umean800_600 >= 5 AND t_totals >= 46 AND k_index >= 30) OR (ml_el < 6000 AND umean800_600 >= 16 AND k_index >= 20 AND umean01 >= 10 AND s03 >= 10) THEN 1 ELSE 0 END"),
})
index("ensemble_side_indices", "J26", {
    "t_totals": (lambda: X.total_totals("ta850", "dp850", "t500"), "(ta850 - t500) + (dp850 - t500)"),
    "logit_measured": (lambda: X.logit_model("measured"), "1 / (1 + EXP(-(-13 + 6.1E-2 * ebwd + 1.5E-1 * umean800_600 + 9.4E-1 * lr13 + 3.9E-2 * rhmin13 + 1.7E-2 * srhe_left + 3.8E-1 * q_melting + 4.7E-4 * eff_lcl)))"),
    "logit_reported": (lambda: X.logit_model("reported"), "1 / (1 + EXP(-(-5.6E0 + 1.3E-1 * ebwd + 1.7E-1 * umean06 + 1.6E-3 * ml_cape + 4.1E-1 * lr13)))"),
})
index("logistic_on_grid", "L4,H13", {
    "probability": (lambda: X.logit_model("measured_regional"), "1 / (1 + EXP(-(-14.8E0 + 8.5E-1 * lr36 + 6.2E-1 * lr_freezing + 3.9E-4 * ml_el + 3.8E-2 * s06 + 1.5E-2 * srhe_left + 1.6E-1 * umean06)))"),
})

_ES = "6.112E0 * EXP(17.67E0 * {t} / ({t} + 243.5E0))"
_EST, _ESD = _ES.format(t="ta"), _ES.format(t="dp")
_LN = f"LN(rh / 100E0 * {_EST} / 6.112E0)"
_R = f"(0.622E0 * {_ESD} / (p - {_ESD}))"
_LCL = "(56 + 1 / (1 / (dp + 273.15E0 - 56) + LN((ta + 273.15E0) / (dp + 273.15E0)) / 800E0))"
index("moist_thermodynamics", "H9", {
    "dewpoint": (lambda: T.dewpoint_from_rh("ta", "rh"), f"243.5E0 * {_LN} / (17.67E0 - {_LN})"),
    "rh_back": (lambda: T.rh_from_dewpoint("ta", "dp"), f"100 * {_ESD} / ({_EST})"),
    "mixing": (lambda: 1000 * T.mixing_ratio_from_rh("ta", "rh", "p"), f"1000 * rh / 100E0 * 0.622E0 * {_EST} / (p - {_EST})"),
    "theta": (lambda: T.potential_temperature("ta", "p"), "(ta + 273.15E0) * POW(1000 / p, 0.2857142857142857E0)"),
    "theta_e": (lambda: T.equivalent_potential_temperature("ta", "dp", "p"),
                f"(ta + 273.15E0) * POW(1000 / (p - {_ESD}), 0.2857142857142857E0) * POW((ta + 273.15E0) / {_LCL}, 0.28E0 * {_R}) * EXP({_R} * (1 + 0.448E0 * {_R}) * (3036 / {_LCL} - 1.78E0))"),
})
index("humidity_from_specific", "H10", {
    "rh": (lambda: T.rh_from_specific_humidity("ta", "q", "p"), f"LEAST(GREATEST(100 * (q / (1 - q)) / (0.622E0 * {_EST} / (p - {_EST})), 0E0), 100E0)"),
})
index("hydrostatic_levels", "H11", {
    "p_at_z": (lambda: T.pressure_from_height("ps", "z", "tv"), "ps * EXP(-9.8E0 * z / (287 * tv))"),
    "z_at_p": (lambda: T.height_from_pressure("p", "ps", "tv", "te_diff"), "-287 * tv * LN(p / ps) / 9.8E0 + GREATEST(te_diff, 0E0)"),
    "hybrid": (lambda: T.hybrid_pressure("q", "lr03", "ps", 1000.0), "q * 1000 + lr03 * ps"),
})
index("vertical_velocity_conversion", "H12", {
    "omega": (lambda: T.omega_from_w("w", "ta", "p"), "-w * (100 * p / (287.05E0 * (ta + 273.15E0))) * 9.80665E0"),
    "w_back": (lambda: T.w_from_omega(T.omega_from_w("w", "ta", "p"), "ta", "p"), "w"),
})
index("updraft_speed", "H14,H15", {
    "wmax": (lambda: S.wmax("ml_cape"), "SQRT(2 * ml_cape)"),
    "log_cape": (lambda: S.guarded_ln("ml_cape"), "CASE WHEN ml_cape > 0 THEN LN(ml_cape) END"),
    "bounded": (lambda: S.clamp("s06", 7.0, 27.0), "LEAST(GREATEST(s06, 7E0), 27E0)"),
    "ratio": (lambda: S.share("dcape", "s06"), "dcape / NULLIF(s06, 0)"),
})
_EV = "(611.2E0 * EXP(17.67E0 * dp / (dp + 243.12E0)))"
_TK, _PP = "(ta + 273.15E0)", "(p * 100)"


def _e():
    return T.vapour_pressure_pa("dp")


def _tk():
    return F.col("ta") + 273.15


def _pp():
    return F.col("p") * 100


index("thermodynamic_library", "H17", {
    "vapour_pa": (lambda: _e(), _EV),
    "mixing": (lambda: 1000 * T.mixing_ratio_pa(_e(), _pp()), f"1000 * (0.622E0 * {_EV} / ({_PP} - {_EV}))"),
    "dewpoint": (lambda: T.dewpoint_from_vapour_pa(_e()), f"((17.67E0 - LN({_EV} / 611.2E0)) * 273.15E0 + 243.5E0 * LN({_EV} / 611.2E0)) / (17.67E0 - LN({_EV} / 611.2E0)) - 273.15E0"),
    "theta": (lambda: T.theta_k(_tk(), _pp()), f"{_TK} * POW(100000 / {_PP}, {287.05 / 1004.6!r})"),
    "latent": (lambda: T.latent_heat("ta"), "1000 * (2500.8E0 - 2.36E0 * ta + 0.0016E0 * ta * ta - 0.00006E0 * ta * ta * ta)"),
    "density": (lambda: T.moist_density(_tk(), _pp(), _e()), f"({_PP} - {_EV}) / (287.05E0 * {_TK}) + {_EV} / (461.51E0 * {_TK})"),
    "wet_bulb": (lambda: T.wet_bulb_stull("ta", "rh"), "ta * ATAN(0.151977E0 * SQRT(rh + 8.313659E0)) + ATAN(ta + rh) - ATAN(rh - 1.676331E0) + 0.00391838E0 * POW(rh, 1.5E0) * ATAN(0.023101E0 * rh) - 4.686035E0"),
})


@query("unit_conversions", "H4", sql("v_points", WIDE_CTE + """ SELECT loc_id, time, ROUND(umean06 / 3.6E0, 6) AS kmh, ROUND(umean06 * 0.514444E0, 6) AS from_knots,
 ROUND(umean06 * 1.944E0, 6) AS knots, ROUND(z / 9.8E0, 6) AS height, ROUND(p / 100E0, 6) AS hpa FROM d"""))
def _(t):
    return _wide(t).select(
        "loc_id", "time", r6(S.kmh_to_ms("umean06")).alias("kmh"), r6(S.knots_to_ms("umean06")).alias("from_knots"),
        r6(S.ms_to_knots("umean06")).alias("knots"), r6(S.geopotential_height("z")).alias("height"), r6(S.to_hpa("p")).alias("hpa"),
    )
