"""Composite storm and wind indices as column expressions over one diagnostics row (J)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from squallframe import refs
from squallframe.functions.scalar import angle, clamp, col, linear, logistic, ms_to_knots, power, speed



def floor0(c: Column) -> Column:
    """max(c, 0) that keeps nulls."""
    return F.when(c < 0, 0.0).otherwise(c)


def _lcl_term(lcl):
    return F.when(col(lcl) < 1000, 1.0).when(col(lcl) > 2000, 0.0).otherwise((2000.0 - col(lcl)) / 1000.0)


def stp_fixed(sb_cape, sb_lcl, srh, bwd6):
    return col(sb_cape) / 1500.0 * _lcl_term(sb_lcl) * col(srh) / 150.0 * clamp(bwd6, 12.5, 30.0) / 20.0


def stp_cin(ml_cape, ml_lcl, esrh, ebwd, ml_cin):
    shear = F.when(col(ebwd) < 12.5, 0.0).when(col(ebwd) > 30, 1.5).otherwise(col(ebwd) / 20.0)
    cin = F.when(col(ml_cin) < 50, 1.0).when(col(ml_cin) > 200, 0.0).otherwise((200.0 - col(ml_cin)) / 150.0)
    return floor0(col(ml_cape) / 1500.0 * _lcl_term(ml_lcl) * col(esrh) / 150.0 * shear * cin)


def _shear_cap(s):
    return F.when(col(s) > 20, 20.0).when(col(s) < 10, 0.0).otherwise(col(s))


def scp(mu_cape, srhe, ebwd):
    return col(mu_cape) / 1000.0 * col(srhe) / 50.0 * _shear_cap(ebwd) / 20.0


def scp_fixed(mu_cape, srh01, s06):
    return col(mu_cape) / 1000.0 * col(srh01) / 50.0 * _shear_cap(s06) / 20.0


def ship(mu_cape, mu_q, lr75, t500, s06, freezing):
    """Mixing ratio in g/kg."""
    cold = F.least(col(t500), F.lit(-5.5))
    base = -(col(mu_cape) * clamp(mu_q, 11.0, 13.6) * col(lr75) * cold * clamp(s06, 7.0, 27.0)) / 42000000.0
    for c, limit in ((mu_cape, 1300.0), (lr75, 5.8), (freezing, 2400.0)):
        base = base * F.when(col(c) < limit, col(c) / limit).otherwise(1.0)
    return base


MMP_COEFS = {"max_shear": -4.59e-2, "lr38": -1.16, "mu_cape": -6.17e-4, "mean_wind": -0.17}  # fixed values


def mmp(max_shear, lr38, mu_cape, mean_wind):
    given = {"max_shear": max_shear, "lr38": lr38, "mu_cape": mu_cape, "mean_wind": mean_wind}
    z = F.lit(13.0)
    for name, c in MMP_COEFS.items():
        z = z + c * col(given[name])
    return F.when(col(mu_cape) < 100, 0.0).otherwise(1.0 / (1.0 + F.exp(z)))


def sherb(shear, lr03, lr75):
    """0-3 km shear for the plain form, effective shear for the effective form."""
    return col(shear) / 27.0 * (col(lr03) / 5.2) * (col(lr75) / 5.6)


def wndg(ml_cape, ml_cin, lr03, mean_wind):
    steep = F.when(col(lr03) < 7, 0.0).otherwise(col(lr03))
    cin = F.greatest(-col(ml_cin), F.lit(-50.0))
    return col(ml_cape) / 2000.0 * (steep / 9.0) * (col(mean_wind) / 15.0) * ((50.0 + cin) / 40.0)


def esp(ml_cape, lr03):
    return F.when((col(lr03) < 7) | (col(ml_cape) < 250), 0.0).otherwise(col(ml_cape) / 50.0 * (col(lr03) - 7.0))


def sweat(td850, t_totals, u850, v850, u500, v500):
    """Wind in m/s; the direction terms use each level's own wind, the zeroing rules keep their order."""
    s850, s500 = speed(u850, v850), speed(u500, v500)
    d850, d500 = angle(col(v850), col(u850)), angle(col(v500), col(u500))
    moist = 12.0 * floor0(col(td850))
    totals = F.when(col(t_totals) < 49, 0.0).otherwise(20.0 * (col(t_totals) - 49.0))
    turn = floor0(125.0 * (F.sin(F.radians(d500 - d850)) + 0.2))
    off = d850.between(130, 250) | d500.between(210, 310) | ((d500 - d850) > 0) | ((s850 >= 7.71) & (s500 >= 7.71))
    return moist + totals + 2.0 * ms_to_knots(s850) + ms_to_knots(s500) + F.when(off, 0.0).otherwise(turn)


def mburst(sfc_theta_e, sb_cape, pwat, dcape, lr03, v_totals, tei):
    cape = (
        F.when(col(sb_cape) >= 3300, 4).when(col(sb_cape) >= 2700, 2).when(col(sb_cape) >= 2300, 1).when(col(sb_cape) >= 1000, 0).otherwise(-5)
    )
    totals = F.when(col(v_totals) >= 29, 3).when(col(v_totals) >= 28, 2).when(col(v_totals) >= 27, 1).otherwise(0)
    one = lambda c: F.when(c, 1).otherwise(0)
    score = (
        one(col(sfc_theta_e) >= 355) + cape + F.when(col(pwat) < 1.5, -3).otherwise(0)
        + one((col(pwat) > 1.7) & (col(dcape) > 900)) + one(col(lr03) > 8.4) + totals + one(col(tei) >= 35)
    )
    return F.greatest(score, F.lit(0))


def dcp(dcape, mu_cape, s06, mean_wind, units: str = "knots"):
    """Derecho composite; ``units='ms'`` leaves the winds in m/s."""
    if units not in ("knots", "ms"):
        raise ValueError(units)
    k = refs.KNOT_PER_MS if units == "knots" else 1.0
    return col(dcape) / 980.0 * (col(mu_cape) / 2000.0) * (col(s06) * k / 20.0) * (col(mean_wind) * k / 16.0)


def windex(melting, q_mean01, lr_freezing, q_melting):
    inner = col(melting) / 1000.0 * (col(q_mean01) / 12.0) * (F.pow(col(lr_freezing), 2) - 30.0 + col(q_mean01) - 2.0 * col(q_melting))
    return F.when(inner >= 0, 5.0 * F.sqrt(inner)).otherwise(0.0)


def gustex(windex_value, mean_wind06):
    return 0.5 * col(windex_value) + 0.5 * col(mean_wind06)


def hmi(lr850_670, dpd850, dpd670):
    return floor0(col(lr850_670) + col(dpd850) - col(dpd670))


def dmi(lr750_500, dpd700, dpd500):
    return floor0(col(lr750_500) + col(dpd700) - col(dpd500))


def wmsi(ml_cape, te_diff):
    return floor0(col(ml_cape) * col(te_diff) / 1000.0)


def mwpi(ml_cape, lr850_670, dpd850, dpd670, floor: bool = False):
    out = col(ml_cape) / 100.0 + (col(lr850_670) + col(dpd850) - col(dpd670))
    return floor0(out) if floor else out


def wmpi(melting, lr_freezing, q1, q_melting):
    inner = F.pow(col(melting), 2) * (col(lr_freezing) / 1000.0 - 5.5e-3) + col(melting) * (col(q1) - 1.5 * col(q_melting)) / 3.0
    return F.when(inner >= 0, F.sqrt(inner) / 5.0)


def mosh(lr03, s01, max_tevv):
    return floor0((col(lr03) - 4.0) / 4.0 * ((col(s01) - 8.0) / 10.0) * ((col(max_tevv) + 10.0) / 9.0))


def moshe(lr03, s01, ebwd, max_tevv):
    return floor0(
        (col(lr03) - 4.0) / 4.0 * ((col(s01) - 8.0) / 10.0) * ((col(ebwd) - 8.0) / 10.0) * ((col(max_tevv) + 10.0) / 9.0)
    )


def cape_shear(cape, s06):
    return col(cape) * power(col(s06), F.lit(1.67))


def dmgwind(dcape, wind):
    return col(dcape) / 800.0 * (col(wind) / 8.0)


def convgust_wet(mean_wind, dcape):
    return F.sqrt(F.pow(col(mean_wind), 2) + 2.0 * col(dcape))


def convgust_dry(mean_wind, dcape):
    return F.sqrt(F.pow(col(mean_wind), 2) + col(dcape))


def non_supercell_tornado(lr, ml_cape, ml_cin, s06, lcl, vorticity):
    return (
        F.abs(col(lr)) / 9.0 * (col(ml_cape) / 100.0) * ((225.0 - col(ml_cin)) / 200.0) * ((18.0 - col(s06)) / 5.0)
        * ((2000.0 - col(lcl)) / 1500.0) * (F.abs(col(vorticity)) / 8e-5)
    )


def frontogenesis(grad_x, grad_y, divergence, stretching, shearing, vorticity) -> dict[str, Column]:
    """F, Fn, Fs, icon, vgt, convergence and vorticity from horizontal derivatives."""
    gx, gy, div, vo = col(grad_x), col(grad_y), col(divergence), col(vorticity)
    mag = F.sqrt(gx * gx + gy * gy)
    total = F.sqrt(F.pow(col(stretching), 2) + F.pow(col(shearing), 2))
    psi = 0.5 * F.atan2(col(shearing), col(stretching))
    ratio = (-gx * F.cos(psi) - gy * F.sin(psi)) / F.nullif(mag, F.lit(0.0))
    beta = F.asin(clamp(ratio, -1.0, 1.0))
    scale = 1.08e4 * 1e5
    return {
        "f": 0.5 * mag * (total * F.cos(2 * beta) - div) * scale,
        "fn": 0.5 * mag * (div - total * F.cos(2 * beta)) * scale,
        "fs": 0.5 * mag * (vo + total * F.sin(2 * beta)) * scale,
        "icon": 0.5 * (total - div) * 1e5,
        "vgt": F.sqrt(div * div + vo * vo + total * total) * 1e5,
        "conv": -div * 1e5,
        "vo": vo * 1e5,
    }


def tq(t850, td850, t700):
    return col(t850) + col(td850) - 1.7 * col(t700)


def ducs3(mlm, dcape, ml_cape, s03):
    return (col(mlm) + col(dcape)) / 30.0 * (cape_shear(ml_cape, s03) / 20000.0)


def strong_forcing(s06, dcape, mlm, strict: bool = False) -> Column:
    shear = col(s06) > 30 if strict else col(s06) >= 30
    return (shear & (col(dcape) < 500) & (col(mlm) >= 26)).cast("double")


def moderate_forcing(ml_cape, dcape, mlm) -> Column:
    return ((col(ml_cape) > 120) & (col(dcape) > 350) & (col(mlm) < 26)).cast("double")


def conditional_wind(s06, ml_cape, dcape, mlm, strict: bool = False) -> Column:
    return F.greatest(strong_forcing(s06, dcape, mlm, strict), moderate_forcing(ml_cape, dcape, mlm))


def deep_or_shallow(ml_el, u800_600, t_totals, k_index, mean_wind01, s03) -> Column:
    deep = (col(ml_el) >= 6000) & (col(u800_600) >= 5) & (col(t_totals) >= 46) & (col(k_index) >= 30)
    shallow = (col(ml_el) < 6000) & (col(u800_600) >= 16) & (col(k_index) >= 20) & (col(mean_wind01) >= 10) & (col(s03) >= 10)
    return (deep | shallow).cast("int")


def total_totals(t850, td850, t500):
    return (col(t850) - col(t500)) + (col(td850) - col(t500))


def k_index(t850, t500, td850, dpd700):
    return floor0(col(t850) - col(t500) + col(td850) - col(dpd700))


# Logistic models as (coefficients by predictor, intercept).
LOGIT_MODELS = {
    "measured": (
        {"ebwd": 6.1e-2, "umean800_600": 1.5e-1, "lr13": 9.4e-1, "rhmin13": 3.9e-2, "srhe_left": 1.7e-2, "q_melting": 3.8e-1, "eff_lcl": 4.7e-4},
        -13.0,
    ),
    "reported": ({"ebwd": 1.3e-1, "umean06": 1.7e-1, "ml_cape": 1.6e-3, "lr13": 4.1e-1}, -5.6),
    "measured_regional": (
        {"lr36": 8.5e-1, "lr_freezing": 6.2e-1, "ml_el": 3.9e-4, "s06": 3.8e-2, "srhe_left": 1.5e-2, "umean06": 1.6e-1},
        -14.8,
    ),
}


def logit_model(name: str) -> Column:
    coefs, intercept = LOGIT_MODELS[name]
    return logistic(linear(coefs, intercept))
