"""Closed-form moist thermodynamics as column expressions.

Temperatures are in Celsius and pressures in hPa unless a name ends in ``_k`` or ``_pa``.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from squallframe.functions.scalar import clamp, col

# Gas and moist-air constants.
RD, RV, CPD, EPS, G = 287.05, 461.51, 1004.6, 0.622, 9.80665
ZERO, MOLAR_AIR, R_STAR = 273.15, 28.9644e-3, 8.31432
KAPPA = 0.2857142857142857


def saturation_vapour(t):
    """Bolton saturation vapour pressure, hPa."""
    return 6.112 * F.exp(17.67 * col(t) / (col(t) + 243.5))


def dewpoint_from_rh(t, rh, floor_at: float = -85.0):
    """Dew point; zero humidity gives the floor value."""
    ln = F.ln(F.nullif(col(rh), F.lit(0.0)) / 100.0 * saturation_vapour(t) / 6.112)
    return F.coalesce(243.5 * ln / (17.67 - ln), F.when(col(rh) == 0, F.lit(floor_at)))


def rh_from_dewpoint(t, dp):
    return 100.0 * saturation_vapour(dp) / saturation_vapour(t)


def mixing_ratio_from_rh(t, rh, p):
    """kg/kg."""
    es = saturation_vapour(t)
    return col(rh) / 100.0 * EPS * es / (col(p) - es)


def mixing_ratio_from_dewpoint(dp, p):
    e = saturation_vapour(dp)
    return EPS * e / (col(p) - e)


def potential_temperature(t, p):
    """Kelvin."""
    return (col(t) + ZERO) * F.pow(1000.0 / col(p), F.lit(KAPPA))


def equivalent_potential_temperature(t, dp, p):
    """Bolton (1980) theta-e, Kelvin."""
    tk, dk = col(t) + ZERO, col(dp) + ZERO
    e = saturation_vapour(dp)
    r = EPS * e / (col(p) - e)
    lcl = 56.0 + 1.0 / (1.0 / (dk - 56.0) + F.ln(tk / dk) / 800.0)
    dry = tk * F.pow(1000.0 / (col(p) - e), F.lit(KAPPA)) * F.pow(tk / lcl, 0.28 * r)
    return dry * F.exp(r * (1.0 + 0.448 * r) * (3036.0 / lcl - 1.78))


def rh_from_specific_humidity(t, q, p):
    """Relative humidity in percent, clamped to 0..100."""
    es = saturation_vapour(t)
    mixing = col(q) / (1.0 - col(q))
    return clamp(100.0 * mixing / (EPS * es / (col(p) - es)), 0.0, 100.0)


def virtual_temperature_k(t_k, q):
    """From specific humidity; the form used with the hydrostatic levels."""
    r = col(q) / (1.0 - col(q))
    return col(t_k) * (r + EPS) / (EPS * (1.0 + r))


def pressure_from_height(ps, z, tv_k):
    return col(ps) * F.exp(-9.8 * col(z) / (287.0 * col(tv_k)))


def height_from_pressure(p, ps, tv_k, orography):
    return -287.0 * col(tv_k) * F.ln(col(p) / col(ps)) / 9.8 + F.greatest(col(orography), F.lit(0.0))


def hybrid_pressure(a, b, ps, p0=None):
    """a*p0 + b*ps, or ap + b*ps when no reference pressure is given."""
    return (col(a) if p0 is None else col(a) * p0) + col(b) * col(ps)


def density(t, p):
    """Dry-air density, kg/m3."""
    return 100.0 * col(p) / (RD * (col(t) + ZERO))


def omega_from_w(w, t, p):
    """Pa/s from m/s."""
    return -col(w) * density(t, p) * G


def w_from_omega(omega, t, p):
    return -col(omega) / (density(t, p) * G)


def barometric_pa(base_pa, base_k, dz, lapse: float = -0.0065):
    return col(base_pa) * F.pow(col(base_k) / (col(base_k) + lapse * col(dz)), F.lit(G * MOLAR_AIR / (R_STAR * lapse)))


def barometric_height(base_z, base_k, base_pa, top_pa, lapse: float = -0.0065):
    return col(base_z) + col(base_k) * (F.pow(col(base_pa) / col(top_pa), F.lit(R_STAR * lapse / (G * MOLAR_AIR))) - 1) / lapse


def theta_k(t_k, p_pa, ref: float = 100000.0):
    return col(t_k) * F.pow(ref / col(p_pa), F.lit(RD / CPD))


def temperature_from_theta_k(theta, p_pa, ref: float = 100000.0):
    return col(theta) * F.pow(col(p_pa) / ref, F.lit(RD / CPD))


def vapour_pressure_pa(t, ice: bool = False):
    liquid = 611.2 * F.exp(17.67 * col(t) / (col(t) + 243.12))
    if not ice:
        return liquid
    return F.when(col(t) < 0, 611.2 * F.exp(22.46 * col(t) / (col(t) + 272.62))).otherwise(liquid)


def mixing_ratio_pa(e_pa, p_pa):
    return EPS * col(e_pa) / (col(p_pa) - col(e_pa))


def vapour_from_mixing_pa(r, p_pa):
    return col(r) * col(p_pa) / (EPS + col(r))


def dewpoint_from_vapour_pa(e_pa):
    ln = F.ln(col(e_pa) / 611.2)
    return ((17.67 - ln) * ZERO + 243.5 * ln) / (17.67 - ln) - ZERO


def theta_v_k(t_k, p_pa, e_pa):
    r = mixing_ratio_pa(e_pa, p_pa)
    return theta_k(t_k, p_pa) * (1 + r / EPS) / (1 + r)


def theta_e_holton_k(t_k, p_pa, e_pa):
    r = mixing_ratio_pa(e_pa, p_pa)
    rh = col(e_pa) / vapour_pressure_pa(col(t_k) - ZERO)
    lcl = (col(t_k) - 55) * 2840 / (2840 - F.ln(rh) * (col(t_k) - 55)) + 55
    dry = col(t_k) * F.pow(100000.0 / (col(p_pa) - col(e_pa)), F.lit(RD / CPD)) * F.pow(col(t_k) / lcl, 0.28 * r)
    return dry * F.exp(2.5e6 * r / (CPD * lcl))


def latent_heat(t):
    t = col(t)
    return 1000 * (2500.8 - 2.36 * t + 0.0016 * t * t - 0.00006 * t * t * t)


def virtual_temperature_from_vapour_k(t_k, p_pa, e_pa):
    return col(t_k) / (1 - col(e_pa) / col(p_pa) * (1 - EPS))


def virtual_temperature_from_mixing_k(t_k, r):
    return col(t_k) * (1.0 + 0.6 * col(r))


def moist_density(t_k, p_pa, e_pa):
    return (col(p_pa) - col(e_pa)) / (RD * col(t_k)) + col(e_pa) / (RV * col(t_k))


def moist_lapse_per_pa(t_k, p_pa):
    """Moist adiabatic lapse rate, degrees per Pa."""
    tc = col(t_k) - ZERO
    es = vapour_pressure_pa(tc)
    ws, lv = mixing_ratio_pa(es, p_pa), latent_heat(tc)
    rho = col(p_pa) / (RD * virtual_temperature_from_vapour_k(t_k, p_pa, es))
    top = -1.0 * (1.0 + lv * ws / (RD * col(t_k)))
    return top / (rho * (CPD + EPS * lv * lv * ws / (RD * col(t_k) * col(t_k))))


def wet_bulb_stull(t, rh):
    """Stull (2011) wet-bulb approximation."""
    t, rh = col(t), col(rh)
    return (
        t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh) - 4.686035
    )
