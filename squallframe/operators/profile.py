"""Vertical-profile operators (I): level rows to one row per column.

``prepare`` pairs each level with the one above it by one window over the column; every other
function here is an aggregate expression, so any number of diagnostics of a column come out of a
single ``groupBy`` on the same keys, with no further shuffle.  A column is unique by level, so these
windows hold at most the number of model levels.

Prepared frames have p (hPa), z (m above ground), their ``_up`` partners, ``k`` (position from the
ground, 1-based) and ``top`` (true on the highest level).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions.scalar import EARTH_KM, speed

Layer = Callable[[Column, Column], Column]


def insert_surface(levels: DataFrame, surface: DataFrame, keys: Sequence[str], level: str = "lev") -> DataFrame:
    """Add the surface as level 0; below, equal pressures put the higher index first."""
    return levels.unionByName(surface.withColumn(level, F.lit(0)), allowMissingColumns=True)


def column_window(keys: Sequence[str], level: str):
    """Ground up: descending pressure, the last index first on equal pressure."""
    return Window.partitionBy(*keys).orderBy(F.col("p").desc(), F.col(level).desc())


def prepare(levels: DataFrame, keys: Sequence[str], cols: Sequence[str], level: str = "lev") -> DataFrame:
    w = column_window(keys, level)
    ups = [F.lead(c).over(w).alias(f"{c}_up") for c in ("p", "z", *cols)]
    return levels.select("*", *ups, F.row_number().over(w).alias("k")).withColumn("top", F.col("p_up").isNull())


def between_heights(bottom, top) -> Layer:
    return lambda z, p: (z >= bottom) & (z <= top)


def between_pressures(bottom, top, ps=None) -> Layer:
    if ps is None:
        return lambda z, p: (p <= bottom) & (p >= top)
    return lambda z, p: (p <= bottom) & (p >= top) & (p <= ps)


def _pick(c, cond):
    return F.max(F.when(cond, c))


def at_height(var: str, height, clamp_top: bool = False, clamp_low: bool = True) -> Column:
    """Value at a height above ground: an exact level, else the lowest level if it lies above, else linear.

    Heights rise along a column, so one level at most meets a case and a single aggregate does.
    """
    v, up, z, zu = F.col(var), F.col(f"{var}_up"), F.col("z"), F.col("z_up")
    case = F.when(z == height, v)
    if clamp_low:
        case = case.when((F.col("k") == 1) & (z > height), v)
    case = case.when((z < height) & (zu > height), v + (up - v) * (height - z) / (zu - z))
    if clamp_top:
        case = case.when(F.col("top") & (z < height), v)
    return F.max(case)


def at_pressure(var: str, pressure, clamp_top: bool = False) -> Column:
    """Value at a pressure, with the same rules."""
    v, up, p, pu = F.col(var), F.col(f"{var}_up"), F.col("p"), F.col("p_up")
    case = F.when(p == pressure, v).when((F.col("k") == 1) & (p < pressure), v)
    case = case.when((p > pressure) & (pu < pressure), v + (up - v) * (pressure - p) / (pu - p))
    if clamp_top:
        case = case.when(F.col("top") & (p > pressure), v)
    return F.max(case)


def height_of(var: str, value) -> Column:
    """Lowest height where the profile crosses a value."""
    v, up, z, zu = F.col(var), F.col(f"{var}_up"), F.col("z"), F.col("z_up")
    crossing = ((v - value) * (up - value) <= 0) & (v != up)
    return F.min(F.when(v == value, z).when(crossing, z + (zu - z) * (value - v) / F.nullif(up - v, F.lit(0.0))))


def mass_mean_where(var: str, here: Column, above: Column) -> Column:
    """Pressure-weighted mean over the levels with ``here``; a single level is its own mean, none gives null."""
    v, up, p, pu = F.col(var), F.col(f"{var}_up"), F.col("p"), F.col("p_up")
    area = F.sum(F.when(here & above, (v + up) * (pu - p)))
    depth = F.min(F.when(here, p)) - F.max(F.when(here, p))
    return F.when(F.count(F.when(here, 1)) == 1, _pick(v, here)).otherwise(
        F.coalesce(area, F.lit(0.0)) / (2 * F.nullif(depth, F.lit(0.0)))
    )


def mass_mean(var: str, layer: Layer) -> Column:
    return mass_mean_where(var, layer(F.col("z"), F.col("p")), layer(F.col("z_up"), F.col("p_up")))


def plain_mean(var: str, layer: Layer) -> Column:
    return F.avg(F.when(layer(F.col("z"), F.col("p")), F.col(var)))


def layer_min(var: str, layer: Layer) -> Column:
    return F.min(F.when(layer(F.col("z"), F.col("p")), F.col(var)))


def mid_range(var: str, layer: Layer) -> Column:
    inside = F.when(layer(F.col("z"), F.col("p")), F.col(var))
    return (F.min(inside) + F.max(inside)) / 2


def shear_components(u: str, v: str, bottom, top) -> tuple[Column, Column]:
    return at_height(u, top) - at_height(u, bottom), at_height(v, top) - at_height(v, bottom)


def shear(u: str, v: str, bottom, top) -> Column:
    return speed(*shear_components(u, v, bottom, top))


def shear_pressure(u: str, v: str, bottom, top) -> Column:
    return speed(at_pressure(u, top) - at_pressure(u, bottom), at_pressure(v, top) - at_pressure(v, bottom))


def lapse_rate_height(t: str, bottom, top) -> Column:
    """Degrees per km; a top above the last level uses the last level's temperature.

    Bounds may be columns that hold one value per profile (a melting height, a cloud base).
    """
    warm, cold = at_height(t, bottom), at_height(t, top, clamp_top=True, clamp_low=False)
    of = lambda h: F.max(h) if isinstance(h, Column) else F.lit(float(h))
    return -(cold - warm) / F.nullif(of(top) - of(bottom), F.lit(0.0)) * 1000.0


def lapse_rate_pressure(t: str, z: str, bottom, top) -> Column:
    depth = (at_pressure(z, top) - at_pressure(z, bottom)) / 1000.0
    return -(at_pressure(t, top) - at_pressure(t, bottom)) / F.nullif(depth, F.lit(0.0))


def storm_motion(u: str, v: str, top: float = 6000.0) -> dict[str, Column]:
    """Mean 0-6 km wind 7.5 m/s to the right and left of the 0-6 km shear."""
    deep = between_heights(0.0, top)
    mu, mv = plain_mean(u, deep), plain_mean(v, deep)
    su, sv = shear_components(u, v, 0.0, top)
    scale = 7.5 / F.nullif(speed(su, sv), F.lit(0.0))
    return {"u_right": mu + scale * sv, "v_right": mv - scale * su, "u_left": mu - scale * sv, "v_left": mv + scale * su}


def storm_helicity(u: str, v: str, bottom, top, motion_top: float = 6000.0) -> dict[str, Column]:
    """Storm-relative helicity of a layer for the left and right mover.

    Expanding the layer sum in the storm motion leaves three plain sums, so the motion and the
    helicity come out of one aggregation.
    """
    inside = between_heights(bottom, top)
    pair = inside(F.col("z"), F.col("p")) & inside(F.col("z_up"), F.col("p_up"))
    u0, v0, u1, v1 = F.col(u), F.col(v), F.col(f"{u}_up"), F.col(f"{v}_up")
    cross = F.sum(F.when(pair, u1 * v0 - u0 * v1))
    du, dv = F.sum(F.when(pair, u1 - u0)), F.sum(F.when(pair, v1 - v0))
    m = storm_motion(u, v, motion_top)
    return {side: F.abs(cross - m[f"v_{side}"] * du + m[f"u_{side}"] * dv) for side in ("left", "right")}


def precipitable_water(q: str, top: float = 400.0) -> Column:
    """From the mixing ratio (kg/kg) of the layers that end below the top pressure."""
    area = (F.col(q) + F.col(f"{q}_up")) * 1000.0 / 2 * (F.col("p") - F.col("p_up")) * 0.00040173
    return F.sum(F.when((F.col("p") >= top) & (F.col("p_up") >= top), area))


def mark_extremes(levels: DataFrame, keys: Sequence[str], var: str, bottom: float, top: float) -> DataFrame:
    """Adds ``{var}_least`` and ``{var}_most``: the layer's extremes on every level of the column."""
    w = Window.partitionBy(*keys)
    inside = F.when(between_heights(bottom, top)(F.col("z"), F.col("p")), F.col(var))
    return levels.withColumns({f"{var}_least": F.min(inside).over(w), f"{var}_most": F.max(inside).over(w)})


def theta_e_difference(te: str, top: float = 3000.0) -> Column:
    """Max minus min in the layer, zero when the (first) minimum lies below the (first) maximum.

    Needs ``mark_extremes(..., te, 0, top)``; comparing positions of plain numbers keeps the hash aggregate.
    """
    inside = between_heights(0.0, top)(F.col("z"), F.col("p"))
    low, high = F.col(f"{te}_least"), F.col(f"{te}_most")
    low_at = F.min(F.when(inside & (F.col(te) == low), F.col("k")))
    high_at = F.min(F.when(inside & (F.col(te) == high), F.col("k")))
    return F.when(low_at < high_at, 0.0).otherwise(F.max(high) - F.min(low))


def theta_e_index(te: str, sfc_te, ps, depth: float = 400.0) -> Column:
    """Surface theta-e minus the least value of the lowest 400 hPa, not below zero."""
    lowest = F.min(F.when((F.col("p") <= ps) & (F.col("p") >= ps - depth), F.col(te)))
    return F.greatest(sfc_te - lowest, F.lit(0.0))


def max_theta_e_gradient(
    te: str, omega: str, low: float = 2000.0, high: float = 6000.0, min_dz: float = 0.25, only_positive: bool = False
) -> Column:
    """Largest theta-e gradient from a low level to a higher one, times omega at the upper level.

    Works on one column's level array (bounded by the model levels); no pairs are emitted as rows.
    """
    inside = (F.col("z") >= 0) & (F.col("z") <= high)
    levels = F.collect_list(F.when(inside, F.struct(F.col("z").alias("z"), F.col(te).alias("te"), F.col(omega).alias("om"))))

    def best_from(i):
        def one(j):
            dz = (j["z"] - i["z"]) / 1000.0
            return F.when(dz >= min_dz, (j["te"] - i["te"]) / dz * j["om"])

        return F.array_max(F.transform(levels, one))

    found = F.array_max(F.transform(F.filter(levels, lambda i: i["z"] <= low), best_from))
    return F.greatest(found, F.lit(0.0)) if only_positive else found


def updraft_helicity(vorticity: str, w: str, bottom: int = 2000, top: int = 5000, step: int = 1000) -> Column:
    """Sum over 1 km layers of mean vorticity times mean vertical velocity, x 1000."""
    total = F.lit(0.0)
    for b in range(bottom, top, step):
        layer = between_heights(float(b), float(b + step))
        total = total + mass_mean(vorticity, layer) * mass_mean(w, layer)
    return total * 1000.0


def most_unstable(cape: str, attributes: Sequence[str], ps, depth: float = 500.0) -> Column:
    """Attributes of the level with most CAPE in the lowest 500 hPa, the lowest such level on ties."""
    inside = (F.col("p") <= ps) & (F.col("p") >= ps - depth) & F.col(cape).isNotNull()
    return F.max_by(F.struct(cape, *attributes), F.when(inside, F.struct(F.col(cape), -F.col("k"))))


def least_theta_e(te: str, attributes: Sequence[str], ps, depth: float = 400.0, min_p: float = 300.0) -> Column:
    """Attributes of the level with least theta-e in the lowest 400 hPa."""
    inside = (F.col("p") <= ps) & (ps - F.col("p") <= depth) & (F.col("p") >= min_p)
    return F.min_by(F.struct(*attributes), F.when(inside, F.struct(F.col(te), F.col("k"))))


def buoyancy_areas(levels: DataFrame, keys: Sequence[str], parcel: str, env: str, ps: Column, level: str = "lev") -> DataFrame:
    """CAPE, CIN (the negative area below the first positive level) and downdraft CAPE by trapezoids."""
    b = 9.81 * (F.col(parcel) - F.col(env)) / (F.col(env) + 273.15)
    rows = levels.withColumns({"pos": F.greatest(b, F.lit(0.0)), "neg": F.least(b, F.lit(0.0)), "_b": b})
    rows = rows.withColumn("down", F.when(F.col("p") < ps, F.col("neg")).otherwise(0.0))
    first_up = F.min(F.when(F.col("_b") > 0, F.col("z"))).over(Window.partitionBy(*keys))
    up = prepare(rows, keys, ["pos", "neg", "down"], level).withColumn("_z0", first_up)
    area = lambda c: (F.col(c) + F.col(f"{c}_up")) / 2 * (F.col("z_up") - F.col("z"))
    return up.groupBy(*keys).agg(
        F.sum(area("pos")).alias("cape"),
        F.coalesce(F.sum(F.when(F.col("z_up") <= F.col("_z0"), area("neg"))), F.lit(0.0)).alias("cin"),
        (-F.sum(area("down"))).alias("dcape"),
    )


def accepted_soundings(
    levels: DataFrame, keys: Sequence[str], min_rows: int = 12, top: float = 200.0, base: float = 850.0, gap: float = 100.0
) -> DataFrame:
    """Levels of the soundings with enough rows, a deep enough reach and no large pressure gap."""
    w = Window.partitionBy(*keys).orderBy(F.col("p").desc())
    gaps = levels.withColumn("_gap", F.lag("p").over(w) - F.col("p"))
    ok = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("p").alias("_top"), F.max("p").alias("_base"), F.max("_gap").alias("_g")
    )
    ok = ok.where((F.col("_n") > min_rows) & (F.col("_top") < top) & (F.col("_base") > base) & (F.col("_g") < gap))
    return levels.join(ok.select(*keys), list(keys), "left_semi")


def mean_between_nearest(var: str, bottom: float, top: float) -> Column:
    """Mean of the levels from the one nearest ``bottom`` to the one nearest ``top`` (older form).

    Level arrays are bounded by the model levels.
    """
    levels = F.array_sort(F.collect_list(F.struct(F.col("k").alias("k"), F.col("z").alias("z"), F.col(var).alias("v"))))

    def nearest(h):
        return F.array_min(F.transform(levels, lambda x: F.struct(F.abs(x["z"] - h), x["k"])))["k"]

    inside = F.filter(levels, lambda x: (x["k"] >= nearest(bottom)) & (x["k"] <= nearest(top)))
    return F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(inside)


def density_mean(var: str, density: str, layer: Layer) -> Column:
    inside = layer(F.col("z"), F.col("p"))
    return F.sum(F.when(inside, F.col(var) * F.col(density))) / F.nullif(F.sum(F.when(inside, F.col(density))), F.lit(0.0))


def critical_angle(u: str, v: str, storm_u: Column, storm_v: Column, sfc_u: Column, sfc_v: Column, height: float = 500.0) -> Column:
    """Angle between the storm-relative surface wind and the low shear vector, degrees."""
    su, sv = at_height(u, height) - sfc_u, at_height(v, height) - sfc_v
    ru, rv = storm_u - sfc_u, storm_v - sfc_v
    cosine = (su * ru + sv * rv) / F.nullif(speed(su, sv) * speed(ru, rv), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def derivative(df: DataFrame, line: Sequence[str], order: str, x: str, values: Sequence[str], suffix: str) -> DataFrame:
    """d(value)/dx along grid lines: three-point centred, three-point one-sided at the ends.

    A line is one row or column of the grid at one time, so the window is bounded by the grid size.
    """
    w = Window.partitionBy(*line).orderBy(order)
    at = lambda c, o: F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w)
    xs = {o: at(x, o) if o else F.col(x) for o in (-2, -1, 0, 1, 2)}
    frame = df.withColumns({f"_x{o}": xs[o] for o in xs})
    out = {}
    for val in values:
        f = {o: at(val, o) if o else F.col(val) for o in (-2, -1, 0, 1, 2)}
        x_ = {o: F.col(f"_x{o}") for o in xs}

        def three(a, b, c, here, f=f, x_=x_):
            """Slope at ``here`` of the parabola through points a, b, c."""
            xa, xb, xc, xh = x_[a], x_[b], x_[c], x_[here]
            return (
                f[a] * ((xh - xb) + (xh - xc)) / ((xa - xb) * (xa - xc))
                + f[b] * ((xh - xa) + (xh - xc)) / ((xb - xa) * (xb - xc))
                + f[c] * ((xh - xa) + (xh - xb)) / ((xc - xa) * (xc - xb))
            )

        inner = x_[-1].isNotNull() & x_[1].isNotNull()
        two = F.when(x_[1].isNotNull(), (f[1] - f[0]) / (x_[1] - x_[0])).otherwise((f[0] - f[-1]) / (x_[0] - x_[-1]))
        out[f"{val}_{suffix}"] = (
            F.when(inner, three(-1, 0, 1, 0))
            .when(x_[1].isNotNull() & x_[2].isNotNull(), three(0, 1, 2, 0))
            .when(x_[-1].isNotNull() & x_[-2].isNotNull(), three(-2, -1, 0, 0))
            .otherwise(two)
        )
    return frame.withColumns(out).drop(*[f"_x{o}" for o in xs])


def horizontal_derivatives(
    grid: DataFrame, step: Sequence[str], i: str, j: str, values: Sequence[str], lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Adds ``{v}_dx`` and ``{v}_dy`` per metre on a sphere, for rows i (latitude) and columns j (longitude)."""
    metre = EARTH_KM * 1000.0
    rows = grid.withColumns(
        {"_mx": F.radians(lon) * metre * F.cos(F.radians(lat)), "_my": F.radians(lat) * metre}
    )
    rows = derivative(rows, [*step, i], j, "_mx", values, "dx")
    rows = derivative(rows, [*step, j], i, "_my", values, "dy")
    return rows.drop("_mx", "_my")


def kinematic_terms(u: str, v: str) -> dict[str, Column]:
    ux, uy, vx, vy = (F.col(f"{c}_{d}") for c in (u, v) for d in ("dx", "dy"))
    return {"divergence": ux + vy, "vorticity": vx - uy, "stretching": ux - vy, "shearing": vx + uy}
