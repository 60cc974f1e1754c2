"""Named diagnostics of vertical columns: a registry with dependencies, resolved to one shuffle for any list of names.

A diagnostic belongs to a stage.  ``level``: a value on every level, from the level's own columns.  ``mark``: one value a column, put
on all its levels, so that layers may depend on it (a melting height, a cloud base).  ``column``: an aggregate over the pairs of
levels, and the marks.  ``index``: an expression over column values.  ``diagnose`` resolves what the asked names need,
pairs the levels by one window over the column, and computes everything of a stage together; windows and aggregation
share the column's partitioning.

Level inputs: p (hPa), z (m above ground), ta and dp (deg C), ua and va (m/s); for the buoyancy diagnostics also the
temperature of the lifted parcels, parcel_sb, parcel_ml, parcel_mu, and of the sinking one, parcel_down.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions import composites as X
from squallframe.functions import thermo as T
from squallframe.functions.scalar import speed
from squallframe.operators import profile as P

STAGES = ("level", "mark", "column", "index")
INPUTS = ("p", "z", "ta", "dp", "ua", "va", "parcel_sb", "parcel_ml", "parcel_mu", "parcel_down")
PARCELS = ("sb", "ml", "mu")
# The layers over which the shear of the maintenance probability is taken, m
SHEAR_LOWS, SHEAR_TOPS = range(0, 1001, 250), range(6000, 10001, 1000)


@dataclass(frozen=True)
class Diagnostic:
    name: str
    stage: str
    needs: tuple[str, ...]
    make: Callable[[], Column]


REGISTRY: dict[str, Diagnostic] = {}


def register(stage: str, name: str, needs: str, make: Callable[[], Column]) -> None:
    """Add a diagnostic; ``needs`` are names of inputs or of others, which come at an earlier stage or the same one."""
    if name in REGISTRY or name in INPUTS:
        raise ValueError(f"diagnostic {name!r} registered twice")
    REGISTRY[name] = Diagnostic(name, stage, tuple(needs.split()), make)


def resolve(names: Iterable[str]) -> dict[str, list[Diagnostic]]:
    """Stage -> the diagnostics that the names take, each after what it needs; unknown names and circles are errors."""
    out, done, path = {s: [] for s in STAGES}, set(), []

    def visit(name: str, by: str | None):
        if name in INPUTS or name in done:
            return
        if name not in REGISTRY:
            raise KeyError(f"no diagnostic {name!r}" + (f", needed by {by!r}" if by else ""))
        if name in path:
            raise ValueError(f"diagnostics need each other: {' -> '.join([*path, name])}")
        own = REGISTRY[name]
        path.append(name)
        for n in own.needs:
            visit(n, name)
            if n in REGISTRY and STAGES.index(REGISTRY[n].stage) > STAGES.index(own.stage):
                raise ValueError(f"{name!r} is of an earlier stage than {n!r}, which it needs")
        path.pop()
        done.add(name)
        out[own.stage].append(own)

    for name in names:
        visit(name, None)
    return out


def inputs(names: Iterable[str]) -> list[str]:
    """The level columns that the names take, p and z always."""
    used = {n for group in resolve(names).values() for d in group for n in d.needs}
    return [c for c in INPUTS if c in used | {"p", "z"}]


def rounds(group: list[Diagnostic]) -> list[list[Diagnostic]]:
    """The diagnostics of a stage in as few steps as their needs among each other allow."""
    depth = {}
    for d in group:  # each comes after what it needs
        depth[d.name] = 1 + max((depth[n] for n in d.needs if n in depth), default=-1)
    return [[d for d in group if depth[d.name] == i] for i in range(max(depth.values(), default=-1) + 1)]


def diagnose(levels: DataFrame, keys: Sequence[str], names: Sequence[str], level: str = "lev") -> DataFrame:
    """(keys, names): a row per column with the asked diagnostics.

    Only what they need is computed and paired.  Names of the stages level and mark can't be asked for by themselves.  A layer or height that
    a column does not reach gives null, as do null inputs.
    """
    plan = resolve(names)
    wrong = [n for n in names if REGISTRY[n].stage in ("level", "mark")]
    if wrong:
        raise ValueError(f"not a value of a column: {wrong}")
    rows = levels.select(*keys, level, *inputs(names))
    for step in rounds(plan["level"]):
        rows = rows.withColumns({d.name: d.make() for d in step})
    paired = dict.fromkeys(n for s in ("mark", "column") for d in plan[s] for n in d.needs if n in INPUTS or REGISTRY[n].stage == "level")
    up = P.prepare(rows, keys, [n for n in paired if n not in ("p", "z")], level)
    whole = Window.partitionBy(*keys)
    for step in rounds(plan["mark"]):
        up = up.withColumns({d.name: d.make().over(whole) for d in step})
    out = up.groupBy(*keys).agg(*[d.make().alias(d.name) for d in plan["column"]] or [F.lit(1).alias("_")])
    for step in rounds(plan["index"]):
        out = out.withColumns({d.name: d.make() for d in step})
    return out.select(*keys, *names)


# --- level values

register("level", "te", "ta dp p", lambda: T.equivalent_potential_temperature("ta", "dp", "p"))
register("level", "q", "dp p", lambda: T.mixing_ratio_from_dewpoint("dp", "p") * 1000.0)
register("level", "rh", "ta dp", lambda: T.rh_from_dewpoint("ta", "dp"))
for _p in (*PARCELS, "down"):
    register("level", f"buoyancy_{_p}", f"parcel_{_p} ta", lambda p=_p: 9.81 * (F.col(f"parcel_{p}") - F.col("ta")) / (F.col("ta") + 273.15))
    register("level", f"lift_{_p}", f"buoyancy_{_p}", lambda p=_p: F.greatest(F.col(f"buoyancy_{p}"), F.lit(0.0)))
    register("level", f"sink_{_p}", f"buoyancy_{_p}", lambda p=_p: F.least(F.col(f"buoyancy_{p}"), F.lit(0.0)))

# --- values of a column that its levels need

register("mark", "ps", "p", lambda: F.max("p"))
register("mark", "melting_at", "ta z", lambda: P.height_of("ta", 0.0))
register("mark", "cloud_base", "ta dp z", lambda: F.max(F.when(F.col("k") == 1, 125.0 * (F.col("ta") - F.col("dp")))))
register("mark", "te_least", "te z", lambda: F.min(F.when(P.between_heights(0.0, 3000.0)(F.col("z"), F.col("p")), F.col("te"))))
register("mark", "te_most", "te z", lambda: F.max(F.when(P.between_heights(0.0, 3000.0)(F.col("z"), F.col("p")), F.col("te"))))
for _p in PARCELS:
    register("mark", f"free_{_p}", f"buoyancy_{_p} z", lambda p=_p: F.min(F.when(F.col(f"buoyancy_{p}") > 0, F.col("z"))))

# --- aggregates over a column


def _layer(low: float, high: float) -> P.Layer:
    return P.between_heights(low, high)


def _area(c: str) -> Column:
    return (F.col(c) + F.col(f"{c}_up")) / 2 * (F.col("z_up") - F.col("z"))


def _wind(of) -> Column:
    return speed(of("ua"), of("va"))


def max_shear() -> Column:
    """The largest shear from any low to any top that the column reaches; every height is interpolated once."""
    at = {h: [P.at_height(c, float(h)) for c in ("ua", "va")] for h in (*SHEAR_LOWS, *SHEAR_TOPS)}
    return F.greatest(*[speed(*(top - low for top, low in zip(at[t], at[b]))) for b in SHEAR_LOWS for t in SHEAR_TOPS])


for _b, _t in ((0, 1), (0, 3), (1, 3), (2, 4), (3, 6), (3, 8)):
    register("column", f"lr{_b}{_t}", "ta z", lambda b=_b, t=_t: P.lapse_rate_height("ta", b * 1000.0, t * 1000.0))
for _b, _t in ((700, 500), (850, 670), (750, 500)):
    register("column", f"lr{_b}_{_t}", "ta z p", lambda b=_b, t=_t: P.lapse_rate_pressure("ta", "z", float(b), float(t)))
register("column", "melting", "melting_at", lambda: F.max("melting_at"))
register("column", "lcl", "cloud_base", lambda: F.max("cloud_base"))
register("column", "pwat", "q p", lambda: P.precipitable_water("q", 400.0) / 1000.0)
for _t in (1, 3, 6):
    register("column", f"q_mean0{_t}", "q z p", lambda t=_t: P.mass_mean("q", _layer(0.0, t * 1000.0)))
    register("column", f"q{_t}", "q z", lambda t=_t: P.at_height("q", t * 1000.0))
    register("column", f"umean0{_t}", "ua va z p", lambda t=_t: _wind(lambda c: P.mass_mean(c, _layer(0.0, t * 1000.0))))
    register("column", f"wind{_t}", "ua va z", lambda t=_t: _wind(lambda c: P.at_height(c, t * 1000.0)))
    for _side in ("left", "right"):
        register("column", f"srh0{_t}_{_side}", "ua va z", lambda t=_t, s=_side: P.storm_helicity("ua", "va", 0.0, t * 1000.0)[s])
register("column", "umean3_12", "ua va z p", lambda: _wind(lambda c: P.mass_mean(c, _layer(3000.0, 12000.0))))
register("column", "umean800_600", "ua va z p", lambda: _wind(lambda c: P.mass_mean(c, P.between_pressures(800.0, 600.0))))
for _b, _t in ((0, 1), (0, 3), (1, 3)):
    register("column", f"rhmin{_b}{_t}", "rh z", lambda b=_b, t=_t: P.layer_min("rh", _layer(b * 1000.0, t * 1000.0)))
for _b, _t in ((0, 1), (0, 3), (0, 6), (0, 10), (1, 3), (3, 6)):
    register("column", f"s{_b}{_t}", "ua va z", lambda b=_b, t=_t: P.shear("ua", "va", b * 1000.0, t * 1000.0))
for _side in ("left", "right"):
    register("column", f"storm_{_side}", "ua va z", lambda s=_side: speed(*(P.storm_motion("ua", "va")[f"{c}_{s}"] for c in "uv")))
register("column", "max_shear", "ua va z", max_shear)
for _c in ("ta", "dp"):
    for _t in (850, 700, 670, 500):
        register("column", f"{_c}{_t}", f"{_c} p", lambda c=_c, t=_t: P.at_pressure(c, float(t)))
for _c in ("u", "v"):
    for _t in (850, 500):
        register("column", f"{_c}{_t}", f"{_c}a p", lambda c=_c, t=_t: P.at_pressure(f"{c}a", float(t)))
register("column", "sfc_te", "te z", lambda: P.at_height("te", 0.0))
register("column", "te_diff", "te te_least te_most z", lambda: P.theta_e_difference("te", 3000.0))
register("column", "te_low", "te ps p", lambda: F.min(F.when(F.col("p") >= F.col("ps") - 400.0, F.col("te"))))
register("column", "lr_freezing", "ta melting_at z", lambda: P.lapse_rate_height("ta", 0.0, F.col("melting_at")))
register("column", "q_melting", "q melting_at z", lambda: P.at_height("q", F.col("melting_at")))
register("column", "lr_subcloud", "ta cloud_base z", lambda: P.lapse_rate_height("ta", 0.0, F.col("cloud_base")))
register("column", "q_mean_subcloud", "q cloud_base z p", lambda: P.mass_mean("q", _layer(0.0, F.col("cloud_base"))))
register("column", "rhmin_subcloud", "rh cloud_base z", lambda: P.layer_min("rh", _layer(0.0, F.col("cloud_base"))))
for _p in PARCELS:
    register("column", f"{_p}_cape", f"lift_{_p} z", lambda p=_p: F.coalesce(F.sum(_area(f"lift_{p}")), F.lit(0.0)))
    register("column", f"{_p}_cin", f"sink_{_p} free_{_p} z", lambda p=_p: F.coalesce(F.abs(F.sum(F.when(F.col("z_up") <= F.col(f"free_{p}"), _area(f"sink_{p}")))), F.lit(0.0)))
register("column", "dcape", "sink_down z", lambda: F.coalesce(-F.sum(_area("sink_down")), F.lit(0.0)))

# --- indices

for _t in (850, 700, 670, 500):
    register("index", f"dpd{_t}", f"ta{_t} dp{_t}", lambda t=_t: F.col(f"ta{t}") - F.col(f"dp{t}"))
register("index", "v_totals", "ta850 ta500", lambda: F.col("ta850") - F.col("ta500"))
register("index", "c_totals", "dp850 ta500", lambda: F.col("dp850") - F.col("ta500"))
register("index", "t_totals", "ta850 dp850 ta500", lambda: X.total_totals(F.col("ta850"), F.col("dp850"), F.col("ta500")))
register("index", "k_index", "ta850 ta500 dp850 dpd700", lambda: X.k_index("ta850", "ta500", "dp850", "dpd700"))
register("index", "sweat", "dp850 t_totals u850 v850 u500 v500", lambda: X.sweat("dp850", "t_totals", "u850", "v850", "u500", "v500"))
register("index", "tei", "sfc_te te_low", lambda: F.greatest(F.col("sfc_te") - F.col("te_low"), F.lit(0.0)))
register("index", "tq", "ta850 dp850 ta700", lambda: X.tq("ta850", "dp850", "ta700"))
register("index", "stp_fixed", "sb_cape lcl srh01_left s06", lambda: X.stp_fixed("sb_cape", "lcl", "srh01_left", "s06"))
register("index", "stp_cin", "ml_cape lcl srh01_left s06 ml_cin", lambda: X.stp_cin("ml_cape", "lcl", "srh01_left", "s06", "ml_cin"))
register("index", "scp", "mu_cape srh03_left s06", lambda: X.scp("mu_cape", "srh03_left", "s06"))
register("index", "scp_fixed", "mu_cape srh01_left s06", lambda: X.scp_fixed("mu_cape", "srh01_left", "s06"))
register("index", "ship", "mu_cape q_mean01 lr700_500 ta500 s06 melting", lambda: X.ship("mu_cape", "q_mean01", "lr700_500", "ta500", "s06", "melting"))
register("index", "mmp", "max_shear lr38 mu_cape umean3_12", lambda: X.mmp("max_shear", "lr38", "mu_cape", "umean3_12"))
register("index", "sherb", "s03 lr03 lr700_500", lambda: X.sherb("s03", "lr03", "lr700_500"))
register("index", "wndg", "ml_cape ml_cin lr03 umean800_600", lambda: X.wndg("ml_cape", "ml_cin", "lr03", "umean800_600"))
register("index", "esp", "ml_cape lr03", lambda: X.esp("ml_cape", "lr03"))
register("index", "mburst", "sfc_te sb_cape pwat dcape lr03 v_totals tei", lambda: X.mburst("sfc_te", "sb_cape", "pwat", "dcape", "lr03", "v_totals", "tei"))
register("index", "dcp", "dcape mu_cape s06 umean06", lambda: X.dcp("dcape", "mu_cape", "s06", "umean06"))
register("index", "windex", "melting q_mean01 lr_freezing q_melting", lambda: X.windex("melting", "q_mean01", "lr_freezing", "q_melting"))
register("index", "gustex", "windex umean06", lambda: X.gustex("windex", "umean06"))
register("index", "hmi", "lr850_670 dpd850 dpd670", lambda: X.hmi("lr850_670", "dpd850", "dpd670"))
register("index", "dmi", "lr750_500 dpd700 dpd500", lambda: X.dmi("lr750_500", "dpd700", "dpd500"))
register("index", "wmsi", "ml_cape te_diff", lambda: X.wmsi("ml_cape", "te_diff"))
register("index", "mwpi", "ml_cape lr850_670 dpd850 dpd670", lambda: X.mwpi("ml_cape", "lr850_670", "dpd850", "dpd670"))
register("index", "wmpi", "melting lr_freezing q1 q_melting", lambda: X.wmpi("melting", "lr_freezing", "q1", "q_melting"))
for _p in PARCELS:
    register("index", f"{_p}_cape_s06", f"{_p}_cape s06", lambda p=_p: X.cape_shear(f"{p}_cape", "s06"))
register("index", "dmgwind", "dcape umean800_600", lambda: X.dmgwind("dcape", "umean800_600"))
register("index", "convgust_wet", "umean06 dcape", lambda: X.convgust_wet("umean06", "dcape"))
register("index", "convgust_dry", "umean06 dcape", lambda: X.convgust_dry("umean06", "dcape"))

FULL = tuple(n for n, d in REGISTRY.items() if d.stage in ("column", "index"))
# The short list of diagnostics that is kept when space matters
REDUCED = ("ml_cape", "mu_cape", "ml_cin", "lcl", "lr03", "lr13", "lr_freezing", "q_mean01", "q_melting", "pwat", "t_totals", "te_diff", "dcape", "srh01_left", "s06", "s03", "umean06", "umean800_600", "dcp", "scp", "stp_fixed", "ship", "mmp", "sweat", "k_index")
