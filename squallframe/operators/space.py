"""Regridding, regions and ensembles (O)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squallframe import refs


def _axis_weights(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(target value, source value, weight) along one axis; empty outside the source range.

    An axis has as many values as the grid has rows or columns, so one short window orders it.
    """
    pts = source.select(F.col(axis).alias("v")).distinct().withColumn("s", F.lit(1))
    both = pts.unionByName(target.select(F.col(axis).alias("v")).distinct().withColumn("s", F.lit(0)))
    known = F.when(F.col("s") == 1, F.col("v"))
    up = Window.orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col("v").desc()).rangeBetween(Window.unboundedPreceding, 0)
    near = both.select("v", "s", F.max(known).over(up).alias("lo"), F.min(known).over(down).alias("hi")).where("s = 0")
    near = near.where("lo IS NOT NULL AND hi IS NOT NULL")
    frac = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    ends = F.array(F.struct(F.col("lo").alias("src"), (1 - frac).alias("w")), F.struct(F.col("hi").alias("src"), frac.alias("w")))
    return near.select(F.col("v").alias(axis), F.inline(ends)).where("w > 0").withColumnRenamed("src", f"{axis}_s").withColumnRenamed("w", f"w_{axis}")


def bilinear_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """Static table (lat, lon, lat_s, lon_s, w, corners) from the two regular grids."""
    rows = target.select("lat", "lon").distinct()
    w = rows.join(_axis_weights(source, target, "lat"), "lat").join(_axis_weights(source, target, "lon"), "lon")
    w = w.withColumn("w", F.col("w_lat") * F.col("w_lon")).drop("w_lat", "w_lon")
    corners = w.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("corners"))
    return w.join(corners, ["lat", "lon"])


def regrid(cube: DataFrame, weights: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Weighted sum of the source corners; null if any corner is null, absent outside the source grid."""
    src = cube.withColumnsRenamed({"lat": "lat_s", "lon": "lon_s"})
    out = src.join(weights, ["lat_s", "lon_s"]).groupBy(*keys, "lat", "lon").agg(
        F.sum(F.col("w") * F.col(value)).alias("_v"), F.count(value).alias("_n"), F.first("corners").alias("_c")
    )
    return out.select(*keys, "lat", "lon", F.when(F.col("_n") == F.col("_c"), F.col("_v")).alias(value))


def regrid_mask(mask: DataFrame, target: DataFrame, name: str = "lsm", cutoff: float = 50.0) -> DataFrame:
    """Nearest-cell mask, then 1 at or above the cutoff; each axis is matched on its own."""
    out = target.select("lat", "lon").distinct()
    for axis in ("lat", "lon"):
        w = _axis_weights(mask, target, axis)
        best = w.groupBy(axis).agg(F.max_by(f"{axis}_s", F.struct(F.col(f"w_{axis}"), -F.col(f"{axis}_s"))).alias(f"{axis}_s"))
        out = out.join(best, axis)
    src = mask.withColumnsRenamed({"lat": "lat_s", "lon": "lon_s"})
    return out.join(src, ["lat_s", "lon_s"]).select("lat", "lon", (F.col(name) >= cutoff).cast("int").alias(name))


def coarsen(cube: DataFrame, keys: Sequence[str], i: str, j: str, value: str, size: int = 6) -> DataFrame:
    """Block means; incomplete blocks are left out.  Needs one row per (keys, i, j)."""
    out = cube.groupBy(*keys, F.floor(F.col(i) / size).cast("int").alias("bi"), F.floor(F.col(j) / size).cast("int").alias("bj")).agg(
        F.avg(value).alias(value), F.count(F.lit(1)).alias("_n")
    )
    return out.where(F.col("_n") == size * size).drop("_n")


def tag_regions(cells: DataFrame, edges: DataFrame, cell: Sequence[str], band: float = 1.0) -> DataFrame:
    """Region of each cell centre by ray casting; the region with the largest id wins.

    ``edges`` (region_id, x1, y1, x2, y2) are repeated for the latitude bands they cross, cells keep
    their own band, so a cell only meets the edges at its latitude.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.where(F.col("y1") != F.col("y2")).withColumn(
        "_band", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band)))
    )
    own = cells.select(*cell, "lat", "lon").distinct().withColumn("_band", F.floor(F.col("lat") / band))
    y, x = F.col("lat"), F.col("lon")
    crosses = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hits = own.join(spread, "_band").where(crosses & (x < at))
    inside = hits.groupBy(*cell, "region_id").agg(F.count(F.lit(1)).alias("_c")).where("_c % 2 = 1")
    return inside.groupBy(*cell).agg(F.max("region_id").alias("region_id"))


def polygon_edges(spark, polygons: dict[int, Sequence[tuple[float, float]]]) -> DataFrame:
    """Edge table of short hand-written polygons; large shapes arrive as a table."""
    rows = []
    for rid, pts in polygons.items():
        ring = list(pts)
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
            rows.append((rid, float(xa), float(ya), float(xb), float(yb)))
    return refs.literal_table(spark, rows, ["region_id", "x1", "y1", "x2", "y2"])


def regional_change(cube: DataFrame, keys: Sequence[str], experiment: str, value: str, relative: bool = True) -> DataFrame:
    """Regional means of both experiments and their (relative, in percent, or absolute) change."""
    of = lambda e: F.avg(F.when(F.col(experiment) == e, F.col(value)))
    g = cube.groupBy(*keys).agg(of("historical").alias("hist"), of("scenario").alias("scen"))
    diff = F.col("scen") - F.col("hist")
    return g.withColumn("change", diff / F.nullif("hist", F.lit(0.0)) * 100 if relative else diff)


def model_bias(cube: DataFrame, cell: Sequence[str], model: str, reference, value: str) -> DataFrame:
    """Difference of each model's mean from the reference model's mean, absolute and relative."""
    means = cube.groupBy(model, *cell).agg(F.avg(value).alias("mean"))
    ref = means.where(F.col(model) == reference).select(*cell, F.col("mean").alias("ref"))
    out = means.where(F.col(model) != reference).join(ref, list(cell))
    return out.withColumns({"bias": F.col("mean") - F.col("ref"), "relative": (F.col("mean") - F.col("ref")) / F.nullif("ref", F.lit(0.0)) * 100})


def pattern_correlation(bias: DataFrame, model: str) -> DataFrame:
    """Correlation over cells of a model's mean map with the reference map, with RMSE."""
    return bias.groupBy(model).agg(
        F.corr("mean", "ref").alias("r"), F.sqrt(F.avg(F.col("bias") * F.col("bias"))).alias("rmse"), F.count(F.lit(1)).alias("cells")
    )


def select_models(df: DataFrame, model: str, time: str, models: Sequence, first: int, last: int, order: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Chosen models and years, one row per model, cell and time (the first by ``order``).

    The year range is a range on the time column itself, so it reaches the files.
    """
    start, end = F.lit(f"{first}-01-01").cast("timestamp"), F.lit(f"{last + 1}-01-01").cast("timestamp")
    rows = df.where(F.col(model).isin(list(models)) & (F.col(time) >= start) & (F.col(time) < end))
    rest = [c for c in df.columns if c not in (model, time, *cell)]
    top = rows.groupBy(model, time, *cell).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(model, time, *cell, "_r.*")


def annual_cycle_change(cube: DataFrame, keys: Sequence[str], time: str, experiment: str, value: str) -> DataFrame:
    """Monthly mean per key, scenario minus historical."""
    of = lambda e: F.avg(F.when(F.col(experiment) == e, F.col(value)))
    g = cube.groupBy(*keys, F.month(time).alias("month")).agg(of("historical").alias("hist"), of("scenario").alias("scen"))
    return g.withColumn("change", F.col("scen") - F.col("hist"))


def case_window(df: DataFrame, time: str, start: str, end: str, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Rows of a box and a time span, both ends included."""
    span = F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return df.where(span & F.col("lat").between(*lat) & F.col("lon").between(*lon))

