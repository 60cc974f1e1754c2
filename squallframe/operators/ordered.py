"""Order-dependent work without one-task windows.

A plain ``Window.partitionBy(key).orderBy(x)`` puts a whole key on one task.  A key here may be a
station or a grid cell that holds a third of all rows, so every operator that needs an order runs in
two levels: windows inside (key, bucket), and one small window per key over the bucket totals.
Buckets are a monotone function of the order column, so the results are the same as those of the
plain window.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BINS = 65536  # bins of one key at most; a bin table row is a few numbers
ROWS_PER_BIN = 50_000  # a key gets one bin per this many rows, so small keys stay whole
_UNB, _CUR = Window.unboundedPreceding, Window.currentRow
ALL = "_all"


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped frame a constant key so that grouped code serves both cases."""
    if keys:
        return df, list(keys)
    return df.withColumn(ALL, F.lit(0)), [ALL]


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a table with one row per key.

    Without keys that is one row, and is said so: an equality of constants would be folded away and
    leave the planner to guess which side of a condition-free join is the small one.
    """
    if list(keys) == [ALL]:
        return df.crossJoin(F.broadcast(per_key.drop(ALL)))
    return df.join(per_key, list(keys))


def day_bucket(time: str | Column) -> Column:
    return F.floor(F.unix_timestamp(F.col(time) if isinstance(time, str) else time) / 86400)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value) with its count: ties collapse before any sort."""
    names = {"n", *(sums or {})}
    if names & {value, *keys}:
        raise ValueError(f"rename columns {sorted(names & {value, *keys})}: they clash with the counts")
    extra = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def value_range(df: DataFrame, keys: Sequence[str], value: str, of: Column | None = None) -> DataFrame:
    """Per key: value range (of the rows with ``of``) and the number of bins for its row count."""
    v = F.col(value).cast("double")
    v = v if of is None else F.when(of, v)
    bins = F.least(F.lit(MAX_BINS), F.ceil(F.count(F.lit(1)) / ROWS_PER_BIN)).cast("int")
    return df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), bins.alias("_nb"))


def bin_of(value: str | Column) -> Column:
    """Equal-width slice of [_lo, _hi]; values outside go to the end bins.  Monotone in the value."""
    v = F.col(value) if isinstance(value, str) else value
    raw = F.floor((v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * F.col("_nb"))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.col("_nb") - 1, raw)), F.lit(0)).cast("int")


def with_bin(df: DataFrame, keys: Sequence[str], value: str, keep_low: bool = False) -> DataFrame:
    out = attach(df, value_range(df, keys, value), keys).withColumn("_bin", bin_of(value))
    return out.drop("_hi", "_nb", *([] if keep_low else ["_lo"]))


def shared(vc: DataFrame, value: str, counts: Sequence[str]) -> DataFrame:
    """Tie the value to every count column (all are >= 0, so nothing is dropped).

    The readers of a count table then need the same columns; column pruning leaves their plans equal
    and Spark runs the table's shuffle once for all of them.
    """
    seen = reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in counts])
    return vc.withColumn(value, F.when(seen, F.col(value)))


def _bin_offsets(binned: DataFrame, keys: list[str], counts: Sequence[str]) -> DataFrame:
    """Per (keys, bin): the sum of every earlier bin and the key total; one row per bin."""
    tot = binned.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(f"{c}_bin") for c in counts])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(_UNB, -1)
    whole = Window.partitionBy(*keys)
    out = [F.coalesce(F.sum(f"{c}_bin").over(before), F.lit(0)).alias(f"{c}_off") for c in counts]
    out += [F.sum(f"{c}_bin").over(whole).alias(f"{c}_total") for c in counts]
    return tot.select(*keys, "_bin", *[f"{c}_bin" for c in counts], *out)


def running_counts(
    vc: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str] = ("n",)
) -> DataFrame:
    """For distinct (keys, value) rows add ``{c}_le`` (up to and with), ``{c}_lt`` (before), ``{c}_total``."""
    vc, ks = keyed(shared(vc, value, counts), keys)
    binned = with_bin(vc, ks, value)
    inside = Window.partitionBy(*ks, "_bin").orderBy(value).rowsBetween(_UNB, _CUR)
    for c in counts:
        binned = binned.withColumn(f"{c}_in", F.sum(c).over(inside))
    out = binned.join(_bin_offsets(binned, ks, counts).drop(*[f"{c}_bin" for c in counts]), [*ks, "_bin"])
    for c in counts:
        out = out.withColumn(f"{c}_le", F.col(f"{c}_off") + F.col(f"{c}_in"))
        out = out.withColumn(f"{c}_lt", F.col(f"{c}_le") - F.col(c))
    drop = ["_bin"] + [f"{c}_{s}" for c in counts for s in ("in", "off")]
    return out.drop(*drop, *([] if keys else [ALL]))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float | Column]
) -> DataFrame:
    """Exact linear-interpolated quantiles per key.

    Counts per bin find the bins that hold the wanted ranks; only those bins are sorted.
    """
    return count_quantiles(value_counts(df, keys, value), keys, value, probs, ("n",)).drop("least", "n_total")


def count_quantiles(
    vc: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float | Column], counts: Sequence[str] = ("n",)
) -> DataFrame:
    """``quantiles`` of a table of distinct values with count ``n``; ``counts`` names all its count columns.

    Also returns each key's smallest value as ``least`` and its totals as ``{count}_total``.
    """
    vc, ks = keyed(shared(vc, value, counts), keys)
    binned = with_bin(vc, ks, value, keep_low=True)
    offs = _bin_offsets(binned, ks, counts)

    def spot(p):
        return (p if isinstance(p, Column) else F.lit(float(p))) * (F.col("n_total") - 1)

    def ranks(p):
        return F.floor(spot(p)), F.ceil(spot(p))

    wanted = [
        (F.col("n_off") <= r) & (r < F.col("n_off") + F.col("n_bin")) for p in probs.values() for r in ranks(p)
    ]
    need = offs.where(reduce(lambda a, b: a | b, wanted))
    picked = binned.join(need.select(*ks, "_bin", "n_off", *[f"{c}_total" for c in counts]), [*ks, "_bin"])
    inside = Window.partitionBy(*ks, "_bin").orderBy(value).rowsBetween(_UNB, _CUR)
    le = F.col("n_off") + F.sum("n").over(inside)
    picked = picked.withColumns({"_le": le, "_lt": le - F.col("n")})
    aggs = [F.first("_lo").alias("least"), *[F.first(f"{c}_total").alias(f"{c}_total") for c in counts]]
    for name, p in probs.items():
        for tag, r in zip(("lo", "hi"), ranks(p), strict=True):
            hit = (F.col("_lt") <= r) & (r < F.col("_le"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
    out = picked.groupBy(*ks).agg(*aggs)
    cols = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (spot(p) - F.floor(spot(p)))).alias(n)
        for n, p in probs.items()
    ]
    return out.select(*keys, *cols, "least", *[f"{c}_total" for c in counts])


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """1-based position by a column that is unique within the key."""
    base, ks = keyed(df, keys)
    binned = with_bin(base, ks, order)
    offs = _bin_offsets(binned.withColumn("n", F.lit(1)), ks, ["n"]).select(*ks, "_bin", "n_off", "n_total")
    inside = Window.partitionBy(*ks, "_bin").orderBy(order)
    out = binned.withColumn("_in", F.row_number().over(inside)).join(offs, [*ks, "_bin"])
    return (
        out.withColumn(name, F.col("n_off") + F.col("_in"))
        .withColumnRenamed("n_total", f"{name}_total")
        .drop("_bin", "_in", "n_off", *([] if keys else [ALL]))
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, cols: Sequence[str], before: int, after: int
) -> DataFrame:
    """Add ``{c}_prev{i}`` / ``{c}_next{i}`` for the i-th row before and after in the key's order.

    The rows near a bucket's edge form a small table (at most before+after rows per bucket) whose
    neighbours are looked up across buckets; all other rows only look inside their bucket.
    ``order`` must be unique within the key.
    """
    keys, reach = list(keys), max(before, after)
    out_cols = [(f"{c}_prev{i}", c, -i) for c in cols for i in range(1, before + 1)]
    out_cols += [(f"{c}_next{i}", c, i) for c in cols for i in range(1, after + 1)]

    def shifted(w, c, off):
        return F.lag(c, -off).over(w) if off < 0 else F.lead(c, off).over(w)

    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    whole = Window.partitionBy(*keys, "_bucket")
    base = df.withColumn("_bucket", bucket)
    base = base.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_sz"),
        *[shifted(inside, c, off).alias(n) for n, c, off in out_cols],
    )
    head, tail = F.col("_rn") <= reach, F.col("_sz") - F.col("_rn") < reach
    edge_w = Window.partitionBy(*keys).orderBy(*order)
    edges = base.where(head | tail)
    edges = edges.select(
        "*", *[shifted(edge_w, c, off).alias(f"_e_{n}") for n, c, off in out_cols]
    )
    edges = edges.withColumns(
        {n: F.when(head if off < 0 else tail, F.col(f"_e_{n}")).otherwise(F.col(n)) for n, _, off in out_cols}
    ).select(*base.columns)
    return base.where(~(head | tail)).unionByName(edges).drop("_bucket", "_rn", "_sz")


def lookup_rows(
    queries: DataFrame, knots: DataFrame, keys: Sequence[str], x: str, xp: str, fp: str, out: str, fp_left: str | None = None
) -> DataFrame:
    """``interp_lookup`` for rows that repeat a query value only a few times: all columns ride along.

    Queries and knots meet in one sort per (key, bin).  The bins are sized by the key's rows, so the
    table of bin ends that carries knots across empty bins has one row per ROWS_PER_BIN rows.
    """
    pay = [c for c in queries.columns if c not in keys]
    asked, ks = keyed(queries.where(F.col(x).isNotNull()).withColumn("_pay", F.struct(*pay)), keys)
    asked = asked.select(*ks, F.col(x).cast("double").alias("_x"), F.lit(None).cast("struct<_x:double,_f:double,_l:double>").alias("_k"), "_pay")
    curve, _ = keyed(knots, keys)
    knot = F.struct(
        F.col(xp).cast("double").alias("_x"), F.col(fp).cast("double").alias("_f"), F.col(fp_left or fp).cast("double").alias("_l")
    )
    curve = curve.select(*ks, F.col(xp).cast("double").alias("_x"), knot.alias("_k"))
    both = asked.unionByName(curve, allowMissingColumns=True)
    ranges = value_range(both, ks, "_x", F.col("_k").isNotNull())
    rows = attach(both, ranges, ks).withColumn("_bin", bin_of("_x")).drop("_lo", "_hi", "_nb")
    ends = attach(curve, ranges, ks).withColumn("_bin", bin_of("_x")).groupBy(*ks, "_bin").agg(F.min("_k").alias("_h"), F.max("_k").alias("_t"))
    every = ranges.select(*ks, F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_bin")).join(ends, [*ks, "_bin"], "left")
    # frames that grow from the start cost one step per row; frames that reach to the end would cost a
    # pass per row, so looking ahead is looking back in reverse order
    up, down = (Window.partitionBy(*ks).orderBy(o).rowsBetween(_UNB, -1) for o in (F.col("_bin"), F.col("_bin").desc()))
    carry = every.select(
        *ks, "_bin", F.last("_t", ignorenulls=True).over(up).alias("_p"), F.last("_h", ignorenulls=True).over(down).alias("_n")
    )
    # a query that equals a knot sorts just after it, so its lower knot is that knot
    ask = F.col("_k").isNull()
    here = Window.partitionBy(*ks, "_bin")
    before = here.orderBy(F.col("_x"), ask).rowsBetween(_UNB, _CUR)
    after = here.orderBy(F.col("_x").desc(), ask.desc()).rowsBetween(_UNB, _CUR)
    near = rows.select("*", F.last("_k", ignorenulls=True).over(before).alias("_a"), F.last("_k", ignorenulls=True).over(after).alias("_b"))
    near = near.where(F.col("_k").isNull()).join(carry, [*ks, "_bin"])
    lo, hi = F.coalesce("_a", "_p"), F.coalesce("_b", "_n")
    line = lo["_f"] + (hi["_l"] - lo["_f"]) / F.nullif(hi["_x"] - lo["_x"], F.lit(0.0)) * (F.col("_x") - lo["_x"])
    value = F.when(lo.isNull(), hi["_l"]).when(hi.isNull() | (lo["_x"] == F.col("_x")), lo["_f"]).otherwise(line)
    return near.select(*keys, "_pay.*", value.alias(out))


def interp_lookup(
    queries: DataFrame, knots: DataFrame, keys: Sequence[str], x: str, xp: str, fp: str, out: str, fp_left: str | None = None
) -> DataFrame:
    """Piecewise-linear lookup of ``x`` in the curve (xp, fp) of the same key, clamped at both ends.

    Knots must be unique on (keys, xp).  A curve that jumps at its knots gives the value reached from
    the left in ``fp_left``; the knot itself and what lies to its right use ``fp``.  A value is looked
    up once however often it occurs, and joined back.
    """
    points = queries.select(*keys, x).distinct()
    found = lookup_rows(points, knots, keys, x, xp, fp, "_found", fp_left)
    found = found.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, x]], F.col("_found").alias(out))
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in [*keys, x]])
    return queries.join(found, match, "left").select(*queries.columns, out)
