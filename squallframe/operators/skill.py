"""Forecast verification (K): threshold sweeps, contingency scores, AUC, bootstrap bounds.

Rows are read once.  A sweep turns each row into a threshold index, counts per index, and works on
those counts; nothing is repeated per threshold.
"""
from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions.draws import counted, lot, picks
from squallframe.functions.scalar import col
from squallframe.operators.ordered import ALL, attach, count_quantiles, keyed, quantiles, row_numbers, running_counts, shared, value_counts
from squallframe.session import settle

MIN_POD = 0.66  # fixed value


def _ratio(a, b):
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def hss(h, m, f, c) -> Column:
    h, m, f, c = (col(x).cast("double") for x in (h, m, f, c))
    return _ratio(2 * (h * c - m * f), m * m + f * f + 2 * h * c + (m + f) * (h + c))


def score(name: str, h, m, f, c, min_pod: float = MIN_POD) -> Column:
    """One side's score from hits, misses, false alarms and correct negatives; -1 (0 for CSI) where undefined."""
    h, m, f, c = (col(x).cast("double") for x in (h, m, f, c))
    pod, pofd = _ratio(h, h + m), _ratio(f, f + c)
    if name == "pss":
        out, undefined = pod - pofd, -1.0
    elif name == "csi":
        out, undefined = F.when(pod > min_pod, _ratio(h, h + m + f)).otherwise(F.when(pod.isNotNull(), 0.0)), 0.0
    elif name == "hss":
        out, undefined = F.when(pod > min_pod, hss(h, m, f, c)).otherwise(F.when(pod.isNotNull(), 0.0)), -1.0
    elif name == "edi":
        a = F.when(pofd > 0, F.ln(pofd))
        b = F.when(pod > 0, F.ln(pod))
        out, undefined = _ratio(a - b, a + b), -1.0
    else:
        raise ValueError(f"unknown score {name!r}")
    return F.coalesce(out, F.lit(undefined))


def two_sided(name: str, hits_gt, fa_gt, hits_lt, fa_lt, n_event, n_other, min_pod: float = MIN_POD, low_pod: float | None = None) -> Column:
    """Best of the rules 'value > t' and 'value < t'."""
    ne, no = col(n_event), col(n_other)
    up = score(name, hits_gt, ne - col(hits_gt), fa_gt, no - col(fa_gt), min_pod)
    down = score(name, hits_lt, ne - col(hits_lt), fa_lt, no - col(fa_lt), min_pod if low_pod is None else low_pod)
    return F.greatest(up, down)


def to_long(df: DataFrame, params: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., param, value) rows; nulls are left out."""
    typed = df.select(*keep, *[F.col(p).cast("double").alias(p) for p in params])
    return typed.unpivot(list(keep), list(params), "param", "value").where("value IS NOT NULL")


def threshold_counts(
    long: DataFrame, keys: Sequence[str], value: str, event: str, steps: int = 1000, top: float = 0.9995,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Contingency counts of both rules at ``steps`` even thresholds from the minimum to the top percentile,
    or between fixed ``limits``.

    Per key: at most steps+1 rows after the counting, so the running sums are small windows.
    """
    rows, keys = keyed(long.where(F.col(event).isNotNull()), keys)
    vc = shared(value_counts(rows, keys, value, {"e": F.col(event).cast("long")}), value, ("n", "e"))
    if limits is None:
        span = count_quantiles(vc, keys, value, {"hi": top}, ("n", "e")).withColumnRenamed("least", "lo")
    else:
        span = vc.groupBy(*keys).agg(F.sum("n").alias("n_total"), F.sum("e").alias("e_total"))
        span = span.withColumns({"lo": F.lit(float(limits[0])), "hi": F.lit(float(limits[1]))})
    span = span.withColumn("step", (F.col("hi") - F.col("lo")) / (steps - 1)).drop("hi")
    at = lambda i: F.col("lo") + i * F.col("step")
    v = F.col(value)
    # how many thresholds lie strictly below the value: a first guess two too low, then four exact checks
    guess = F.ceil((v - F.col("lo")) / F.nullif("step", F.lit(0.0))) - 2
    marked = attach(vc, span, keys).withColumn("_g", F.greatest(F.least(F.coalesce(guess, F.lit(0)), F.lit(steps)), F.lit(0)).cast("int"))
    below = F.col("_g")
    for k in range(4):
        i = F.col("_g") + k
        below = below + ((i < steps) & (at(i) < v)).cast("int")
    flat = F.col("step") == 0
    marked = marked.withColumn("_gt", F.when(flat, F.when(v > F.col("lo"), steps).otherwise(0)).otherwise(below))
    tie = ((F.col("_gt") < steps) & (at(F.col("_gt")) == v)).cast("int")
    marked = marked.withColumn("_lt", F.when(flat, F.when(v >= F.col("lo"), steps).otherwise(0)).otherwise(F.col("_gt") + tie))
    # each distinct value counts at its two indices; the zero row opens every key's list
    names = ["e_gt", "o_gt", "e_lt", "o_lt"]
    e, o, zero = F.col("e"), F.col("n") - F.col("e"), F.lit(0).cast("long")
    cell = lambda i, *c: F.struct(i.cast("int").alias("i"), *[x.alias(n) for x, n in zip(c, names, strict=True)])
    spots = F.array(cell(F.col("_gt"), e, o, zero, zero), cell(F.col("_lt"), zero, zero, e, o), cell(F.lit(0), zero, zero, zero, zero))
    fixed = ["lo", "step", "n_total", "e_total"]
    per = marked.select(*keys, *fixed, F.inline(spots)).groupBy(*keys, "i").agg(
        *[F.sum(c).alias(c) for c in names], *[F.first(c).alias(c) for c in fixed]
    )
    return running_contingency(per, keys, steps)


def running_contingency(per: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """Contingency counts at every threshold from the events and others (e_gt, o_gt, e_lt, o_lt) that change side at ``i``.

    ``per`` has a row per (keys, i) where a count changes, i = 0 always, with lo, step, n_total and e_total of the key.
    """
    names, fixed = ["e_gt", "o_gt", "e_lt", "o_lt"], ["lo", "step", "n_total", "e_total"]
    at = lambda i: F.col("lo") + i * F.col("step")
    w = Window.partitionBy(*keys).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = per.select(*keys, *fixed, F.col("i").alias("_from"), F.lead("i").over(w).alias("_next"), *[F.sum(c).over(upto).alias(c) for c in names])
    # counts only change where a value lies; each run of equal counts is spread over its thresholds
    last = F.least(F.coalesce(F.col("_next"), F.lit(steps)), F.lit(steps)) - 1
    out = run.where(F.col("_from") < steps).withColumn("i", F.explode(F.sequence(F.col("_from"), last)))
    n_other = F.col("n_total") - F.col("e_total")
    return out.select(
        *[k for k in keys if k != ALL], "i", at(F.col("i")).alias("threshold"),
        (F.col("e_total") - F.col("e_gt")).alias("hits_gt"), (n_other - F.col("o_gt")).alias("fa_gt"),
        F.col("e_lt").alias("hits_lt"), F.col("o_lt").alias("fa_lt"), F.col("e_total").alias("n_event"), n_other.alias("n_other"),
    )


def best_thresholds(
    long: DataFrame, keys: Sequence[str], value: str, event: str, name: str = "hss", steps: int = 1000,
    min_pod: float = MIN_POD, low_pod: float | None = None, limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Best score and the lowest threshold reaching it, per key."""
    counts = threshold_counts(long, keys, value, event, steps, limits=limits)
    return pick_best(with_score(counts, name, min_pod, low_pod), keys)


def with_score(counts: DataFrame, name: str, min_pod: float = MIN_POD, low_pod: float | None = None) -> DataFrame:
    s = two_sided(name, "hits_gt", "fa_gt", "hits_lt", "fa_lt", "n_event", "n_other", min_pod, low_pod)
    return counts.withColumn("score", s)


def pick_best(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    top = F.max_by(F.struct("threshold", "score"), F.struct(F.col("score"), -F.col("i")))
    return scored.groupBy(*keys).agg(top.alias("_b")).select(*keys, "_b.threshold", "_b.score")


def pair_sweep(
    df: DataFrame, a: str, b: str, event: str, rule: str, steps: int = 50, top: float = 0.9995
) -> DataFrame:
    """PSS of 'a >= ta AND (OR) b >= tb' on a grid of thresholds.

    Rows collapse to a 2-D histogram of threshold indices; two running sums give every AND count and
    inclusion-exclusion every OR count.
    """
    if rule not in ("and", "or"):
        raise ValueError(rule)
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(event).cast("long").alias("e")).dropna()
    pairs = shared(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e")), "a", ("n", "e"))
    values = pairs.unpivot(["n", "e"], ["a", "b"], "axis", "value").groupBy("axis", "value").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    q = count_quantiles(values, ["axis"], "value", {"hi": top}, ("n", "e")).withColumnRenamed("least", "lo")
    of = lambda axis, c: F.max(F.when(F.col("axis") == axis, c))
    step = (F.col("hi") - F.col("lo")) / (steps - 1)
    span = q.agg(
        *[of(c, F.col("lo")).alias(f"lo_{c}") for c in ("a", "b")], *[of(c, step).alias(f"st_{c}") for c in ("a", "b")],
        F.max("n_total").alias("n_all"), F.max("e_total").alias("n_event"),
    )
    fixed = span.columns
    marked = pairs.crossJoin(F.broadcast(span))  # one row
    thresholds = F.sequence(F.lit(0), F.lit(steps - 1))
    reached = lambda c: F.size(F.filter(thresholds, lambda i: F.col(c) >= F.col(f"lo_{c}") + i * F.col(f"st_{c}")))
    hist = marked.groupBy(reached("a").alias("ia"), reached("b").alias("ib")).agg(
        F.sum("n").alias("n"), F.sum("e").alias("e"), *[F.first(c).alias(c) for c in fixed]
    )
    # from here on at most (steps+1)^2 cells: every cell adds to all cells at or below it on both axes
    cells = hist.withColumn("ja", F.explode(F.sequence(F.lit(0), F.col("ia")))).withColumn("jb", F.explode(F.sequence(F.lit(0), F.col("ib"))))
    run = cells.groupBy(F.col("ja").alias("ia"), F.col("jb").alias("ib")).agg(
        F.sum("n").alias("n"), F.sum("e").alias("e"), *[F.first(c).alias(c) for c in fixed]
    )
    # a pair of limits that no row reaches together still has a place on the grid
    axis = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("ia"))
    dense = axis.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    full = dense.unionByName(run, allowMissingColumns=True).groupBy("ia", "ib").agg(*[F.max(c).alias(c) for c in ("n", "e", *fixed)])
    full = full.select("ia", "ib", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "e")], *fixed)
    by_a, by_b = Window.partitionBy("ia"), Window.partitionBy("ib")
    margin = lambda c, ix, w: F.max(F.when(F.col(ix) == 0, F.col(c))).over(w)
    full = full.withColumns(
        {"na": margin("n", "ib", by_a), "ea": margin("e", "ib", by_a), "nb": margin("n", "ia", by_b), "eb": margin("e", "ia", by_b)}
    )
    whole = Window.partitionBy(F.lit(0))  # the grid only
    full = full.withColumns({c: F.max(c).over(whole) for c in fixed}).where("ia > 0 AND ib > 0")
    both = (F.col("n"), F.col("e")) if rule == "and" else (F.col("na") + F.col("nb") - F.col("n"), F.col("ea") + F.col("eb") - F.col("e"))
    hits, fa = both[1], both[0] - both[1]
    ne = F.col("n_event")
    pss = score("pss", hits, ne - hits, fa, F.col("n_all") - ne - fa)
    t = {c: F.col(f"lo_{c}") + (F.col(f"i{c}") - 1) * F.col(f"st_{c}") for c in ("a", "b")}
    return full.select((F.col("ia") - 1).alias("ia"), (F.col("ib") - 1).alias("ib"), t["a"].alias("ta"), t["b"].alias("tb"), pss.alias("score"))


def best_pair(grid: DataFrame) -> DataFrame:
    """The first best pair in row order."""
    top = F.max_by(F.struct("ta", "tb", "score"), F.struct(F.col("score"), -F.col("ia"), -F.col("ib")))
    return grid.agg(top.alias("_b")).select("_b.*")


def counts_at(rows: DataFrame, keys: Sequence[str], flag: Column, event: str) -> DataFrame:
    """hits, misses, false alarms and correct negatives of a yes/no forecast."""
    e, f = F.col(event) == 1, F.coalesce(flag, F.lit(False))
    one = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    no = F.col(event) == 0
    aggs = [one(e & f).alias("hits"), one(e & ~f).alias("misses"), one(no & f).alias("false_alarms"), one(no & ~f).alias("correct_negatives")]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def rates(counts: DataFrame) -> DataFrame:
    h, m, f, c = (F.col(x) for x in ("hits", "misses", "false_alarms", "correct_negatives"))
    return counts.withColumns(
        {"pod": _ratio(h, h + m), "far": _ratio(f, h + f), "pofd": _ratio(f, f + c), "csi": _ratio(h, h + m + f), "hss": hss(h, m, f, c)}
    )


def hss_at(long: DataFrame, keys: Sequence[str], thresholds: DataFrame, value: str = "value", event: str = "event") -> DataFrame:
    """HSS of the better of '> t' and '<= t' at given thresholds (param, threshold); no POD rule."""
    rows = long.join(thresholds.select("param", "threshold"), "param")
    c = counts_at(rows, [*keys, "param"], F.col(value) > F.col("threshold"), event)
    up = hss("hits", "misses", "false_alarms", "correct_negatives")
    down = hss("misses", "hits", "correct_negatives", "false_alarms")
    return c.withColumn("hss", F.greatest(up, down))


def station_scores(
    long: DataFrame, station: str, thresholds: DataFrame, name: str = "pss", value: str = "value", event: str = "event"
) -> DataFrame:
    """Each station's score at the national threshold; null with one event or none."""
    rows = long.join(thresholds.select("param", "threshold"), "param")
    e, o, gt, lt = F.col(event) == 1, F.col(event) == 0, F.col(value) > F.col("threshold"), F.col(value) < F.col("threshold")
    one = lambda c: F.sum(c.cast("int"))
    c = rows.groupBy(station, "param").agg(
        one(e & gt).alias("hg"), one(o & gt).alias("fg"), one(e & lt).alias("hl"), one(o & lt).alias("fl"), one(e).alias("events"), one(o).alias("others")
    )
    s = two_sided(name, "hg", "fg", "hl", "fl", "events", "others")
    return c.select(station, "param", "events", F.when(F.col("events") > 1, s).alias("score"))


def far_at_two_thirds(
    long: DataFrame, keys: Sequence[str], value: str = "value", event: str = "event", prob: float = 0.33, yes_no: Sequence[str] = ()
) -> DataFrame:
    """Threshold hit by two thirds of the events, with its false-alarm ratio and rate; of a ``yes_no`` parameter it is 1."""
    limit = quantiles(long.where(F.col(event) == 1), keys, value, {"threshold": prob})
    if yes_no:
        limit = limit.withColumn("threshold", F.when(F.col("param").isin(*yes_no), 1.0).otherwise(F.col("threshold")))
    c = counts_at(long.join(limit, list(keys)), [*keys, "threshold"], F.col(value) >= F.col("threshold"), event)
    r = rates(c)
    return r.select(*keys, "threshold", F.col("far").alias("fa_ratio"), F.col("pofd").alias("fa_rate"))


def auc(long: DataFrame, keys: Sequence[str], value: str = "value", event: str = "event") -> DataFrame:
    """Area under the ROC curve from average ranks; ties count half."""
    vc = value_counts(long.where(F.col(event).isNotNull()), keys, value, {"e": F.col(event).cast("long")})
    rc = running_counts(vc, keys, value)
    rank = F.col("n_lt") + (F.col("n") + 1) / 2.0
    agg = [F.sum(F.col("e") * rank).alias("r"), F.sum("e").alias("n1"), F.sum(F.col("n") - F.col("e")).alias("n0")]
    g = rc.groupBy(*keys).agg(*agg) if keys else rc.agg(*agg)
    area = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0) / F.nullif((F.col("n1") * F.col("n0")).cast("double"), F.lit(0.0))
    return g.select(*keys, area.alias("auc"))


def flip_low(long: DataFrame, low_params: Sequence[str], event: str = "event") -> DataFrame:
    """Swap the label for parameters where low values mean danger, on a copy of the rows only."""
    return long.withColumn(event, F.when(F.col("param").isin(*low_params), 1 - F.col(event)).otherwise(F.col(event)))


DRAWS = 1 << 16  # draws that are made at a time
MOST_LABELS = 8  # questions whose answers make groups, so there are 13,122 groups at most


def exceedance_groups(df: DataFrame, event: str, flags: dict[str, Column]) -> DataFrame:
    """(event, flags..., n): rows of a class that answer all the yes/no questions alike; null where a value is missing."""
    asked = df.where(F.col(event).isin(0, 1)).select(event, *[f.cast("int").alias(name) for name, f in flags.items()])
    return asked.groupBy(event, *flags).agg(F.count(F.lit(1)).alias("n"))


def resample_groups(
    groups: DataFrame, event: str, n_rep: int, m: int | None, share: float | None = None, seed: str = "k9", by: Sequence[float] = ()
) -> DataFrame:
    """Bootstrap of groups of like rows: (rep, [share], event, labels..., times).

    Each replicate draws m rows with the event, and as many times the sample's ratio without it (or ``share`` of those there are),
    with replacement.  ``m`` of None draws as many events as there are; ``by`` repeats the draw for several shares.
    ``groups`` has a count n per class and labels; a group owns as many positions of its class as it has rows, in order of the labels.
    So a draw is a number that is looked up among the groups, and no data row is numbered, moved or joined; the draws are made
    and counted in numpy.
    """
    spark = groups.sparkSession
    labels = [c for c in groups.columns if c not in (event, "n")]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{len(labels)} labels: resample at most {MOST_LABELS} at a time")
    # at most 2 x 3^labels rows, as a label is yes, no or missing
    rows = groups.orderBy(event, *labels).collect()
    of = {c: [r for r in rows if r[event] == c] for c in (0, 1)}
    ends = {c: np.cumsum([r["n"] for r in own], dtype=np.int64) for c, own in of.items()}
    ne, no = (int(ends[c][-1]) if len(ends[c]) else 0 for c in (1, 0))
    names = {c: [[r[x] for x in labels] for r in own] for c, own in of.items()}
    reps = spark.range(n_rep).select(F.col("id").cast("int").alias("rep"))
    want_e = F.lit(ne if m is None else m)
    if by:
        reps = reps.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in by])))
        want_o = F.bround(F.lit(no) * F.col("share"))
    elif share is not None:
        want_o = F.bround(F.lit(no) * share)
    else:
        want_o = want_e * F.bround(F.lit(ne + no) / F.lit(ne)) if ne else F.lit(0)
    keys = ["rep", *(["share"] if by else [])]
    classes = F.array(
        F.struct(F.lit(1).alias("c"), want_e.cast("long").alias("want"), F.lit(ne).cast("long").alias("size")),
        F.struct(F.lit(0).alias("c"), want_o.cast("long").alias("want"), F.lit(no).cast("long").alias("size")),
    )
    ask = reps.select(*keys, F.inline(classes)).where("want > 0 AND size > 0")
    ask = ask.withColumn("_start", lot(F.concat_ws("-", F.lit(seed), F.col("c").cast("string"), *([F.col("share").cast("string")] if by else [])), "rep"))
    # a replicate's draws are spread over tasks in blocks
    ask = ask.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want") - 1, F.lit(DRAWS).cast("long"))))
    ask = ask.withColumn("_to", F.least(F.col("_from") + DRAWS, F.col("want"))).repartition(*keys, "c", "_from")
    schema = "rep int, " + ("share double, " if by else "") + f"{event} int, " + "".join(f"{x} int, " for x in labels) + "times long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def draw(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own = tuple(r[: len(keys)])
                c, first, last, start, size = map(int, r[len(keys) :])
                drawn = np.searchsorted(ends[c], picks(start, np.arange(first, last, dtype=np.int64), size), "right")
                times = np.bincount(drawn, minlength=len(ends[c]))
                out += [(*own, c, *names[c][g], int(times[g])) for g in np.flatnonzero(times)]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({x: "Int32" for x in labels})

    asked = ask.select(*keys, "c", "_from", "_to", "_start", "size")
    return asked.mapInPandas(draw, schema).groupBy(*keys, event, *labels).agg(F.sum("times").alias("times"))


def resampled_contingency(sample: DataFrame, keys: Sequence[str], event: str, flags: Sequence[str]) -> DataFrame:
    """Contingency counts per replicate and flag: (keys..., param, hits, misses, false_alarms, correct_negatives)."""
    cell = lambda f, e, y: F.sum(F.when((F.col(event) == e) & (F.col(f) == y), F.col("times")).otherwise(0))
    cells = [("hits", 1, 1), ("misses", 1, 0), ("false_alarms", 0, 1), ("correct_negatives", 0, 0)]
    wide = sample.groupBy(*keys).agg(*[cell(f, e, y).alias(f"{f}_{n}") for f in flags for n, e, y in cells])
    rows = F.array(*[F.struct(F.lit(f).alias("param"), *[F.col(f"{f}_{n}").alias(n) for n, _, _ in cells]) for f in flags])
    return wide.select(*keys, F.inline(rows))


def _thresholds_of(df: DataFrame, params: Sequence[str], thresholds: DataFrame, reached) -> tuple[DataFrame, dict[str, Column]]:
    """The rows beside each parameter's threshold, and whether they reach it."""
    one = thresholds.agg(*[F.max(F.when(F.col("param") == p, F.col("threshold"))).alias(f"_t_{p}") for p in params])
    return df.crossJoin(F.broadcast(one)), {p: reached(F.col(p).cast("double"), F.col(f"_t_{p}")) for p in params}  # one row


def bootstrap_hss_bounds(
    df: DataFrame, params: Sequence[str], event: str, thresholds: DataFrame, n_rep: int = 1000, m: int | None = 100,
    low: float = 0.025, high: float = 0.975, **draw,
) -> DataFrame:
    """Percentile bounds of each parameter's HSS over the replicates."""
    if len(params) > MOST_LABELS:
        parts = [bootstrap_hss_bounds(df, params[i : i + MOST_LABELS], event, thresholds, n_rep, m, low, high, **draw) for i in range(0, len(params), MOST_LABELS)]
        return functools.reduce(DataFrame.unionByName, parts)
    by = ["share"] if draw.get("by") else []
    rows, flags = _thresholds_of(df, params, thresholds, lambda v, t: v > t)
    sample = resample_groups(exceedance_groups(rows, event, flags), event, n_rep, m, **draw)
    c = resampled_contingency(sample, ["rep", *by], event, params)
    best = F.greatest(hss("hits", "misses", "false_alarms", "correct_negatives"), hss("misses", "hits", "correct_negatives", "false_alarms"))
    # one value per replicate and parameter
    return c.withColumn("hss", best).groupBy(*by, "param").agg(
        F.percentile("hss", F.lit(low)).alias("lower"), F.percentile("hss", F.lit(high)).alias("upper"), F.count("hss").alias("replicates")
    )


def bootstrap_pod_bounds(
    df: DataFrame, params: Sequence[str], event: str, thresholds: DataFrame, n_rep: int = 1000, m: int | None = 100, low: float = 0.025, high: float = 0.975
) -> DataFrame:
    if len(params) > MOST_LABELS:
        parts = [bootstrap_pod_bounds(df, params[i : i + MOST_LABELS], event, thresholds, n_rep, m, low, high) for i in range(0, len(params), MOST_LABELS)]
        return functools.reduce(DataFrame.unionByName, parts)
    rows, flags = _thresholds_of(df, params, thresholds, lambda v, t: v >= t)
    sample = resample_groups(exceedance_groups(rows, event, flags), event, n_rep, m)
    pod = rates(resampled_contingency(sample, ["rep"], event, params))
    return pod.groupBy("param").agg(F.percentile("pod", F.lit(low)).alias("lower"), F.percentile("pod", F.lit(high)).alias("upper"))


STRETCH = 4096  # rows of a block of values, about


def draws_below(series: str, n: int, places: Sequence[int], n_rep: int) -> np.ndarray:
    """places x replicates: how many of n draws with replacement from the positions 0 to n - 1 fall below each place.

    The draws come down a binary tree: those of a stretch of positions split binomially between its halves, all replicates at once.
    A node's numbers come from a hash of the series and the stretch, so whoever asks for a place, and however often, sees the
    same draws, and no draw is made by itself.
    """
    out = np.zeros((len(places), n_rep), np.int64)

    def down(lo, hi, draws, before, asked):
        for i in asked:
            if places[i] >= hi:
                out[i] = before + draws
            elif places[i] <= lo:
                out[i] = before
        asked = [i for i in asked if lo < places[i] < hi]
        if asked:
            middle = (lo + hi) // 2
            number = int.from_bytes(hashlib.md5(f"{series}:{lo}:{hi}".encode()).digest(), "little")
            left = np.random.Generator(np.random.Philox(number)).binomial(draws, (middle - lo) / (hi - lo))
            down(lo, middle, left, before, [i for i in asked if places[i] <= middle])
            down(middle, hi, draws - left, before + left, [i for i in asked if places[i] > middle])

    down(0, n, np.full(n_rep, n, np.int64), np.zeros(n_rep, np.int64), range(len(places)))
    return out


def drawn_areas(series: str, total: int, start: int, n: np.ndarray, e: np.ndarray, n_rep: int, some: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of ascending values with n rows and e events each, whose rows stand from ``start`` on in the order of values:
    events and others that each replicate draws, and the pairs of them within the block that stand in order, ties half."""
    below = draws_below(series, total, [start, start + int(n.sum())], n_rep)
    shares = np.concatenate([e, n - e]) / n.sum()
    number = int.from_bytes(hashlib.md5(f"{series}:{start}:rows".encode()).digest(), "little")
    rng = np.random.Generator(np.random.Philox(number))
    out = []
    for at in range(0, n_rep, some):
        drawn = rng.multinomial((below[1] - below[0])[at : at + some], shares)
        events, others = drawn[:, : len(n)], drawn[:, len(n) :]
        area = (events * (np.cumsum(others, axis=1) - others / 2.0)).sum(axis=1)
        out.append((events.sum(axis=1), others.sum(axis=1), area))
    return tuple(np.concatenate(c) for c in zip(*out))


def bootstrap_auc(df: DataFrame, params: Sequence[str], event: str, n_rep: int, low: float = 0.005, high: float = 0.995, seed: str = "k8") -> DataFrame:
    """AUC bounds over whole-sample resamples, for each parameter by itself.

    Rows count by value.  A replicate's draws come down a binary tree over the rows in order of value to blocks of values, and
    within a block to the values at once, so work goes with replicates x distinct values and a row per block and replicate is all
    that is moved; no draw becomes a row.  A replicate without events or without others has no AUC.
    """
    values = to_long(df, params, [event]).groupBy("param", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("e"))
    placed = running_counts(values, ["param"], "value", ("n",)).withColumn("block", F.floor(F.col("n_lt") / STRETCH))

    def draw(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("value")
        first = block.iloc[0]
        e, o, area = drawn_areas(f"{seed}:{key[0]}", int(first["n_total"]), int(first["n_lt"]), block["n"].to_numpy(), block["e"].to_numpy(), n_rep)
        return pd.DataFrame({"param": key[0], "block": key[1], "rep": np.arange(n_rep), "e": e, "o": o, "area": area})

    kinds = "param string, block long, rep int, e long, o long, area double"
    drawn = placed.select("param", "block", "value", "n", "e", "n_lt", "n_total").groupBy("param", "block").applyInPandas(draw, kinds)
    before = Window.partitionBy("param", "rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("area", F.col("area") + F.col("e") * F.coalesce(F.sum("o").over(before), F.lit(0)))
    g = drawn.groupBy("param", "rep").agg(F.sum("area").alias("area"), F.sum("e").alias("e"), F.sum("o").alias("o"))
    g = g.withColumn("auc", _ratio(F.col("area"), F.col("e").cast("double") * F.col("o")))
    return g.groupBy("param").agg(F.percentile("auc", F.lit(low)).alias("lower"), F.percentile("auc", F.lit(high)).alias("upper"))


def conditional_grid_search(
    df: DataFrame, event: str, strong: dict[str, Sequence[float]], moderate: dict[str, Sequence[float]], winds: Sequence[float], min_hit_rate: float = 0.6, max_fa_rate: float = 0.1
) -> DataFrame:
    """CSI, hit rate and false-alarm rate of every combination of two rules that share a wind limit.

    strong: ml_cape > a, s06 >= b, dcape < c, mlm >= wind, dcape > d; moderate: ml_cape > a, dcape > b,
    mlm < wind.  The rules exclude each other, so their counts add: rows collapse to threshold-index
    histograms, each rule's grid is counted alone, and the two grids meet on the wind limit.  ``passes`` marks combinations
    above the hit rate and below the false-alarm rate, ``best`` those of the highest CSI.
    """

    def passed(column, limits, test):
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(limits)]), lambda t: test(F.col(column), t)))

    gt, ge, lt = (lambda a, b: a > b), (lambda a, b: a >= b), (lambda a, b: a < b)
    keep = df.where(F.col(event).isin(0, 1))
    hist = keep.groupBy(
        passed("ml_cape", strong["ml_cape"], gt).alias("sa"), passed("s06", strong["s06"], ge).alias("sb"), passed("dcape", strong["dcape_below"], lt).alias("sc"),
        passed("dcape", strong["dcape_above"], gt).alias("sd"), passed("ml_cape", moderate["ml_cape"], gt).alias("ma"), passed("dcape", moderate["dcape"], gt).alias("mb"),
        passed("mlm", winds, ge).alias("w"),
    ).agg(F.sum(F.col(event).cast("int")).alias("e"), F.sum(1 - F.col(event).cast("int")).alias("o"))
    total = keep.agg(F.sum(F.col(event).cast("int")).alias("ne"), F.sum(1 - F.col(event).cast("int")).alias("no"))

    def grid(bins, axes, wind_cond, prefix):
        """Count each combination of limits; ``axes`` maps index column to (name, sorted limits, 'above' or 'below')."""
        cells = bins.groupBy(*axes, "w").agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
        for ix, (name, limits, side) in axes.items():
            opts = sorted(limits)
            rank = {v: (k if side == "above" else len(opts) - 1 - k) for k, v in enumerate(opts)}
            choice = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(rank[v]).alias("r")) for v in opts])
            cells = cells.withColumn("_c", F.explode(choice)).where(F.col(ix) > F.col("_c.r")).withColumn(name, F.col("_c.v")).drop("_c")
            cells = cells.groupBy(*[c for c in cells.columns if c not in (ix, "e", "o")]).agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
        opts = sorted(winds)
        choice = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(k).alias("r")) for k, v in enumerate(opts)])
        cells = cells.withColumn("_c", F.explode(choice)).where(wind_cond(F.col("w"), F.col("_c.r"))).withColumn("wind", F.col("_c.v"))
        names = [n for n, _, _ in axes.values()]
        return cells.groupBy("wind", *names).agg(F.sum("e").alias(f"{prefix}_e"), F.sum("o").alias(f"{prefix}_o")), names

    sf, sf_names = grid(
        hist, {"sa": ("sf_ml", strong["ml_cape"], "above"), "sb": ("sf_s06", strong["s06"], "above"), "sc": ("sf_dcape_below", strong["dcape_below"], "below"), "sd": ("sf_dcape_above", strong["dcape_above"], "above")},
        lambda w, r: w > r, "sf",
    )
    mf, mf_names = grid(hist, {"ma": ("mf_ml", moderate["ml_cape"], "above"), "mb": ("mf_dcape", moderate["dcape"], "above")}, lambda w, r: w <= r, "mf")
    combos = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(w)) for w in winds])).alias("wind"))
    lists = {
        "sf_ml": strong["ml_cape"], "sf_s06": strong["s06"], "sf_dcape_below": strong["dcape_below"], "sf_dcape_above": strong["dcape_above"],
        "mf_ml": moderate["ml_cape"], "mf_dcape": moderate["dcape"],
    }
    for name, values in lists.items():
        combos = combos.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    full = combos.join(sf, ["wind", *sf_names], "left").join(mf, ["wind", *mf_names], "left").crossJoin(F.broadcast(total))  # one row
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    hits, fa = n("sf_e") + n("mf_e"), n("sf_o") + n("mf_o")
    scored = full.select(
        "wind", *lists, hits.alias("hits"), fa.alias("false_alarms"),
        _ratio(hits, F.col("ne")).alias("hit_rate"), _ratio(fa, F.col("no")).alias("fa_rate"), _ratio(hits, F.col("ne") + fa).alias("csi"),
    )
    top = scored.agg(F.max("csi").alias("_top"))
    scored = scored.crossJoin(F.broadcast(top)).withColumn("best", F.coalesce(F.col("csi") == F.col("_top"), F.lit(False)))  # one row
    passes = (F.col("hit_rate") > min_hit_rate) & (F.col("fa_rate") < max_fa_rate)
    return scored.withColumn("passes", F.coalesce(passes, F.lit(False))).drop("_top")


def curve_counts(df: DataFrame, x: str, y: str, event: str, first: tuple, second: tuple, kind: str = "log") -> DataFrame:
    """Events and non-events strictly above and below a curve through two points.

    'log': y = m ln(x) + c with the points scaled by the first; 'exp': y = c exp(m x); 'linear': y = m x + c.
    """
    (x1, y1), (x2, y2) = first, second
    if kind == "log":
        m, c = (y2 - y1) / math.log(x2 / x1), y1
        line = F.when(F.col(x) > 0, F.lit(m) * F.ln(F.col(x)) + F.lit(float(c)))
        line = F.coalesce(line, F.lit(float("-inf") if m > 0 else float("inf")))
    elif kind == "exp":
        m = math.log(y2 / y1) / (x2 - x1)
        line = F.lit(y1 / math.exp(m * x1)) * F.exp(F.lit(m) * F.col(x))
    elif kind == "linear":
        m = (y2 - y1) / (x2 - x1)
        line = F.lit(float(m)) * F.col(x) + F.lit(float(y1 - m * x1))
    else:
        raise ValueError(kind)
    rows = df.withColumn("_l", line)
    above, below = F.col(y) > F.col("_l"), F.col(y) < F.col("_l")
    one = lambda c: F.sum(c.cast("int"))
    e, o = F.col(event) == 1, F.col(event) == 0
    return rows.agg(
        one(above & e).alias("hits"), one(below & e).alias("misses"), one(above & o).alias("false_alarms"), one(below & o).alias("correct_negatives")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct (keys, value) with the mean rank of its ties."""
    rc = running_counts(value_counts(df, keys, value), keys, value)
    return rc.select(*keys, value, (F.col("n_lt") + (F.col("n") + 1) / 2.0).alias(out))


def weighted_corr(x: str, y: str, w: str) -> Column:
    X, Y, W = F.col(x), F.col(y), F.col(w)
    n = F.sum(W)
    sxy = F.sum(W * X * Y) - F.sum(W * X) * F.sum(W * Y) / n
    sxx = F.sum(W * X * X) - F.sum(W * X) * F.sum(W * X) / n
    syy = F.sum(W * Y * Y) - F.sum(W * Y) * F.sum(W * Y) / n
    return sxy / F.nullif(F.sqrt(sxx * syy), F.lit(0.0))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Rank correlation with tied ranks averaged; equal pairs collapse before any join."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = rows.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    ranked = pairs.join(average_ranks(rows, keys, "_x", "_rx"), [*keys, "_x"]).join(average_ranks(rows, keys, "_y", "_ry"), [*keys, "_y"])
    c = weighted_corr("_rx", "_ry", "_w").alias(out)
    return ranked.groupBy(*keys).agg(c) if keys else ranked.agg(c)


def comparison_stats(df: DataFrame, keys: Sequence[str], obs: str, model: str) -> DataFrame:
    """Pearson r, bias ratio, mean difference, RMSE, and linear and quadratic fits of model on obs."""
    rows = df.where(F.col(obs).isNotNull() & F.col(model).isNotNull())
    x, y, d = F.col(obs), F.col(model), F.col(model) - F.col(obs)
    mean = rows.groupBy(*keys).agg(F.avg(x).alias("_mx"))
    c = rows.join(mean, list(keys)).withColumn("_x", x - F.col("_mx"))
    X = F.col("_x")
    g = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"), (F.avg(y) / F.nullif(F.avg(x), F.lit(0.0))).alias("bias"),
        F.avg(d).alias("mean_difference"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.first("_mx").alias("_mx"), F.sum(X * X).alias("s2"), F.sum(X * X * X).alias("s3"), F.sum(X * X * X * X).alias("s4"),
        F.sum(y).alias("t0"), F.sum(X * y).alias("t1"), F.sum(X * X * y).alias("t2"),
    )
    # centred normal equations (the first moment is zero), solved by elimination
    n, s2, s3, s4 = (F.col(k) for k in ("n", "s2", "s3", "s4"))
    det = s4 * s2 * n - s2 * s2 * s2 - s3 * s3 * n
    a = (F.col("t2") * s2 * n - F.col("t0") * s2 * s2 - F.col("t1") * s3 * n) / F.nullif(det, F.lit(0.0))
    b = (F.col("t1") - a * s3) / F.nullif(s2, F.lit(0.0))
    k = (F.col("t0") - a * s2) / n
    mx = F.col("_mx")
    return g.select(
        *keys, "n", "r", "bias", "mean_difference", "rmse", "slope", "intercept",
        a.alias("quad_2"), (b - 2 * a * mx).alias("quad_1"), (k - b * mx + a * mx * mx).alias("quad_0"),
    )


def join_scores(tables: dict[str, DataFrame], keys: Sequence[str], rank_by: str) -> DataFrame:
    """Outer join of score tables (param, threshold, score) by variant, ranked by one of them.

    The tables have one row per parameter.
    """
    out = None
    for name, t in tables.items():
        named = t.select(*keys, F.col("score").alias(f"score_{name}"))
        out = named if out is None else out.join(named, list(keys), "full")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col(f"score_{rank_by}").desc_nulls_last(), *keys)))
