"""Logistic models, predictor selection, collinearity and density (L).

Fits run as Spark jobs; only coefficients, p-values and k x k sums reach the driver.  Fitted
models are applied as plain column expressions.  Tables that several fits read should be settled first.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions import scalar as S
from squallframe.functions.scalar import logistic
from squallframe.operators import skill as K
from squallframe.operators.ordered import quantiles, running_counts, value_counts
from squallframe.session import settle

PROB_STEPS = 101  # fixed value: probability thresholds 0, 0.01, ... 1


def top_by_score(scores: DataFrame, kind: str, value: str, name: str, n: int = 20) -> DataFrame:
    """Names in the top n of any score; the table has one row per score and name."""
    w = Window.partitionBy(kind).orderBy(F.col(value).desc(), name)
    return scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(name).distinct()


@dataclass(frozen=True)
class Model:
    predictors: tuple[str, ...]
    coefs: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        return logistic(S.linear(dict(zip(self.predictors, self.coefs, strict=True)), self.intercept))


def _vectors(df: DataFrame, predictors: Sequence[str], *keep: str | Column) -> DataFrame:
    typed = df.select(*[F.col(p).cast("double").alias(p) for p in predictors], *keep)
    return VectorAssembler(inputCols=list(predictors), outputCol="features").transform(typed).drop(*predictors)


def balanced_fits(
    df: DataFrame, event: str, fits: Sequence[tuple[Column | None, Sequence[str]]], penalty: float = 1.0, max_iter: int = 1000, tol: float = 1e-10
) -> list[Model]:
    """L2 logistic fits with class weights n / (2 n_k), one for each (training rows or None for all, predictors).

    Newton's method on all fits at once: a step is one pass of ``newton_sums``, and the driver solves a small system per fit.  The intercept is not penalised, so coefficients differ slightly
    from solvers that do.  Fits that are not done after ``max_iter`` steps are an error.
    """
    names = list(dict.fromkeys(p for _, preds in fits for p in preds))
    parts = list({id(t): t for t, _ in fits}.values())
    part_of = np.array([next(i for i, t in enumerate(parts) if t is train) for train, _ in fits])
    holds = F.array(*[F.lit(True) if t is None else F.coalesce(t, F.lit(False)) for t in parts])
    x = F.array(*[F.col(p).cast("double") for p in names])
    rows = settle(df.where(F.col(event).isin(0, 1)).dropna(subset=names).select(F.col(event).cast("double").alias("y"), x.alias("x"), holds.alias("holds")))
    inside = [F.sum(F.col("holds")[i].cast("long")).alias(f"n{i}") for i in range(len(parts))]
    inside += [F.sum(F.when(F.col("holds")[i], F.col("y"))).alias(f"e{i}") for i in range(len(parts))]
    sizes = rows.agg(*inside).first()
    weights = np.zeros((len(parts), 2))
    for i in range(len(parts)):
        n, e = sizes[f"n{i}"] or 0, sizes[f"e{i}"] or 0
        if not e or e == n:
            raise ValueError("both classes are needed")
        weights[i] = n / (2.0 * e), n / (2.0 * (n - e))
    k = len(names) + 1
    beta = np.zeros((len(fits), k))
    free = [np.array([0, *(1 + names.index(p) for p in preds)]) for _, preds in fits]
    ridge = np.diag([0.0] + [penalty] * (k - 1))
    open_ = list(range(len(fits)))
    upper = np.triu_indices(k)
    for _ in range(max_iter):
        sums = newton_sums(rows, beta[open_], part_of[open_], weights)
        left = []
        for f, own in zip(open_, sums):
            hess = ridge.copy()
            hess[upper] += own[k:]
            hess.T[upper] = hess[upper]
            grad = own[:k] + ridge @ beta[f]
            step = np.linalg.solve(hess[np.ix_(free[f], free[f])], grad[free[f]])
            beta[f][free[f]] -= step
            if not np.abs(step).max() < tol * max(1.0, np.abs(beta[f]).max()):
                left.append(f)
        open_ = left
        if not open_:
            beta = np.array([[float(f"{b:.12g}") for b in own] for own in beta])  # digits beyond follow the order of sums
            return [Model(tuple(preds), tuple(float(beta[f][1 + names.index(p)]) for p in preds), float(beta[f][0])) for f, (_, preds) in enumerate(fits)]
    raise RuntimeError(f"{len(open_)} logistic fits did not converge in {max_iter} iterations")


CELLS = 1 << 20  # rows x fits that are held at a time


def newton_sums(rows: DataFrame, beta: np.ndarray, part_of: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row per fit: X'W(p - y), then the upper triangle of X'WP(1 - p)X, over the rows (y, x, holds) of the fit's part.

    A batch is one matrix X; the probabilities of all fits are one product with their coefficients, and so are the sums,
    so no row is repeated for a fit.  Tasks send a number per fit and coefficient pair, which Spark adds up.
    """
    k = beta.shape[1]
    pairs = np.triu_indices(k)
    width = k + len(pairs[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(beta), width))
        for batch in batches:
            step = max(1, CELLS // len(beta))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                y = part.column("y").to_numpy()
                x = np.column_stack([np.ones(len(y)), part.column("x").flatten().to_numpy().reshape(len(y), -1)])
                inside = part.column("holds").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                w = np.where(inside, np.where(y[:, None] == 1, weights[:, 0], weights[:, 1]), 0.0)[:, part_of]
                p = 0.5 * (1.0 + np.tanh(0.5 * (x @ beta.T)))
                total[:, :k] += (w * (p - y[:, None])).T @ x
                total[:, k:] += (w * p * (1.0 - p)).T @ (x[:, pairs[0]] * x[:, pairs[1]])
        fit, at = np.divmod(np.arange(total.size), width)
        yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(at, pa.int32()), pa.array(total.ravel())], names=["fit", "at", "v"])

    out = np.zeros((len(beta), width))
    # a number per task, added in order of size, so that a rerun gives the same bits
    ordered = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda a, v: a + v)
    for r in rows.mapInArrow(add, "fit int, at int, v double").groupBy("fit", "at").agg(ordered.alias("v")).collect():
        out[r["fit"], r["at"]] = r["v"]
    return out


def balanced_fit(df: DataFrame, predictors: Sequence[str], event: str, penalty: float = 1.0, max_iter: int = 1000) -> Model:
    """One of ``balanced_fits``, on all rows."""
    return balanced_fits(df, event, [(None, predictors)], penalty, max_iter)[0]


class SingularDesign(ValueError):
    """The predictors depend on each other linearly, so their coefficients have no standard errors."""


def p_values(df: DataFrame, predictors: Sequence[str], event: str, max_iter: int = 1000) -> dict[str, float]:
    """Wald p-values of an unweighted logistic regression, and of its constant."""
    g = gram(df.withColumn("_one", F.lit(1.0)).dropna(subset=list(predictors)), [*predictors, "_one"])
    scale = np.sqrt(np.diag(g))
    if (scale == 0).any() or np.linalg.matrix_rank(g / np.outer(scale, scale), hermitian=True) < len(g):
        raise SingularDesign(" ".join(predictors))
    rows = _vectors(df, predictors, F.col(event).cast("double").alias("label"))
    fit = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter).fit(rows)
    if fit.summary.numIterations >= max_iter:
        raise RuntimeError(f"the regression did not converge in {max_iter} iterations")
    return dict(zip([*predictors, "const"], (float(p) for p in fit.summary.pValues), strict=True))


HASH_SPACE = 16.0**12


def split_draw(seed: str, split, unique: str) -> Column:
    """A 48-bit number per (seed, split, row); exact as a double."""
    text = F.concat_ws(":", F.lit(seed), split if isinstance(split, Column) else F.lit(str(split)), F.col(unique).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")


CUT_BINS = 4096  # slices of the draws; the draws are even, so a slice holds one in so many of a class's rows


def stratified_cutoffs(df: DataFrame, unique: str, event: str, n_splits: int, train_share: float = 0.8, seed: str = "l2") -> DataFrame:
    """(split, event, cut): rows of a class with a draw up to ``cut`` are that split's training part.

    The cut is the draw of the class's last training row, so the share is exact per class.  Draws are counted by slices first;
    only the slice that holds the cut is put in order.
    """
    ids = settle(df.select(unique, event))  # two passes read them
    drawn = ids.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    drawn = drawn.withColumn("_u", split_draw(seed, F.col("split").cast("string"), unique)).where(F.col("_u").isNotNull())
    drawn = drawn.withColumn("_slice", F.floor(F.col("_u") / HASH_SPACE * CUT_BINS).cast("int"))
    w = Window.partitionBy("split", event)  # the slices only
    slices = drawn.groupBy("split", event, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.select("split", event, "_slice", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.floor(F.sum("_n").over(w) * train_share).alias("_k"))
    held = slices.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_upto"))).select("split", F.col(event).alias("_e"), "_slice", "_before", "_k")
    inside = drawn.join(F.broadcast(held.withColumnRenamed("split", "_s").withColumnRenamed("_slice", "_t")),  # one row per split and class
                        (F.col("split") == F.col("_s")) & F.col(event).eqNullSafe(F.col("_e")) & (F.col("_slice") == F.col("_t")))
    draws = inside.groupBy("split", event, "_before", "_k", "_u").agg(F.count(F.lit(1)).alias("_n"))
    le = F.col("_before") + F.sum("_n").over(w.orderBy("_u").rowsBetween(Window.unboundedPreceding, 0))
    return draws.withColumn("_le", le).where((F.col("_le") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_le"))).select("split", event, F.col("_u").alias("cut"))


def stratified_splits(df: DataFrame, unique: str, event: str, n_splits: int, train_share: float = 0.8, seed: str = "l2") -> list[Column]:
    """One 'is training row' condition per split; the cutoffs (two numbers per split) become literals."""
    cuts = {(r["split"], r[event]): r["cut"] for r in stratified_cutoffs(df, unique, event, n_splits, train_share, seed).collect()}
    out = []
    for s in range(n_splits):
        u = split_draw(seed, s, unique)
        out.append(F.when(F.col(event) == 1, u <= cuts[(s, 1)]).otherwise(u <= cuts[(s, 0)]))
    return out


def _tests(df: DataFrame, event: str, keyed_models: Sequence[tuple[dict, Column, Model]]) -> DataFrame:
    """Test rows of each model with its probability as ``value``, one pass over the rows: (keys..., value, event)."""
    first = keyed_models[0][0]
    scored = F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in keys.items()], m.probability().alias("value"), F.coalesce(~train, F.lit(False)).alias("test")) for keys, train, m in keyed_models
    ])
    return df.select(F.col(event).alias("event"), F.inline(scored)).where("test").select(*first, "value", "event")


def cross_validate(df: DataFrame, unique: str, predictors: Sequence[str], event: str, splits: Sequence[Column]) -> DataFrame:
    """Best HSS and PSS over probability thresholds on each split's test part: (split, score, threshold, name)."""
    return cross_validate_sets(df, [predictors], event, splits).drop("predictors")


def cross_validate_sets(df: DataFrame, sets: Sequence[Sequence[str]], event: str, splits: Sequence[Column]) -> DataFrame:
    """The same for several predictor sets, all fitted together: (predictors, split, threshold, score, name)."""
    models = balanced_fits(df, event, [(train, s) for s in sets for train in splits])
    counts = probability_counts(df, event, models, splits)
    names = F.array(*[F.lit(" ".join(s)) for s in sets])
    keyed = F.get(names, F.floor(F.col("fit") / len(splits)).cast("int")), (F.col("fit") % len(splits)).cast("int")
    counts = counts.select(keyed[0].alias("predictors"), keyed[1].alias("split"), *[c for c in counts.columns if c != "fit"])
    best = [K.pick_best(K.with_score(counts, name), ["predictors", "split"]).withColumn("name", F.lit(name)) for name in ("hss", "pss")]
    return best[0].unionByName(best[1])


def probability_counts(df: DataFrame, event: str, models: Sequence[Model], splits: Sequence[Column]) -> DataFrame:
    """Contingency counts of every model on its split's test rows at PROB_STEPS thresholds from 0 to 1, by ``fit``, its place in ``models``.

    The models stand in rounds of ``splits``, which are conditions for training rows.  A batch's probabilities are made with numpy and
    counted by threshold at once, so a task sends a number per model and threshold, no row is repeated for a model, and the plan is as
    large for many models as for one.
    """
    names = list(dict.fromkeys(p for m in models for p in m.predictors))
    n = len(splits)
    coefs = [{p: c for p, c in zip(m.predictors, m.coefs, strict=True)} for m in models]
    intercepts = [m.intercept for m in models]
    limits = 0.0 + np.arange(PROB_STEPS) * (1.0 / (PROB_STEPS - 1))
    width = PROB_STEPS + 1
    test = F.array(*[F.coalesce(~train, F.lit(False)) for train in splits])
    rows = df.where(F.col(event).isNotNull()).select(
        F.col(event).cast("long").alias("y"), F.array(*[F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in names]).alias("x"),
        F.array(*[F.col(p).isNull() for p in names]).alias("none"), test.alias("test"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(models), width))
        for batch in batches:
            y = batch.column("y").to_numpy().astype(float)
            x, none, held = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) for c in ("x", "none", "test"))
            for f in range(len(models)):
                own = held[:, f % n]
                for i, p in enumerate(names):
                    if p in coefs[f]:
                        own = own & ~none[:, i]
                eta = np.full(int(own.sum()), intercepts[f])
                for i, p in enumerate(names):
                    if p in coefs[f]:
                        eta += coefs[f][p] * x[own, i]
                with np.errstate(over="ignore"):
                    v = 1.0 / (1.0 + np.exp(-eta))
                e = y[own]
                for at, side in enumerate(("left", "right")):  # thresholds below the value, and those up to it
                    spot = np.searchsorted(limits, v, side)
                    total[2 * at, f] += np.bincount(spot, e, width)
                    total[2 * at + 1, f] += np.bincount(spot, 1.0 - e, width)
        fit, i = np.divmod(np.arange(len(models) * width), width)
        sums = [pa.array(np.rint(t.ravel()).astype(np.int64)) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(i, pa.int32()), *sums], names=["fit", "i", *cells])

    cells = ["e_gt", "o_gt", "e_lt", "o_lt"]
    per = rows.mapInArrow(count, "fit int, i int, " + ", ".join(f"{c} long" for c in cells)).groupBy("fit", "i").agg(*[F.sum(c).alias(c) for c in cells])
    whole = Window.partitionBy("fit")  # a row per threshold
    per = per.withColumns({"e_total": F.sum("e_gt").over(whole), "n_total": F.sum(F.col("e_gt") + F.col("o_gt")).over(whole), "lo": F.lit(0.0), "step": F.lit(1.0 / (PROB_STEPS - 1))})
    return K.running_contingency(settle(per.where("n_total > 0")), ["fit"], PROB_STEPS)


def summarise_splits(scores: DataFrame) -> DataFrame:
    return scores.groupBy("name").agg(
        F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg("threshold").alias("threshold")
    )


def diagnostic_scores(df: DataFrame, params: Sequence[str], event: str, splits: Sequence[Column], name: str = "hss") -> DataFrame:
    """The same test parts scored by single diagnostics: (split, param, threshold, score)."""
    tests = None
    for i, train in enumerate(splits):
        part = df.where(~train).withColumn("split", F.lit(i))
        tests = part if tests is None else tests.unionByName(part)
    long = K.to_long(tests.withColumnRenamed(event, "event"), params, ["split", "event"])
    return K.best_thresholds(long, ["split", "param"], "value", "event", name)


def subset_search(
    df: DataFrame, unique: str, predictors: Sequence[str], event: str, splits: Sequence[Column], sizes: Sequence[int]
) -> DataFrame:
    """Mean split scores of every predictor combination of the given sizes, best first; all are fitted together."""
    combos = [c for r in sizes for c in itertools.combinations(predictors, r)]
    scores = cross_validate_sets(df, combos, event, splits).groupBy("predictors", "name").agg(F.avg("score").alias("mean"), F.avg("threshold").alias("threshold"))
    wide = scores.groupBy("predictors").agg(
        *[F.max(F.when(F.col("name") == n, F.col(v))).alias(f"{n}{t}") for n in ("hss", "pss") for v, t in (("mean", ""), ("threshold", "_thresh"))]
    )
    return wide.orderBy(F.col("hss").desc(), "predictors")


def full_sample_hss(df: DataFrame, model: Model, event: str) -> tuple[float, float]:
    """Best HSS of a model's probabilities on its own rows, with its threshold."""
    rows = df.select(model.probability().alias("value"), F.col(event).alias("event"))
    best = K.best_thresholds(rows, [], "value", "event", "hss", 100, limits=(0.0, 1.0)).first()
    return float(best["score"]), float(best["threshold"])


def forward_selection(
    df: DataFrame, unique: str, predictors: Sequence[str], event: str, by: str = "pval", alpha: float = 0.05, n_rep: int = 1000, max_steps: int | None = None
) -> list[dict]:
    """Add predictors while they help: least p-value, or best HSS among models whose terms are all significant.

    The HSS rule also asks the new score to reach the 95th bootstrap percentile of the current model's.
    Returns one record per step with the predictor, its score, the chosen model's p-value, and the predictors that could not be
    tried because they depend linearly on the chosen ones.
    """
    if by not in ("pval", "hss"):
        raise ValueError(by)
    chosen: list[str] = []
    steps: list[dict] = []
    current = 0.0
    while len(chosen) < (max_steps or len(predictors)):
        tried, singular = [], []
        for p in predictors:
            if p in chosen:
                continue
            names = [*chosen, p]
            try:
                pv = p_values(df, names, event)
            except SingularDesign:
                singular.append(p)
                continue
            rec = {"predictor": p, "pval": pv[p], "ok": all(v <= alpha for v in pv.values()), "score": None}
            if by == "hss" and rec["ok"]:
                rec["score"] = full_sample_hss(df, balanced_fit(df, names, event), event)[0]
            tried.append(rec)
        good = [r for r in tried if r["ok"]]
        if by == "pval":
            best = min(tried, key=lambda r: r["pval"], default=None)
            if best is None or best["pval"] > alpha or not best["ok"]:
                break
        else:
            best = max(good, key=lambda r: r["score"], default=None)
            if best is None or best["score"] <= current:
                break
            if chosen and best["score"] < _bootstrap_limit(df, chosen, event, n_rep):
                break
            current = best["score"]
        chosen.append(best["predictor"])
        steps.append({"step": len(chosen), "predictor": best["predictor"], "pval": best["pval"], "score": best["score"], "singular": singular})
    return steps


def _bootstrap_limit(df: DataFrame, chosen: Sequence[str], event: str, n_rep: int) -> float:
    model = balanced_fit(df, chosen, event)
    _, threshold = full_sample_hss(df, model, event)
    groups = K.exceedance_groups(df, event, {"yes": model.probability() > threshold})
    sample = K.resample_groups(groups, event, n_rep, None, seed="l6")
    c = K.resampled_contingency(sample, ["rep"], event, ["yes"])
    limit = c.select(K.score("hss", "hits", "misses", "false_alarms", "correct_negatives").alias("s"))
    return float(limit.agg(F.percentile("s", F.lit(0.95)).alias("q")).first()["q"])  # one value per replicate


def scaled(df: DataFrame, predictors: Sequence[str], how: str = "minmax") -> DataFrame:
    """Min-max or robust (median and quartile range) scaling, as expressions on a one-row summary."""
    if how == "minmax":
        s = df.agg(*[f(p).cast("double").alias(f"_{n}_{p}") for p in predictors for n, f in (("c", F.min), ("t", F.max))])
        width = {p: F.col(f"_t_{p}") - F.col(f"_c_{p}") for p in predictors}
    elif how == "robust":
        long = K.to_long(df, predictors, [])
        q = quantiles(long, ["param"], "value", {"a": 0.25, "c": 0.5, "t": 0.75})
        s = q.agg(*[F.max(F.when(F.col("param") == p, F.col(n))).alias(f"_{n}_{p}") for p in predictors for n in ("a", "c", "t")])
        width = {p: F.col(f"_t_{p}") - F.col(f"_a_{p}") for p in predictors}
    else:
        raise ValueError(how)
    out = df.crossJoin(F.broadcast(s))  # one row
    return out.withColumns({p: (F.col(p) - F.col(f"_c_{p}")) / F.nullif(width[p], F.lit(0.0)) for p in predictors}).select(*df.columns)


def recursive_elimination(
    df: DataFrame, predictors: Sequence[str], event: str, keep: int = 1, how: str = "minmax", unique: str | None = None, folds: int = 5
) -> list[dict]:
    """Drop the smallest absolute coefficient each round; returns the rounds in order of removal.

    With ``unique`` each round also tells the mean AUC of the predictors it started from over so many folds, and ``best``
    marks the round whose predictors do best; the last record is the set that is left.
    """
    rows = settle(scaled(df, predictors, how))  # every step of every fit reads them
    left, out = list(predictors), []

    trains = _fold_trains(unique, folds) if unique else []

    def fits():
        """The model on all rows, and the folds' AUC; all are fitted together."""
        model, *parts = balanced_fits(rows, event, [(t, left) for t in (None, *trains)])
        return model, {"auc": float(_fold_auc(rows, event, trains, parts).agg(F.avg("auc")).first()[0])} if unique else {}

    while len(left) > keep:
        model, auc = fits()
        size = dict(zip(model.predictors, map(abs, model.coefs), strict=True))
        worst = min(left, key=lambda p: (size[p], p))
        out.append({"round": len(out) + 1, "removed": worst, "coef": size[worst], "predictors": " ".join(left)} | auc)
        left.remove(worst)
    if unique:
        out.append({"round": len(out) + 1, "removed": None, "coef": None, "predictors": " ".join(left)} | fits()[1])
        top = max(r["auc"] for r in out)
        for r in out:
            r["best"] = r["auc"] == top
    return out


def _fold_trains(unique: str, folds: int, seed: str = "l7") -> list[Column]:
    fold = F.floor(split_draw(seed, "f", unique) / HASH_SPACE * folds).cast("int")
    return [fold != f for f in range(folds)]


def _fold_auc(df: DataFrame, event: str, trains: Sequence[Column], models: Sequence[Model]) -> DataFrame:
    return K.auc(_tests(df, event, [({"fold": f}, t, m) for f, (t, m) in enumerate(zip(trains, models, strict=True))]), ["fold"])


def fold_auc(df: DataFrame, unique: str, predictors: Sequence[str], event: str, folds: int = 5, seed: str = "l7") -> DataFrame:
    """AUC of each fold's held-out rows."""
    trains = _fold_trains(unique, folds, seed)
    return _fold_auc(df, event, trains, balanced_fits(df, event, [(t, predictors) for t in trains]))


def gram(df: DataFrame, predictors: Sequence[str]) -> np.ndarray:
    """X'X by one aggregation; k(k+1)/2 numbers reach the driver."""
    pairs = [(a, b) for i, a in enumerate(predictors) for b in predictors[i:]]
    x = lambda p: F.col(p).cast("double")
    row = df.agg(*[F.sum(x(a) * x(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)]).first()
    pos = {p: i for i, p in enumerate(predictors)}
    out = np.zeros((len(predictors), len(predictors)))
    for i, (a, b) in enumerate(pairs):
        out[pos[a], pos[b]] = out[pos[b], pos[a]] = row[f"g{i}"]
    return out


def inflation_factors(df: DataFrame, predictors: Sequence[str]) -> dict[str, float]:
    """Variance inflation from the uncentred R2 of each predictor on the others, without a constant."""
    g = gram(df.dropna(subset=list(predictors)), predictors)
    inverse = np.linalg.inv(g)
    return {p: float(g[i, i] * inverse[i, i]) for i, p in enumerate(predictors)}


def rule_comparison(df: DataFrame, event: str, flags: dict[str, Column]) -> DataFrame:
    """POD, FAR and HSS of several yes/no rules over the same rows, in one pass."""
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f, F.lit(False)).alias("yes")) for n, f in flags.items()])
    rows = df.select(F.col(event).alias("event"), F.inline(rules))
    return K.rates(K.counts_at(rows, ["rule"], F.col("yes"), "event")).select("rule", "pod", "far", "hss")


def density(df: DataFrame, keys: Sequence[str], value: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth at even points over the range widened by half on each side.

    Equal values are counted once; each distinct value then adds its kernel to the points.  To leave rows out, such as those
    a model identifies, filter ``df``.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n, s1 = F.sum("_c"), F.sum(F.col("_c") * F.col("_v"))
    mean = counts.groupBy(*keys).agg((s1 / n).alias("_m"), n.alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    dev = F.col("_v") - F.col("_m")
    per = counts.join(mean, list(keys)).groupBy(*keys, "_n", "_lo", "_hi").agg(F.sum(F.col("_c") * dev * dev).alias("_q"))
    per = per.withColumn("_h", F.sqrt(F.col("_q") / (F.col("_n") - 1)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    span = F.col("_hi") - F.col("_lo")
    grid = counts.join(per, list(keys)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") - 0.5 * span + F.col("i") * (2.0 * span / (points - 1))
    z = (x - F.col("_v")) / F.col("_h")
    return grid.groupBy(*keys, "i").agg(
        F.first(x).alias("x"), (F.sum(F.col("_c") * F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_h")) / 2.5066282746310002).alias("density")
    )
