"""Statistical learning queries (L)."""
import itertools

from pyspark.sql import functions as F

from squallframe.functions import composites as X
from squallframe.operators import learn as L
from squallframe.operators.cleaning import clip_to_percentiles
from squallframe.plans.registry import query, r6, sql
from squallframe.plans.skill import PARAMS, SCORES, _events, events_cte
from squallframe.refs import literal_table
from squallframe.session import settle



def _rows(t):
    """Aligned events, stored once: every fit below reads them several times.

    They are spread over the cores by number, as the work goes with rows x fits: by size a whole table of them made a task or two.
    """
    rows = _events(t).select("event_id", "is_sta", *PARAMS)
    return settle(rows.repartition(3 * t.spark.sparkContext.defaultParallelism, "event_id"))


HASH = "CAST('0x' || SUBSTR(MD5('l2:' || split || ':' || event_id), 1, 12) AS BIGINT)"


def newton_ctes(rows, fits, steps=12, name="fit"):
    """CTEs that solve ridge logistic fits by Newton steps: ``rows`` has part, y, w and the predictors, ``fits`` f, part and a mask
    m_ per predictor; ends in ``{name}`` (f, b0, b_...).  The linear systems are solved by elimination, a CTE per column."""
    k = len(PARAMS) + 1
    x = ["1E0", *[f"r.{p} * g.m_{p}" for p in PARAMS]]
    out = [f"z0 AS MATERIALIZED (SELECT f, {', '.join(f'0E0 AS b{j}' for j in range(k))} FROM {fits})"]
    for t in range(steps):
        eta = " + ".join(f"b.b{j} * {x[j]}" for j in range(k))
        sums = [f"SUM(w * (p - y) * x{j}) + {'0' if j == 0 else f'ANY_VALUE(b{j})'} AS c0_{j}_{k}" for j in range(k)]
        sums += [f"SUM(w * p * (1 - p) * x{min(i, j)} * x{max(i, j)}) + {1 if i == j and i else 0} AS c0_{i}_{j}" for i in range(k) for j in range(k)]
        out.append(
            f"e{t} AS MATERIALIZED (SELECT f, {', '.join(f'ANY_VALUE(b{j}) AS b{j}' for j in range(k))}, {', '.join(sums)} FROM ("
            f"SELECT b.*, r.y, r.w, 1 / (1 + EXP(-({eta}))) AS p, {', '.join(f'{c} AS x{j}' for j, c in enumerate(x))} FROM {rows} r JOIN {fits} g USING (part) JOIN z{t} b USING (f)) GROUP BY f)"
        )
        src = f"e{t}"
        for col in range(k):
            cells = []
            for i in range(k):
                for j in range(k + 1):
                    own, head = f"c{col}_{i}_{j}", f"c{col}_{col}_{j} / c{col}_{col}_{col}"
                    cells.append(f"{head if i == col else f'{own} - c{col}_{i}_{col} * ({head})'} AS c{col + 1}_{i}_{j}")
            out.append(f"e{t}_{col} AS MATERIALIZED (SELECT f, {', '.join(f'b{j}' for j in range(k))}, {', '.join(cells)} FROM {src})")
            src = f"e{t}_{col}"
        out.append(f"z{t + 1} AS MATERIALIZED (SELECT f, {', '.join(f'b{j} - c{k}_{j}_{k} AS b{j}' for j in range(k))} FROM {src})")
    return ", ".join(out) + f", {name} AS (SELECT * FROM z{steps})"


def split_ctes(n_splits, share):
    """Rows of every split: ``spl`` with part, train, y and predictors; ``trn`` its training rows with class weights."""
    preds = ", ".join(PARAMS)
    return f"""h AS (SELECT split, is_sta, event_id, {preds}, ROW_NUMBER() OVER (PARTITION BY split, is_sta ORDER BY {HASH}) AS k, COUNT(*) OVER (PARTITION BY split, is_sta) AS n FROM ev CROSS JOIN RANGE({n_splits}) s(split)),
spl AS MATERIALIZED (SELECT split AS part, k <= FLOOR(n * {share}) AS train, CAST(is_sta AS DOUBLE) AS y, {preds} FROM h),
trn AS MATERIALIZED (SELECT *, COUNT(*) OVER (PARTITION BY part) / (2E0 * COUNT(*) OVER (PARTITION BY part, y)) AS w FROM spl WHERE train)"""


def probability_sql(row="s", fit="b"):
    return f"1 / (1 + EXP(-({fit}.b0 + " + " + ".join(f"{fit}.b{j} * {row}.{p}" for j, p in enumerate(PARAMS, 1)) + ")))"


def split_score_ctes(keys):
    """From ``prob`` (keys, v, y) the best HSS and PSS over 101 probability thresholds: ``hs`` (keys, name, threshold, score)."""
    up = lambda s: SCORES[s].format(h="CAST(hg AS DOUBLE)", f="CAST(fg AS DOUBLE)", ne="CAST(ne AS DOUBLE)", no="CAST(no AS DOUBLE)")
    down = lambda s: SCORES[s].format(h="CAST(hl AS DOUBLE)", f="CAST(fl AS DOUBLE)", ne="CAST(ne AS DOUBLE)", no="CAST(no AS DOUBLE)")
    best = " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS name, t AS threshold, score FROM (SELECT *, COALESCE(GREATEST({up(s)}, {down(s)}), -1) AS score FROM cn) QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY score DESC, i) = 1" for s in ("hss", "pss")
    )
    return f"""cn AS MATERIALIZED (SELECT {keys}, i, 0E0 + i * ((1E0 - 0E0) / 100) AS t, SUM(y) ne, COUNT(*) - SUM(y) no, SUM(CASE WHEN v > 0E0 + i * ((1E0 - 0E0) / 100) THEN y ELSE 0 END) hg, SUM(CASE WHEN v > 0E0 + i * ((1E0 - 0E0) / 100) THEN 1 - y ELSE 0 END) fg,
 SUM(CASE WHEN v < 0E0 + i * ((1E0 - 0E0) / 100) THEN y ELSE 0 END) hl, SUM(CASE WHEN v < 0E0 + i * ((1E0 - 0E0) / 100) THEN 1 - y ELSE 0 END) fl FROM prob CROSS JOIN RANGE(101) r(i) GROUP BY ALL),
hs AS ({best})"""


EVERY = ", ".join(f"1 AS m_{p}" for p in PARAMS)


@query("balanced_logistic_fit", "L1", sql("v_obs v_points", f"""{events_cte()},
trn AS MATERIALIZED (SELECT 0 AS part, CAST(is_sta AS DOUBLE) AS y, {', '.join(PARAMS)}, COUNT(*) OVER () / (2E0 * COUNT(*) OVER (PARTITION BY is_sta)) AS w FROM ev), ft AS (SELECT 0 AS f, 0 AS part, {EVERY}),
{newton_ctes('trn', 'ft')}
{' UNION ALL '.join(f"SELECT '{p}' AS term, ROUND(b{j}, 6) AS coef FROM fit" for j, p in enumerate(['const', *PARAMS]))}"""))
def _(t):
    m = L.balanced_fit(_rows(t), PARAMS, "is_sta")
    rows = [*zip(m.predictors, m.coefs, strict=True), ("const", m.intercept)]
    return literal_table(t.spark, [(p, round(c, 6)) for p, c in rows], ["term", "coef"])


@query("stratified_splits", "L2", sql("v_obs v_points", f"""{events_cte()},
h AS (SELECT split, is_sta, event_id, ROW_NUMBER() OVER (PARTITION BY split, is_sta ORDER BY {HASH}) AS k, COUNT(*) OVER (PARTITION BY split, is_sta) AS n FROM ev CROSS JOIN RANGE(4) s(split))
SELECT CAST(split AS INT) AS split, is_sta, COUNT(*) AS n_train, CAST(SUM(event_id) AS BIGINT) AS id_sum FROM h WHERE k <= FLOOR(n * 0.8E0) GROUP BY 1, 2"""))
def _(t):
    ev = _events(t).select("event_id", "is_sta")
    cuts = L.stratified_cutoffs(ev, "event_id", "is_sta", 4)
    rows = ev.join(cuts, "is_sta").where(L.split_draw("l2", F.col("split").cast("string"), "event_id") <= F.col("cut"))
    return rows.groupBy("split", "is_sta").agg(F.count(F.lit(1)).alias("n_train"), F.sum("event_id").alias("id_sum"))


SPLITS = 16


@query("cross_validated_scores", "L3", sql("v_obs v_points", f"""{events_cte()}, {split_ctes(SPLITS, '0.8E0')}, ft AS (SELECT part AS f, part, {EVERY} FROM RANGE({SPLITS}) r(part)),
{newton_ctes('trn', 'ft')}, prob AS (SELECT s.part, {probability_sql()} AS v, y FROM spl s JOIN fit b ON b.f = s.part WHERE NOT train), {split_score_ctes('part')}
SELECT name, ROUND(AVG(score), 5) AS mean, ROUND(MIN(score), 5) AS min, ROUND(MAX(score), 5) AS max, ROUND(AVG(threshold), 5) AS threshold FROM hs GROUP BY 1"""))
def _(t):
    rows = _rows(t)
    splits = L.stratified_splits(rows, "event_id", "is_sta", SPLITS)
    s = L.summarise_splits(L.cross_validate(rows, "event_id", PARAMS, "is_sta", splits))
    return s.select("name", *[r6(c, 5).alias(c) for c in ("mean", "min", "max", "threshold")])


@query("diagnostic_split_scores", "L3", sql("v_obs v_points", f"""{events_cte()}, {split_ctes(SPLITS, '0.8E0')},
tst AS MATERIALIZED ({' UNION ALL '.join(f"SELECT part AS split, '{p}' AS param, CAST({p} AS DOUBLE) AS value, y AS event FROM spl WHERE NOT train" for p in PARAMS)}),
b AS (SELECT split, param, MIN(value) lo, QUANTILE_CONT(value, 0.9995) hi, SUM(event) ne, COUNT(*) - SUM(event) no FROM tst GROUP BY 1, 2), x AS (SELECT split, param, i, lo + i * ((hi - lo) / 999) AS t, ne, no FROM b CROSS JOIN RANGE(1000) r(i)),
d AS (SELECT split, param, value, SUM(event) e, COUNT(*) n FROM tst GROUP BY 1, 2, 3),
c AS (SELECT split, param, i, t, ANY_VALUE(ne) ne, ANY_VALUE(no) no, SUM(CASE WHEN value > t THEN e ELSE 0 END) hg, SUM(CASE WHEN value > t THEN n - e ELSE 0 END) fg, SUM(CASE WHEN value < t THEN e ELSE 0 END) hl, SUM(CASE WHEN value < t THEN n - e ELSE 0 END) fl FROM x JOIN d USING (split, param) GROUP BY 1, 2, 3, 4),
s AS (SELECT split, param, i, t, GREATEST(hg / CAST(ne AS DOUBLE) - fg / CAST(no AS DOUBLE), hl / CAST(ne AS DOUBLE) - fl / CAST(no AS DOUBLE)) AS score FROM c)
SELECT CAST(split AS INT) AS split, param, ROUND(t, 6) AS threshold, ROUND(score, 6) AS score FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY split, param ORDER BY score DESC, i) = 1"""))
def _(t):
    rows = _rows(t)
    splits = L.stratified_splits(rows, "event_id", "is_sta", SPLITS)
    out = L.diagnostic_scores(rows, PARAMS, "is_sta", splits, "pss")
    return out.select("split", "param", r6("threshold").alias("threshold"), r6("score").alias("score"))


SUBSETS = [c for n in range(2, len(PARAMS) + 1) for c in itertools.combinations(PARAMS, n)]


@query("predictor_subset_search", "L5", sql("v_obs v_points", f"""{events_cte()}, {split_ctes(SPLITS, '0.8E0')},
sub AS ({' UNION ALL '.join(f"SELECT {i} AS sub, '{' '.join(c)}' AS predictors, {', '.join(f'{int(p in c)} AS m_{p}' for p in PARAMS)}" for i, c in enumerate(SUBSETS))}),
ft AS MATERIALIZED (SELECT sub * {SPLITS} + part AS f, sub.*, part FROM sub CROSS JOIN RANGE({SPLITS}) r(part)),
{newton_ctes('trn', 'ft')}, prob AS (SELECT g.predictors, s.part, {probability_sql()} AS v, y FROM spl s JOIN ft g USING (part) JOIN fit b USING (f) WHERE NOT train), {split_score_ctes('predictors, part')}
SELECT predictors, {', '.join(f"ROUND(AVG(CASE WHEN name = '{n}' THEN {v} END), {d}) AS {n}{t}" for n in ('hss', 'pss') for v, t, d in (('score', '', 5), ('threshold', '_thresh', 6)))} FROM hs GROUP BY 1"""))
def _(t):
    rows = _rows(t)
    splits = L.stratified_splits(rows, "event_id", "is_sta", SPLITS)
    out = L.subset_search(rows, "event_id", PARAMS, "is_sta", splits, range(2, len(PARAMS) + 1))
    return out.select("predictors", *[r6(c, 5).alias(c) for c in ("hss", "pss")], *[r6(c).alias(c) for c in ("hss_thresh", "pss_thresh")])


@query("forward_selection", "L6")
def _(t):
    steps = L.forward_selection(_rows(t), "event_id", PARAMS, "is_sta", "pval", 0.05)
    rows = [(s["step"], s["predictor"], round(s["pval"], 6)) for s in steps]
    return t.spark.createDataFrame(rows, "step int, predictor string, pval double")


@query("forward_selection_by_skill", "L6")
def _(t):
    rows = _rows(t)
    steps = L.forward_selection(rows, "event_id", PARAMS, "is_sta", "hss", 0.05, 1000)
    m = L.balanced_fit(rows, [s["predictor"] for s in steps], "is_sta") if steps else None
    coefs = dict(zip(m.predictors, m.coefs, strict=True)) if m else {}
    out = [(s["step"], s["predictor"], round(s["score"], 6), round(coefs[s["predictor"]], 6)) for s in steps]
    return t.spark.createDataFrame(out, "step int, predictor string, score double, coef double")


@query("recursive_elimination", "L7")
def _(t):
    rounds = L.recursive_elimination(settle(clip_to_percentiles(_rows(t), PARAMS)), PARAMS, "is_sta", unique="event_id")
    rows = [(r["round"], r["removed"], None if r["coef"] is None else round(r["coef"], 6), r["predictors"], round(r["auc"], 6), r["best"]) for r in rounds]
    return t.spark.createDataFrame(rows, "round int, removed string, coef double, predictors string, auc double, best boolean")


@query("collinearity_factors", "L8", sql("v_points", """
g AS (SELECT SUM(t_totals * t_totals) a, SUM(t_totals * s06) b, SUM(t_totals * umean06) c, SUM(s06 * s06) d, SUM(s06 * umean06) e, SUM(umean06 * umean06) f FROM v_points),
h AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g)
SELECT 't_totals' AS param, ROUND(a * (d * f - e * e) / det, 6) AS vif FROM h UNION ALL SELECT 's06', ROUND(d * (a * f - c * c) / det, 6) FROM h UNION ALL SELECT 'umean06', ROUND(f * (a * d - b * b) / det, 6) FROM h"""))
def _(t):
    v = L.inflation_factors(t.points, ["t_totals", "s06", "umean06"])
    return literal_table(t.spark, list(v.items()), ["param", "vif"]).select("param", r6("vif").alias("vif"))


@query("model_rule_threshold_comparison", "L9,J25")
def _(t):
    rows = _rows(t)
    train = L.stratified_splits(rows, "event_id", "is_sta", 1, 0.5)[0]
    model = L.balanced_fits(rows, "is_sta", [(train, PARAMS)])[0]
    rule = X.deep_or_shallow(F.col("dcape") * 10, F.col("umean06") * 2, "t_totals", F.col("t_totals") - 20, "umean06", "s06") == 1
    out = L.rule_comparison(rows.where(~train), "is_sta", {"logistic": model.probability() >= 0.6, "rule": rule, "t_totals": F.col("t_totals") >= 47.4})
    return out.select("rule", *[r6(c).alias(c) for c in ("pod", "far", "hss")])


@query("kernel_density", "L10", sql("v_obs", """
a AS (SELECT is_sta, wind_gust AS v, COUNT(*) AS c FROM v_obs WHERE wind_gust IS NOT NULL GROUP BY 1, 2),
s AS (SELECT is_sta, MIN(wind_gust) lo, MAX(wind_gust) hi, STDDEV_SAMP(wind_gust) * POW(COUNT(wind_gust), -0.2E0) h, COUNT(wind_gust) n FROM v_obs GROUP BY 1),
g AS (SELECT s.*, i, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 999) AS x FROM s CROSS JOIN RANGE(1000) r(i))
SELECT is_sta, CAST(i AS INT) AS i, ROUND(ANY_VALUE(x), 6) + 0E0 AS x, ROUND(SUM(c * EXP(-0.5 * POW((x - v) / h, 2))) / ANY_VALUE(n * h) / 2.5066282746310002E0, 6) AS density FROM g JOIN a USING (is_sta) GROUP BY 1, 2"""))
def _(t):
    out = L.density(t.obs.select("is_sta", "wind_gust"), ["is_sta"], "wind_gust")
    return out.select("is_sta", "i", r6("x").alias("x"), r6("density").alias("density"))


@query("kernel_density_of_missed_rows", "L10", sql("v_obs v_points", f"""{events_cte()},
q AS (SELECT is_sta, wind_gust FROM ev WHERE NOT (t_totals >= 47.4E0)), a AS (SELECT is_sta, wind_gust AS v, COUNT(*) AS c FROM q GROUP BY 1, 2),
s AS (SELECT is_sta, MIN(wind_gust) lo, MAX(wind_gust) hi, STDDEV_SAMP(wind_gust) * POW(COUNT(wind_gust), -0.2E0) h, COUNT(wind_gust) n FROM q GROUP BY 1),
g AS (SELECT s.*, i, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 199) AS x FROM s CROSS JOIN RANGE(200) r(i))
SELECT is_sta, CAST(i AS INT) AS i, ROUND(ANY_VALUE(x), 6) + 0E0 AS x, ROUND(SUM(c * EXP(-0.5 * POW((x - v) / h, 2))) / ANY_VALUE(n * h) / 2.5066282746310002E0, 6) AS density FROM g JOIN a USING (is_sta) GROUP BY 1, 2"""))
def _(t):
    missed = _events(t).where(~(F.col("t_totals") >= 47.4)).select("is_sta", "wind_gust")
    out = L.density(missed, ["is_sta"], "wind_gust", 200)
    return out.select("is_sta", "i", r6("x").alias("x"), r6("density").alias("density"))
