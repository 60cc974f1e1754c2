"""Approximate nearest neighbours: probed lists, in which partial distances abandon candidates early."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from squallframe.session import settle

SAMPLE = 20_000  # vectors that the index is fitted on, and the recall tried on
TRIED = 256  # of them taken as queries
CANDIDATES, QUERIES = 4096, 512  # rows of a block at most, about
COLUMNS = 16  # dimensions that are added at a time


@dataclass(frozen=True)
class Index:
    """Centres of the lists, a random rotation, and the number of lists to probe for the wanted recall."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Distances to the centres, up to a term that is the same for a row."""
        return (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.order(x).argmin(axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(self.order(x), axis=1, kind="stable")[:, : self.probes]


def fit(sample: np.ndarray, lists: int, k: int, recall: float, seed: int = 7) -> Index:
    """Fit on a bounded sample: centres by Lloyd's steps, and as many probes as the recall takes within the sample.

    Neighbours within a sample are further away, so they are spread over more lists than those of all rows: the tried
    recall errs on the safe side.
    """
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    lists = max(1, min(lists, n // 8))
    centres = sample[rng.choice(n, lists, replace=False)]
    for _ in range(10):
        own = Index(centres, rotation, 1).nearest(sample)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=lists)
        np.add.at(sums, own, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    every = Index(centres, rotation, lists)
    own = every.nearest(sample)
    tried = sample[rng.choice(n, min(TRIED, n), replace=False)]
    far = (sample**2).sum(axis=1) - 2 * tried @ sample.T
    near = np.argsort(far, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the query itself
    rank = np.argsort(every.probed(tried), axis=1)  # at which probe a list comes
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else lists
    return Index(centres, rotation, probes)


def scan(queries: np.ndarray, rows: np.ndarray, rotation: np.ndarray, k: int, doubt: float = 2.1) -> list[np.ndarray]:
    """For each query the places of the rows that may be among its k nearest in the block, by an adaptive scan of dimensions.

    In rotated space the first t of d columns give an unbiased guess of the distance, partial * d / t, whose spread shrinks as
    1 / sqrt(t).  After each block of columns, candidates whose guess is above the k-th best distance so far by more than
    ``doubt`` / sqrt(t) are abandoned: the hypothesis that they are near enough is rejected.  The bar is the k-th best full
    distance among the 16 k candidates that look best after the first block; ties at the bar stay.
    """
    q, r = queries @ rotation, rows @ rotation
    d, n = r.shape[1], len(r)
    first = min(COLUMNS, d)
    # the first block for all pairs at once
    partial = (q[:, :first] ** 2).sum(axis=1)[:, None] - 2 * q[:, :first] @ r[:, :first].T + (r[:, :first] ** 2).sum(axis=1)
    out = []
    for i in range(len(q)):
        if n <= k:
            out.append(np.arange(n))
            continue
        pool = np.argpartition(partial[i], min(n, 16 * k) - 1)[: 16 * k]
        full = ((r[pool] - q[i]) ** 2).sum(axis=1)
        bar = np.partition(full, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
        live = np.flatnonzero(partial[i] * d / first <= bar * (1 + doubt / np.sqrt(first)) ** 2)
        part, t = partial[i][live], first
        while t < d:
            step = slice(t, min(t + COLUMNS, d))
            part = part + ((r[live, step] - q[i, step]) ** 2).sum(axis=1)
            t = step.stop
            limit = bar if t == d else bar * t / d * (1 + doubt / np.sqrt(t)) ** 2
            keep = part <= limit
            live, part = live[keep], part[keep]
        if d <= first:
            live = live[part <= bar]
        out.append(np.union1d(live, pool[full <= bar]))
    return out


def usable(vec: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(rows: DataFrame, key: str, vec: str, is_query: Column, k: int = 10, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance in double precision.

    Queries are the rows where ``is_query`` holds; a query's own row is no candidate.  Rank 1 is the nearest, ties go to the smaller
    key; with fewer than k candidates all are returned.  Vectors that are not ``usable`` take no part, and
    vectors of other lengths than the query's are no candidates.  Rows with a null key or a repeated key and vector are
    passed over, the latter but once.  Other columns are not looked at.

    Rows of one vector become one point with its k + 1 smallest keys: no larger key can be among the k nearest of any query, so
    large groups of copies cost nothing and no neighbour is lost.  Points go to the list of their nearest centre, queries to every
    list they probe, and both meet in blocks of bounded size: a long list is cut into several.
    """
    spark = rows.sparkSession
    v = rows.where(F.col(key).isNotNull() & usable(F.col(vec))).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    v = v.withColumn("h", F.xxhash64("vec"))
    smallest = Window.partitionBy("h", "vec").orderBy("id")
    few = v.select("h", "vec", "id").withColumn("place", F.dense_rank().over(smallest)).where(F.col("place") <= k + 1)
    points = settle(few.groupBy("h", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("point", F.col("ids")[0]).withColumn("dim", F.size("vec")))
    asked = v.where("is_query").select("h", "vec", F.col("id").alias("query_id")).distinct()
    asked = settle(asked.join(points.select("h", "vec", "point"), ["h", "vec"]).select("query_id", "point"))
    seekers = points.join(asked.select("point").distinct(), "point", "left_semi")

    # the index: fitted on a sample of a bounded number of points
    total = points.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "h", "point"), F.lit(1 << 30)) / float(1 << 30)
    drawn = points.where(draw < min(1.0, SAMPLE / max(1, total))).select("dim", "vec").orderBy("dim", "vec").toPandas()
    lists = max(1, min(1024, round(total**0.5 / 2)))
    indexes = {int(dim): fit(np.stack(part["vec"].to_numpy()), lists, k, recall) for dim, part in drawn.groupby("dim")}
    shared = spark.sparkContext.broadcast(indexes)

    def assign(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    index = shared.value.get(int(dim))
                    x = matrix(part.column("vec"))
                    if index is None:
                        own = np.zeros((len(x), 1), np.int64)
                    else:
                        own = index.probed(x) if probe else index.nearest(x)[:, None]
                    for at in range(0, len(x), 256):
                        of = np.repeat(np.arange(at, min(at + 256, len(x))), own.shape[1])
                        taken = part.take(pa.array(of))
                        yield pa.RecordBatch.from_arrays([taken.column("dim"), pa.array(own[at : at + 256].ravel(), pa.int32()), taken.column("point"), taken.column("vec")], names=["dim", "list", "point", "vec"])

        return run

    kind = "dim int, list int, point long, vec array<double>"
    listed = settle(points.select("dim", "point", "vec").mapInArrow(assign(False), kind))
    probed = settle(seekers.select("dim", "point", "vec").mapInArrow(assign(True), kind))
    sizes = listed.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("c"))
    sizes = sizes.join(probed.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q")), ["dim", "list"])
    sizes = settle(sizes)  # a row per list

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(sizes, ["dim", "list"])
        df = df.withColumn(own, F.pmod(F.xxhash64("point"), F.col(own)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"seeker": [], "point": [], "score": []})
        q, r = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        names, index = right["point"].to_numpy(), shared.value.get(q.shape[1])
        rotation = index.rotation if index else np.eye(q.shape[1])
        out = []
        for i, found in enumerate(scan(q, r, rotation, k + 1)):
            score = np.sqrt(((r[found] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((names[found], score))[: k + 1]
            out.append(pd.DataFrame({"seeker": left["point"].iat[i], "point": names[found][best], "score": score[best]}))
        return pd.concat(out)

    on = ["dim", "list", "c", "q"]
    near = dealt(probed, "q", "c").groupBy(*on).cogroup(dealt(listed, "c", "q").groupBy(*on)).applyInPandas(block, "seeker long, point long, score double")
    best = Window.partitionBy("seeker").orderBy("score", "point")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # each of the k + 1 points stands for up to k + 1 rows; of those the k + 1 nearest count, one of which may be the query itself
    each = near.join(points.select("point", "ids"), "point").select("seeker", "score", F.explode("ids").alias("vec_id"))
    near = each.groupBy("seeker").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    mine = asked.join(near, F.col("point") == F.col("seeker"))
    other = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(other).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
