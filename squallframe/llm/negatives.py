"""Hard negatives: segment means and deviations bound inner products, and only what they leave open is scored."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from squallframe.llm.common import finite
from squallframe.llm.neighbours import matrix
from squallframe.session import settle

SEGMENTS, COARSE = 16, 4  # segments of a stored summary; so many of them make a segment of the level above
POINTS, SEEKERS, TILE = 4096, 4096, 64  # rows of a block, about, and seekers that are bounded at a time
FIRST, GROWTH = 32_768, 8  # points of the first round, about, and how many times as many have been seen after each further one
ANCHORS = 1024  # anchors with one vector and label that are answered in one group
FAR = 2**62


# --- summaries


@dataclass(frozen=True)
class Summary:
    """Mean and deviation of each segment of each row; ``lengths`` are the segments' dimensions."""

    mean: np.ndarray
    dev: np.ndarray
    lengths: np.ndarray

    def coarser(self, step: int = COARSE) -> Summary:
        """The summary over segments joined ``step`` at a time."""
        at = np.arange(0, len(self.lengths), step)
        lengths = np.add.reduceat(self.lengths, at)
        mean = np.add.reduceat(self.mean * self.lengths, at, axis=1) / lengths
        squares = np.add.reduceat((self.dev**2 + self.mean**2) * self.lengths, at, axis=1) / lengths
        return Summary(mean, np.sqrt(np.maximum(squares - mean**2, 0.0)), lengths)

    def rows(self, at) -> Summary:
        return Summary(self.mean[at], self.dev[at], self.lengths)

    def norm(self) -> float:
        """At least the length of the longest row."""
        return float(np.sqrt(((self.dev**2 + self.mean**2) * self.lengths).sum(axis=1).max(initial=0.0)))

    def bounds(self, other: Summary) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all inner products: within a segment the product is length * (means' product +- deviations' product)."""
        middle = (self.mean * self.lengths) @ other.mean.T
        spread = (self.dev * self.lengths) @ other.dev.T
        spread += 0.25 + 1e-9 * self.norm() * other.norm()  # rounding; scores are whole numbers
        return middle - spread, middle + spread


def segment_edges(dim: int, segments: int = SEGMENTS) -> np.ndarray:
    return np.unique(np.arange(segments + 1) * dim // segments)


def summarise(x: np.ndarray, segments: int = SEGMENTS) -> Summary:
    edges = segment_edges(x.shape[1], segments)
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    dev = np.sqrt(np.add.reduceat((x - np.repeat(mean, lengths, axis=1)) ** 2, edges[:-1], axis=1) / lengths)
    return Summary(mean, dev, lengths)


# --- one block


def undecided(lower: np.ndarray, upper: np.ndarray, allowed: np.ndarray, lists: list[dict], k: int) -> np.ndarray:
    """Which points may still be among the k best of a list, by the bounds of their scores.

    A list takes scores from lo to hi, and none below its bar, the k-th best score known.  If k points lie within the limits for
    certain, the k-th best of their lower bounds raises the bar.
    """
    keep = np.zeros(len(lower), bool)
    for x in lists:
        least = max(x["lo"], x["bar"])
        sure = lower[allowed & (lower >= least) & (upper <= x["hi"])]
        if len(sure) >= k:
            least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
        keep |= (upper >= least) & (lower <= x["hi"])
    return keep & allowed


def exact(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as int64; by doubles where these hold them."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(own).max(initial=0)) * rows.shape[1]
    return (rows.astype(float) @ own.astype(float)).astype(np.int64) if most < 2**53 else rows.astype(np.int64) @ own.astype(np.int64)


def best_of_block(seekers: dict, points: dict, k: int, same: bool) -> Iterator[tuple]:
    """(seeker, list, point, first, score): per list the k best points of the block within the list's limits and bar.

    Coarse summaries bound a tile of seekers against all points; the points that they leave open are bounded again by the finer
    ones, and what is open then is scored exactly.
    """
    fine = points["summary"]
    coarse = fine.coarser()
    for at in range(0, len(seekers["vec"]), TILE):
        tile = slice(at, at + TILE)
        lower, upper = seekers["summary"].rows(tile).coarser().bounds(coarse)
        for i, lists in enumerate(seekers["lists"][tile]):
            me = at + i
            allowed = (points["label"] == seekers["label"][me]) == same
            live = np.flatnonzero(undecided(lower[i], upper[i], allowed, lists, k))
            if len(live) > k:
                low, high = seekers["summary"].rows([me]).bounds(fine.rows(live))
                live = live[undecided(low[0], high[0], np.ones(len(live), bool), lists, k)]
            scores = exact(points["vec"][live], seekers["vec"][me])
            for x in lists:
                inside = np.flatnonzero((scores >= max(x["lo"], x["bar"])) & (scores <= x["hi"]))
                for j in inside[np.lexsort((points["first"][live[inside]], -scores[inside]))[:k]]:
                    yield seekers["seeker"][me], x["list"], points["point"][live[j]], points["first"][live[j]], scores[j]


def columns_of(t: pa.Table) -> dict:
    """The columns of a block as arrays, with the vectors' summary."""
    out = {n: t.column(n).combine_chunks() for n in t.column_names}
    out = {n: matrix(c) if n in ("vec", "mean", "dev") else c.to_pylist() if n == "lists" else c.to_numpy() for n, c in out.items()}
    out["summary"] = Summary(out["mean"], out["dev"], np.diff(segment_edges(out["vec"].shape[1])))
    return out


# --- all blocks


NEAR = pa.schema([("seeker", pa.int64()), ("list", pa.int64()), ("point", pa.int64()), ("first", pa.int64()), ("score", pa.int64())])
NEAR_DDL = "seeker long, list long, point long, first long, score long"


def best_points(points: DataFrame, seekers: DataFrame, lists: DataFrame, k: int, same: bool) -> DataFrame:
    """(seeker, list, point, first, score): the k best points of every list, ties to the smaller ``first``.

    ``points`` have point, first, dim, label, vec, mean, dev; ``seekers`` seeker and the others; ``lists`` seeker, list, lo, hi.  With
    ``same``, points of the seeker's label count, else those of other labels.

    Points are seen in rounds: about ``FIRST`` drawn by a hash, then ``GROWTH`` times as many, and so on.  The k-th best score of a round
    bars what the next need not report, so a list gets some k * GROWTH rows a round however many blocks there are.  In a
    round, seekers and points meet in blocks of bounded size; with ``same`` only blocks of one label.
    """
    total = max(1, points.count())
    points = points.drop("ids", "h")
    cell = F.col("label") if same else F.lit(0).cast("long")
    draw = F.pmod(F.xxhash64(F.lit("round"), "point"), F.lit(1 << 30)) / float(1 << 30)
    best, seen = None, 0.0
    where = ["dim", "cell", "c", "q"]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NEAR.empty_table()
        found = list(best_of_block(columns_of(left), columns_of(right), k, same))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found)], schema=NEAR) if found else NEAR.empty_table()

    def cut(df, sizes, name, own, other):
        df = df.withColumn("cell", cell).join(sizes, ["dim", "cell"])
        df = df.withColumn(own, F.pmod(F.xxhash64(name), F.col(own)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    while seen < 1.0:
        upto = min(1.0, max(seen * GROWTH, FIRST / total))
        part = points.where((draw >= seen) & (draw < upto))
        limits = lists.withColumn("bar", F.lit(-FAR))
        if best is not None:
            bars = best.groupBy("seeker", "list").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            limits = lists.join(bars, ["seeker", "list"], "left").withColumn("bar", F.coalesce("least", F.lit(-FAR)))
        limits = limits.groupBy("seeker").agg(F.collect_list(F.struct("list", "lo", "hi", "bar")).alias("lists"))
        asking = settle(seekers.join(limits, "seeker"))
        sizes = part.groupBy("dim", cell.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / POINTS).cast("int").alias("c"))
        asked = asking.groupBy("dim", cell.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / SEEKERS).cast("int").alias("q"))
        sizes = settle(sizes.join(asked, ["dim", "cell"]))  # a row per label and length
        left, right = cut(asking, sizes, "seeker", "q", "c"), cut(part, sizes, "point", "c", "q")
        near = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(block, NEAR_DDL)
        near = near if best is None else best.unionByName(near)
        order = Window.partitionBy("seeker", "list").orderBy(F.desc("score"), "first", "point")
        best = settle(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"))
        seen = upto
    return best


def first_rows(best: DataFrame, points: DataFrame, k: int, name: str) -> DataFrame:
    """(seeker, list, name): the k first rows of each list as structs (order, id, score), from its best points."""
    rows = best.join(points.select("point", "ids"), "point").select("seeker", "list", "score", F.explode("ids").alias("id"))
    each = rows.select("seeker", "list", F.struct((-F.col("score")).alias("order"), "id", "score").alias("row"))
    return each.groupBy("seeker", "list").agg(F.slice(F.sort_array(F.collect_list("row")), 1, k).alias(name))


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each entry, at most so large that an inner product fits a long."""
    most = F.least(F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vec), F.lit(1)))), F.lit(2**30)).cast("double")
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -most), most)).cast("int"))


def mine(rows: DataFrame, key: str, vec: str, label: str, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all exact.

    A vector counts as the whole numbers floor(scale * x); a score is the inner product of two.  Anchors are the rows where ``is_anchor``
    holds.  An anchor's positives are the first other rows of its label, higher scores first, ties by smaller key; for each
    positive, the negatives are the first rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's, so a positive that scores 0 only takes 0 and one below 0 takes none.  Fewer rows than asked for are all returned.

    Rows take no part whose key, label or vector is null or whose vector has a null or non-finite entry.  Whole numbers
    beyond 2^30, or beyond the root of 2^62 / dimensions, count as these.  Vectors of another length than the anchor's are no
    partners, and those without entries take no part.  Rows alike in key, label and vector count once; an anchor meets no row of its own
    key, which otherwise is taken to be unique.  An empty table gives an empty result; other columns are not looked at.

    Rows alike in label and vector become one point with its smallest keys, as no more of them can be among the first, so large
    groups of copies cost nothing.  Anchors of one point are answered together.
    """
    spare = max(positives + 1, negatives)
    used = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite(F.col(vec)) & (F.size(vec) > 0))
    v = used.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_numbers(F.col(vec), scale).alias("vec"), is_anchor.alias("is_anchor"))
    v = v.withColumn("h", F.xxhash64("label", "vec"))
    alike = ["h", "label", "vec"]
    few = v.withColumn("place", F.dense_rank().over(Window.partitionBy(*alike).orderBy("id"))).where(F.col("place") <= spare)
    points = few.groupBy(*alike).agg(F.sort_array(F.collect_set("id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("point"), F.col("ids")[0].alias("first"), F.size("vec").alias("dim"), "ids", *alike
    )
    points = settle(summarised(points))

    asked = settle(v.where("is_anchor").select("id", *alike).distinct().join(points.select("point", *alike), alike).select(F.col("id").alias("anchor_id"), F.col("point").alias("seeker")))
    groups = asked.groupBy("seeker").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("cuts"))
    many = settle(groups.where("cuts > 1"))  # a hot vector's anchors are answered in several groups

    def parted(df: DataFrame, of: Column) -> DataFrame:
        return df.join(many, "seeker", "left").withColumn("cut", of).drop("cuts")

    cuts = F.coalesce("cuts", F.lit(1))
    asked = parted(asked, F.pmod(F.xxhash64("anchor_id"), cuts).cast("int"))
    to_each = F.explode(F.sequence(F.lit(0), cuts - 1))

    seekers = settle(points.join(asked.select(F.col("seeker").alias("point")).distinct(), "point", "left_semi").withColumnRenamed("point", "seeker").drop("ids", "first", "h"))
    anything = seekers.select("seeker", F.lit(0).cast("long").alias("list"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))
    near = first_rows(best_points(points, seekers, anything, positives + 1, True), points, positives + 1, "near").drop("list")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    mine_ = asked.join(parted(near, to_each), ["seeker", "cut"]).select("seeker", "cut", "anchor_id", F.explode(others).alias("p"))
    pairs = settle(mine_.select("seeker", "cut", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("list")))

    # one list for each different score of a seeker's positives
    lo, hi = F.ceil(F.col("list").cast("decimal(38,0)") * low / 100), F.floor(F.col("list").cast("decimal(38,0)") * high / 100)
    lists = pairs.select("seeker", "list").distinct().select("seeker", "list", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    lists = settle(lists.where("lo <= hi"))
    hard = first_rows(best_points(points, seekers, lists, negatives, False), points, negatives, "hard")
    out = pairs.join(parted(hard, to_each), ["seeker", "cut", "list"]).select("anchor_id", "positive_id", F.col("list").alias("positive_score"), F.posexplode("hard").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def summarised(points: DataFrame) -> DataFrame:
    """Adds mean and dev, the segments' summary of vec."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                s = summarise(matrix(part.column("vec")).astype(float))
                ends = pa.array(np.arange(len(part) + 1) * s.mean.shape[1], pa.int32())
                made = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (s.mean, s.dev)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "mean", "dev"])

    return points.mapInArrow(run, f"{kinds}, mean array<double>, dev array<double>")
