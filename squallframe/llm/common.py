"""Helpers shared by the operators: words, hashes, row numbers and connected components."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from squallframe.session import settle

# the word pattern of all contracts: runs without space, tab, line feed, vertical tab, form feed, return
WORD = r"[^\x20\x09-\x0D]+"
WORD_PATTERN = re.compile(WORD)


TEXTS = 1000  # of a batch that goes to a Python worker at most
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to hand Python workers at most ``TEXTS`` rows at a time.

    Spark's own 10,000 texts, held on both sides, take a good part of a small executor.  The setting stays, as plans run
    later; a lower one is kept.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= TEXTS:
        conf.set(ARROW_ROWS, str(TEXTS))
    return df


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def hash60(*parts: Column | str) -> Column:
    """A long below 2^60 from the md5 of the parts, the same in any engine that has md5."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def plain_key(key: Column) -> Column:
    """A record key as text; null becomes the word null."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def finite(vec: Column) -> Column:
    """Vectors that are not null and hold neither null nor non-finite entries."""
    every = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(every, F.lit(False))


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, in the given order, without a group in one task.

    Rows are dealt by range over (group, order, arrival), so a large group, or a key that many rows share, spreads over
    many tasks.  The sorted rows are written once; then each stretch of a group learns how many rows come before it.
    ``group`` must have few values, as the table of stretches has a row per group and partition at most.  Rows alike in
    group and order are numbered by arrival.  ``df`` must come from files (see ``settle``), so that a retry sees the same.
    """
    keys = [*group, *order, "__arrival"]
    arranged = (
        df.withColumn("__arrival", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__place", F.monotonically_increasing_id())
        .drop("__arrival")
    )
    arranged = settle(arranged)
    part = F.shiftright("__place", 33).alias("__part")
    stretch = arranged.groupBy(part, *group).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    stretch = settle(stretch.select("__part", "__first", "__before", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]))
    same = F.shiftright("__place", 33) == F.col("__part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    numbered = arranged.join(stretch, same).withColumn(name, F.col("__place") - F.col("__first") + F.col("__before"))
    return numbered.select(*df.columns, name)


def components(links: DataFrame) -> DataFrame:
    """Smallest member of each node's component: (node, root) for every node that has a link in (a, b).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every component is a star around its smallest
    member, which one count by node shows.  A step groups by node with a plain minimum, so nothing of a component is gathered
    in one place; each step is a written table.
    """
    edges = settle(links.where("a <> b").selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo").distinct())
    while not _stars(edges):
        both = edges.selectExpr("hi AS u", "lo AS v").unionAll(edges.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").where("hi <> lo").distinct()
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_min, "hi")
        edges = settle(
            small.selectExpr("hi", "m AS lo").unionAll(small.where("lo <> m").selectExpr("lo AS hi", "m AS lo")).where("hi <> lo").distinct()
        )
    return edges.selectExpr("hi AS node", "lo AS root").unionAll(edges.selectExpr("lo AS node", "lo AS root").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.selectExpr("hi AS u", "1 AS up", "0 AS down").unionAll(edges.selectExpr("lo AS u", "0 AS up", "1 AS down"))
    of_node = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of_node.agg(F.max(F.expr("up > 1 OR (up = 1 AND down = 1)"))).first()[0]


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of what ``roots`` (node, root) connects already and of further links (a, b).

    Only the roots at the ends of the further links meet, so the work goes with those.
    """

    def lifted(df: DataFrame, of: str) -> DataFrame:
        r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return df.join(r, F.col(of) == F.col("__node"), "left").withColumn(of, F.coalesce("__root", of)).drop("__node", "__root")

    more = settle(components(lifted(lifted(links.select("a", "b"), "a"), "b")))
    above = more.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    moved = roots.join(above, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    return settle(moved.unionAll(more.join(roots, "node", "left_anti").select("node", "root")))
