"""Mixing sources to target weights by nested hash thresholds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from squallframe.llm.common import hash60, words
from squallframe.session import settle

BITS, LEVELS = 12, 5  # 5 levels of 4096 buckets use up the 60 bits of the hash


def targets(totals: DataFrame, weights: list[int], share: float = 1.0, most: int = 3) -> DataFrame:
    """Words to take of each source: (source, source_size, target, base, rest).

    ``totals`` has one row per source: (source, source_size).  Sources in code point order, null last, get the weights in
    turn and share ``share`` of all words by weight.  A target stops at ``most`` times its source; the excess goes to the
    others by weight.  Sources sorted by cap over weight fill up in that order, so one pass of running sums finds
    the level that the uncapped ones share.  base is the number of whole passes over the source and rest what is left.
    The window spans the table of sources, which is the mixture's own list of weights, never the documents.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(listed) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("place", F.row_number().over(filled))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("first_open", F.min(F.when(~F.col("full"), F.col("place"))).over(every))
        .withColumn("common", F.max(F.when(F.col("place") == F.col("first_open"), F.col("level"))).over(every))
    )
    capped = F.col("first_open").isNull() | (F.col("place") < F.col("first_open"))
    t = t.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight")))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    t = t.withColumn("base", passes.cast("long"))
    return t.select("source", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("rest"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, bound): rows whose hash lies below ``bound`` add up to nearly ``rest`` words of each source.

    ``sized`` has (source, hash, size).  Each level sums sizes by source and hash bucket, a histogram of at most 4096
    numbers per source that is summed up before it is shuffled, finds the bucket in which the budget ends, and keeps only the rows
    of that bucket for the next level.  The last level holds a single hash, which is taken if that comes nearer.
    """
    edge = goals.select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    rows = sized
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        cell = F.shiftright("hash", shift)
        sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        s = sums.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "s2")
        hit = s.join(edge.select("source", "rest"), F.col("s2").eqNullSafe(F.col("source")) & (F.col("upto") > F.col("rest")))
        hit = hit.groupBy("source").agg(F.min(F.struct("cell", "upto", "words", "rest")).alias("h"))
        # a budget that no bucket exceeds takes all rows that are left: no row of hit, so no bound
        edge = settle(hit.select("source", F.col("h.cell").alias("prefix"), (F.col("h.rest") - F.col("h.upto") + F.col("h.words")).alias("rest"), F.col("h.words").alias("words")))
        if level < LEVELS - 1:
            e = edge.select(F.col("source").alias("s2"), "prefix")
            rows = rows.join(e, F.col("source").eqNullSafe(F.col("s2")) & (cell == F.col("prefix"))).drop("s2", "prefix")
            rows = settle(rows)
    nearer = (F.col("words") - F.col("rest") < F.col("rest")).cast("long")
    return edge.select("source", (F.col("prefix") + nearer).alias("bound"))


def own_hash(key: Column, text: Column, seed: str) -> Column:
    """A document's place in the order of its source: a hash of its key, or of its text where the key is null."""
    return hash60(seed, F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit(""))))))


def sizes(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    own = F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size")
    return settle(docs.select(*own, own_hash(F.col(key), F.col(text), seed).alias("hash")))


def shares(sized: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """What each source takes: (s2, source_size, target, base, rest, bound), one row per source."""
    goals = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    bounds = thresholds(sized, goals)
    plan = goals.alias("g").join(bounds.alias("b"), F.col("g.source").eqNullSafe(F.col("b.source")), "left")
    return settle(plan.select(F.col("g.source").alias("s2"), "source_size", "target", "base", "rest", "bound"))


def with_copies(rows: DataFrame, plan: DataFrame, source: str, own: Column, most: int, name: str) -> DataFrame:
    """Adds how often each row is taken.  Rows meet only the row of their source, so nothing is sorted."""
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("s2", "base", "rest", "bound")])
    below = F.coalesce(own < F.col("__bound"), (F.col("__rest") > 0) & (F.col("__base") < most))
    joined = rows.join(plan, F.col(source).eqNullSafe(F.col("__s2")))
    return joined.withColumn(name, F.col("__base") + below.cast("long")).select(*rows.columns, name)


def mix(docs: DataFrame, key: str, text: str, source: str, weights: list[int], share: float = 1.0, most: int = 3, seed: str = "mix") -> DataFrame:
    """How often every document is taken: key, size, source, source_size, target, copies and taken words.

    Sizes are words of the whole text (null: 0).  A document's hash comes from its key (from its text where the key is null), so reruns
    agree, larger budgets take what smaller ones took, and rows that repeat a key rise and fall together.  Sources may be null.
    Empty tables give no rows.  Other columns are not looked at.  No row is sorted: documents meet only the thresholds of
    their source, a table of one row per source that is written first, so that its real size decides how it is joined.
    """
    sized = sizes(docs, key, text, source, seed)
    plan = shares(sized, weights, share, most)
    out = with_copies(sized, plan, "source", F.col("hash"), most, "copies")
    goal = plan.select("s2", "source_size", "target")
    out = out.join(goal, F.col("source").eqNullSafe(F.col("s2")))
    return out.select("key", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, key: str, text: str, source: str, weights: list[int], share: float = 1.0, most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed documents themselves, with all their columns: each row as often as the mix takes it, which may be never."""
    plan = shares(sizes(docs, key, text, source, seed), weights, share, most)
    taken = with_copies(docs, plan, source, own_hash(F.col(key), F.col(text), seed), most, "__copies").where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)
