"""Deterministic draws: a replicate's k-th pick is a hash of (seed, replicate, k).

The same rows are drawn on any cluster, after any retry, and in any other engine with md5.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.functions.scalar import col


HEX_DIGITS = 15  # 60 bits, so the number stays a positive long
LOW = (1 << 31) - 1
# Odd multipliers below 2^31 of the mixing rounds, so that products stay below 2^62
ROUNDS = [2146121005, 2073254073, 1759714725, 1458777923]


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def lot(seed, *parts) -> Column:
    """A number below 2^60 from a hash of the parts: a random order of rows, or the start of a series of draws."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return _number(F.concat_ws(":", first, *[col(p).cast("string") for p in parts]))


def _let(x: Column, use) -> Column:
    """``use(x)`` with x computed once, however often it occurs: repeated expressions would grow with every round."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _round(x: Column, by: int) -> Column:
    return (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(by)).bitwiseAND(F.lit(LOW))


def pick(start, k, n) -> Column:
    """0-based index below ``n``: the k-th draw of the series that begins at ``start`` (see ``lot``).

    Integer rounds on 31-bit halves give 60 bits, so positions of any sample can be drawn; a hash of text is needed only
    once a series.
    """
    start, k = (c if isinstance(c, Column) else F.lit(c) for c in (start, k))
    start, k = start.cast("long"), k.cast("long")
    high, rest = F.shiftright(k, 31).bitwiseAND(F.lit(LOW)), F.lit((1 << 29) - 1)

    def joined(a, b):
        return F.shiftleft(a.bitwiseXOR(F.shiftright(a, 16)), 29) + b.bitwiseXOR(F.shiftright(b, 14)).bitwiseAND(rest)

    def second(a):
        half = _let(a.bitwiseXOR(F.shiftright(start, 31)), lambda u: _round(u, ROUNDS[2]).bitwiseXOR(F.shiftright(a, 13)))
        return _let(_let(half, lambda v: _round(v, ROUNDS[3])), lambda b: joined(a, b))

    first = _let(k.bitwiseXOR(start).bitwiseAND(F.lit(LOW)), lambda x: _round(x, ROUNDS[0]).bitwiseXOR(high))
    number = _let(_let(first, lambda y: _round(y, ROUNDS[1])), second)
    return number % (n if isinstance(n, Column) else F.lit(n))


def picks(start: int, k: np.ndarray, n: int) -> np.ndarray:
    """``pick`` of many draws of one series in numpy."""

    def rnd(x, by):
        return ((x ^ (x >> 15)) * by) & LOW

    a = rnd(rnd((k ^ start) & LOW, ROUNDS[0]) ^ ((k >> 31) & LOW), ROUNDS[1])
    b = rnd(rnd(a ^ (start >> 31), ROUNDS[2]) ^ (a >> 13), ROUNDS[3])
    return (((a ^ (a >> 16)) << 29) + ((b ^ (b >> 14)) & ((1 << 29) - 1))) % n


def counted(series: DataFrame, keep: list[str], start: str, size: str, block: int = 4096, some: int = 64) -> DataFrame:
    """(keep..., pos, times): how often a series that begins at ``start`` draws each 0-based position below its ``size``, with
    ``size`` draws in all.

    Draws are made in blocks that are dealt out, so one long series does not stay on one task; a block counts its own draws.
    """
    last = F.floor((F.col(size) - 1) / block)
    blocks = series.where(F.col(size) > 0).select(*keep, F.col(start).cast("long").alias("_from"), F.col(size).cast("long").alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block"))
    blocks = blocks.repartition("_from", "_size", "_block")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def draw(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, some):
                batch = whole.slice(at, some)
                asked = zip(*(batch.column(c).to_pylist() for c in ("_from", "_size", "_block")))
                found = [np.unique(picks(s, np.arange(b * block, min(b * block + block, n), dtype=np.int64), n), return_counts=True) for s, n, b in asked]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
                own = [batch.column(c).take(rows) for c in keep]
                drawn = [pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *drawn], names=[*keep, "pos", "times"])

    out = blocks.mapInArrow(draw, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", pos long, times long")
    return out.groupBy(*keep, "pos").agg(F.sum("times").alias("times"))


def lot_sql(text: str) -> str:
    """``lot`` in SQL."""
    return f"CAST('0x' || SUBSTR(MD5({text}), 1, {HEX_DIGITS}) AS BIGINT)"


def pick_sql(src: str, start: str, k: str, n: str, out: str, keep: str) -> str:
    """``pick`` in SQL: a SELECT of ``keep`` and the index ``out`` from ``src``; a step per round."""

    def rnd(x, by):
        return f"((xor({x}, {x} >> 15) * {by}) & {LOW})"

    one = f"SELECT *, CAST({start} AS BIGINT) AS st_, CAST({k} AS BIGINT) AS k_, CAST({n} AS BIGINT) AS n_ FROM {src}"
    two = f"SELECT *, xor(k_, st_) & {LOW} AS x_ FROM ({one})"
    three = f"SELECT *, xor({rnd('x_', ROUNDS[0])}, (k_ >> 31) & {LOW}) AS y_ FROM ({two})"
    four = f"SELECT *, {rnd('y_', ROUNDS[1])} AS a_ FROM ({three})"
    five = f"SELECT *, xor(a_, st_ >> 31) AS u_ FROM ({four})"
    six = f"SELECT *, xor({rnd('u_', ROUNDS[2])}, a_ >> 13) AS v_ FROM ({five})"
    seven = f"SELECT *, {rnd('v_', ROUNDS[3])} AS b_ FROM ({six})"
    return f"SELECT {keep}, ((xor(a_, a_ >> 16) << 29) + (xor(b_, b_ >> 14) & {(1 << 29) - 1})) % n_ AS {out} FROM ({seven})"


def replicates(spark: SparkSession, n: int, name: str = "rep") -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))
