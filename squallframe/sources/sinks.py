"""Writes (A16-A20): partitioned tables, back-filled columns, exports, compute-or-load."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(
    df: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str] = (), units: dict[str, str] | None = None
) -> None:
    """Overwrite only the partitions present in ``df``; one shuffle groups each partition's rows.

    A random salt is not needed: AQE splits oversized partitions of the rebalance.
    """
    for name, unit in (units or {}).items():
        df = df.withColumn(name, F.col(name).alias(name, metadata={"units": unit}))
    out = df.hint("rebalance", *partitions)
    if sort:
        out = out.sortWithinPartitions(*partitions, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_variable(
    spark: SparkSession, path: str, out: str, new: dict[str, Column], partitions: Sequence[str]
) -> None:
    """Back-fill derived columns of a stored table into ``out`` (a table is never rewritten in place)."""
    if path.rstrip("/") == out.rstrip("/"):
        raise ValueError("write the back-filled table to a new path")
    write_partitioned(spark.read.parquet(path).withColumns(new), out, partitions)


def wide_gusts(daily: DataFrame, station: str, date: str, value: str, stations: Sequence) -> DataFrame:
    """One row per date, one column per listed station."""
    return daily.groupBy(date).pivot(station, list(stations)).agg(F.max(value))


def homogenisation_long(wide: DataFrame, date: str, stations: Sequence) -> DataFrame:
    """The dense long form: every date for every station, missing values kept as null."""
    names = [f"`{s}`" for s in stations]
    return wide.unpivot([date], [F.col(n) for n in names], "station", "wind_gust")


def write_text_table(df: DataFrame, path: str, sep: str = ",", null: str = "NA", header: bool = False) -> None:
    df.write.mode("overwrite").options(nullValue=null, emptyValue="", sep=sep, header=header).csv(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the stored result if it is complete, else build and store it first."""
    if not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    """The commit marker tells a finished write from one cut short."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
