"""Stored tables replayed as streams: deliveries land in a folder, and a query that resumes from its checkpoint reads what is new."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.session import shared_folder


def in_order(df: DataFrame, time: str, parts: int = 3) -> list[DataFrame]:
    """The rows with a time, as so many deliveries of equal spans of time."""
    at = F.unix_micros(time)
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [df.where(F.col(time).isNotNull())]
    part = F.floor((at - low) * parts / (high - low + 1))
    return [df.where(part == k) for k in range(parts)]


def closing(df: DataFrame, time: str, at: datetime = datetime(2250, 1, 1)) -> DataFrame:
    """One row, null but for a time far ahead, that moves the watermark past all others."""
    spark = df.sparkSession
    end = F.lit(at).cast(df.schema[time].dataType)
    return spark.range(1).select(*[(end if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema])


def replay(deliveries: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The rows that ``build`` of a stream hands on, and how many rows came too late for it.

    Each delivery is written to the folder that the stream reads; then the query is started anew, resumes from its checkpoint,
    takes in all that is new and ends.  The files lie in the cluster's shared folder and are committed by the sink, so a lost
    executor or a restart neither drops nor repeats a row.
    """
    late, made = 0, None
    for part in deliveries:
        spark = part.sparkSession
        folder = folder if made is not None else f"{shared_folder(spark)}/squallframe/{uuid.uuid4().hex}"
        part.write.mode("append").parquet(f"{folder}/in")
        made = build(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        sink = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        run = sink.outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        late += sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)
    return spark.read.schema(made.schema).parquet(f"{folder}/out"), late
