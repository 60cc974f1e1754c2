"""Session settings and reliable lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(name: str = "squallframe", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and bench; clusters pass their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="run-"))
    return _local_folder[0]


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a table in the shared folder and read it back.

    For results that several later steps read: they are computed once, the plan stays small, and a
    lost executor only re-reads files.  The files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/squallframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
