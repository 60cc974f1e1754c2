"""Sharding by weighted rendezvous hashing: a record's key and the list of shards decide where it goes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.llm.common import number_rows, plain_key
from squallframe.session import settle

UNIT = float(2**52)


def race(key: Column, shard: int, weight: float, seed: str = "shard") -> Column:
    """The shard's time to win the key: exponential with rate ``weight``, from 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(shard), plain_key(key))), 1, 13)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / UNIT
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """The shard that wins the race for the key, in proportion to the weights.

    A new shard only takes keys it wins itself; a lost shard's keys spread over the others by weight; a heavier shard
    only gains.  Shards of weight 0 get nothing.  A null key is the key ``null``; rows of equal keys stay together.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    bids = [F.struct(race(key, i, w, seed).alias("time"), F.lit(i).alias("shard")) for i, w in live]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard_records(docs: DataFrame, key: str, text: str, weights: list[float], more: list[float] | None = None) -> DataFrame:
    """Where every record goes: key, size, text_crc32, shard, slot and, if ``more`` weights are given, grown_shard.

    size is the text's UTF-8 bytes plus one (a null text has none); slot is the record's place in its shard by key, size
    and checksum, gapless from 0.  Repeated rows get a slot each.  Other columns are not looked at.
    """
    own, body = F.col(key), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    placed = docs.select(
        own.alias("key"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(own, weights).alias("shard"),
        (rendezvous(own, weights + more) if more else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_rows(settle(placed), ["shard"], ["key", "size", "text_crc32"], "slot")


def write_shards(docs: DataFrame, key: str, weights: list[float], path: str, files_per_shard: int = 1) -> None:
    """Write whole records to one folder per shard; a shard's rows are spread over its files by key."""
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    placed = docs.withColumn("__shard", rendezvous(F.col(key), weights))
    placed.repartition(len(weights) * files_per_shard, "__shard", spread).write.partitionBy("__shard").parquet(path)
