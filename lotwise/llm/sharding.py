"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key picks its shard by a walk over a pseudo-random sequence; no ring
table exists, and going from n to n + 1 shards moves only the rows that the new shard
takes, a share of about 1 / (n + 1).

Slots number the rows of each shard without gaps. One shard may hold far more rows than
one task should see, so they are numbered in hash buckets: rows are counted by bucket,
the counts are summed over the few buckets of a shard, and each bucket numbers its own
rows from there. Equal rows are one group with a count until the end, so a key that
repeats in a third of all rows is never sorted row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import kept_aside, read_table

#: Hash buckets per shard; a bucket's keys are sorted in one task.
SLOT_BUCKETS = 1024
#: Equal rows that one generator row expands into.
COPIES_AT_ONCE = 65_536


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key."""
    key = keys.astype(np.uint64, copy=True)
    bucket = np.full(len(key), -1, dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = ahead[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = 2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[live] = np.floor((bucket[live] + 1) * step).astype(np.int64)
            live = live[ahead[live] < shards]
    return bucket.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key, 0 to shards - 1. A null key counts as key 0."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """Every row with `shard` and, for one more shard, `grown_shard`; keys that aren't whole numbers are hashed first.

    An empty table stays empty; rows with equal keys share a shard; a null key counts as key 0. Other columns pass
    through, those of the two names with an underscore before them.
    """
    kind = df.select(key.alias("k")).schema["k"].dataType
    df = df.withColumn("_jump_key", key if isinstance(kind, IntegralType) else F.when(key.isNotNull(), F.xxhash64(key)))
    df, key = kept_aside(df, "shard", "grown_shard"), F.col("_jump_key")
    return df.withColumn("shard", jump_shard(key, shards)).withColumn("grown_shard", jump_shard(key, shards + 1)).drop("_jump_key")


def number_slots(groups: DataFrame, shard: str, order: list[str], copies: str) -> DataFrame:
    """Expands groups of equal rows into rows with a gapless `slot` per shard, in bucket order, then by `order`."""
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)))
    counts = groups.groupBy(shard, "_bucket").agg(F.sum(copies).alias("_n"))
    starts = counts.select(shard, "_bucket", (F.sum("_n").over(W.partitionBy(shard).orderBy("_bucket")) - F.col("_n")).alias("_start"))
    inside = W.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = groups.withColumn("_before", F.sum(copies).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(copies))
    placed = numbered.join(starts, [shard, "_bucket"]).withColumn("_first", F.col("_start") + F.col("_before"))
    # a large group of equal rows is cut into blocks, which Spark spreads before it expands them
    blocks = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    offset = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES_AT_ONCE), F.col(copies) - F.col("_block")) - 1))
    rows = blocks.hint("rebalance").withColumn("_offset", offset)
    return rows.withColumn("slot", F.col("_first") + F.col("_block") + F.col("_offset"))


def op9_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards by key. Null text: size 8 and checksum 0; a null doc_id counts as key 0."""
    docs = read_table(spark, sf_dir, "documents")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    equal = thin.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    rows = number_slots(assign_shards(equal, F.col("doc_id"), shards), "shard", ["doc_id", "size", "text_crc32"], "_copies")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
