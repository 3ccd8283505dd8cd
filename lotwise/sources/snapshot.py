"""Portable snapshots: listings and price points as Parquet, restored by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold


def export(listings: DataFrame, points: DataFrame, path: str) -> None:
    """Listings with a price and the keys that lookups need, ordered for pruning; points in order of time."""
    rows = listings.where("price_czk IS NOT NULL").withColumn("make_norm", fold(F.col("make"))).withColumn("model_norm", fold(F.col("model")))
    rows.sortWithinPartitions("status", "make_norm", "model_norm", "year").write.mode("overwrite").parquet(f"{path}/listings")
    points.sortWithinPartitions("listing_id", "observed_at").write.mode("overwrite").parquet(f"{path}/price_points")


def counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/listings").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "removed").alias("removed"))
    return rows.crossJoin(spark.read.parquet(f"{path}/price_points").agg(F.count(F.lit(1)).alias("points")))


def restore(spark: SparkSession, path: str, listings: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot's listings over the current ones by id, and both logs without repeated points."""
    fresh = spark.read.parquet(f"{path}/listings").withColumn("_part", F.lit(0))
    both = fresh.unionByName(listings.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("_part"))).where("_n = 1").drop("_n", "_part")
    log = points.unionByName(spark.read.parquet(f"{path}/price_points")).dropDuplicates(["listing_id", "observed_at", "price_czk"])
    return rows, log


def encrypted(documents: DataFrame, key: str, column: str = "body") -> DataFrame:
    """Adds `sealed`, the column under AES in GCM mode with a key that the caller derives."""
    return documents.withColumn("sealed", F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM")))
