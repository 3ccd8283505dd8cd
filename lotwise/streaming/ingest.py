"""Incremental ingest: observations arrive as files; state and price log follow.

A micro-batch folds its observations, merges them into the stored state and writes the
price changes. Batches may come in any order: where a listing's new rows are older than its
newest one, its observations from there on are read again and their points are stated anew;
what earlier batches said of that time is void (`read_log`). A batch that runs again after a
failure writes the same version again, so the result is the same as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import price_log

SCHEMA = "listing long, observed_at timestamp, seq long, price long, region string, features string"


def versions(spark: SparkSession, path: str) -> list[int]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    if not files.exists(folder):
        return []
    found = (f.getPath() for f in files.listStatus(folder))
    return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


TIMES = ["price_at", "region_at", "features_at"]


def stored_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    known = [v for v in versions(spark, f"{path}/state") if before is None or v < before]
    return spark.read.parquet(f"{path}/state/v{known[-1]}") if known else None


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    state = stored_state(spark, path)
    return None if state is None else state.drop(*TIMES)


def folded(batch: DataFrame) -> DataFrame:
    """A batch's observations as state, with the time that each value is from."""
    order = F.struct("observed_at", "seq")
    filled = {"price": order, "region": F.when(F.col("region").isNotNull(), order), "features": F.when(F.coalesce("features", F.lit("")) != "", order)}
    values = [e for c, when in filled.items() for e in (F.max_by(c, when).alias(c), F.max(when).alias(f"{c}_at"))]
    return batch.groupBy("listing").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("sightings"), *values)


def merged(states: DataFrame) -> DataFrame:
    """States of the same listings in one: the latest value of each column wins, in whatever order batches came."""
    values = [e for t in TIMES for e in (F.max_by(t.removesuffix("_at"), t).alias(t.removesuffix("_at")), F.max(t).alias(t))]
    return states.groupBy("listing").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings"), *values)


def price_points(spark: SparkSession, path: str, number: int, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The price points of a batch's listings from each one's first new row on, and for late ones where these begin.

    Only listings with late rows have their stored observations read; for the others the state knows the price before.
    """
    batch = spark.read.parquet(f"{path}/seen/batch={number}")
    order = F.struct("observed_at", "seq")
    rows, cuts = batch, spark.createDataFrame([], "listing long, since struct<observed_at:timestamp,seq:bigint>")
    if old is not None:
        since = batch.groupBy("listing").agg(F.min(order).alias("since"))
        known = since.join(old.select("listing", "price", "price_at"), "listing")
        late = known.where(F.col("price_at") >= F.col("since")).select("listing", "since")
        base = known.where(F.col("price_at") < F.col("since")).select("listing", F.col("price_at.observed_at").alias("observed_at"), F.col("price_at.seq").alias("seq"), "price")
        if not late.isEmpty():
            cuts = late
            seen = spark.read.parquet(f"{path}/seen").where(F.col("batch") < number).drop("batch").join(late, "listing")
            before = seen.where(order < F.col("since")).groupBy("listing").agg(F.max_by(F.struct("observed_at", "seq", "price"), order).alias("r")).select("listing", "r.*")
            rows = rows.unionByName(seen.where(order >= F.col("since")).drop("since"))
            base = base.unionByName(before)
        # the row before counts for comparison and is no point itself
        rows = rows.withColumn("own", F.lit(True)).unionByName(base.withColumn("own", F.lit(False)))
        return price_log(rows, more=["own"]).where("own").drop("own"), cuts
    return price_log(rows), cuts


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The price log: each point as the last batch that spoke of its listing and time has it."""
    points, cuts = spark.read.parquet(f"{path}/log"), spark.read.parquet(f"{path}/cuts")
    later = (points["listing"] == cuts["listing"]) & (cuts["batch"] > points["batch"]) & (cuts["since"] <= F.struct(points["observed_at"], points["seq"]))
    return points.join(cuts, later, "left_anti").drop("batch")


def apply_batch(batch: DataFrame, number: int, path: str, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Merges a batch into the state and writes its price points; `after` then gets the new state, if the batch had rows.

    Rows without a listing or a time, or with a price below zero, go to quarantine and stop nothing.
    """
    spark = batch.sparkSession
    fine = F.col("listing").isNotNull() & F.col("observed_at").isNotNull() & F.coalesce(F.col("price") >= 0, F.lit(True))
    batch.where(~fine).write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
    batch = batch.where(fine)
    old = stored_state(spark, path, number)
    new = folded(batch)
    state = new if old is None else merged(old.unionByName(new))
    state.write.mode("overwrite").parquet(f"{path}/state/v{number}")
    batch.select("listing", "observed_at", "seq", "price").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
    points, cuts = price_points(spark, path, number, old)
    points.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
    cuts.write.mode("overwrite").parquet(f"{path}/cuts/batch={number}")
    if after and not batch.isEmpty():
        after(spark.read.parquet(f"{path}/state/v{number}").drop(*TIMES), number)


def ingest(spark: SparkSession, source: str, path: str, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Processes whatever has arrived since the last call, then stops; `after` aggregates the state of each batch with rows."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, path, after)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_prices(stream: DataFrame) -> DataFrame:
    """Extension: mean price in five-minute windows of event time, ten minutes of lateness allowed."""
    return stream.withWatermark("observed_at", "10 minutes").groupBy(F.window("observed_at", "5 minutes"), "region").agg(F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("n"))
