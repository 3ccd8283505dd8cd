"""Tables kept by key over runs, and a log of the runs.

A kept table is partitioned by the day that its key names, and a run replaces the days that it brings and no others. So a run
that is repeated, or runs again after it failed half-way, leaves what it would have left at once.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "run string, name string, started_at timestamp, finished_at timestamp, status string, stats string"


def replace_days(rows: DataFrame, path: str, day: str) -> None:
    """Writes the rows; days that they hold are replaced whole, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def keep_rates(rates: DataFrame, path: str) -> None:
    """Keeps (quoted_on, currency, czk_per_unit): one rate of a day and currency, the crown itself left out, implausible ones too."""
    fine = rates.where((F.upper("currency") != "CZK") & (F.col("czk_per_unit") > 0) & F.col("quoted_on").isNotNull())
    once = fine.groupBy("quoted_on", F.upper("currency").alias("currency")).agg(F.max("czk_per_unit").alias("czk_per_unit"))
    replace_days(once, path, "quoted_on")


def market_date(at: Column, zone: str = "Europe/Prague") -> Column:
    """The day that a time in UTC belongs to where the market is."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def logged(rows: DataFrame, name: str, write: Callable[[DataFrame], None], log: str, **metrics: Column) -> dict:
    """Writes the rows and logs the run with its metrics, which are gathered while the rows are written and not by a second pass.

    A run that fails is logged too, with what went wrong, and fails.
    """
    spark, watched = rows.sparkSession, Observation(f"{name}-{uuid.uuid4().hex}")
    started, stats, status = datetime.datetime.now(datetime.timezone.utc), {}, "failed"
    try:
        write(rows.observe(watched, *(c.alias(n) for n, c in metrics.items())))
        stats, status = dict(watched.get), "finished"
    except Exception as error:
        stats = {"error": f"{type(error).__name__}: {error}"[:500]}
        raise
    finally:
        row = (uuid.uuid4().hex, name, started, datetime.datetime.now(datetime.timezone.utc), status, json.dumps(stats, default=str, sort_keys=True))
        spark.createDataFrame([row], RUNS).write.mode("append").parquet(log)
    return stats


def runs(spark: SparkSession, log: str) -> DataFrame:
    """The logged runs, the newest first."""
    return spark.read.schema(RUNS).parquet(log).orderBy(F.desc("started_at"), "run")
