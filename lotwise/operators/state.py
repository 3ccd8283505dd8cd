"""Folding observations into current state, a price log and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ["observed_at", "seq"]


def fold_state(observations: DataFrame, key: str = "listing", latest: tuple[str, ...] = ("price",), latest_known: tuple[str, ...] = ("region",), latest_filled: tuple[str, ...] = ("features",)) -> DataFrame:
    """One row per key: first and last sighting, the latest value of some columns, the latest
    known (not null) of others and the latest non-empty of others. Null when there is none.

    One aggregation with map-side partials; no key's history is ever held together.
    """
    order = F.struct(*ORDER)
    out = [F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("sightings")]
    out += [F.max_by(c, order).alias(c) for c in latest]
    out += [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in latest_known]
    out += [F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", order)).alias(c) for c in latest_filled]
    return observations.groupBy(key).agg(*out)


def price_log(observations: DataFrame, key: str = "listing", more: list[str] | None = None) -> DataFrame:
    """The first price of every key and each that differs from the one before it, with `more` columns."""
    before = F.lag("price").over(W.partitionBy(key).orderBy(*ORDER))
    return observations.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("price"))).select(key, "observed_at", "seq", "price", *(more or []))


def downward_moves(log: DataFrame, key: str = "listing") -> DataFrame:
    """Whether any price of a key fell below the one before it, or the last below the first."""
    window = W.partitionBy(key).orderBy(*ORDER)
    order = F.struct(*ORDER)
    fell = F.coalesce(F.col("price") < F.lag("price").over(window), F.lit(False)).cast("int")
    return log.withColumn("fell", fell).groupBy(key).agg(
        F.greatest(F.max("fell"), (F.max_by("price", order) < F.min_by("price", order)).cast("int")).alias("dropped"),
        F.count(F.lit(1)).alias("points"),
        F.max_by("price", order).alias("last_price"),
    )


def status_of(events: DataFrame, key: str = "listing") -> DataFrame:
    """Status after the last event: gone and rejected remove a listing, seen and live revive it."""
    order = F.struct(*ORDER)
    return events.groupBy(key).agg(
        F.when(F.max_by("kind", order).isin("gone", "rejected"), "removed").otherwise("active").alias("status"),
        F.max(F.when(F.col("kind").isin("seen", "live"), F.col("observed_at"))).alias("last_seen"),
    )


def mark_missing(listings: DataFrame, seen: DataFrame, source: str, before: str, key: str = "id") -> DataFrame:
    """Active listings of a source that were not seen again since `before`: the rows to remove."""
    rows = listings.where((F.col("source") == source) & (F.col("status") == "active") & (F.col("last_seen") < F.lit(before).cast("timestamp")))
    return rows.join(seen.select(key), key, "left_anti")


def touch(listings: DataFrame, live: DataFrame, now: str, key: str = "id") -> DataFrame:
    """Listings confirmed live are seen now and active."""
    marks = live.select(key).distinct().withColumn("_live", F.lit(True))
    hit = F.coalesce("_live", F.lit(False))
    out = listings.join(marks, key, "left")
    return out.withColumn("last_seen", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("last_seen"))).withColumn("status", F.when(hit, "active").otherwise(F.col("status"))).drop("_live")


def merge_state(old: DataFrame, new: DataFrame, key: str, always: list[str], known: list[str]) -> DataFrame:
    """A keyed upsert: new rows win in `always`, and in `known` where they have a value."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    there = F.col(f"b.{key}").isNotNull()
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in always),
        *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in known),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
