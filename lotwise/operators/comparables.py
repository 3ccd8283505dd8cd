"""Price histories of comparables, what became of removed ones, and what features are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as m
from . import pricing

# Fixed values.
HISTORIES, POOL_YEARS, POOL_KM, POOL_LEAST, ROWS_LEAST = 80, 3, 80_000, 8, 6
SIDE_LEAST, SIDE_SURE, RARE, UNCOMMON = 3, 5, 0.08, 0.25
SPREAD_LEAST, SPREAD, FEATURES_MOST = 5_000, 0.35, 120_000


def histories(points: DataFrame, key: str = "id") -> DataFrame:
    """(key, history): a listing's prices in order of time."""
    ordered = F.array_sort(F.collect_list(F.struct("observed_at", "seq", "price")))
    return points.groupBy(key).agg(F.transform(ordered, lambda p: p["price"]).alias("history"))


def dropped(history: Column, ask: Column) -> Column:
    """Whether a price fell: any below the one before, or a single one above the last ask."""
    fell = F.exists(F.zip_with(F.slice(history, 1, F.size(history) - 1), F.slice(history, 2, F.size(history) - 1), lambda a, b: b < a), lambda x: x)
    return F.coalesce(F.when(F.size(history) > 1, fell).when(F.size(history) == 1, ask < F.element_at(history, 1)), F.lit(False))


def worth_a_history(removed: DataFrame, group: list[str], order: list, days: str = "days", most: int = HISTORIES) -> DataFrame:
    """The first removed listings of every group that weren't withdrawn at once; only their histories are read."""
    eligible = removed.where(F.col(days).isNull() | (F.col(days) >= pricing.WITHDRAWN_DAYS))
    return eligible.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def inferred_sales(listings: DataFrame, points: DataFrame, now: str, group: list[str], order: list) -> DataFrame:
    """(id, points, dropped, kind, proxy) of removed listings, against the median days of their group's active ones."""
    rows = listings.withColumn("days", pricing.days_on_market(now))
    typical = rows.where("status = 'active'").groupBy(*group).agg(pricing.percentile(F.col("days"), 0.5).alias("median_days"))
    gone = rows.where("status = 'removed'").select("id", *group, "price_czk", "days")
    wanted = worth_a_history(gone, group, order).select("id")
    known = histories(points.join(wanted, "id", "left_semi"))
    gone = gone.join(known, "id", "left").join(typical, group, "left")
    fell = dropped(F.col("history"), F.col("price_czk"))
    last = F.coalesce(F.try_element_at("history", F.lit(-1)), F.col("price_czk"))
    judged = pricing.sold_proxy(F.col("days"), fell, F.col("median_days"), last)
    sold = judged["kind"] == "likely_sold"
    return gone.select("id", F.coalesce(F.size("history"), F.lit(0)).alias("points"), (sold & fell).cast("int").alias("dropped"), judged["kind"].alias("kind"), judged["proxy"].alias("proxy"))


def feature_values(comps: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per (subject, feature) of `wanted`: what the feature adds to the price, and how sure that is.

    `comps` has (subject, s_year, s_mileage_km, year, mileage_km, price_czk, features). The pool is the near ones of a
    subject if they are enough. Counts and medians of both sides come from one aggregation: the side without a feature is
    not listed, each feature meets its subject's rows once.
    """
    near = (F.coalesce(F.abs(F.col("year") - F.col("s_year")) <= POOL_YEARS, F.lit(True))) & (
        F.col("mileage_km").isNull() | ~F.coalesce(F.col("s_mileage_km") > 0, F.lit(False)) | (F.abs(F.col("mileage_km") - F.col("s_mileage_km")) <= POOL_KM)
    )
    rows = comps.withColumn("near", near)
    sizes = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("near"), 1)).alias("near_rows")).where(F.col("rows") >= ROWS_LEAST)
    pool = rows.join(sizes, "subject").where(F.col("near") | (F.col("near_rows") < POOL_LEAST))
    met = pool.join(wanted, "subject").withColumn("has", F.array_contains("features", F.col("feature")))
    side = lambda has: F.when(F.col("has") == has, F.col("price_czk"))
    out = met.groupBy("subject", "feature").agg(
        F.count(F.lit(1)).alias("pool"), F.count(side(True)).alias("sample"), pricing.percentile(side(True), 0.5).alias("with"), pricing.percentile(side(False), 0.5).alias("without")
    )
    others = F.col("pool") - F.col("sample")
    delta = F.when((F.col("sample") >= SIDE_LEAST) & (others >= SIDE_LEAST), F.col("with") - F.col("without"))
    spread = F.greatest(F.lit(SPREAD_LEAST), m.half_up(F.abs(F.col("delta")) * SPREAD))
    share = F.col("sample") / F.col("pool")
    return out.withColumn("delta", delta).select(
        "subject", "feature", "sample", F.when(share < RARE, "rare").when(share < UNCOMMON, "uncommon").otherwise("common").alias("rarity"),
        (F.col("delta") - spread).alias("low"), (F.col("delta") + spread).alias("high"),
        ((F.col("sample") < SIDE_SURE) | (others < SIDE_SURE) | F.col("delta").isNull()).cast("int").alias("unsure"),
    )


def damped(total: Column, most: int = FEATURES_MOST) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), total))


def rare_features(values: DataFrame) -> DataFrame:
    """(subject, adjustment): what rare, sure and positive features add, within a cap."""
    middle = m.half_up((F.col("low") + F.col("high")) / 2)
    counted = F.when((F.col("rarity") == "rare") & (F.col("unsure") == 0) & (middle > 0), middle)
    return values.groupBy("subject").agg(damped(F.coalesce(F.sum(counted), F.lit(0))).cast("long").alias("adjustment"))
