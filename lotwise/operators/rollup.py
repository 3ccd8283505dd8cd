"""Daily price roll-up over every subset of fuel, transmission and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import LEAST_PRICE, MOST_PRICE, half_even
from ..functions.text import slug
from .keep import market_date, replace_days

DIMENSIONS = ["fuel", "transmission", "body"]
MISSING = "neuvedeno"


def key(c: Column) -> Column:
    return slug(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(MISSING)))


def market_rows(listings: DataFrame, as_of: Column | None = None, fresh_days: int | None = None) -> DataFrame:
    """Rows that count: active, asked for in crowns, with make, model and year, a plausible price and, if asked for, seen lately."""
    if "currency" in listings.columns:
        listings = listings.where(F.upper(F.coalesce("currency", F.lit("CZK"))) == "CZK")
    rows = listings.where((F.col("status") == "active") & F.col("year").isNotNull() & F.col("price_czk").between(LEAST_PRICE, MOST_PRICE))
    rows = rows.where((F.trim("make") != "") & (F.trim("model") != ""))
    if fresh_days is not None:
        rows = rows.where(F.col("last_seen") >= as_of - F.expr(f"INTERVAL {fresh_days} DAYS"))
    return rows


def roll_up(rows: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Quartiles and count for every key and every one of the eight subsets of the dimensions.

    Missing dimensions are named before grouping, so they never meet the rolled-up ''.
    Partial aggregates are (price, count) maps, so tasks pass on distinct prices, not rows.
    """
    fixed = [*(more or []), "category_key", "make_key", "model_key", "year"]
    named = rows.select(
        *(more or []), slug(F.col("category")).alias("category_key"), slug(F.col("make")).alias("make_key"), slug(F.col("model")).alias("model_key"), "year",
        *(key(F.col(d)).alias(d) for d in DIMENSIONS), "price_czk",
    )
    sets = [[*fixed, *(d for i, d in enumerate(DIMENSIONS) if mask >> i & 1)] for mask in range(8)]
    columns = [F.col(c) for c in (*fixed, *DIMENSIONS)]
    mask = sum(((1 - F.grouping(d)) * (1 << i) for i, d in enumerate(DIMENSIONS)), F.lit(0))
    grouped = named.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        mask.cast("int").alias("dimension_mask"),
        F.percentile("price_czk", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.count(F.lit(1)).alias("active_count"),
    )
    return grouped.select(
        *fixed, "dimension_mask", *(F.coalesce(d, F.lit("")).alias(f"{d}_key") for d in DIMENSIONS),
        half_even(F.col("q")[0]).alias("p25_czk"), half_even(F.col("q")[1]).alias("median_czk"), half_even(F.col("q")[2]).alias("p75_czk"), "active_count",
    )


def write_daily(listings: DataFrame, at: Column, path: str, fresh_days: int = 7) -> None:
    """Rolls the fresh listings up under the market's day and replaces that day and no other."""
    rows = market_rows(listings, at, fresh_days).withColumn("observed_date", market_date(at))
    replace_days(roll_up(rows, ["observed_date"]), path, "observed_date")
