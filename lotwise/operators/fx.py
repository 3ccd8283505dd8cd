"""Reference rates and re-quoting of foreign prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import to_hundred


def cross_rates(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """(quoted_on, currency, czk_per_unit) from rate documents that quote all currencies per euro."""
    at = "//Cube[@currency]"
    rows = documents.select(F.xpath_string(xml, F.lit("//Cube/@time")).alias("quoted_on"), F.xpath(xml, F.lit(f"{at}/@currency")).alias("c"), F.xpath(xml, F.lit(f"{at}/@rate")).alias("r"))
    rates = rows.select("quoted_on", F.posexplode("c").alias("i", "currency"), "r").select("quoted_on", "currency", F.col("r")[F.col("i")].cast("double").alias("per_euro"))
    czk = rates.where("currency = 'CZK'").select("quoted_on", F.col("per_euro").alias("czk"))
    euro = czk.select("quoted_on", F.lit("EUR").alias("currency"), F.lit(1.0).alias("per_euro"))
    crossed = rates.where("currency <> 'CZK'").unionByName(euro).join(czk, "quoted_on")
    return crossed.select(F.to_date("quoted_on").alias("quoted_on"), "currency", (F.col("czk") / F.col("per_euro")).cast("decimal(12,6)").alias("czk_per_unit"))


def latest_rates(rates: DataFrame) -> DataFrame:
    """The rates of the last day that has any, and the crown itself."""
    last = rates.agg(F.max("quoted_on").alias("last"))
    now = rates.join(F.broadcast(last), F.col("quoted_on") == F.col("last")).select("currency", F.col("czk_per_unit").cast("double").alias("rate"), "quoted_on")
    return now.unionByName(last.select(F.lit("CZK").alias("currency"), F.lit(1.0).alias("rate"), F.col("last").alias("quoted_on")))


def requote(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """New prices of foreign listings whose rate is older than the latest; rows of unknown currencies stay out.

    `rates` has one row per currency of one day, a bounded list, and is broadcast.
    """
    now = F.broadcast(latest_rates(rates).withColumnRenamed("quoted_on", "_on").withColumnRenamed("rate", "_rate"))
    stale = listings.where((F.upper("currency") != "CZK") & (F.col("price_foreign") > 0))
    found = stale.join(now.withColumnRenamed("currency", "_cur"), F.upper("currency") == F.col("_cur"))
    found = found.where(F.col("fx_rate_date").isNull() | (F.col("fx_rate_date") < F.col("_on")))
    price = to_hundred(F.col("price_foreign") * F.col("_rate"))
    return found.select("id", F.col("price_czk").alias("old_price"), price.alias("new_price"), F.col("_on").alias("rate_date"), (price != F.col("price_czk")).cast("int").alias("changed"))


#: Months of rates that may be broadcast; more are joined by a shuffle.
BROADCAST_SPANS = 100_000


def rate_as_of(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """Extension: the last rate on or before each amount's day, null before the first.

    A rate holds until the next of its currency. These spans, cut by months, meet the amounts by currency and month, so that no
    currency's amounts come together in one task.
    """
    last = amounts.agg(F.max("day")).first()[0]
    day = W.partitionBy("currency").orderBy("quoted_on")
    spans = rates.select("currency", "quoted_on", F.lead("quoted_on").over(day).alias("next"), F.col("czk_per_unit").cast("double").alias("rate"))
    until = F.greatest(F.coalesce(F.date_sub("next", 1), F.lit(last)), F.col("quoted_on"))
    months = F.sequence(F.trunc("quoted_on", "month"), F.trunc(until, "month"), F.expr("INTERVAL 1 MONTH"))
    spans = spans.select(F.col("currency").alias("_of"), F.explode(months).alias("_month"), "quoted_on", "next", "rate")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_SPANS else spans
    here = (F.col("currency") == F.col("_of")) & (F.trunc("day", "month") == F.col("_month")) & (F.col("day") >= F.col("quoted_on")) & F.coalesce(F.col("day") < F.col("next"), F.lit(True))
    return amounts.select("id", "currency", "day").join(spans, here, "left").select("id", "currency", "day", "rate")
