"""Rows of feeds on their way in: prices, enrichment, catalogue joins, quarantine and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import money as m
from ..functions.text import fold_spaces

# Fixed values.
PRICES, VAT = (5_000, 50_000_000), 1.21
STUB_RATES = {"EUR": 25.0, "PLN": 5.8, "USD": 23.0}


def valid_price(price: Column) -> Column:
    return F.when(price.between(*PRICES), price)


def resolved_prices(price: Column, without_vat: Column, is_without: Column, deductible: Column) -> dict[str, Column]:
    """A feed's price with VAT, without it, and what is known of the VAT; all null for implausible prices."""
    listed, without = valid_price(price), valid_price(without_vat)
    net = F.coalesce(is_without, F.lit(False))
    gross = valid_price(m.half_even(listed * VAT))
    ok = F.when(net, gross.isNotNull()).otherwise(listed.isNotNull())
    includes = F.when(net, False).when((without < listed) | deductible, True)
    return {
        "price_czk": F.when(net, gross).otherwise(listed),
        "price_without_vat": F.when(ok, F.when(net, listed).otherwise(without)),
        "vat_deductible": F.when(ok, F.when(net, F.coalesce(deductible, F.lit(True))).otherwise(deductible)),
        "price_includes_vat": F.when(ok, includes),
    }


def stub_rate(code: Column) -> Column:
    return labels.exact(code, {k: str(v) for k, v in STUB_RATES.items()}).cast("double")


def import_fields(amount: Column, currency: Column, given: Column, live: Column, live_date: Column) -> dict[str, Column]:
    """Crowns and the rate behind them: a given rate before a live one before a stub; whole hundreds for foreign amounts."""
    code = labels.currency(currency)
    rate = F.coalesce(given, live, stub_rate(code))
    foreign = code != "CZK"
    crowns = F.when(foreign, F.floor((amount * rate + 50) / 100) * 100).otherwise(m.half_even(amount))
    return {
        "price_czk": F.when(amount > 0, crowns.cast("long")),
        "price_foreign": F.when(foreign, amount.cast("double")),
        "fx_rate_date": F.when(foreign, live_date),
        "fx_czk_per_unit": F.when(foreign, rate),
    }


def enriched(rows: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with a detail's columns where it has them; blank texts count as missing."""
    renamed = details.select(key, *(F.col(c).alias(f"detail_{c}") for c in columns))
    out = rows.join(renamed, key, "left")
    kinds = dict(rows.dtypes)
    value = lambda c: F.when(F.trim(f"detail_{c}") != "", F.col(f"detail_{c}")) if kinds[c] == "string" else F.col(f"detail_{c}")
    return out.select(*(F.coalesce(value(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def first_fuel(plates: DataFrame, fuels: DataFrame, key: str, order: list) -> DataFrame:
    """Plates with the first fuel that the register has for them."""
    first = fuels.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", *[c for c in order if c != key])
    return plates.join(first, key, "left")


def variant_keys(rows: DataFrame) -> DataFrame:
    """Makes, models and variants under keys that follow from their names alone, so that feeds meet without a counter.

    A variant is a model of a category in one year, body, fuel, transmission, motor label, power and displacement; names count
    without case and accents, what isn't known has a mark of its own.
    """
    name = lambda c: F.coalesce(fold_spaces(F.col(c)), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("string")
    keyed = rows.withColumn("make_key", F.sha2(name("make"), 256)).withColumn("model_key", F.sha2(F.concat_ws("|", name("make"), name("model"), name("category")), 256))
    parts = ["model_key", number("year"), name("body"), name("fuel"), name("transmission"), name("motor_label"), number("power_kw"), number("displacement_cc")]
    return keyed.withColumn("variant_key", F.sha2(F.concat_ws("|", *parts), 256))


def merged_variants(rows: DataFrame) -> DataFrame:
    """One row per variant of keyed rows: how all its sources name it, the latest name first, and when it was first and last seen."""
    shown = ["make", "model", "category", "year", "body", "fuel", "transmission", "motor_label", "power_kw", "displacement_cc"]
    keys = ["make_key", "model_key", "variant_key"]
    # names travel once, in the latest row, and keys as the bytes that their digits stand for
    held = rows.groupBy(*(F.unhex(k).alias(k) for k in keys)).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("seen").alias("first_seen"), F.max(F.struct("seen", "source", *shown)).alias("latest")
    )
    return held.select(*(F.lower(F.hex(k)).alias(k) for k in keys), "sources", "first_seen", F.col("latest.seen").alias("last_seen"), *(F.col(f"latest.{c}").alias(c) for c in shown))


def outcome(source: Column, known: list[str], error: Column, skipped: Column) -> Column:
    """What becomes of a row: an error (an unknown source included) and a skip keep it out, the batch goes on."""
    return F.when(~F.coalesce(source.isin(known), F.lit(False)) | error, "error").when(skipped, "skipped").otherwise("ingested")


def counters(rows: DataFrame, by: str = "source") -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("outcome") == kind, 1)).alias(kind)
    return rows.groupBy(by).agg(count("ingested"), count("error"), count("skipped"))
