"""Texts that a report shows: amounts, labels, sentences and addresses without secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import exact
from .money import half_up

# What a report calls things.
SOURCES = {"sauto": "Sauto", "bazos": "Bazoš", "tipcars": "TipCars", "autobazar_eu": "Autobazar.eu", "autoscout24": "AutoScout24", "mobile_de": "Mobile.de"}
SELLERS = {"private": "Soukromý", "dealer": "Dealer"}
LEVELS = {"high": "Vysoká", "medium": "Střední"}
NO_BREAK = " "


def crowns(value: Column) -> Column:
    """An amount in groups of three digits with its currency, a dash for none."""
    grouped = F.replace(F.format_number(half_up(value), 0), F.lit(","), F.lit(NO_BREAK))
    return F.coalesce(F.concat(grouped, F.lit(" Kč")), F.lit("—"))


def source_label(source: Column) -> Column:
    return F.coalesce(exact(source, SOURCES), source)


def seller_label(kind: Column) -> Column:
    return exact(kind, SELLERS)


def level_label(level: Column) -> Column:
    return F.coalesce(exact(level, LEVELS), F.lit("Nízká"))


def czech_date(moment: Column) -> Column:
    """The date at a UTC moment in Prague."""
    return F.date_format(F.from_utc_timestamp(moment, "Europe/Prague"), "d. M. yyyy")


def ask_gap(gap: Column) -> Column:
    """A sentence on how far offers are from the value."""
    pct = half_up(F.abs(gap) * 100)
    way = F.when(gap > 0, "víc").otherwise("míň")
    apart = F.concat(F.lit("Inzeráty žádají o "), pct.cast("string"), F.lit(" % "), way, F.lit(" než reálná hodnota."))
    return F.when(gap.isNotNull(), F.when(pct == 0, "Inzeráty žádají zhruba totéž co reálná hodnota.").otherwise(apart))


def turnover(days: Column) -> Column:
    return F.when(days < 30, "Rychle").when(days <= 60, "Běžně").when(days.isNotNull(), "Pomalu")


def without_password(address: Column) -> Column:
    """A proxy's address with its password hidden."""
    host, left = F.substring_index(address, "@", -1), F.regexp_extract(address, "^(.*)@[^@]*$", 1)
    user = F.regexp_extract(left, "^(.*?://[^:]*)", 1)
    hidden = F.when(F.contains(left, F.lit("://")), F.concat(user, F.lit(":***@"), host)).otherwise(F.concat(F.lit("***@"), host))
    return F.when(F.contains(address, F.lit("@")), hidden).otherwise(address)


def snapshot_address(base: Column, version: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/?$", "/"), F.lit("snapshot.bin?v="), F.url_encode(version))
