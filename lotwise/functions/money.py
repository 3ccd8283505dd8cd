"""Money, rounding and age arithmetic as column expressions.

Three roundings exist and differ at ties: to the nearest, halves up (pricing); halves to
even (roll-up, native amounts); halves up to a hundred (currency conversion).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
VAT = 0.21
ANNUAL_KM = 15_000
DEFAULT_HAIRCUT = 0.08
HAIRCUTS = [(14, 0.05), (45, 0.08)]
LAST_HAIRCUT = 0.12
LEAST_PRICE, MOST_PRICE = 5_000, 50_000_000
DAY_SECONDS = 86_400


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("long")


def half_even(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("long")


def to_thousand(c: Column) -> Column:
    return half_up(c / 1000) * 1000


def to_hundred(c: Column) -> Column:
    """Nearest hundred, halves up; at least 100 for positive amounts below it is not enforced."""
    return (F.floor((c + 50) / 100) * 100).cast("long")


def with_vat(price: Column, includes_vat: Column) -> Column:
    """Consumer price: VAT is added only where the flag says it is missing; unknown counts as included."""
    grossed = F.when(includes_vat.eqNullSafe(F.lit(False)), half_up(price * F.lit(1 + VAT))).otherwise(half_up(price))
    return F.when(price <= 0, price).otherwise(grossed)


def haircut(days: Column) -> Column:
    share = F.when(days.isNull() | (days < 0), F.lit(DEFAULT_HAIRCUT))
    for most, part in HAIRCUTS:
        share = share.when(days <= most, F.lit(part))
    return share.otherwise(F.lit(LAST_HAIRCUT))


def after_haircut(ask: Column, days: Column) -> Column:
    return half_up(ask * (F.lit(1.0) - haircut(days)))


def calibrated_haircut(default: Column, ask_median: Column, sold_median: Column, sales: Column) -> Column:
    """The default share moved towards the observed gap between asks and sales, fully from five sales on."""
    gap = F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.lit(1.0) - sold_median / ask_median))
    known = (sales > 0) & (ask_median > 0) & sold_median.isNotNull()
    weight = F.least(sales / F.lit(5.0), F.lit(1.0))
    return F.when(F.coalesce(known, F.lit(False)), default * (1 - weight) + gap * weight).otherwise(default)


def assumed_km(year: Column, as_of_year: int) -> Column:
    return F.greatest(F.lit(1), F.lit(as_of_year) - year + 1) * ANNUAL_KM


def effective_km(km: Column, year: Column, as_of_year: int) -> Column:
    return F.when(km > 0, half_up(km)).otherwise(assumed_km(year, as_of_year).cast("long"))


def age_adjustment(subject_year: Column, subject_km: Column, year: Column, km: Column, base: Column) -> Column:
    """What to add to a comparable's price for the subject's mileage and year, capped at 40 % or 40,000."""
    per_km = F.greatest(F.lit(3_000), half_up(base * 0.012))
    per_year = F.greatest(F.lit(8_000), half_up(base * 0.03))
    by_km = F.when(km.isNotNull() & (subject_km > 0), (km - subject_km) / F.lit(10_000.0) * per_km).otherwise(0.0)
    by_year = F.when(year.isNotNull(), (subject_year - year) * per_year).otherwise(0)
    cap = F.greatest(F.lit(40_000), half_up(base * 0.4))
    return half_up(F.greatest(-cap, F.least(cap, by_km + by_year)))


def days_between(start: Column, end: Column) -> Column:
    """Whole days, null when a date is missing or the end comes first."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds >= 0, F.floor(seconds / DAY_SECONDS)).cast("long")


def dealer_advice(fair: Column, margin_pct: Column | None = None, buffer: Column | None = None) -> dict[str, Column]:
    margin = F.lit(8.0) if margin_pct is None else F.coalesce(F.least(F.lit(40.0), F.greatest(F.lit(0.0), margin_pct)), F.lit(8.0))
    rework = F.lit(0).cast("long") if buffer is None else F.coalesce(F.greatest(F.lit(0), half_up(buffer)), F.lit(0)).cast("long")
    list_at = to_thousand(fair)
    buy_in = to_thousand(fair * (1 - margin / 100) - rework)
    return {"list_at": list_at, "buy_in": buy_in, "commission": list_at - buy_in}


def to_czk(amount: Column, currency: Column, rate: Column) -> Column:
    """Native amounts round half to even; converted ones to the nearest hundred; unknown rates give null."""
    return F.when(F.upper(currency) == "CZK", half_even(amount)).otherwise(to_hundred(amount * rate))


def usable_price(c: Column) -> Column:
    return F.when(c.between(LEAST_PRICE, MOST_PRICE), c)
