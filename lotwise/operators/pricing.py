"""Robust price statistics, inferred sales and fair values for many subjects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as m
from ..sources.shared import stored

# Fixed values.
WITHDRAWN_DAYS, LONG_DAYS, NO_DROP = 3, 14, 0.05
FEW_COMPS, NARROW, WIDE = 8, 2, 6
WINDOWS = (NARROW, WIDE)
SALES_FOR_OVERRIDE = 5


def percentile(c: Column, p: float) -> Column:
    """Linear percentile, interpolated values rounded halves up; null for no rows."""
    return m.half_up(F.percentile(c, F.lit(p)))


def inside_fences(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows within one and a half interquartile ranges of the quartiles; groups under four stay whole."""
    group = W.partitionBy(*key)
    q1, q3 = (m.half_up(F.percentile(value, F.lit(p)).over(group)) for p in (0.25, 0.75))
    held = rows.withColumn("_n", F.count(value).over(group)).withColumn("_q1", q1).withColumn("_q3", q3)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return held.where((F.col("_n") < 4) | F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_n", "_q1", "_q3")


def inside_fences_of_groups(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The same for groups of any size: quartiles are aggregated map-side first and joined back, no group is held together.

    Rows of a null key stay.
    """
    cuts = rows.groupBy(*key).agg(F.count(value).alias("_n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q1, q3 = (m.half_up(F.get("_q", F.lit(i))) for i in (0, 1))
    held = rows.join(cuts, key, "left").withColumn("_q1", q1).withColumn("_q3", q3)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    kept = F.coalesce(F.col("_n") < 4, F.lit(True)) | F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)
    return held.where(kept).drop("_n", "_q", "_q1", "_q3")


def days_on_market(now: str) -> Column:
    return m.days_between(F.coalesce("published_at", "first_seen"), F.coalesce("last_seen", F.lit(now).cast("timestamp")))


def sold_proxy(days: Column, dropped: Column, median_days: Column, last_ask: Column) -> dict[str, Column]:
    """What became of a removed listing: withdrawn, ignored, or likely sold and at which price."""
    short = F.coalesce((days < WITHDRAWN_DAYS) & ~dropped, F.lit(False))
    stayed = F.coalesce((days >= LONG_DAYS) | F.coalesce(days >= median_days, F.lit(False)), F.lit(False))
    kind = F.when(short, "withdrawn").when(~dropped & ~stayed, "ignore").otherwise("likely_sold")
    price = F.when(dropped, m.half_up(last_ask)).otherwise(m.half_up(last_ask * (1 - NO_DROP)))
    return {"kind": kind, "proxy": F.when(kind == "likely_sold", price)}


def blend(live: Column, sold: Column, sold_count: Column, ask_median: Column, ask_p25: Column) -> Column:
    """Live and sold medians mixed by the number of sales, below the median ask and not far below its quartile."""
    weight = F.when(sold_count >= 8, 0.7).when(sold_count >= 3, 0.5).otherwise(0.0)
    mixed = F.when((weight == 0) | sold.isNull(), live.cast("double")).when(live.isNull(), sold.cast("double")).otherwise(sold * weight + live * (1 - weight))
    mixed = F.when(ask_median.isNotNull(), F.least(mixed, ask_median.cast("double"))).otherwise(mixed)
    low = F.when((sold_count < 8) & ask_p25.isNotNull(), F.greatest(mixed, ask_p25 * 0.7)).otherwise(mixed)
    return F.when(mixed.isNotNull(), m.to_thousand(low))


def blend_sales(proxy: Column, sales: Column, sold_median: Column) -> Column:
    """Recorded sales take over from five on and mix in below."""
    rounded = m.to_thousand(sold_median)
    weight = sales / F.lit(float(SALES_FOR_OVERRIDE))
    mixed = m.to_thousand(proxy * (1 - weight) + rounded * weight)
    return F.when((sales >= SALES_FOR_OVERRIDE) & rounded.isNotNull(), rounded).when((sales > 0) & rounded.isNotNull() & proxy.isNotNull(), mixed).otherwise(proxy)


def fair_values(comps: DataFrame, now: str, as_of_year: int, adjustment: DataFrame | None = None) -> DataFrame:
    """One row per subject from its ranked comparables (see matching.ranked): band, live and sold medians, fair value.

    Comparables may say whether their price fell (`dropped`) and what was asked last (`last_price`). An `adjustment`
    (subject, adjustment) is added to the live median; the rows then also have the unrounded `ask_median`.
    """
    km = m.effective_km(F.col("s_mileage_km"), F.col("s_year"), as_of_year)
    base = m.with_vat(F.col("price_czk"), F.col("price_includes_vat"))
    rows = comps.withColumn("km", km).withColumn("ask", base).withColumn("days", days_on_market(now))
    adjust = lambda value: m.age_adjustment(F.col("s_year"), F.col("km"), F.col("year"), F.col("mileage_km"), value)
    active = rows.where((F.col("status") == "active") & (F.col("ask") > 0))
    band = inside_fences(active, ["subject"], "ask").groupBy("subject").agg(percentile(F.col("ask"), 0.25).alias("p25"), percentile(F.col("ask"), 0.5).alias("typical"), percentile(F.col("ask"), 0.75).alias("p75"), F.count(F.lit(1)).alias("live_asks"))
    live = active.withColumn("live", m.after_haircut(F.col("ask") + adjust(F.col("ask")), F.col("days"))).where("live > 0")
    live = inside_fences(live, ["subject"], "live").groupBy("subject").agg(percentile(F.col("live"), 0.5).alias("live_median"))
    typical_days = active.groupBy("subject").agg(percentile(F.col("days"), 0.5).alias("median_days"))
    gone = rows.where(F.col("status") == "removed").join(typical_days, "subject", "left")
    fell = F.coalesce("dropped", F.lit(False)) if "dropped" in comps.columns else F.lit(False)
    last = F.coalesce(m.with_vat(F.col("last_price"), F.col("price_includes_vat")), F.col("ask")) if "last_price" in comps.columns else F.col("ask")
    judged = sold_proxy(F.col("days"), fell, F.col("median_days"), last)
    sold = gone.withColumn("proxy", judged["proxy"]).where("proxy IS NOT NULL").withColumn("proxy", F.col("proxy") + adjust(F.col("proxy")))
    sold = sold.groupBy("subject").agg(percentile(F.col("proxy"), 0.5).alias("sold_median"), F.count(F.lit(1)).alias("sold_count"))
    out = band.join(live, "subject", "left").join(sold, "subject", "left").withColumn("sold_count", F.coalesce("sold_count", F.lit(0)))
    live_median, more = F.col("live_median"), []
    if adjustment is not None:
        out = out.join(adjustment, "subject", "left")
        live_median, more = live_median + F.coalesce("adjustment", F.lit(0)), [F.col("typical").alias("ask_median")]
    fair = blend(live_median, F.col("sold_median"), F.col("sold_count"), F.col("typical"), F.col("p25"))
    return out.select(
        "subject", "live_asks", "sold_count", fair.alias("fair_value"), *more,
        m.to_thousand(F.col("p25")).alias("price_low"), m.to_thousand(F.col("typical")).alias("price_typical"), m.to_thousand(F.col("p75")).alias("price_high"),
    )


def appraise(ranked: DataFrame, now: str, as_of_year: int, margin_pct: float = 8.0) -> DataFrame:
    """Fair value, band and dealer advice per subject, from comparables two years around, or six where those are few.

    `ranked` has the rows of both windows (matching.ranked with WINDOWS): a subject's narrow count decides which it uses.
    """
    narrow = F.count(F.when((F.col("status") == "active") & (F.col("window") == NARROW), 1)).over(W.partitionBy("subject"))
    rows = ranked.withColumn("used", F.when(narrow >= FEW_COMPS, NARROW).otherwise(WIDE))
    # at most 400 rows a subject and status, read by every statistic below: written once
    rows = stored(rows.where(F.col("window") == F.col("used")), "comparables")
    windows = rows.groupBy("subject").agg(F.max("window").alias("year_window"))
    advice = m.dealer_advice(F.col("fair_value"), F.lit(margin_pct))
    return fair_values(rows, now, as_of_year).join(windows, "subject").select("*", *(c.alias(n) for n, c in advice.items()))


def firm_estimate(comps: DataFrame, as_of_year: int) -> DataFrame:
    """A firm ask per subject: comparables brought to the subject's year and mileage at the market's
    median, the zone between their 35th and 50th percentiles, a pull towards dealers where five or
    more are known, and a corridor around the market's quartiles."""
    km = m.effective_km(F.col("s_mileage_km"), F.col("s_year"), as_of_year)
    # few rows a subject, read by every statistic below: written once
    rows = stored(comps.select("subject", "year", "mileage_km", "price_czk", "seller_type", "s_year", km.alias("km")), "comparables")
    price = F.col("price_czk")
    market = inside_fences(rows, ["subject"], "price_czk").groupBy("subject").agg(percentile(price, 0.25).alias("p25"), percentile(price, 0.5).alias("market"), percentile(price, 0.75).alias("p75"))
    typical_km = rows.groupBy("subject").agg(percentile(F.when(F.col("mileage_km") > 0, F.col("mileage_km")), 0.5).alias("median_km"), F.first("km").alias("km"))
    adjusted = price + m.age_adjustment(F.col("s_year"), F.col("km"), F.col("year"), F.col("mileage_km"), F.col("market"))
    normal = rows.join(market.select("subject", "market"), "subject").withColumn("normal", adjusted)
    core = inside_fences(normal.where("normal > 0"), ["subject"], "normal").groupBy("subject").agg(percentile(F.col("normal"), 0.35).alias("p35"), percentile(F.col("normal"), 0.5).alias("p50"))
    dealers = inside_fences(normal.where("seller_type = 'dealer'"), ["subject"], "normal").groupBy("subject").agg(F.count(F.lit(1)).alias("dealers"), percentile(F.col("normal"), 0.5).alias("dealer_median"))
    out = market.join(typical_km, "subject").join(core, "subject", "left").join(dealers, "subject", "left")
    liquid = m.half_up(F.col("p35") * 0.45 + F.col("p50") * 0.55)
    pulled = F.when(F.col("dealers") >= 5, m.half_up(liquid * 0.65 + F.col("dealer_median") * 0.35)).otherwise(liquid)
    low = F.when(F.coalesce(F.col("km") > F.col("median_km") * 1.35, F.lit(False)), F.col("p25") * 0.55).otherwise(F.col("p25") * 0.97)
    held = F.when(pulled.isNotNull(), F.greatest(low, F.least(F.col("p75") * 1.03, pulled.cast("double"))))
    return out.select("subject", m.to_thousand(held).alias("suggested"), m.to_thousand(F.col("p50")).alias("normalised"), m.to_thousand(F.col("p25")).alias("market_p25"), m.to_thousand(F.col("p75")).alias("market_p75"))


def sample_level(sample: Column, year_window: Column) -> Column:
    """high, medium or low by the number of comparables and the window of years alone."""
    return F.when(sample < 5, "low").when((sample < 15) | (year_window >= 4), "medium").otherwise("high")


def confidence(sample: Column, window: Column, low: Column, high: Column, typical: Column, features: Column, weak_features: Column, km_weak: Column, sold: Column) -> Column:
    """high, medium or low, from the sample's size, the year window, the band's width, the features and the sales.

    `km_weak` counts the ways in which the mileage is weak: assumed, extreme.
    """
    width = (high - low) / typical
    share = weak_features / features
    points = F.when(sample >= 25, 3).when(sample >= 15, 2).when(sample >= 8, 1).when(sample >= 5, 0).otherwise(-2)
    points = points + F.when(window <= 2, 1).when(window >= 6, -1).otherwise(0)
    known = F.coalesce(typical > 0, F.lit(False)) & low.isNotNull() & high.isNotNull()
    points = points + F.when(~known, 0).when(width < 0.18, 1).when(width > 0.55, -2).when(width > 0.4, -1).otherwise(0)
    points = points + F.when(features <= 0, 0).when(share > 0.6, -1).when((share < 0.25) & (features >= 2), 1).otherwise(0) - km_weak
    strong = (km_weak == 0) & ~F.coalesce(sold < 3, F.lit(False))
    return F.when((points >= 3) & strong, "high").when((points >= 1) | ((km_weak > 0) & (points >= 0)), "medium").otherwise("low")
