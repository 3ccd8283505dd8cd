"""A whole appraisal of many subjects at once: ranked comparables, histories, features, recorded sales, confidence and warnings.

All subjects go through each step together; their comparables, at most 400 of a status, are written once and read by every
statistic. Every subject has a row, those without comparables too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as m
from ..functions import vocabulary as v
from ..sources.shared import stored
from . import comparables, gates, matching, pricing

# Limits, and what warnings and notes say.
EXTREME_KM, SHOWN = 300_000, 200
WIDENED = "Málo přesných shod — rozšířen roční filtr (±6 let)."
ASSUMED = ("Nájezd neuveden — použili jsme předpoklad ", " km (~15 tis. km/rok).")
EXTREME = "Extrémní nájezd — odhad je silně stlačený dolů a jistota klesá; ověřte stav vozu."
VERIFIED = ("Ověřeno na ", " reálných prodejích.")
NO_COMPARABLES = "Nenašli jsme srovnatelné inzeráty. Doplňte data crawlem nebo upravte model."


def keyed_subjects(subjects: DataFrame) -> DataFrame:
    """Subjects with all keys that a full match looks at."""
    return matching.keyed_subjects(subjects).withColumn("s_drive_key", v.drive_key(F.col("s_drive")))


def comparables_of(subjects: DataFrame, listings: DataFrame) -> DataFrame:
    """The ranked domestic, undamaged listings of every subject in the window of years that it uses, by the full score.

    `listings` have a `feature_keys` array and `displacement_cc`. A subject uses the narrow window if that has enough active ones.
    """
    found = matching.retrieve(subjects, listings, windows=pricing.WINDOWS).withColumn("drive_key", v.drive_key(F.col("drive")))
    keys = F.coalesce("feature_keys", F.array().cast("array<string>"))
    fine = F.col("source").isin(matching.DOMESTIC) & matching.reject_reason(drive=True).isNull() & ~(gates.accident_keys(keys) | gates.accident_text(F.col("title")))
    found = found.where(fine).withColumn("match_score", matching.score(full=True)).where(F.col("match_score") >= matching.LEAST_SCORE)
    rank = F.row_number().over(W.partitionBy("subject", "status", "window").orderBy(F.desc("match_score"), "price_czk", "recency"))
    narrow = F.count(F.when((F.col("status") == "active") & (F.col("window") == pricing.NARROW), 1)).over(W.partitionBy("subject"))
    used = F.when(narrow >= pricing.FEW_COMPS, pricing.NARROW).otherwise(pricing.WIDE)
    return found.withColumn("rank", rank).withColumn("used", used).where(F.col("window") == F.col("used"))


def with_histories(comps: DataFrame, points: DataFrame, now: str) -> DataFrame:
    """Comparables with `dropped` and `last_ask`, for the removed ones whose histories are worth reading."""
    gone = comps.where("status = 'removed'").withColumn("days", pricing.days_on_market(now))
    wanted = comparables.worth_a_history(gone, ["subject"], ["rank"]).select("subject", "id", "price_czk")
    known = comparables.histories(points.join(matching.sent(wanted.select("id").distinct()), "id", "left_semi"))
    judged = wanted.join(known, "id").select("subject", "id", comparables.dropped(F.col("history"), F.col("price_czk")).alias("dropped"), F.element_at("history", -1).alias("last_price"))
    return comps.join(judged, ["subject", "id"], "left")


def recorded_sales(subjects: DataFrame, sales: DataFrame, windows: DataFrame) -> DataFrame:
    """(subject, closed_sales, sold_median) from sales of make, model, year and price_czk, matched like listings, in each subject's window of years."""
    named = subjects.select("subject", "s_make_norm", "s_model_norm", "s_year").join(windows, "subject")
    s = sales.where(F.col("price_czk") > 0).select(matching.fold(F.col("make")).alias("make_norm"), matching.fold(F.col("model")).alias("model_norm"), "year", "price_czk")
    pairs = matching.name_pairs(named, s)
    found = s.join(pairs, ["make_norm", "model_norm"]).join(named, ["s_make_norm", "s_model_norm"]).where(F.coalesce(F.abs(F.col("year") - F.col("s_year")) <= F.col("year_window"), F.lit(True)))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("closed_sales"), pricing.percentile(F.col("price_czk"), 0.5).alias("recorded_median"))


def warnings(widened: Column, assumed: Column, km: Column, sales: Column, provenance: Column) -> Column:
    number = lambda n: F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))
    said = [
        F.when(provenance == "closed_sales", F.concat(F.lit(VERIFIED[0]), number(sales), F.lit(VERIFIED[1]))),
        F.when(widened, WIDENED),
        F.when(assumed, F.concat(F.lit(ASSUMED[0]), number(km), F.lit(ASSUMED[1]))).when(km >= EXTREME_KM, EXTREME),
    ]
    return F.filter(F.array(*said), lambda w: w.isNotNull())


def appraise(subjects: DataFrame, listings: DataFrame, points: DataFrame, sales: DataFrame, now: str, as_of_year: int, margin_pct: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """The appraisals, a row per subject, and the comparables shown with them, at most SHOWN of a subject.

    subjects: subject, make, model, year, mileage_km, fuel, transmission, body, power_kw, displacement_cc, drive, motorization,
    generation, trim, feature_keys. points: id, observed_at, seq, price.
    """
    keyed = keyed_subjects(subjects)
    comps = stored(with_histories(stored(comparables_of(keyed, listings), "ranked"), points, now), "comparables")
    active = comps.where("status = 'active'")
    windows = keyed.select("subject").join(comps.groupBy("subject").agg(F.max("used").alias("used")), "subject", "left").select("subject", F.coalesce("used", F.lit(pricing.WIDE)).alias("year_window"))

    wanted = keyed.select("subject", F.explode(F.coalesce("s_feature_keys", F.array().cast("array<string>"))).alias("feature")).distinct()
    values = comparables.feature_values(active.withColumn("features", F.col("feature_keys")), wanted)
    features = values.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.struct("feature", "sample", "rarity", "low", "high", "unsure"))).alias("features"), F.count(F.lit(1)).alias("n_features"), F.sum("unsure").alias("weak_features")
    )
    fair = pricing.fair_values(comps, now, as_of_year, adjustment=comparables.rare_features(values))

    seller = lambda kind, value: F.when(F.col("seller_type") == kind, value)
    split = active.groupBy("subject").agg(
        *(m.to_thousand(pricing.percentile(seller(k, F.col("price_czk")), 0.5)).alias(f"{k}_median") for k in ("private", "dealer")), *(F.count(seller(k, F.lit(1))).alias(f"{k}_count") for k in ("private", "dealer"))
    )
    # an appraisal stands on active comparables
    out = keyed.select("subject", "s_year", "s_mileage_km").join(windows, "subject").join(fair, "subject", "left").join(split, "subject", "left").join(features, "subject", "left")
    out = out.join(recorded_sales(keyed, sales, windows), "subject", "left")
    there = F.coalesce(F.col("live_asks") > 0, F.lit(False))
    count = lambda c: F.when(there, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    closed = count("closed_sales")
    km, assumed = m.effective_km(F.col("s_mileage_km"), F.col("s_year"), as_of_year), ~F.coalesce(F.col("s_mileage_km") > 0, F.lit(False))
    out = out.withColumn("closed_sales", closed).withColumn("proxy_value", F.col("fair_value"))
    value = F.when(there, pricing.blend_sales(F.col("proxy_value"), F.col("closed_sales"), F.col("recorded_median")))
    provenance = F.when(F.col("closed_sales") >= pricing.SALES_FOR_OVERRIDE, "closed_sales").otherwise("ask_proxy")
    level = pricing.confidence(
        F.col("live_asks"), F.col("year_window"), F.col("price_low"), F.col("price_high"), F.col("price_typical"), F.coalesce("n_features", F.lit(0)), F.coalesce("weak_features", F.lit(0)),
        F.when(assumed, 1).otherwise(0) + F.when(~assumed & (km >= EXTREME_KM), 1).otherwise(0), F.col("sold_count"),
    )
    out = out.withColumn("fair_value", value)
    advice = m.dealer_advice(F.col("fair_value"), F.lit(margin_pct))
    said = warnings(there & (F.col("year_window") == pricing.WIDE), assumed, km, F.col("closed_sales"), provenance)
    rows = out.select(
        "subject", count("live_asks").alias("sample_size"), "price_low", "price_typical", "price_high", "fair_value", provenance.alias("provenance"), "closed_sales", count("sold_count").alias("sold_count"),
        ((F.col("ask_median") - F.col("proxy_value")) / F.nullif(F.col("proxy_value"), F.lit(0))).alias("ask_gap"), "year_window", F.when(there, level).otherwise("low").alias("confidence"), "private_median", "dealer_median",
        count("private_count").alias("private_count"), count("dealer_count").alias("dealer_count"), F.when(there, F.col("features")).alias("features"), F.when(there, said).otherwise(F.array(F.lit(NO_COMPARABLES))).alias("warnings"),
        *(c.alias(n) for n, c in advice.items()),
    )
    return rows, active.where(F.col("rank") <= SHOWN).select("subject", "rank", "id", "match_score", "price_czk")
