"""Finding and ranking comparable listings for many subjects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import equipment
from ..functions import vocabulary as v
from ..functions.extract import title_hits
from ..functions.money import half_up
from ..functions.text import fold, token_present
from ..sources.shared import stored

# Fixed values of the match.
CANDIDATES, LEAST_SCORE = 400, 38
YEAR_ZERO, YEAR_MOST, KM_ZERO, KW_ZERO = 4, 8, 120_000, 35
CC_ZERO, TITLE_HIT, TITLE_MOST, FEATURE_HIT, FEATURE_MOST = 400, 5, 15, 4, 16
UNKNOWN_PENALTY = 4
#: Rows of a side that is sent to every task; and months that a filter may name.
SENT_MOST, MONTHS_MOST = 20_000, 2_000
DOMESTIC = ["sauto", "bazos", "tipcars", "autobazar_eu"]


def keyed_subjects(subjects: DataFrame) -> DataFrame:
    """Subjects under their own names and with the keys that matching needs; those of their features where they have any."""
    more = {"s_equipment": equipment.keys(F.col("s_feature_keys"))} if "feature_keys" in subjects.columns else {}
    s = subjects.select([F.col(c).alias(c if c == "subject" else f"s_{c}") for c in subjects.columns])
    return s.withColumns(
        {
            "s_make_norm": fold(F.col("s_make")),
            "s_model_norm": fold(F.col("s_model")),
            "s_fuel_key": v.fuel_key(F.col("s_fuel")),
            "s_transmission_key": v.transmission_key(F.col("s_transmission")),
            "s_body_key": v.body_key(F.col("s_body")),
            **more,
        }
    )


def keyed_listings(listings: DataFrame) -> DataFrame:
    """Listings with the keys that matching needs, each made once; those of their features where they have any."""
    more = {"equipment": equipment.keys(F.col("feature_keys"))} if "feature_keys" in listings.columns else {}
    return listings.withColumns(
        {
            "make_norm": fold(F.col("make")),
            "model_norm": fold(F.col("model")),
            "title_norm": fold(F.col("title")),
            "fuel_key": v.fuel_key(F.col("fuel")),
            "transmission_key": v.transmission_key(F.col("transmission")),
            "body_key": F.coalesce(v.body_key(F.col("body")), v.body_key(F.col("title"))),
            **more,
        }
    )


def name_pairs(subjects: DataFrame, listings: DataFrame) -> DataFrame:
    """The names of makes and models of listings that hold those of subjects, each pair once."""
    pairs = listings.select("make_norm", "model_norm").distinct()
    names = subjects.where((F.col("s_make_norm") != "") & (F.col("s_model_norm") != "")).select("s_make_norm", "s_model_norm").distinct()
    hit = F.contains(F.col("make_norm"), F.col("s_make_norm")) & F.contains(F.col("model_norm"), F.col("s_model_norm"))
    return names.join(pairs, hit).select("s_make_norm", "s_model_norm", "make_norm", "model_norm")


def sent(rows: DataFrame, most: int = SENT_MOST) -> DataFrame:
    """Rows that joins send to every task if they are few; others are left to shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def month_seen() -> Column:
    """The month of last_seen by its number, which grows with the time; unknown times come before all others."""
    return F.coalesce(F.year("last_seen") * 12 + F.month("last_seen"), F.lit(-1_000_000))


def retrieve(subjects: DataFrame, listings: DataFrame, most: int = CANDIDATES, years: int = 6, windows: tuple[int, ...] = ()) -> DataFrame:
    """The newest listings whose make and model hold the subject's, within `years`; unknown years pass.

    The substring test runs on the distinct names of both sides, of which there are few; what it finds joins
    subjects and listings by equality. Ties of last_seen go by id. With `windows`, the newest of every status
    and window of years are taken apart; a listing then stands once for each `window` that it is in.

    Listings are counted by name, year and month first. The counts say from which month on a group's newest are, and
    only listings of such months are read in full; all others are outside of every group.
    """
    keyed = "title_norm" in listings.columns
    rows = listings if keyed else listings.withColumns({"make_norm": fold(F.col("make")), "model_norm": fold(F.col("model"))})
    group = ["subject", "status", "window"] if windows else ["subject"]
    apart = F.coalesce(F.abs(F.col("year") - F.col("s_year")), F.lit(0))

    def within(found: DataFrame) -> DataFrame:
        found = found.where(apart <= years)
        return found.withColumn("window", F.explode(F.filter(F.array(*(F.lit(w) for w in windows)), lambda w: apart <= w))) if windows else found

    names = ["make_norm", "model_norm"]
    counted = stored(rows.groupBy(*names, "year", *group[1:2], month_seen().alias("_month")).agg(F.count(F.lit(1)).alias("_n")), "months")
    s_names = ["s_make_norm", "s_model_norm"]
    pairs = name_pairs(subjects, counted)
    met = within(counted.join(pairs, names).join(subjects.select("subject", *s_names, "s_year"), s_names))
    months = met.groupBy(*group, "_month").agg(F.sum("_n").alias("_n"))
    newer = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy(F.desc("_month")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a month is needed if those after it hold fewer than `most`
    needed = stored(months.withColumn("_newer", newer).where(F.col("_newer") < most).select(*group, "_month"), "needed")
    read = [r["_month"] for r in needed.select("_month").distinct().limit(MONTHS_MOST + 1).collect()]
    rows = rows.where(month_seen().isin(read)) if len(read) <= MONTHS_MOST else rows
    first = needed.groupBy(*group).agg(F.min("_month").alias("_first"))
    wanted = subjects.join(pairs, s_names).join(first.select("subject", *(F.col(c).alias(f"_{c}") for c in group[1:]), "_first"), "subject")
    wanted = wanted.withColumnsRenamed({c: f"_{c}" for c in names})
    same = [F.col(c) == F.col(f"_{c}") for c in names] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group[1:2]]
    found = rows.join(sent(wanted), same).where((apart <= years) & (month_seen() >= F.col("_first")))
    if windows:
        found = found.where(apart <= F.col("_window")).withColumnRenamed("_window", "window")
    found = found.drop(*(f"_{c}" for c in [*names, "status"]), "_first")
    newest = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("last_seen"), "id"))
    found = found.withColumn("recency", newest).where(F.col("recency") <= most)
    return found if keyed else keyed_listings(found)


def reject_reason(drive: bool = False) -> Column:
    """The first hard rule that a candidate breaks, null if it passes; unknown attributes pass. The `drive` is looked at where both sides have one."""
    def differ(kind: str) -> Column:
        return F.col(f"s_{kind}_key").isNotNull() & F.col(f"{kind}_key").isNotNull() & (F.col(f"s_{kind}_key") != F.col(f"{kind}_key"))

    make_ok = token_present(F.col("make_norm"), F.col("s_make_norm")) | token_present(F.col("title_norm"), F.col("s_make_norm"))
    titled = F.coalesce(F.col("title_norm"), F.lit("")) != ""
    return F.coalesce(
        F.when((F.coalesce("s_make_norm", F.lit("")) == "") | (F.coalesce("s_model_norm", F.lit("")) == ""), "subject_incomplete"),
        F.when(~make_ok, "make"),
        F.when(titled & ~token_present(F.col("title_norm"), F.col("s_model_norm")), "model_title"),
        F.when(~titled & ~token_present(F.col("model_norm"), F.col("s_model_norm")), "model"),
        F.when(differ("fuel"), "fuel"),
        F.when(~v.transmissions_agree(F.col("s_transmission_key"), F.col("transmission_key")), "transmission"),
        *([F.when(differ("drive"), "drive")] if drive else []),
        F.when(differ("body"), "body"),
        F.when(F.abs(F.col("year") - F.col("s_year")) > YEAR_MOST, "year_hard"),
    )


def near(delta: Column, zero_at: int, points: int) -> Column:
    return F.lit(float(points)) * (1 - F.least(F.abs(delta), F.lit(zero_at)) / F.lit(float(zero_at)))


def score(full: bool = False) -> Column:
    """Similarity from 0 to 100 of a candidate that passed the hard rules.

    The `full` score also weighs displacement, drive, words of the title and equipment, whose columns it needs:
    displacement_cc, drive_key, equipment, and with s_ before them displacement_cc, drive, motorization, generation, trim, equipment.
    """
    def graded(want: str, have: str, zero_at: int, points: int) -> Column:
        asked = F.col(want).isNotNull() & (F.col(want) > 0)
        return F.when(~asked, 0.0).when(F.col(have).isNull(), float(-UNKNOWN_PENALTY)).otherwise(near(F.col(have) - F.col(want), zero_at, points))

    def confirmed(kind: str, points: int) -> Column:
        asked = F.coalesce(F.col(f"s_{kind}"), F.lit("")) != ""
        return F.when(~asked, 0).when(F.col(f"{kind}_key").isNull(), -UNKNOWN_PENALTY).otherwise(points)

    gearbox = F.when(F.coalesce("s_transmission", F.lit("")) == "", 0).when(F.col("transmission_key").isNull(), -UNKNOWN_PENALTY)
    gearbox = gearbox.when(F.col("s_transmission_key") == F.col("transmission_key"), 4).when(F.col("s_transmission_key").isNotNull(), 2).otherwise(0)
    total = F.lit(42.0) + graded("s_year", "year", YEAR_ZERO, 18) + graded("s_mileage_km", "mileage_km", KM_ZERO, 14) + graded("s_power_kw", "power_kw", KW_ZERO, 8)
    total = total + confirmed("fuel", 3) + gearbox + confirmed("body", 2)
    if full:
        cc = F.col("displacement_cc") - F.col("s_displacement_cc")
        total = total + F.when(~F.coalesce(F.col("s_displacement_cc") > 0, F.lit(False)), 0.0).when(cc.isNull(), -2.0).otherwise(near(cc, CC_ZERO, 6))
        total = total + F.when(F.coalesce("s_drive", F.lit("")) == "", 0).when(F.col("drive_key").isNull(), -UNKNOWN_PENALTY).otherwise(2)
        hits = title_hits(F.col("title_norm"), [F.col(f"s_{c}") for c in ("motorization", "generation", "trim")])
        total = total + F.least(F.lit(TITLE_MOST), hits * TITLE_HIT)
        wanted = F.col("s_equipment")
        overlap = F.size(F.filter(wanted, lambda k: (k == "") | F.array_contains("equipment", k)))
        bare = F.size("equipment") <= 0
        total = total + F.when(F.size(wanted) == 0, 0).otherwise(F.least(F.lit(FEATURE_MOST), overlap * FEATURE_HIT) - F.when(bare, UNKNOWN_PENALTY).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), half_up(total))).cast("int")


def ranked(subjects: DataFrame, listings: DataFrame, least: int = LEAST_SCORE, windows: tuple[int, ...] = ()) -> DataFrame:
    """Matches of every subject, and `window` if these are asked for, best score first, then cheaper, then newer."""
    found = retrieve(keyed_subjects(subjects), listings, windows=windows)
    found = found.where(F.col("source").isin(DOMESTIC)).where(reject_reason().isNull()).withColumn("match_score", score()).where(F.col("match_score") >= least)
    rank = F.row_number().over(W.partitionBy("subject", *(["window"] if windows else [])).orderBy(F.desc("match_score"), "price_czk", "recency"))
    return found.withColumn("rank", rank)
