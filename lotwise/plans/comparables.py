"""Queries over histories, full matches and feature values, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import fold
from ..operators import comparables, matching, pricing
from ..sources import views
from .market import NOW, L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: Price points of listings: an asking price at first sight for most, the last one for some.
POINTS = """points AS (
  SELECT id, first_seen AS observed_at, 1 AS seq, price_czk + 1000 * (power_kw % 4) AS price FROM listings WHERE power_kw % 5 <> 0
  UNION ALL SELECT id, last_seen, 2, price_czk FROM listings WHERE power_kw % 2 = 0)"""


def price_points(listings):
    asked = listings.where("power_kw % 5 <> 0").selectExpr("id", "first_seen AS observed_at", "1 AS seq", "price_czk + 1000 * (power_kw % 4) AS price")
    return asked.union(listings.where("power_kw % 2 = 0").selectExpr("id", "last_seen", "2", "price_czk"))


@query(f"""{L}, {POINTS}, h AS (SELECT id, string_agg(CAST(price AS VARCHAR), ',' ORDER BY observed_at, seq) AS history, count(*) AS n FROM points GROUP BY id)
SELECT listings.id, history, CAST(coalesce(n, 0) AS INT) AS points FROM listings LEFT JOIN h ON h.id = listings.id""")
def listing_prices(spark, sf_dir):
    """Listings with their ordered prices; null where there are none."""
    listings = views.listings(spark, sf_dir)
    known = comparables.histories(price_points(listings))
    out = listings.select("id").join(known, "id", "left")
    return out.select("id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"), F.greatest(F.coalesce(F.size("history"), F.lit(0)), F.lit(0)).alias("points"))


DAYS = "CASE WHEN last_seen >= coalesce(published_at, first_seen) THEN CAST(floor(epoch(last_seen - coalesce(published_at, first_seen)) / 86400) AS BIGINT) END"


@query(f"""{L}, {POINTS}, d AS (SELECT *, {DAYS} AS days FROM listings),
 med AS (SELECT make, model, floor(quantile_cont(days, 0.5) + 0.5) AS md FROM d WHERE status = 'active' GROUP BY make, model),
 pick AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY make, model ORDER BY price_czk, id) AS n FROM d WHERE status = 'removed' AND (days IS NULL OR days >= 3)) x WHERE n <= 80),
 lagged AS (SELECT id, price, observed_at, seq, lag(price) OVER (PARTITION BY id ORDER BY observed_at, seq) AS before FROM points WHERE id IN (SELECT id FROM pick)),
 h AS (SELECT id, count(*) AS n, bool_or(coalesce(price < before, false)) AS fell, arg_max(price, (observed_at, seq)) AS last_price, arg_min(price, (observed_at, seq)) AS first_price FROM lagged GROUP BY id),
 j AS (SELECT d.id, coalesce(n, 0) AS n, days, md, coalesce(last_price, price_czk) AS last_ask,
   CASE WHEN n > 1 THEN fell OR last_price < first_price WHEN n = 1 THEN price_czk < first_price ELSE false END AS fell
   FROM d LEFT JOIN h ON h.id = d.id LEFT JOIN med ON med.make = d.make AND med.model = d.model WHERE d.status = 'removed'),
 k AS (SELECT *, CASE WHEN days < 3 AND NOT fell THEN 'withdrawn' WHEN NOT fell AND NOT coalesce(days >= 14 OR days >= md, false) THEN 'ignore' ELSE 'likely_sold' END AS kind FROM j)
SELECT id, CAST(n AS INT) AS points, CAST(kind = 'likely_sold' AND fell AS INT) AS dropped, kind,
 CASE WHEN kind = 'likely_sold' THEN CAST(floor(CASE WHEN fell THEN last_ask ELSE last_ask * 0.95 END + 0.5) AS BIGINT) END AS proxy FROM k""")
def sold_proxy_kind(spark, sf_dir):
    """What became of every removed listing, with the histories of the first 80 eligible of a make and model."""
    listings = views.listings(spark, sf_dir)
    return comparables.inferred_sales(listings, price_points(listings), NOW, ["make", "model"], ["price_czk", "id"])


N = "CAST(substr(p_brand, 7) AS INT)"
#: A subject for every make and model, with all that a full match looks at.
FULL_SUBJECTS = f"""SELECT DISTINCT p_brand AS make, p_type AS model, 1996 + {N} % 5 AS year, CASE WHEN {N} % 4 = 0 THEN NULL ELSE 60000 + 10000 * ({N} % 9) END AS mileage_km,
  60 + {N} AS power_kw, CASE WHEN {N} % 3 = 0 THEN NULL ELSE 1000 + 100 * {N} END AS displacement_cc, CASE {N} % 3 WHEN 0 THEN 'Nafta' WHEN 1 THEN 'Benzín' END AS fuel,
  CASE {N} % 4 WHEN 0 THEN 'Automatická' WHEN 1 THEN 'Manuální' END AS transmission, CASE {N} % 5 WHEN 0 THEN 'Kombi' WHEN 1 THEN 'SUV' END AS body,
  CASE {N} % 4 WHEN 1 THEN '4x4' WHEN 2 THEN 'Přední' END AS drive, CASE {N} % 2 WHEN 0 THEN 'Red' ELSE '2.0 ring' END AS motorization,
  CASE {N} % 3 WHEN 1 THEN 'small' ELSE '12' END AS generation, CASE WHEN {N} % 5 = 0 THEN 'hot-gear' END AS trim, CASE WHEN {N} % 4 = 3 THEN '' ELSE 'widget small' END AS wanted
  FROM part"""


def full_pairs(spark, sf_dir):
    """Every listing beside the subject of its make and model."""
    subjects = views.over_tables(spark, sf_dir, FULL_SUBJECTS.replace("FROM part", "FROM {part}"), "part")
    subjects = subjects.withColumn("feature_keys", F.filter(F.split("wanted", " "), lambda x: x != "")).withColumn("subject", F.concat_ws("|", "make", "model"))
    listings = views.listings(spark, sf_dir).withColumn("displacement_cc", F.expr("CASE WHEN power_kw % 4 <> 0 THEN power_kw * 20 END"))
    listings = listings.withColumn("feature_keys", F.when(F.col("power_kw") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("features", " ")))
    listings = matching.keyed_listings(listings).withColumn("drive_key", v.drive_key(F.col("drive")))
    subjects = matching.keyed_subjects(subjects).withColumn("s_drive_key", v.drive_key(F.col("s_drive")))
    # one row for each of the few pairs of make and model: small enough to send to every task, checked by its count
    subjects = F.broadcast(subjects) if subjects.count() <= 100_000 else subjects
    return listings.join(subjects, (F.col("make") == F.col("s_make")) & (F.col("model") == F.col("s_model")))


PAIRS = f"""{L}, subjects AS ({FULL_SUBJECTS}), p AS (
  SELECT l.*, s.year AS sy, s.mileage_km AS skm, s.power_kw AS skw, s.displacement_cc AS scc, s.fuel AS sf, s.transmission AS st, s.body AS sb, s.drive AS sd, s.motorization, s.generation, s.trim, s.wanted,
    CASE WHEN l.power_kw % 4 <> 0 THEN l.power_kw * 20 END AS cc, lower(l.title) AS t, CASE l.fuel WHEN 'Nafta' THEN 'nafta' WHEN 'Benzín' THEN 'benzin' END AS fk,
    CASE l.transmission WHEN 'Manuální' THEN 'manual' WHEN 'DSG / dvojspojka' THEN 'dsg' END AS tk, CASE l.drive WHEN '4x4' THEN 'awd' WHEN 'Přední' THEN 'fwd' END AS dk, lower(l.body) AS bk
  FROM listings l JOIN subjects s ON l.make = s.make AND l.model = s.model)"""


REASON = """CASE WHEN sf = 'Nafta' AND fk <> 'nafta' OR sf = 'Benzín' AND fk <> 'benzin' THEN 'fuel' WHEN st = 'Automatická' AND tk = 'manual' OR st = 'Manuální' AND tk = 'dsg' THEN 'transmission'
  WHEN sd = '4x4' AND dk = 'fwd' OR sd = 'Přední' AND dk = 'awd' THEN 'drive' WHEN lower(sb) <> bk THEN 'body' WHEN abs(year - sy) > 8 THEN 'year_hard' END"""


@query(f"{PAIRS} SELECT id, {REASON} AS reason FROM p")
def hard_match_drive(spark, sf_dir):
    """The first hard rule that a listing breaks against its subject, drive included."""
    return full_pairs(spark, sf_dir).select("id", matching.reject_reason(drive=True).alias("reason"))


def near_sql(have: str, want: str, zero: int, points: int) -> str:
    return f"{points}.0 * (1 - least(abs({have} - {want}), {zero}) / {zero}.0)"


SCORE = f"""42.0 + CASE WHEN year IS NULL THEN -4 ELSE {near_sql('year', 'sy', 4, 18)} END
  + CASE WHEN skm IS NULL THEN 0 WHEN mileage_km IS NULL THEN -4 ELSE {near_sql('mileage_km', 'skm', 120000, 14)} END + {near_sql('power_kw', 'skw', 35, 8)}
  + CASE WHEN scc IS NULL THEN 0 WHEN cc IS NULL THEN -2 ELSE {near_sql('cc', 'scc', 400, 6)} END
  + CASE WHEN sf IS NULL THEN 0 WHEN fk IS NULL THEN -4 ELSE 3 END
  + CASE WHEN st IS NULL THEN 0 WHEN tk IS NULL THEN -4 WHEN st = 'Manuální' AND tk = 'manual' THEN 4 ELSE 2 END
  + CASE WHEN sd IS NULL THEN 0 WHEN dk IS NULL THEN -4 ELSE 2 END + CASE WHEN sb IS NULL THEN 0 WHEN bk IS NULL THEN -4 ELSE 2 END
  + least(15, 5 * (CASE WHEN motorization = 'Red' THEN CAST(t LIKE '%red%' AS INT) ELSE CAST(t LIKE '%2.0%' AND t LIKE '%ring%' AS INT) END
    + CASE WHEN generation = 'small' THEN CAST(t LIKE '%small%' AS INT) ELSE 0 END + CASE WHEN trim = 'hot-gear' THEN CAST(t LIKE '%hot%' AND t LIKE '%gear%' AS INT) ELSE 0 END))
  + CASE WHEN wanted = '' THEN 0 WHEN power_kw % 5 = 0 THEN -4 ELSE least(16, 4 * (CAST(list_contains(string_split(features, ' '), 'widget') AS INT) + CAST(list_contains(string_split(features, ' '), 'small') AS INT))) END"""


@query(f"{PAIRS}, s AS (SELECT id, {SCORE} AS score FROM p) SELECT id, CAST(greatest(0, least(100, floor(score + 0.5))) AS INT) AS match_score FROM s")
def soft_score_full(spark, sf_dir):
    """The full score of every listing against its subject, whatever the hard rules say."""
    return full_pairs(spark, sf_dir).select("id", matching.score(full=True).alias("match_score"))


WANTED = ["red", "ring", "hot", "widget"]
VALUES = f"""{L}, subjects AS ({FULL_SUBJECTS}), c AS (SELECT concat(l.make, '|', l.model) AS subject, l.price_czk, l.features, abs(l.year - s.year) <= 3 AND (l.mileage_km IS NULL OR s.mileage_km IS NULL OR abs(l.mileage_km - s.mileage_km) <= 80000) AS near
    FROM listings l JOIN subjects s ON l.make = s.make AND l.model = s.model),
  z AS (SELECT subject, count(*) AS n, count(*) FILTER (near) AS k FROM c GROUP BY subject),
  pool AS (SELECT c.* FROM c JOIN z ON z.subject = c.subject WHERE n >= 6 AND (near OR k < 8)),
  f AS (SELECT subject, feature, count(*) AS n, count(*) FILTER (has) AS sample, floor(quantile_cont(price_czk, 0.5) FILTER (has) + 0.5) AS med, floor(quantile_cont(price_czk, 0.5) FILTER (NOT has) + 0.5) AS without
    FROM (SELECT *, list_contains(string_split(features, ' '), feature) AS has FROM pool, (VALUES {", ".join(f"('{w}')" for w in WANTED)}) w(feature)) x GROUP BY subject, feature),
  g AS (SELECT *, CASE WHEN sample >= 3 AND n - sample >= 3 THEN med - without END AS delta FROM f),
  v AS (SELECT subject, feature, sample, CASE WHEN sample / n < 0.08 THEN 'rare' WHEN sample / n < 0.25 THEN 'uncommon' ELSE 'common' END AS rarity,
    CAST(delta - greatest(5000, floor(abs(delta) * 0.35 + 0.5)) AS BIGINT) AS low, CAST(delta + greatest(5000, floor(abs(delta) * 0.35 + 0.5)) AS BIGINT) AS high,
    CAST(sample < 5 OR n - sample < 5 OR delta IS NULL AS INT) AS unsure FROM g)"""


def values_of(spark, sf_dir):
    comps = full_pairs(spark, sf_dir).select("subject", "s_year", "s_mileage_km", "year", "mileage_km", "price_czk", F.split("features", " ").alias("features"))
    wanted = comps.select("subject").distinct().select("subject", F.explode(F.array(*(F.lit(w) for w in WANTED))).alias("feature"))
    return comparables.feature_values(comps, wanted)


@query(f"{VALUES} SELECT * FROM v")
def feature_values(spark, sf_dir):
    """What each of some features adds to the price of a make and model."""
    return values_of(spark, sf_dir)


@query(f"{VALUES} SELECT subject, CAST(least(120000, greatest(-120000, coalesce(sum(CASE WHEN rarity = 'rare' AND unsure = 0 AND (low + high) / 2 > 0 THEN floor((low + high) / 2 + 0.5) END), 0))) AS BIGINT) AS adjustment FROM v GROUP BY subject")
def rare_feature_sum(spark, sf_dir):
    """What the rare features of a make and model add, within the cap."""
    return comparables.rare_features(values_of(spark, sf_dir))


@query(f"""{L} SELECT source, id AS listing_id, make, model, year, mileage_km, price_czk, seller_type, fuel, transmission, body, drive, power_kw, title, string_split(features, ' ')[1] AS first_feature,
  coalesce(published_at, last_seen) AS published_at, first_seen AS first_seen_at, last_seen AS last_seen_at, CASE WHEN status = 'removed' THEN 'removed' ELSE 'active' END AS listing_status, 'db' AS origin, price_includes_vat FROM listings""")
def mapped_comps(spark, sf_dir):
    """Listings under the names that comparables have."""
    rows = views.listings(spark, sf_dir)
    kept = ["source", "make", "model", "year", "mileage_km", "price_czk", "seller_type", "fuel", "transmission", "body", "drive", "power_kw", "title", "price_includes_vat"]
    return rows.select(
        *kept, F.col("id").alias("listing_id"), F.try_element_at(F.split("features", " "), F.lit(1)).alias("first_feature"), F.coalesce("published_at", "last_seen").alias("published_at"),
        F.col("first_seen").alias("first_seen_at"), F.col("last_seen").alias("last_seen_at"), F.when(F.col("status") == "removed", "removed").otherwise("active").alias("listing_status"), F.lit("db").alias("origin"),
    )


@query(f"""{L}, d AS (SELECT make, id, price_czk, CAST(coalesce(floor(epoch(TIMESTAMP '{NOW}' - last_seen) / 86400) > 14, true) AS INT) AS stale FROM listings WHERE source = 'bazos')
SELECT * FROM (SELECT make, id, stale, row_number() OVER (PARTITION BY make ORDER BY stale, price_czk, id) AS place FROM d) x WHERE place <= 50""")
def fresh_before_stale(spark, sf_dir):
    """The 50 first offers of every make on one portal: those seen in the last two weeks before the others, each kind by price."""
    rows = views.listings(spark, sf_dir).where("source = 'bazos'")
    days = F.floor((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("last_seen")) / 86400)
    rows = rows.select("make", "id", "price_czk", F.coalesce(days > 14, F.lit(True)).cast("int").alias("stale"))
    place = F.row_number().over(W.partitionBy("make").orderBy("stale", "price_czk", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= 50).select("make", "id", "stale", "place")


@query(f"""{L}, r AS (SELECT make, source, id, row_number() OVER (PARTITION BY make, source ORDER BY last_seen DESC, id) AS n FROM listings WHERE source IN ('sauto', 'bazos'))
SELECT make, source, id, place FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY CASE source WHEN 'sauto' THEN 0 ELSE 1 END, n) AS place FROM r WHERE n <= 15) x WHERE place <= 30""")
def live_cap(spark, sf_dir):
    """At most 30 offers of a make, an equal share of each of the sources, at least five."""
    sources, most = ["sauto", "bazos"], 30
    share = max(5, most // len(sources))
    rows = views.listings(spark, sf_dir).where(F.col("source").isin(sources))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("make", "source").orderBy(F.desc("last_seen"), "id"))).where(F.col("n") <= share)
    order = F.array_position(F.array(*(F.lit(s) for s in sources)), F.col("source"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("make").orderBy(order, "n"))).where(F.col("place") <= most).select("make", "source", "id", "place")


@query(f"{L} SELECT make, model, year, count(*) AS n, CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 15 OR max(year) - min(year) >= 4 THEN 'medium' ELSE 'high' END AS level FROM listings GROUP BY make, model, year")
def sample_confidence(spark, sf_dir):
    """The level of confidence that the number of offers of a model year gives."""
    out = views.listings(spark, sf_dir).groupBy("make", "model", "year").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("level", pricing.sample_level(F.col("n"), F.lit(0)))


@query(f"""{L} SELECT strftime(last_seen, '%Y-%m-%d') AS day, source, count(*) AS n, CAST(sum(CASE WHEN lower(title) LIKE '%red%' THEN 1 ELSE 0 END) AS BIGINT) AS red FROM listings GROUP BY ALL""")
def sightings_by_day(spark, sf_dir):
    """Offers last seen on each day of every source, and those whose folded title names a colour."""
    rows = views.listings(spark, sf_dir)
    return rows.groupBy(F.date_format("last_seen", "yyyy-MM-dd").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.contains(fold(F.col("title")), F.lit("red")).cast("int")).alias("red"))
