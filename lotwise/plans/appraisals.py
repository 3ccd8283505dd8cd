"""The whole appraisal of a subject for every make and model, with SQL that goes its own way over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import appraisal
from ..sources import views
from .comparables import FULL_SUBJECTS, PAIRS, POINTS, REASON, SCORE, price_points
from .market import NOW, sql_adjust, sql_fence, sql_pct

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Appraisals and comparables; a seventh of the listings is marked as damaged, and removed ones of low mileage count as recorded sales."""
    subjects = views.over_tables(spark, sf_dir, FULL_SUBJECTS.replace("FROM part", "FROM {part}"), "part")
    subjects = subjects.withColumn("feature_keys", F.filter(F.split("wanted", " "), lambda x: x != "")).withColumn("subject", F.concat_ws("|", "make", "model")).drop("wanted")
    listings = views.listings(spark, sf_dir)
    keys = F.when(F.col("power_kw") % 5 == 0, F.array().cast("array<string>")).when(F.col("power_kw") % 7 == 0, F.split(F.concat("features", F.lit(" unfall")), " ")).otherwise(F.split("features", " "))
    listings = listings.withColumn("feature_keys", keys).withColumn("displacement_cc", F.expr("CASE WHEN power_kw % 4 <> 0 THEN power_kw * 20 END"))
    sales = listings.where("status = 'removed' AND mileage_km < 30000")
    return appraisal.appraise(subjects, listings, price_points(listings), sales, NOW, views.AS_OF_YEAR)


#: Listings whose names hold those of the subject.
HELD = "contains(l.make, s.make) AND contains(l.model, s.model)"
NAMED = PAIRS.replace("l.make = s.make AND l.model = s.model", HELD).replace("s.year AS sy", "concat(s.make, '|', s.model) AS subject, s.year AS sy")
RANKED = f"""{NAMED}, {POINTS}, c AS (SELECT p.*, k.win, row_number() OVER (PARTITION BY subject, status, k.win ORDER BY last_seen DESC, id) AS recency
   FROM p JOIN (VALUES (2), (6)) k(win) ON abs(year - sy) <= k.win),
 sc AS (SELECT *, CAST(greatest(0, least(100, floor({SCORE} + 0.5))) AS INT) AS match_score FROM c WHERE recency <= 400 AND source IN ('sauto', 'bazos', 'tipcars', 'autobazar_eu') AND ({REASON}) IS NULL
   AND NOT (power_kw % 5 <> 0 AND power_kw % 7 = 0)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, status, win ORDER BY match_score DESC, price_czk, recency) AS rank, sy AS s_year, skm AS s_km,
   count(*) FILTER (WHERE status = 'active' AND win = 2) OVER (PARTITION BY subject) AS narrow FROM sc WHERE match_score >= 38),
 u AS (SELECT *, CASE WHEN skm > 0 THEN skm ELSE greatest(1, 2002 - sy + 1) * 15000 END AS km, CASE WHEN price_includes_vat = false THEN CAST(floor(price_czk * 1.21::DOUBLE + .5) AS BIGINT) ELSE price_czk END AS ask,
   CASE WHEN last_seen >= coalesce(published_at, first_seen) THEN CAST(floor((epoch(last_seen) - epoch(coalesce(published_at, first_seen))) / 86400) AS BIGINT) END AS days FROM ranked WHERE win = CASE WHEN narrow >= 8 THEN 2 ELSE 6 END),
 act AS (SELECT * FROM u WHERE status = 'active')"""

APPRAISED = RANKED + f""",
 band AS (SELECT subject, {sql_pct('ask', .25)} AS p25, {sql_pct('ask', .5)} AS typical, {sql_pct('ask', .75)} AS p75, count(*) AS asks FROM {sql_fence('act', 'ask')} GROUP BY subject),
 lv AS (SELECT *, CAST(floor((ask + {sql_adjust('ask')}) * (1.0::DOUBLE - CASE WHEN days IS NULL THEN 0.08::DOUBLE WHEN days <= 14 THEN 0.05::DOUBLE WHEN days <= 45 THEN 0.08::DOUBLE ELSE 0.12::DOUBLE END) + .5) AS BIGINT) AS live FROM act),
 lv2 AS (SELECT * FROM lv WHERE live > 0),
 live AS (SELECT subject, {sql_pct('live', .5)} AS live_median FROM {sql_fence('lv2', 'live')} GROUP BY subject),
 dom AS (SELECT subject, {sql_pct('days', .5)} AS md FROM act GROUP BY subject),
 pick AS (SELECT subject, id FROM (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY rank) AS n FROM u WHERE status = 'removed' AND (days IS NULL OR days >= 3)) x WHERE n <= 80),
 lagged AS (SELECT id, price, observed_at, seq, lag(price) OVER (PARTITION BY id ORDER BY observed_at, seq) AS before FROM points),
 h AS (SELECT id, count(*) AS n, bool_or(coalesce(price < before, false)) AS fell, arg_max(price, (observed_at, seq)) AS last_price, arg_min(price, (observed_at, seq)) AS first_price FROM lagged GROUP BY id),
 g AS (SELECT u.*, md, coalesce(CASE WHEN h.n > 1 THEN h.fell WHEN h.n = 1 THEN u.price_czk < first_price END, false) AS dropped,
   CASE WHEN last_price IS NULL THEN ask WHEN price_includes_vat = false THEN CAST(floor(last_price * 1.21::DOUBLE + .5) AS BIGINT) ELSE last_price END AS last_ask
   FROM u LEFT JOIN dom USING (subject) LEFT JOIN pick ON pick.subject = u.subject AND pick.id = u.id LEFT JOIN h ON h.id = pick.id WHERE status = 'removed'),
 px AS (SELECT *, CAST(floor(CASE WHEN dropped THEN last_ask ELSE last_ask * 0.95::DOUBLE END + .5) AS BIGINT) AS proxy FROM g WHERE dropped OR (days >= 3 AND (days >= 14 OR coalesce(days >= md, false)))),
 sold AS (SELECT subject, {sql_pct('q', .5)} AS sold_median, count(*) AS sold_count FROM (SELECT subject, proxy + {sql_adjust('proxy')} AS q FROM px) x GROUP BY subject),
 near AS (SELECT *, CASE WHEN power_kw % 5 = 0 THEN [] ELSE string_split(features, ' ') END AS keys, abs(year - sy) <= 3 AND (mileage_km IS NULL OR skm IS NULL OR abs(mileage_km - skm) <= 80000) AS near FROM act),
 z AS (SELECT subject, count(*) AS n, count(*) FILTER (near) AS k FROM near GROUP BY subject),
 f AS (SELECT subject, feature, count(*) AS n, count(*) FILTER (has) AS sample, floor(quantile_cont(price_czk, 0.5) FILTER (has) + 0.5) AS med, floor(quantile_cont(price_czk, 0.5) FILTER (NOT has) + 0.5) AS without
   FROM (SELECT near.subject, feature, price_czk, list_contains(keys, feature) AS has FROM near JOIN z ON z.subject = near.subject, (VALUES ('widget'), ('small')) w(feature) WHERE wanted <> '' AND n >= 6 AND (near OR k < 8)) x GROUP BY subject, feature),
 fd AS (SELECT *, CASE WHEN sample >= 3 AND n - sample >= 3 THEN med - without END AS delta FROM f),
 fx AS (SELECT subject, feature, sample, CASE WHEN sample / n < 0.08 THEN 'rare' WHEN sample / n < 0.25 THEN 'uncommon' ELSE 'common' END AS rarity, CAST(delta - greatest(5000, floor(abs(delta) * 0.35 + 0.5)) AS BIGINT) AS low,
   CAST(delta + greatest(5000, floor(abs(delta) * 0.35 + 0.5)) AS BIGINT) AS high, CAST(sample < 5 OR n - sample < 5 OR delta IS NULL AS INT) AS unsure FROM fd),
 fs AS (SELECT subject, string_agg(concat_ws(':', feature, sample, rarity, coalesce(CAST(low AS VARCHAR), '-'), coalesce(CAST(high AS VARCHAR), '-'), unsure), ',' ORDER BY feature) AS features, count(*) AS nf, sum(unsure) AS wf,
   least(120000, coalesce(sum(CASE WHEN rarity = 'rare' AND unsure = 0 AND (low + high) / 2 > 0 THEN floor((low + high) / 2 + 0.5) END), 0)) AS adj FROM fx GROUP BY subject),
 split AS (SELECT subject, count(*) FILTER (seller_type = 'private') AS pn, count(*) FILTER (seller_type = 'dealer') AS dn, quantile_cont(price_czk, 0.5) FILTER (seller_type = 'private') AS pm, quantile_cont(price_czk, 0.5) FILTER (seller_type = 'dealer') AS dm FROM act GROUP BY subject),
 s AS (SELECT *, concat(make, '|', model) AS subject FROM subjects), yw AS (SELECT subject, max(win) AS yw FROM u GROUP BY subject),
 cs AS (SELECT s.subject, count(*) AS n, {sql_pct('l.price_czk', .5)} AS med FROM s LEFT JOIN yw ON yw.subject = s.subject JOIN listings l ON {HELD} AND abs(l.year - s.year) <= coalesce(yw, 6) WHERE status = 'removed' AND l.mileage_km < 30000 GROUP BY s.subject),
 j AS (SELECT s.subject, s.year AS sy, s.mileage_km AS skm, coalesce(yw, 6) AS year_window, p25, typical, p75, asks, live_median + coalesce(adj, 0) AS lm, sold_median, coalesce(sold_count, 0) AS sc, coalesce(cs.n, 0) AS cn, med, nf, wf, features, pn, dn, pm, dm,
   CASE WHEN coalesce(sold_count, 0) >= 8 THEN 0.7::DOUBLE WHEN coalesce(sold_count, 0) >= 3 THEN 0.5::DOUBLE ELSE 0.0 END AS wt
   FROM s LEFT JOIN yw USING (subject) LEFT JOIN band USING (subject) LEFT JOIN live USING (subject) LEFT JOIN sold USING (subject) LEFT JOIN fs USING (subject) LEFT JOIN split USING (subject) LEFT JOIN cs USING (subject)),
 mx AS (SELECT *, least(CASE WHEN wt = 0 OR sold_median IS NULL THEN lm::DOUBLE WHEN lm IS NULL THEN sold_median::DOUBLE ELSE sold_median * wt + lm * (1 - wt) END, typical::DOUBLE) AS mixed, CASE WHEN skm > 0 THEN skm ELSE greatest(1, 2002 - sy + 1) * 15000 END AS km FROM j),
 pv AS (SELECT *, CAST(floor((CASE WHEN sc < 8 THEN greatest(mixed, p25 * 0.7::DOUBLE) ELSE mixed END) / 1000 + .5) * 1000 AS BIGINT) AS proxy, CAST(floor(med / 1000 + .5) * 1000 AS BIGINT) AS rec FROM mx),
 fv AS (SELECT *, CASE WHEN asks IS NULL THEN NULL WHEN cn >= 5 THEN rec WHEN cn > 0 THEN CAST(floor((proxy * (1 - cn / 5.0::DOUBLE) + rec * (cn / 5.0::DOUBLE)) / 1000 + .5) * 1000 AS BIGINT) ELSE proxy END AS fair,
   CAST(floor(p25 / 1000 + .5) * 1000 AS BIGINT) AS lo, CAST(floor(typical / 1000 + .5) * 1000 AS BIGINT) AS ty, CAST(floor(p75 / 1000 + .5) * 1000 AS BIGINT) AS hi, CASE WHEN skm > 0 THEN 0 ELSE 1 END AS weak FROM pv),
 pt AS (SELECT *, CASE WHEN asks >= 25 THEN 3 WHEN asks >= 15 THEN 2 WHEN asks >= 8 THEN 1 WHEN asks >= 5 THEN 0 ELSE -2 END + CASE WHEN year_window = 2 THEN 1 ELSE -1 END
   + CASE WHEN (hi - lo) / ty::DOUBLE < 0.18 THEN 1 WHEN (hi - lo) / ty::DOUBLE > 0.55 THEN -2 WHEN (hi - lo) / ty::DOUBLE > 0.4 THEN -1 ELSE 0 END
   + CASE WHEN coalesce(nf, 0) = 0 THEN 0 WHEN wf / nf > 0.6 THEN -1 WHEN wf / nf < 0.25 AND nf >= 2 THEN 1 ELSE 0 END - weak AS pts FROM fv)
SELECT subject, coalesce(asks, 0) AS sample_size, lo AS price_low, ty AS price_typical, hi AS price_high, fair AS fair_value, CASE WHEN asks IS NOT NULL AND cn >= 5 THEN 'closed_sales' ELSE 'ask_proxy' END AS provenance,
 CASE WHEN asks IS NULL THEN 0 ELSE cn END AS closed_sales, CASE WHEN asks IS NULL THEN 0 ELSE sc END AS sold_count, CASE WHEN proxy > 0 THEN (typical - proxy) / proxy::DOUBLE END AS ask_gap, CAST(year_window AS INT) AS year_window,
 CASE WHEN asks IS NULL THEN 'low' WHEN pts >= 3 AND weak = 0 AND sc >= 3 THEN 'high' WHEN pts >= 1 OR (weak > 0 AND pts >= 0) THEN 'medium' ELSE 'low' END AS confidence,
 CAST(floor(floor(pm + .5) / 1000 + .5) * 1000 AS BIGINT) AS private_median, CAST(floor(floor(dm + .5) / 1000 + .5) * 1000 AS BIGINT) AS dealer_median, coalesce(pn, 0) AS private_count, coalesce(dn, 0) AS dealer_count,
 coalesce(features, '') AS features,
 CASE WHEN asks IS NULL THEN '{appraisal.NO_COMPARABLES}' ELSE concat_ws('|', CASE WHEN cn >= 5 THEN '{appraisal.VERIFIED[0]}' || replace(format('{{:,}}', cn), ',', chr(160)) || '{appraisal.VERIFIED[1]}' END, CASE WHEN year_window = 6 THEN '{appraisal.WIDENED}' END,
   CASE WHEN weak = 1 THEN '{appraisal.ASSUMED[0]}' || replace(format('{{:,}}', km), ',', chr(160)) || '{appraisal.ASSUMED[1]}' END) END AS warnings,
 fair AS list_at, CAST(floor((fair * (1 - 8.0::DOUBLE / 100) - 0) / 1000 + .5) * 1000 AS BIGINT) AS buy_in, fair - CAST(floor((fair * (1 - 8.0::DOUBLE / 100) - 0) / 1000 + .5) * 1000 AS BIGINT) AS commission FROM pt"""


@query(APPRAISED)
def appraisal_full(spark, sf_dir):
    """The appraisal of every make and model: full match, histories, features, recorded sales, confidence, sellers and warnings."""
    rows, _ = made(spark, sf_dir)
    told = lambda f: F.concat_ws(":", f["feature"], f["sample"], f["rarity"], F.coalesce(f["low"].cast("string"), F.lit("-")), F.coalesce(f["high"].cast("string"), F.lit("-")), f["unsure"])
    features = F.coalesce(F.array_join(F.transform("features", told), ","), F.lit(""))
    return rows.withColumn("features", features).withColumn("warnings", F.array_join("warnings", "|"))


@query(f"{RANKED} SELECT subject, CAST(rank AS INT) AS rank, id, match_score, price_czk FROM act WHERE rank <= 200")
def appraisal_comparables(spark, sf_dir):
    """The comparables shown with each appraisal."""
    return made(spark, sf_dir)[1]
