"""Queries over listings and observations, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as m
from ..functions import vocabulary as v
from ..functions.text import fold, slug
from ..operators import matching, pricing, rollup, state
from ..sources import views

NOW = f"{views.AS_OF} 00:00:00"
L = f"WITH listings AS ({views.LISTINGS_SQL})"


def sql_slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def sql_pct(c: str, p: float) -> str:
    return f"CAST(floor(quantile_cont({c}, {p}) + 0.5) AS BIGINT)"


def sql_even(c: str, p: float) -> str:
    return f"CAST(round_even(quantile_cont({c}, {p}), 0) AS BIGINT)"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


DIMS = {d: f"{sql_slug(f'coalesce(nullif(trim({d}), {chr(39)*2}), {chr(39)}neuvedeno{chr(39)})')}" for d in rollup.DIMENSIONS}
GROUPING = ", ".join("(c, mk, md, year" + "".join(f", {d[0]}" for i, d in enumerate(rollup.DIMENSIONS) if mask >> i & 1) + ")" for mask in range(8))
ROLLUP = f"""{L}, k AS (
  SELECT {sql_slug('category')} AS c, {sql_slug('make')} AS mk, {sql_slug('model')} AS md, year, {DIMS['fuel']} AS f, {DIMS['transmission']} AS t, {DIMS['body']} AS b, price_czk
  FROM listings WHERE status = 'active' AND year IS NOT NULL AND price_czk BETWEEN 5000 AND 50000000 AND trim(make) <> '' AND trim(model) <> '' AND {{extra}})
SELECT c AS category_key, mk AS make_key, md AS model_key, year, CAST((1 - grouping(f)) + 2 * (1 - grouping(t)) + 4 * (1 - grouping(b)) AS INT) AS dimension_mask,
  coalesce(f, '') AS fuel_key, coalesce(t, '') AS transmission_key, coalesce(b, '') AS body_key,
  {sql_even('price_czk', .25)} AS p25_czk, {sql_even('price_czk', .5)} AS median_czk, {sql_even('price_czk', .75)} AS p75_czk, count(*) AS active_count
FROM k GROUP BY GROUPING SETS ({GROUPING})"""


@query(ROLLUP.format(extra="true"))
def market_rollup(spark, sf_dir):
    return rollup.roll_up(rollup.market_rows(views.listings(spark, sf_dir)))


@query(ROLLUP.format(extra="last_seen >= TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 7 DAY"))
def market_rollup_fresh(spark, sf_dir):
    return rollup.roll_up(rollup.market_rows(views.listings(spark, sf_dir), F.lit("2000-06-01 00:00:00").cast("timestamp"), 7))


@query(f"""{L}, q AS (SELECT make, price_czk, count(*) OVER g AS n, floor(quantile_cont(price_czk, .25) OVER g + .5) AS q1, floor(quantile_cont(price_czk, .75) OVER g + .5) AS q3
  FROM listings WINDOW g AS (PARTITION BY make))
SELECT make, count(*) AS kept, {sql_pct('price_czk', .25)} AS p25, {sql_pct('price_czk', .5)} AS median, {sql_pct('price_czk', .75)} AS p75
FROM q WHERE n < 4 OR price_czk BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY make""")
def iqr_band(spark, sf_dir):
    rows = pricing.inside_fences_of_groups(views.listings(spark, sf_dir).select("make", "price_czk"), ["make"], "price_czk")
    price = F.col("price_czk")
    return rows.groupBy("make").agg(F.count(F.lit(1)).alias("kept"), pricing.percentile(price, 0.25).alias("p25"), pricing.percentile(price, 0.5).alias("median"), pricing.percentile(price, 0.75).alias("p75"))


@query(f"""{L} SELECT make, count(*) FILTER (WHERE seller_type = 'private') AS n_private, count(*) FILTER (WHERE seller_type = 'dealer') AS n_dealer,
  CAST(floor(floor(quantile_cont(price_czk, .5) FILTER (WHERE seller_type = 'private') + .5) / 1000 + .5) * 1000 AS BIGINT) AS median_private,
  CAST(floor(floor(quantile_cont(price_czk, .5) FILTER (WHERE seller_type = 'dealer') + .5) / 1000 + .5) * 1000 AS BIGINT) AS median_dealer
  FROM listings GROUP BY make""")
def seller_split(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    out = []
    for kind in ("private", "dealer"):
        price = F.when(F.col("seller_type") == kind, F.col("price_czk"))
        out += [F.count(price).alias(f"n_{kind}"), m.to_thousand(pricing.percentile(price, 0.5)).alias(f"median_{kind}")]
    return rows.groupBy("make").agg(*out)


@query(f"""{L}, d AS (SELECT make, published_at IS NOT NULL AS known, CAST(floor((epoch(last_seen) - epoch(coalesce(published_at, first_seen))) / 86400) AS BIGINT) AS days
  FROM listings WHERE status = 'active' AND last_seen >= coalesce(published_at, first_seen)),
 c AS (SELECT *, count(*) FILTER (WHERE known) OVER (PARTITION BY make) AS n_known FROM d)
SELECT make, CAST(count(*) AS BIGINT) AS sample, CASE WHEN count(*) >= 3 THEN {sql_pct('days', .5)} END AS median_days, max(CAST(n_known >= 3 AS INT)) AS published_only
FROM c WHERE known OR n_known < 3 GROUP BY make""")
def liquidity(spark, sf_dir):
    rows = views.listings(spark, sf_dir).where("status = 'active'").withColumn("days", pricing.days_on_market(NOW)).where("days IS NOT NULL")
    known = F.col("published_at").isNotNull()
    rows = rows.join(rows.groupBy("make").agg(F.count(F.when(known, 1)).alias("n_known")), "make").where(known | (F.col("n_known") < 3))
    return rows.groupBy("make").agg(F.count(F.lit(1)).alias("sample"), F.when(F.count(F.lit(1)) >= 3, pricing.percentile(F.col("days"), 0.5)).alias("median_days"), F.max((F.col("n_known") >= 3).cast("int")).alias("published_only"))


OBS = """WITH obs AS (SELECT user_id AS listing, ts AS observed_at, event_id AS seq, CAST(floor(value / 50) * 50 AS BIGINT) AS price,
  CASE WHEN event_id % 3 = 0 THEN event_type END AS region, CASE WHEN event_id % 5 = 0 THEN concat(event_type, ',abs') ELSE '' END AS features,
  CASE WHEN event_id % 97 = 0 THEN 'gone' WHEN event_id % 53 = 0 THEN 'rejected' WHEN event_id % 31 = 0 THEN 'live' ELSE 'seen' END AS kind FROM events)"""
LOG = OBS + """, l AS (SELECT *, lag(price) OVER (PARTITION BY listing ORDER BY observed_at, seq) AS before FROM obs),
 log AS (SELECT listing, observed_at, seq, price FROM l WHERE before IS NULL OR before <> price)"""


@query(f"""{OBS} SELECT listing, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS sightings, max_by(price, row(observed_at, seq)) AS price,
  max_by(region, row(observed_at, seq)) FILTER (WHERE region IS NOT NULL) AS region, max_by(features, row(observed_at, seq)) FILTER (WHERE features <> '') AS features FROM obs GROUP BY listing""")
def state_fold(spark, sf_dir):
    return state.fold_state(views.observations(spark, sf_dir))


@query(f"{LOG} SELECT listing, observed_at, seq, price FROM log")
def change_log(spark, sf_dir):
    return state.price_log(views.observations(spark, sf_dir))


@query(f"""{LOG}, f AS (SELECT *, CAST(coalesce(price < lag(price) OVER (PARTITION BY listing ORDER BY observed_at, seq), false) AS INT) AS fell FROM log)
SELECT listing, greatest(max(fell), CAST(max_by(price, row(observed_at, seq)) < min_by(price, row(observed_at, seq)) AS INT)) AS dropped, count(*) AS points, max_by(price, row(observed_at, seq)) AS last_price FROM f GROUP BY listing""")
def downward_move(spark, sf_dir):
    return state.downward_moves(state.price_log(views.observations(spark, sf_dir)))


@query(f"""{OBS} SELECT listing, CASE WHEN max_by(kind, row(observed_at, seq)) IN ('gone', 'rejected') THEN 'removed' ELSE 'active' END AS status,
  max(observed_at) FILTER (WHERE kind IN ('seen', 'live')) AS last_seen FROM obs GROUP BY listing""")
def soft_delete_fold(spark, sf_dir):
    return state.status_of(views.observations(spark, sf_dir))


@query(f"""{L} SELECT id, make, model FROM listings WHERE source = 'bazos' AND status = 'active' AND last_seen < TIMESTAMP '2000-01-01 00:00:00' AND id NOT IN (SELECT id FROM listings WHERE price_czk % 3 = 0)""")
def missing_anti(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    return state.mark_missing(rows, rows.where("price_czk % 3 = 0"), "bazos", "2000-01-01 00:00:00").select("id", "make", "model")


@query(f"""{L} SELECT id, CASE WHEN price_czk % 5 = 0 THEN TIMESTAMP '2002-01-01 00:00:00' ELSE last_seen END AS last_seen, CASE WHEN price_czk % 5 = 0 THEN 'active' ELSE status END AS status FROM listings""")
def touch_semi(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    return state.touch(rows, rows.where("price_czk % 5 = 0"), NOW).select("id", "last_seen", "status")


@query(f"""{L}, a AS (SELECT make, max(price_czk) AS price, max(region) AS region FROM (SELECT make, price_czk, body AS region FROM listings WHERE source <> 'sauto') GROUP BY make),
 b AS (SELECT model AS make, max(price_czk) AS price, CAST(NULL AS VARCHAR) AS region FROM listings WHERE source = 'sauto' GROUP BY model UNION ALL SELECT 'Brand#11', 1, NULL)
SELECT coalesce(a.make, b.make) AS make, CASE WHEN b.make IS NOT NULL THEN b.price ELSE a.price END AS price, coalesce(b.region, a.region) AS region FROM a FULL JOIN b ON a.make = b.make""")
def upsert_merge(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    old = rows.where("source <> 'sauto'").groupBy("make").agg(F.max("price_czk").alias("price"), F.max("body").alias("region"))
    new = rows.where("source = 'sauto'").groupBy(F.col("model").alias("make")).agg(F.max("price_czk").alias("price")).withColumn("region", F.lit(None).cast("string"))
    new = new.union(spark.sql("SELECT 'Brand#11', 1L, CAST(NULL AS STRING)"))
    return state.merge_state(old, new, "make", ["price"], ["region"])


@query(f"""{L}, s AS (SELECT price_czk, price_includes_vat AS vat, year, mileage_km, CASE WHEN last_seen >= first_seen THEN CAST(floor((epoch(last_seen) - epoch(first_seen)) / 86400) AS BIGINT) END AS days, id FROM listings),
 a AS (SELECT *, CASE WHEN vat = false THEN CAST(floor(price_czk * 1.21::DOUBLE + .5) AS BIGINT) ELSE price_czk END AS ask, CASE WHEN mileage_km > 0 THEN mileage_km ELSE greatest(1, 2002 - year + 1) * 15000 END AS km,
   CASE WHEN days IS NULL THEN 0.08::DOUBLE WHEN days <= 14 THEN 0.05::DOUBLE WHEN days <= 45 THEN 0.08::DOUBLE ELSE 0.12::DOUBLE END AS cut FROM s),
 b AS (SELECT *, greatest(3000, floor(ask * 0.012::DOUBLE + .5)) AS per_km, greatest(8000, floor(ask * 0.03::DOUBLE + .5)) AS per_year, greatest(40000, floor(ask * 0.4::DOUBLE + .5)) AS cap FROM a)
SELECT id, ask, days, CAST(floor(ask * (1.0::DOUBLE - cut) + .5) AS BIGINT) AS after_cut, CAST(km AS BIGINT) AS km,
  CAST(floor(greatest(-cap, least(cap, CASE WHEN mileage_km IS NOT NULL THEN (mileage_km - 100000) / 10000.0::DOUBLE * per_km ELSE 0 END + (1999 - year) * per_year)) + .5) AS BIGINT) AS adjustment,
  CAST(floor(ask / 1000 + .5) * 1000 AS BIGINT) AS list_at, CAST(floor((ask * (1 - 8.0::DOUBLE / 100) - 0) / 1000 + .5) * 1000 AS BIGINT) AS buy_in FROM b""")
def money_scalars(spark, sf_dir):
    """VAT, haircut, assumed mileage, age adjustment and dealer advice for every listing."""
    rows = views.listings(spark, sf_dir).withColumn("ask", m.with_vat(F.col("price_czk"), F.col("price_includes_vat"))).withColumn("days", m.days_between(F.col("first_seen"), F.col("last_seen")))
    advice = m.dealer_advice(F.col("ask"))
    return rows.select(
        "id", "ask", "days", m.after_haircut(F.col("ask"), F.col("days")).alias("after_cut"), m.effective_km(F.col("mileage_km"), F.col("year"), 2002).cast("long").alias("km"),
        m.age_adjustment(F.lit(1999), F.lit(100000), F.col("year"), F.col("mileage_km"), F.col("ask")).alias("adjustment"), advice["list_at"].alias("list_at"), advice["buy_in"].alias("buy_in"),
    )


SUBJ = f", subjects AS ({views.SUBJECTS_SQL})"
RETRIEVE = (
    L + SUBJ
    + """, c AS (SELECT l.*, s.subject, s.year AS s_year, s.mileage_km AS s_km, s.fuel AS s_fuel, s.transmission AS s_tr, s.body AS s_body, s.power_kw AS s_kw,
   row_number() OVER (PARTITION BY s.subject ORDER BY l.last_seen DESC, l.id) AS recency
 FROM subjects s JOIN listings l ON contains(lower(l.make), lower(s.make)) AND contains(lower(l.model), lower(s.model)) AND l.year BETWEEN s.year - 6 AND s.year + 6),
 top AS (SELECT * FROM c WHERE recency <= 400)"""
)


@query(f"{RETRIEVE} SELECT subject, id, recency FROM top")
def retrieve_top400(spark, sf_dir):
    found = matching.retrieve(matching.keyed_subjects(views.subjects(spark, sf_dir)), views.listings(spark, sf_dir))
    return found.select("subject", "id", F.col("recency").cast("long").alias("recency"))


REASON = """CASE WHEN s_fuel IS NOT NULL AND fuel IS NOT NULL AND s_fuel <> fuel THEN 'fuel'
  WHEN s_tr IS NOT NULL AND transmission = 'Manuální' THEN 'transmission'
  WHEN s_body IS NOT NULL AND body IS NOT NULL AND s_body <> body THEN 'body'
  WHEN abs(year - s_year) > 8 THEN 'year_hard' END"""


@query(f"{RETRIEVE} SELECT subject, coalesce({REASON}, 'pass') AS reason, count(*) AS n FROM top GROUP BY ALL")
def hard_match_reason(spark, sf_dir):
    found = matching.retrieve(matching.keyed_subjects(views.subjects(spark, sf_dir)), views.listings(spark, sf_dir))
    return found.groupBy("subject", F.coalesce(matching.reject_reason(), F.lit("pass")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: The newest of every status and window of years apart.
WINDOWED = (
    L + SUBJ
    + """, c AS (SELECT l.*, s.subject, s.year AS s_year, s.mileage_km AS s_km, s.fuel AS s_fuel, s.transmission AS s_tr, s.body AS s_body, s.power_kw AS s_kw, k.win,
   row_number() OVER (PARTITION BY s.subject, l.status, k.win ORDER BY l.last_seen DESC, l.id) AS recency
 FROM subjects s JOIN listings l ON contains(lower(l.make), lower(s.make)) AND contains(lower(l.model), lower(s.model)) JOIN (VALUES (2), (6)) k(win) ON abs(l.year - s.year) <= k.win),
 top AS (SELECT * FROM c WHERE recency <= 400)"""
)
SCORED = f""", sc AS (SELECT *, CAST(least(100, greatest(0, floor(42.0::DOUBLE + 18.0::DOUBLE * (1 - least(abs(year - s_year), 4) / 4.0::DOUBLE)
   + CASE WHEN s_km IS NULL THEN 0.0 WHEN mileage_km IS NULL THEN -4.0 ELSE 14.0::DOUBLE * (1 - least(abs(mileage_km - s_km), 120000) / 120000.0::DOUBLE) END
   + 8.0::DOUBLE * (1 - least(abs(power_kw - s_kw), 35) / 35.0::DOUBLE)
   + CASE WHEN s_fuel IS NULL THEN 0 WHEN fuel IS NULL THEN -4 ELSE 3 END
   + CASE WHEN s_tr IS NULL THEN 0 WHEN transmission IS NULL THEN -4 ELSE 2 END
   + CASE WHEN s_body IS NULL THEN 0 WHEN body IS NULL THEN -4 ELSE 2 END + .5))) AS INT) AS match_score
  FROM top WHERE source IN ('sauto', 'bazos', 'tipcars', 'autobazar_eu') AND ({REASON}) IS NULL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY match_score DESC, price_czk, recency) AS rank FROM sc WHERE match_score >= 38)"""
RANKED = RETRIEVE + SCORED


@query(f"{RANKED} SELECT subject, id, match_score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 200")
def soft_score_rank(spark, sf_dir):
    return matching.ranked(views.subjects(spark, sf_dir), views.listings(spark, sf_dir)).where("rank <= 200").select("subject", "id", "match_score", "rank")


def sql_adjust(base: str) -> str:
    return f"""CAST(floor(greatest(-greatest(40000, floor({base} * 0.4::DOUBLE + .5)), least(greatest(40000, floor({base} * 0.4::DOUBLE + .5)),
      CASE WHEN mileage_km IS NOT NULL THEN (mileage_km - km) / 10000.0::DOUBLE * greatest(3000, floor({base} * 0.012::DOUBLE + .5)) ELSE 0 END + (s_year - year) * greatest(8000, floor({base} * 0.03::DOUBLE + .5)))) + .5) AS BIGINT)"""


def sql_fence(table: str, value: str) -> str:
    return f"""(SELECT * FROM (SELECT *, count({value}) OVER (PARTITION BY subject) AS n_, floor(quantile_cont({value}, .25) OVER (PARTITION BY subject) + .5) AS q1_, floor(quantile_cont({value}, .75) OVER (PARTITION BY subject) + .5) AS q3_ FROM {table})
      WHERE n_ < 4 OR {value} BETWEEN q1_ - 1.5 * (q3_ - q1_) AND q3_ + 1.5 * (q3_ - q1_))"""


FAIR = WINDOWED + SCORED + f""", w AS (SELECT *, CASE WHEN count(*) FILTER (WHERE status = 'active' AND win = 2) OVER (PARTITION BY subject) >= 8 THEN 2 ELSE 6 END AS year_window FROM ranked),
 u AS (SELECT *, CASE WHEN s_km > 0 THEN s_km ELSE greatest(1, 2002 - s_year + 1) * 15000 END AS km, CASE WHEN price_includes_vat = false THEN CAST(floor(price_czk * 1.21::DOUBLE + .5) AS BIGINT) ELSE price_czk END AS ask,
   CASE WHEN last_seen >= coalesce(published_at, first_seen) THEN CAST(floor((epoch(last_seen) - epoch(coalesce(published_at, first_seen))) / 86400) AS BIGINT) END AS days FROM w WHERE win = year_window),
 act AS (SELECT * FROM u WHERE status = 'active'),
 band AS (SELECT subject, {sql_pct('ask', .25)} AS p25, {sql_pct('ask', .5)} AS typical, {sql_pct('ask', .75)} AS p75, count(*) AS live_asks FROM {sql_fence('act', 'ask')} GROUP BY subject),
 lv AS (SELECT *, CAST(floor((ask + {sql_adjust('ask')}) * (1.0::DOUBLE - CASE WHEN days IS NULL THEN 0.08::DOUBLE WHEN days <= 14 THEN 0.05::DOUBLE WHEN days <= 45 THEN 0.08::DOUBLE ELSE 0.12::DOUBLE END) + .5) AS BIGINT) AS live FROM act),
 lv2 AS (SELECT * FROM lv WHERE live > 0),
 live AS (SELECT subject, {sql_pct('live', .5)} AS live_median FROM {sql_fence('lv2', 'live')} GROUP BY subject),
 dom AS (SELECT subject, {sql_pct('days', .5)} AS median_days FROM act GROUP BY subject),
 px AS (SELECT u.*, CAST(floor(ask * 0.95::DOUBLE + .5) AS BIGINT) AS proxy FROM u LEFT JOIN dom USING (subject) WHERE status = 'removed' AND days >= 3 AND (days >= 14 OR coalesce(days >= median_days, false))),
 sold AS (SELECT subject, {sql_pct('p', .5)} AS sold_median, count(*) AS sold_count FROM (SELECT subject, proxy + {sql_adjust('proxy')} AS p FROM px) GROUP BY subject),
 j AS (SELECT band.*, live_median, sold_median, coalesce(sold_count, 0) AS sold_count, CASE WHEN coalesce(sold_count, 0) >= 8 THEN 0.7::DOUBLE WHEN coalesce(sold_count, 0) >= 3 THEN 0.5::DOUBLE ELSE 0.0 END AS wt
   FROM band LEFT JOIN live USING (subject) LEFT JOIN sold USING (subject)),
 mx AS (SELECT *, least(CASE WHEN wt = 0 OR sold_median IS NULL THEN live_median::DOUBLE WHEN live_median IS NULL THEN sold_median::DOUBLE ELSE sold_median * wt + live_median * (1 - wt) END, typical::DOUBLE) AS mixed FROM j),
 fv AS (SELECT *, CAST(floor((CASE WHEN sold_count < 8 THEN greatest(mixed, p25 * 0.7::DOUBLE) ELSE mixed END) / 1000 + .5) * 1000 AS BIGINT) AS fair_value FROM mx)
SELECT fv.subject, live_asks, sold_count, fair_value, CAST(floor(p25 / 1000 + .5) * 1000 AS BIGINT) AS price_low, CAST(floor(typical / 1000 + .5) * 1000 AS BIGINT) AS price_typical, CAST(floor(p75 / 1000 + .5) * 1000 AS BIGINT) AS price_high,
  year_window, fair_value AS list_at, CAST(floor((fair_value * (1 - 8.0::DOUBLE / 100) - 0) / 1000 + .5) * 1000 AS BIGINT) AS buy_in, fair_value - CAST(floor((fair_value * (1 - 8.0::DOUBLE / 100) - 0) / 1000 + .5) * 1000 AS BIGINT) AS commission
FROM fv JOIN (SELECT subject, max(year_window) AS year_window FROM u GROUP BY subject) y USING (subject)"""


@query(FAIR)
def appraisal_batch(spark, sf_dir):
    return pricing.appraise(matching.ranked(views.subjects(spark, sf_dir), views.listings(spark, sf_dir), windows=pricing.WINDOWS), NOW, views.AS_OF_YEAR)


@query(f"""{L}, f AS (SELECT make, power_kw, price_czk, string_split(features, ' ') AS keys FROM listings), w AS (SELECT DISTINCT make, unnest(keys) AS feature FROM f),
 x AS (SELECT f.make, w.feature, price_czk, list_contains(keys, w.feature) AS has FROM f JOIN w ON f.make = w.make)
SELECT make, feature, count(*) AS pool, count(*) FILTER (WHERE has) AS n_with, {sql_pct('price_czk', .5)} FILTER (WHERE has) AS median_with,
 CASE WHEN count(*) FILTER (WHERE has) * 100 < 8 * count(*) THEN 'rare' WHEN count(*) FILTER (WHERE has) * 100 < 25 * count(*) THEN 'uncommon' ELSE 'common' END AS rarity FROM x GROUP BY make, feature""".replace(f"{sql_pct('price_czk', .5)} FILTER (WHERE has)", "CAST(floor(quantile_cont(price_czk, 0.5) FILTER (WHERE has) + 0.5) AS BIGINT)"))
def feature_premium(spark, sf_dir):
    """How common each feature is within a make, and the median price with it.

    Only rows that have a feature are exploded; the pool's size is joined, not multiplied.
    """
    rows = views.listings(spark, sf_dir).select("make", "price_czk", F.split("features", " ").alias("keys"))
    pool = rows.groupBy("make").agg(F.count(F.lit(1)).alias("pool"))
    has = rows.select("make", "price_czk", F.explode(F.array_distinct("keys")).alias("feature")).groupBy("make", "feature").agg(F.count(F.lit(1)).alias("n_with"), pricing.percentile(F.col("price_czk"), 0.5).alias("median_with"))
    share = F.col("n_with") * 100
    rarity = F.when(share < F.col("pool") * 8, "rare").when(share < F.col("pool") * 25, "uncommon").otherwise("common")
    return has.join(pool, "make").select("make", "feature", "pool", "n_with", "median_with", rarity.alias("rarity"))


@query(f"""{L}, v AS (SELECT DISTINCT {sql_slug('make')} AS make_key, {sql_slug('model')} AS model_key, coalesce(fuel, '') AS fuel, coalesce(body, '') AS body, power_kw, source FROM listings)
SELECT concat_ws('|', make_key, model_key, fuel, body, CAST(power_kw AS VARCHAR)) AS variant, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM v GROUP BY ALL""")
def catalog_variants(spark, sf_dir):
    """The vehicle catalog's variants with the sources that know them."""
    rows = views.listings(spark, sf_dir).select(slug(F.col("make")).alias("make_key"), slug(F.col("model")).alias("model_key"), F.coalesce("fuel", F.lit("")).alias("fuel"), F.coalesce("body", F.lit("")).alias("body"), "power_kw", "source").distinct()
    variant = F.concat_ws("|", "make_key", "model_key", "fuel", "body", F.col("power_kw").cast("string"))
    return rows.groupBy(variant.alias("variant")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


@query(f"{L} SELECT make, model FROM (SELECT DISTINCT make, model FROM listings WHERE trim(make) <> '' ORDER BY lower(make), lower(model), make, model LIMIT 400)")
def distinct_makes(spark, sf_dir):
    return views.listings(spark, sf_dir).where("trim(make) <> ''").select("make", "model").distinct().orderBy(F.lower("make"), F.lower("model"), "make", "model").limit(400)


@query(f"""{L}, u AS (SELECT concat(source, ':', make, ':', CAST(year AS VARCHAR)) AS k, id, price_czk, 0 AS part FROM listings WHERE source = 'sauto' UNION ALL SELECT concat('sauto:', make, ':', CAST(year AS VARCHAR)), id, price_czk, 1 FROM listings WHERE source = 'bazos')
SELECT k, id, price_czk FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, price_czk, id) AS n FROM u) WHERE n = 1""")
def union_dedup(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    key = F.concat(F.lit("sauto:"), "make", F.lit(":"), F.col("year").cast("string")).alias("k")
    parts = [rows.where(F.col("source") == s).select(key, "id", "price_czk", F.lit(i).alias("part")) for i, s in enumerate(("sauto", "bazos"))]
    return state.first_wins(parts[0].unionByName(parts[1]), ["k"], ["part", "price_czk", "id"]).select("k", "id", "price_czk")


@query(f"""{L} SELECT source, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) AS total, count(DISTINCT make) AS makes FROM listings GROUP BY source""")
def source_counts(spark, sf_dir):
    return views.listings(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "removed").alias("removed"), F.count(F.lit(1)).alias("total"), F.countDistinct("make").alias("makes"))


@query(f"""{L}, q AS (SELECT {sql_slug('make')} AS make_key, strftime(last_seen, '%Y-%m') AS month, price_czk FROM listings WHERE price_czk BETWEEN 5000 AND 50000000)
SELECT make_key, month, {sql_even('price_czk', .5)} AS median_czk, count(*) AS n FROM q GROUP BY ALL""")
def price_history(spark, sf_dir):
    """Extension: monthly medians per make (the reference only declares this contract)."""
    rows = views.listings(spark, sf_dir).where(F.col("price_czk").between(5_000, 50_000_000))
    return rows.groupBy(slug(F.col("make")).alias("make_key"), F.date_format("last_seen", "yyyy-MM").alias("month")).agg(m.half_even(F.percentile("price_czk", F.lit(0.5))).alias("median_czk"), F.count(F.lit(1)).alias("n"))


@query(f"""{L} SELECT source, id, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_seen ASC NULLS FIRST, id) AS n FROM listings WHERE status = 'active') WHERE n <= 25""")
def probe_oldest(spark, sf_dir):
    """The 25 active listings per source that were not seen for longest."""
    rows = views.listings(spark, sf_dir).where("status = 'active'").withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(F.asc_nulls_first("last_seen"), "id")))
    return rows.where("n <= 25").select("source", "id", "last_seen")


SALES = ", sales AS (SELECT make, year, count(*) AS n, CAST(floor(quantile_cont(price_czk, 0.5) + 0.5) AS BIGINT) AS median FROM listings WHERE status = 'removed' AND mileage_km < 30000 GROUP BY make, year), asks AS (SELECT make, year, CAST(floor(quantile_cont(price_czk, 0.5) + 0.5) AS BIGINT) AS proxy FROM listings WHERE status = 'active' GROUP BY make, year)"


@query(f"""{L}{SALES}, j AS (SELECT make, year, proxy, coalesce(n, 0) AS n, CAST(floor(median / 1000 + .5) * 1000 AS BIGINT) AS sold FROM asks LEFT JOIN sales USING (make, year))
SELECT make, year, n AS closed_sales, CASE WHEN n >= 5 THEN sold WHEN n > 0 THEN CAST(floor((proxy * (1 - n / 5.0::DOUBLE) + sold * (n / 5.0::DOUBLE)) / 1000 + .5) * 1000 AS BIGINT) ELSE proxy END AS fair_value FROM j""")
def closed_sales_blend(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    half = pricing.percentile(F.col("price_czk"), 0.5)
    sales = rows.where("status = 'removed' AND mileage_km < 30000").groupBy("make", "year").agg(F.count(F.lit(1)).alias("n"), half.alias("median"))
    asks = rows.where("status = 'active'").groupBy("make", "year").agg(half.alias("proxy"))
    out = asks.join(sales, ["make", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("make", "year", F.col("n").alias("closed_sales"), pricing.blend_sales(F.col("proxy"), F.col("n"), F.col("median")).alias("fair_value"))


@query(f"""{L} SELECT id, fold, fk, tk, bk FROM (SELECT id, lower(strip_accents(trim(title))) AS fold, CASE fuel WHEN 'Nafta' THEN 'nafta' WHEN 'Benzín' THEN 'benzin' END AS fk, CASE transmission WHEN 'Manuální' THEN 'manual' WHEN 'DSG / dvojspojka' THEN 'dsg' END AS tk,
  lower(body) AS bk FROM listings)""")
def vocabulary_keys(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    return rows.select("id", fold(F.col("title")).alias("fold"), v.fuel_key(F.col("fuel")).alias("fk"), v.transmission_key(F.col("transmission")).alias("tk"), v.body_key(F.col("body")).alias("bk"))


FIRM = RANKED + f""", r AS (SELECT *, CASE WHEN s_km > 0 THEN s_km ELSE greatest(1, 2002 - s_year + 1) * 15000 END AS km FROM ranked WHERE rank <= 200),
 market AS (SELECT subject, {sql_pct('price_czk', .25)} AS p25, {sql_pct('price_czk', .5)} AS market, {sql_pct('price_czk', .75)} AS p75 FROM {sql_fence('r', 'price_czk')} GROUP BY subject),
 mk AS (SELECT subject, CAST(floor(quantile_cont(mileage_km, .5) FILTER (WHERE mileage_km > 0) + .5) AS BIGINT) AS median_km, max(km) AS km FROM r GROUP BY subject),
 nm AS (SELECT r.*, price_czk + {sql_adjust('market')} AS normal FROM r JOIN market USING (subject)), pos AS (SELECT * FROM nm WHERE normal > 0), dl AS (SELECT * FROM nm WHERE seller_type = 'dealer'),
 core AS (SELECT subject, {sql_pct('normal', .35)} AS p35, {sql_pct('normal', .5)} AS p50 FROM {sql_fence('pos', 'normal')} GROUP BY subject),
 dealers AS (SELECT subject, count(*) AS dealers, {sql_pct('normal', .5)} AS dealer_median FROM {sql_fence('dl', 'normal')} GROUP BY subject),
 j AS (SELECT *, floor(p35 * 0.45::DOUBLE + p50 * 0.55::DOUBLE + .5) AS liquid FROM market JOIN mk USING (subject) LEFT JOIN core USING (subject) LEFT JOIN dealers USING (subject)),
 p AS (SELECT *, CASE WHEN dealers >= 5 THEN floor(liquid * 0.65::DOUBLE + dealer_median * 0.35::DOUBLE + .5) ELSE liquid END AS pulled, CASE WHEN coalesce(km > median_km * 1.35::DOUBLE, false) THEN p25 * 0.55::DOUBLE ELSE p25 * 0.97::DOUBLE END AS low FROM j)
SELECT subject, CAST(floor(CASE WHEN pulled IS NOT NULL THEN greatest(low, least(p75 * 1.03::DOUBLE, pulled)) END / 1000 + .5) * 1000 AS BIGINT) AS suggested, CAST(floor(p50 / 1000 + .5) * 1000 AS BIGINT) AS normalised,
  CAST(floor(p25 / 1000 + .5) * 1000 AS BIGINT) AS market_p25, CAST(floor(p75 / 1000 + .5) * 1000 AS BIGINT) AS market_p75 FROM p"""


@query(FIRM)
def firm_estimate(spark, sf_dir):
    ranked = matching.ranked(views.subjects(spark, sf_dir), views.listings(spark, sf_dir)).where("rank <= 200")
    return pricing.firm_estimate(ranked, views.AS_OF_YEAR)
