"""Queries over captured records of portals and what a report shows of them, each with SQL that DuckDB runs.

Captures are written from the listings in a portal's shape and read back, so the SQL states what must come out of every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, features
from ..sources import portals, views
from .feeds import dealt, with_phrases
from .market import L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


SAUTO_PRICE = "CAST(floor(price_czk / 100) AS BIGINT)"


@query(f"""{L}, r AS (SELECT *, {SAUTO_PRICE} AS p, power_kw % 5 = 0 AS net, CASE power_kw % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ded FROM listings WHERE source = 'sauto' AND power_kw % 7 <> 0 AND {SAUTO_PRICE} BETWEEN 5000 AND 50000000)
SELECT id AS external_id, 'https://www.sauto.cz/osobni/detail/' || replace(make, '#', '%23') || '/model/' || id AS url, make, model, year, mileage_km, fuel, transmission, drive, body, power_kw,
  CASE WHEN seller_type = 'dealer' THEN 'dealer' ELSE 'unknown' END AS seller_type, CASE WHEN power_kw % 2 = 0 THEN 'Praha' ELSE 'Brno-město' END AS region,
  CASE WHEN net THEN CAST(round_even(p * 1.21, 0) AS BIGINT) ELSE p END AS price_czk, CASE WHEN net THEN p END AS price_without_vat, CAST(CASE WHEN net THEN coalesce(ded, true) ELSE ded END AS INT) AS vat_deductible,
  CAST(CASE WHEN net THEN false WHEN ded THEN true END AS INT) AS price_includes_vat, CASE WHEN power_kw % 4 = 0 THEN 'https://img.cz/a.jpg' WHEN power_kw % 4 = 1 THEN 'https://img.cz/b.jpg' END AS image_url,
  concat(make, ' ', model) AS title, CASE WHEN power_kw % 2 = 0 THEN 'heated_seats,zzz' ELSE 'tow_hitch' END AS feature_keys, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS published_at FROM r""")
def sauto_rows(spark, sf_dir):
    """One portal's captured rows as listings."""
    rows = views.listings(spark, sf_dir).where("source = 'sauto'")
    named = lambda c, seo=None: F.struct(F.col(c).alias("name"), (F.col(c) if seo is None else F.lit(seo)).alias("seo_name"))
    kw = F.col("power_kw")
    record = F.struct(
        "id", F.expr(SAUTO_PRICE).alias("price"), (kw % 5 == 0).alias("price_is_without_vat"), F.when(kw % 3 == 0, True).when(kw % 3 == 1, False).alias("price_is_vat_deductible"),
        (kw % 7 == 0).alias("operating_lease"), named("make").alias("manufacturer_cb"), named("model", "model").alias("model_cb"),
        F.when(kw % 2 == 0, F.struct(F.lit("Praha").alias("region"), F.lit("x").alias("district"))).otherwise(F.struct(F.lit(None).cast("string").alias("region"), F.lit("Brno-město").alias("district"))).alias("locality"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("manufacturing_date"), F.concat(F.col("mileage_km").cast("string"), F.lit(" km")).alias("tachometer"), named("fuel").alias("fuel_cb"),
        named("transmission").alias("gearbox_cb"), named("drive").alias("drive_cb"), named("body").alias("vehicle_body_cb"), kw.cast("string").alias("engine_power"), F.when(F.col("seller_type") == "dealer", "salon").alias("premise"),
        F.when(kw % 4 == 0, "//img.cz/a.jpg").alias("image"), F.when(kw % 4 == 1, F.array(F.struct(F.lit("https://img.cz/b.jpg").alias("url")))).alias("images"),
        F.when(kw % 2 == 0, F.array(F.struct(F.lit("Vyhřívaná sedadla").alias("name")), F.struct(F.lit("Zzz").alias("name")))).otherwise(F.array(F.struct(F.lit("tažné").alias("name")))).alias("equipment_cb"),
        F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("create_date"),
    )
    out = portals.sauto(rows.select(F.to_json(record).alias("json")))
    out = out.withColumn("feature_keys", F.array_join("feature_keys", ",")).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    flags = ["vat_deductible", "price_includes_vat"]
    return out.withColumns({c: F.col(c).cast("int") for c in flags}).drop("source", "trim", "displacement_cc")


@query(f"""{L}, r AS (SELECT *, 200 + price_czk % 30000 AS eur FROM listings WHERE source = 'mobile_de')
SELECT id AS external_id, make, model, year, CASE WHEN mileage_km BETWEEN 1 AND 1999999 THEN mileage_km END AS mileage_km, CASE fuel WHEN 'Nafta' THEN 'Nafta' WHEN 'Benzín' THEN 'Benzín' END AS fuel,
 CASE transmission WHEN 'Manuální' THEN 'Manuální' WHEN 'DSG / dvojspojka' THEN 'DSG / dvojspojka' END AS transmission, CASE drive WHEN '4x4' THEN '4x4' WHEN 'Přední' THEN 'Přední' END AS drive,
 CASE WHEN power_kw BETWEEN 15 AND 800 THEN power_kw END AS power_kw, coalesce(seller_type, 'unknown') AS seller_type, CASE WHEN power_kw % 2 = 0 THEN 'München' END AS region,
 CAST(floor((eur * 25.2 + 50) / 100) * 100 AS BIGINT) AS price_czk, CAST(eur AS DOUBLE) AS price_foreign, CASE WHEN power_kw % 4 = 0 THEN 'heated_seats' ELSE '' END AS feature_keys
FROM r WHERE eur BETWEEN 500 AND 500000 AND power_kw % 13 <> 0 AND power_kw % 11 <> 0""")
def mobile_records(spark, sf_dir):
    """A German portal's captured records as listings; damaged ones, by flag or title, are left out."""
    kw = F.col("power_kw")
    rows = views.listings(spark, sf_dir).where("source = 'mobile_de'")
    record = F.struct(
        "id", F.concat(F.lit("https://m.de/"), F.col("id")).alias("url"), F.when(kw % 11 == 0, F.concat("title", F.lit(" Unfallwagen"))).otherwise(F.col("title")).alias("title"), "make", "model",
        F.struct((200 + F.col("price_czk") % 30_000).cast("string").alias("gross")).alias("price"), F.concat(F.lit("03/"), F.col("year").cast("string")).alias("firstRegistration"),
        F.concat(F.col("mileage_km").cast("string"), F.lit(" km")).alias("mileage"), F.when(F.col("fuel") == "Nafta", "Diesel").when(F.col("fuel") == "Benzín", "Super E10").alias("fuel"),
        F.when(F.col("transmission") == "Manuální", "Schaltgetriebe").when(F.col("transmission").isNotNull(), "Doppelkupplung DSG").alias("transmission"),
        F.when(F.col("drive") == "4x4", "Allradantrieb").when(F.col("drive") == "Přední", "Frontantrieb").alias("drive"), kw.cast("string").alias("power"),
        F.struct(F.when(F.col("seller_type") == "dealer", "Dealer").when(F.col("seller_type") == "private", "Privat").alias("type")).alias("contact"),
        F.struct(F.when(kw % 2 == 0, "München").alias("city")).alias("attr"), F.when(kw % 4 == 0, F.array(F.lit("Sitzheizung"), F.lit("Junk"))).alias("features"), F.when(kw % 13 == 0, "true").otherwise("false").alias("accidentDamaged"),
    )
    out = portals.mobile(rows.select(F.to_json(record).alias("json")), 25.2)
    return out.withColumn("feature_keys", F.array_join("feature_keys", ",")).drop("source", "url", "title", "body")


OFFERS = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CZK' WHEN 1 THEN 'EUR' END AS hint, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(300 + p_partkey % 40000 AS DOUBLE) + 0.5 END AS final,
  CASE p_partkey % 4 WHEN 0 THEN 1 ELSE 0 END AS unit, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((300 + p_partkey % 40000) * 25 AS DOUBLE) END AS price FROM part"""


@query(f"""WITH o AS ({OFFERS}), q AS (SELECT *, unit = 1 AND price BETWEEN 5000 AND 50000000 AND (final IS NULL OR price >= final * 3) AND coalesce(hint, '') <> 'EUR' AS mirror,
  CASE WHEN price BETWEEN 5000 AND 50000000 THEN price WHEN final BETWEEN 5000 AND 50000000 THEN final END AS crowns FROM o)
SELECT p_partkey, CASE WHEN mirror THEN price WHEN hint = 'CZK' THEN crowns WHEN final BETWEEN 500 AND 500000 THEN final WHEN price BETWEEN 500 AND 500000 THEN price WHEN price BETWEEN 5000 AND 50000000 THEN price END AS amount,
 CASE WHEN mirror THEN 'CZK' WHEN hint = 'CZK' THEN CASE WHEN crowns IS NOT NULL THEN 'CZK' END WHEN final BETWEEN 500 AND 500000 THEN 'EUR' WHEN price BETWEEN 500 AND 500000 THEN coalesce(hint, 'EUR') WHEN price BETWEEN 5000 AND 50000000 THEN 'CZK' END AS currency FROM q""")
def offer_prices(spark, sf_dir):
    """Amount and currency of offers that state euros, crowns or both."""
    k = F.col("p_partkey")
    money = (300 + k % 40_000)
    record = F.struct(
        F.when(k % 5 == 0, "CZK").when(k % 5 == 1, "EUR").alias("currency"), F.when(k % 3 != 0, F.concat(money.cast("string"), F.lit(".5"))).alias("finalPrice"),
        F.when(k % 4 == 0, "1").otherwise("0").alias("unitPrice"), F.when(k % 7 != 0, (money * 25).cast("string")).alias("price"),
    )
    rows = views.table(spark, sf_dir, "part").select("p_partkey", F.from_json(F.to_json(record), portals.AUTOBAZAR).alias("r"))
    return rows.select("p_partkey", portals.offer_price(F.col("r")).alias("o")).select("p_partkey", "o.*")


SCOUT = [
    ("45.000 km", 45000, None, None), ("5,4 l/100 km", None, None, None), ("110 kW (150 PS)", 110150, 110, None), ("1.199 cm³", 11993 // 10, None, 1199), ("1968 cm³", 1968, None, 1968), ("9 kW", 9, None, None), ("", None, None, None), (None, None, None, None),
]


@query(dealt(SCOUT, ["km", "kw", "cc"]))
def scout_values(spark, sf_dir):
    """Mileage, power and displacement as a portal writes them, each looked for in every text."""
    raw = F.col("phrase")
    return with_phrases(spark, sf_dir, SCOUT).select("p_partkey", portals.scout_mileage(F.regexp_replace(raw, "[³²]", "")).alias("km"), portals.scout_power(raw).alias("kw"), portals.scout_displacement(raw).alias("cc"))


NAMED = [
    ("Adaptivní tempomat", "cruise_control", 1), ("vyhřívaná zadní sedadla", "heated_seats", 1), ("Anhängerkupplung", "tow_hitch", 1), ("Panorama-Dach", "panorama", 1), ("zadní stěrač", "zadni_sterac", 0), ("  ", None, 0), (None, None, 0), ("S-Line paket", "s_line", 1), ("Head-Up Display", "hud", 1),
]


@query(dealt(NAMED, ["key", "known"]))
def feature_names(spark, sf_dir):
    """Names of features as keys, and whether the vocabulary has them."""
    raw = F.col("phrase")
    return with_phrases(spark, sf_dir, NAMED).select("p_partkey", features.feature_key(raw).alias("key"), F.coalesce(features.known_feature(raw).isNotNull(), F.lit(False)).cast("int").alias("known"))


HINTED = [("Panorama, tažné, Webasto", "panorama,tow_hitch,aux_heater"), ("quattro s kamerou, kamera 360", "parking_camera,awd"), ("nic zvláštního", ""), (None, ""), ("kůže KUZE, el. kufr", "leather_seats,el_kufr"), ("mrtvý úhel a lane assist", "blind_spot,lane_assist")]


@query(dealt(HINTED, ["keys"]))
def text_features(spark, sf_dir):
    return with_phrases(spark, sf_dir, HINTED).select("p_partkey", F.coalesce(F.array_join(features.features_of_text(F.col("phrase")), ","), F.lit("")).alias("keys"))


@query(f"""{L} SELECT id, replace(format('{{:,}}', price_czk), ',', chr(160)) || ' Kč' AS price, CASE source WHEN 'sauto' THEN 'Sauto' WHEN 'bazos' THEN 'Bazoš' WHEN 'tipcars' THEN 'TipCars' WHEN 'autobazar_eu' THEN 'Autobazar.eu' WHEN 'autoscout24' THEN 'AutoScout24' ELSE 'Mobile.de' END AS portal,
 CASE seller_type WHEN 'private' THEN 'Soukromý' WHEN 'dealer' THEN 'Dealer' END AS seller, strftime(last_seen AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Prague', '%-d. %-m. %Y') AS seen,
 CASE WHEN power_kw % 30 < 10 THEN 'Rychle' WHEN power_kw % 30 < 20 THEN 'Běžně' END AS zone,
 CASE WHEN power_kw % 3 <> 0 OR power_kw % 30 = 0 THEN 'Inzeráty žádají zhruba totéž co reálná hodnota.' ELSE 'Inzeráty žádají o ' || (power_kw % 30) || ' % ' || CASE WHEN power_kw % 2 = 0 THEN 'víc' ELSE 'míň' END || ' než reálná hodnota.' END AS gap FROM listings""")
def displayed(spark, sf_dir):
    """What a report shows of every listing."""
    kw = F.col("power_kw")
    share = (kw % 30) / 100
    days = F.when(kw % 30 < 10, F.lit(3)).when(kw % 30 < 20, F.lit(60))
    return views.listings(spark, sf_dir).select(
        "id", display.crowns(F.col("price_czk")).alias("price"), display.source_label(F.col("source")).alias("portal"), display.seller_label(F.col("seller_type")).alias("seller"),
        display.czech_date(F.col("last_seen")).alias("seen"), display.turnover(days).alias("zone"), display.ask_gap(F.when(kw % 2 == 0, share).otherwise(-share)).alias("gap"),
    )


ADDRESSES = [("http://bob:secret@h:80", "http://bob:***@h:80"), ("bob:secret@h", "***@h"), ("http://h:80", "http://h:80"), (None, None)]


@query(f"SELECT e.p_partkey, hidden, 'https://x.cz/app/snapshot.bin?v=' || e.p_partkey || '%3A1' AS snapshot FROM ({dealt(ADDRESSES, ['hidden'])}) e")
def hidden_addresses(spark, sf_dir):
    snapshot = display.snapshot_address(F.lit("https://x.cz/app"), F.concat(F.col("p_partkey").cast("string"), F.lit(":1")))
    return with_phrases(spark, sf_dir, ADDRESSES).select("p_partkey", display.without_password(F.col("phrase")).alias("hidden"), snapshot.alias("snapshot"))
