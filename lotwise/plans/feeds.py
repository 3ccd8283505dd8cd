"""Queries over texts and rows of feeds, each with SQL that DuckDB runs on the same tables.

Texts come from phrases dealt over the rows of `part`; the SQL states what each phrase must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog, extract, labels
from ..functions.text import slug
from ..operators import gates, ingest
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


def sql_value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def dealt(phrases: list[tuple], names: list[str]) -> str:
    """SQL: what phrase number p_partkey % n must give, for every part."""
    rows = ", ".join(f"({i}, {', '.join(map(sql_value, p[1:]))})" for i, p in enumerate(phrases))
    return f"SELECT p_partkey, {', '.join(names)} FROM part JOIN (VALUES {rows}) e(i, {', '.join(names)}) ON p_partkey % {len(phrases)} = i"


def with_phrases(spark, sf_dir, phrases: list[tuple]):
    parts = views.table(spark, sf_dir, "part")
    array = F.array(*(F.lit(p[0]) for p in phrases))
    return parts.withColumn("phrase", F.get(array, F.pmod("p_partkey", F.lit(len(phrases))).cast("int")))


DAMAGE = [
    ("Škoda Octavia havarovaná", 1), ("po  NEHODĚ, pojízdné", 1), ("poškozený nárazník", 1), ("auto po totálce", 1), ("po totalce", 1), ("totálka", 1), ("na náhradní díly", 1),
    ("demontováno", 1), ("nebouraný, servisovaný", 0), ("bouraný", 1), ("vrak", 1), ("vrakoviště nedaleko", 0), ("Unfall 2019", 1), ("unfallfrei", 0), ("Beschädigt vorne", 1),
    ("Bastler aufgepasst", 1), ("bastlerei", 0), ("Frontschaden links", 1), ("accident-damaged", 1), ("salvage title", 1), ("pěkné auto", 0), (None, 0), ("", 0), ("nehavarováno", 0),
]


@query(f"SELECT e.p_partkey, CAST(e.hit = 1 OR p_name LIKE '%salvage%' AS INT) AS damaged FROM ({dealt(DAMAGE, ['hit'])}) e JOIN part p ON p.p_partkey = e.p_partkey")
def accident_text(spark, sf_dir):
    """Signs of damage in texts: all words of it, none that deny it."""
    return with_phrases(spark, sf_dir, DAMAGE).select("p_partkey", (gates.accident_text(F.col("phrase")) | gates.accident_text(F.col("p_name"))).cast("int").alias("damaged"))


@query("""SELECT p_partkey, CAST(p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS INT) AS damaged, CAST(p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS INT) AS by_keys, CAST(p_partkey % 13 = 0 OR p_partkey % 17 = 0 AS INT) AS by_flags FROM part""")
def accident_listing(spark, sf_dir):
    """The combined gate over features, flags, tags and texts."""
    on = lambda n, yes, no: F.when(F.col("p_partkey") % n == 0, F.lit(yes)).otherwise(F.lit(no))
    rows = views.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.array(F.lit("abs"), on(7, "Accident Damaged", "esp"), on(11, "totalschaden hinten", "bsm")).alias("keys"),
        F.create_map(F.lit("accident_damaged"), on(13, "Ja", "ne"), F.lit("metallic"), F.lit("true")).alias("flags"), F.array(on(17, "is-currently-damaged", "new")).alias("tags"), on(19, "po nehodě", "po servisu").alias("note"),
    )
    keys, flags = gates.accident_keys(F.col("keys")), gates.accident_flags(F.col("flags"), F.col("tags"))
    every = gates.accident(F.col("p_name"), [F.col("note")], F.col("keys"), F.col("flags"), F.col("tags"))
    return rows.select("p_partkey", every.cast("int").alias("damaged"), keys.cast("int").alias("by_keys"), flags.cast("int").alias("by_flags"))


@query(f"""{L} SELECT id FROM listings WHERE NOT list_has_any(string_split(features, ' '), ['hot', 'accident_damaged']) AND (title IS NULL OR NOT regexp_matches(lower(title), 'economy'))""")
def excluded_listings(spark, sf_dir):
    """Listings without any of some features and without a word in the title: the shape of the exclusion of damaged stock."""
    rows = views.listings(spark, sf_dir)
    off = F.arrays_overlap(F.split("features", " "), F.array(F.lit("hot"), F.lit("accident_damaged")))
    return rows.where(~F.coalesce(off, F.lit(False)) & (F.col("title").isNull() | ~F.col("title").rlike("(?i)economy"))).select("id")


CATALOG = [
    ("Benzine", "Benzín", "Neuvedeno", "Neuvedeno"), ("stationwagen / combi", "Stationwagen / Combi", "Kombi", "Neuvedeno"), ("Elektriciteit", "Elektro", "Neuvedeno", "Neuvedeno"),
    ("golf 7-traps dsg automaat", "Golf 7-traps Dsg Automaat", "Neuvedeno", "DSG / dvojspojka"), ("ambulance", "Ambulance", "Neuvedeno", "Neuvedeno"), ("niet geregistreerd", "Niet Geregistreerd", "Neuvedeno", "Neuvedeno"),
    ("mpv met diesel", "Nafta", "MPV", "Neuvedeno"), ("E-CVT hybride", "Hybrid", "Neuvedeno", "CVT"), ("handgeschakeld coupé", "Handgeschakeld Coupé", "Coupe", "Manuální"), (None, "Neuvedeno", "Dodávka", "Neuvedeno"),
    ("Tiptronic SUV", "Tiptronic Suv", "SUV", "Automatická"), ("  open laadbak ", "Open Laadbak", "Pick-up", "Neuvedeno"),
]


@query(dealt(CATALOG, ["fuel", "body", "transmission"]))
def catalog_labels(spark, sf_dir):
    """A feed's names as fuels, bodies (of vans) and transmissions."""
    raw = F.col("phrase")
    return with_phrases(spark, sf_dir, CATALOG).select("p_partkey", labels.catalog_fuel(raw).alias("fuel"), labels.catalog_body(raw, F.lit("van")).alias("body"), labels.inferred_transmission(raw).alias("transmission"))


KINDS = [("Personenauto|sedan", "passenger"), ("Bedrijfsauto|bestel", "van"), ("Motorfiets|x", "motorcycle"), ("Bromfiets|", "motorcycle"), ("Personenauto|kampeerwagen", "caravan"), ("Middenasaanhangwagen|open", None), ("Aanhangwagen|caravan", "caravan"), ("Bus|x", "van"), ("Landbouw|x", None)]


@query(dealt(KINDS, ["category"]))
def register_categories(spark, sf_dir):
    return with_phrases(spark, sf_dir, KINDS).select("p_partkey", labels.catalog_category(F.substring_index("phrase", "|", 1), F.substring_index("phrase", "|", -1)).alias("category"))


MODELS = [
    ("VOLKSWAGEN GOLF 1.4 TSI COMFORTLINE", "Golf"), ("GOLF VARIANT 110kW", "Golf Variant"), ("Octavia Combi 2,0 TDI", "Octavia Combi"), ("308", "308"), ("TRANSPORTER KOMBI LANGE UITVOERING", "Transporter Kombi Lange"), ("touareg v6", "touareg"), ("  up! ", "up!"), (None, ""),
]


@query(dealt(MODELS, ["model"]))
def clean_models(spark, sf_dir):
    return with_phrases(spark, sf_dir, MODELS).select("p_partkey", labels.clean_model(F.col("phrase"), F.lit("Volkswagen")).alias("model"))


GERMAN = [
    ("Super E10", "Benzín", None, None, None), ("Erdgas", "CNG", None, None, None), ("Schaltgetriebe 6-Gang", None, "Manuální", None, None), ("Halbautomatik", None, "Automatická", None, None), ("Doppelkupplung (PDK)", None, "DSG / dvojspojka", None, None),
    ("Allradantrieb quattro", None, None, "4x4", None), ("Frontantrieb", None, None, "Přední", None), ("Geländewagen", None, None, None, "SUV"), ("Kleinwagen", None, None, None, "Hatchback"), ("Limousine", None, None, None, "Sedan"), ("", None, None, None, None),
    ("Wasserstoff", "Vodík", None, None, None),
]


@query(dealt([(p[0], None if p[1] is None else p[1], *p[2:]) for p in GERMAN], ["fuel", "transmission", "drive", "body"]))
def german_labels(spark, sf_dir):
    """A German portal's names; a fuel only where the name is one."""
    raw = F.col("phrase")
    fuel = F.when(labels.german(raw, labels.GERMAN_FUELS, False).isNotNull(), labels.german_fuel(raw))
    return with_phrases(spark, sf_dir, GERMAN).select("p_partkey", fuel.alias("fuel"), labels.german_transmission(raw).alias("transmission"), labels.german_drive(raw).alias("drive"), labels.german_body(raw).alias("body"))


CODES = [("Kč", "CZK"), ("EURO", "EUR"), ("€", "EUR"), (" zł ", "Z"), ("ZŁ", "PLN"), ("$", "USD"), ("chf.", "CHF"), (None, "CZK"), ("", "CZK"), ("eur", "EUR"), ("123", "CZK")]


@query(dealt(CODES, ["code"]))
def currency_codes(spark, sf_dir):
    return with_phrases(spark, sf_dir, CODES).select("p_partkey", labels.currency(F.col("phrase")).alias("code"))


SELLERS = [("AAA Auto a.s.", "dealer"), ("Jan Novák", "private"), ("", "unknown"), (None, "unknown"), ("Autobazar Brno", "dealer"), ("prodejce s.r.o", "dealer")]


@query(f"SELECT e.p_partkey, CASE WHEN p_size % 10 = 0 THEN 'dealer' ELSE seller END AS seller FROM ({dealt(SELLERS, ['seller'])}) e JOIN part p ON p.p_partkey = e.p_partkey")
def seller_types(spark, sf_dir):
    premise = F.when(F.col("p_size") % 10 == 0, "premise")
    return with_phrases(spark, sf_dir, SELLERS).select("p_partkey", labels.seller_type(premise, F.col("phrase")).alias("seller"))


ADS = [
    ("Octavia Combi 2.0 TDI 4x4 DSG", "Nafta", "Automatická", "Kombi", "4x4", 2000), ("Fabia 1,2 TSI, manuál, hatchback", "Benzín", "Manuální", "Hatchback", None, 1200), ("Tesla elektro, automat, liftback, AWD", "Elektro", "Automatická", "Hatchback", "4x4", None),
    ("Superb plug-in hybrid sedan", "Hybrid", None, "Sedan", None, None), ("motor 1968 ccm, nafta, pohon všech kol", "Nafta", None, None, "4x4", 1968), ("najeto 1.4 mil, LPG, kupé coupé", "LPG", None, "Coupe", None, None),
    ("obsah 12000 ccm", None, None, None, None, None), ("BMW xDrive crossover, převodovka manuální, benzín", "Benzín", "Manuální", "SUV", "4x4", None), ("CNG pick-up", "CNG", None, "Pick-up", None, None), (None, None, None, None, None, None),
]


@query(dealt(ADS, ["fuel", "transmission", "body", "drive", "cc"]))
def ad_attributes(spark, sf_dir):
    """Fuel, gearbox, body, drive and displacement that advertisements' texts state."""
    t = F.col("phrase")
    found = {"fuel": extract.FUELS, "transmission": extract.TRANSMISSIONS, "body": extract.BODIES, "drive": extract.DRIVES}
    return with_phrases(spark, sf_dir, ADS).select("p_partkey", *(extract.labelled(t, table).alias(n) for n, table in found.items()), extract.displacement(t).alias("cc"))


PLACES = [("719 00 Ostrava", "Ostrava"), ("Brno (Černovice)", "Brno"), ("tel 777123456", None), ("ul. Dlouhá 5", None), ("110 00", None), ("  Praha 4 ", "Praha 4"), (None, None), ("Plzeň +420 777 123 456", None)]


@query(dealt(PLACES, ["region"]))
def clean_regions(spark, sf_dir):
    return with_phrases(spark, sf_dir, PLACES).select("p_partkey", extract.region(F.col("phrase")).alias("region"))


TIMES = [("2024-05-01T10:00:00Z", "2024-05-01 10:00:00"), ("2024-05-01T10:00:00+02:00", "2024-05-01 08:00:00"), ("2024-05-01", "2024-05-01 00:00:00"), ("2024-05-01 10:30:00", "2024-05-01 10:30:00"), ("yesterday", None), ("", None), (None, None), ("2024-13-01", None)]


@query(dealt(TIMES, ["utc"]))
def parse_moments(spark, sf_dir):
    return with_phrases(spark, sf_dir, TIMES).select("p_partkey", F.date_format(extract.moment(F.col("phrase")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


COVERS = [("https://a.cz/x.jpg", 1), ("//a.cz/x.jpg", 1), ("https://a.cz/logo.SVG", 0), ("/x.jpg", 0), (None, 0), ("https://www.bazos.cz/obrazky/bazos.svg?1", 0), ("http://a.cz/kosik.svg", 0)]


@query(f"""SELECT e.p_partkey, usable, CASE WHEN usable = 0 THEN 'https://www.bazos.cz/img/1/' || right(CAST(1000000 + e.p_partkey AS VARCHAR), 3) || '/' || CAST(1000000 + e.p_partkey AS VARCHAR) || '.jpg' END AS guessed FROM ({dealt(COVERS, ['usable'])}) e""")
def cover_urls(spark, sf_dir):
    rows = with_phrases(spark, sf_dir, COVERS).withColumn("usable", extract.usable_cover(F.col("phrase")))
    guess = extract.guessed_cover((F.col("p_partkey") + 1_000_000).cast("string"))
    return rows.select("p_partkey", F.col("usable").cast("int").alias("usable"), F.when(~F.col("usable"), guess).alias("guessed"))


@query("""WITH r AS (SELECT p_partkey, p_partkey * 997 % 600000 AS price, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 997 % 600000 - 100 END AS net, p_partkey % 5 = 0 AS is_net, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS ded FROM part),
 s AS (SELECT *, CASE WHEN price BETWEEN 5000 AND 50000000 THEN price END AS listed, CASE WHEN net BETWEEN 5000 AND 50000000 THEN net END AS n FROM r)
SELECT p_partkey, CASE WHEN is_net THEN CAST(round_even(listed * 1.21, 0) AS BIGINT) ELSE listed END AS price_czk, CASE WHEN listed IS NULL THEN NULL WHEN is_net THEN listed ELSE n END AS price_without_vat,
 CAST(CASE WHEN listed IS NULL THEN NULL WHEN is_net THEN coalesce(ded, true) ELSE ded END AS INT) AS vat_deductible, CAST(CASE WHEN listed IS NULL THEN NULL WHEN is_net THEN false WHEN n < listed OR ded THEN true END AS INT) AS price_includes_vat FROM s""")
def resolved_prices(spark, sf_dir):
    """A feed's prices with and without VAT."""
    price = F.pmod(F.col("p_partkey") * 997, F.lit(600_000))
    key = F.col("p_partkey")
    out = ingest.resolved_prices(price, F.when(key % 3 == 0, price - 100), key % 5 == 0, F.when(key % 4 == 0, True).when(key % 4 == 1, False))
    rows = views.table(spark, sf_dir, "part")
    return rows.select("p_partkey", out["price_czk"].cast("long").alias("price_czk"), out["price_without_vat"].cast("long").alias("price_without_vat"), *(out[c].cast("int").alias(c) for c in ("vat_deductible", "price_includes_vat")))


@query("""WITH r AS (SELECT p_partkey, CAST(1000 + p_partkey % 9000 AS DOUBLE) AS amount, CASE p_partkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'PLN' WHEN 2 THEN 'USD' ELSE 'CZK' END AS code,
   CASE WHEN p_partkey % 6 = 0 THEN 24.5 END AS given, CASE WHEN p_partkey % 4 = 0 THEN 25.2 END AS live FROM part),
 s AS (SELECT *, CAST(coalesce(given, live, CASE code WHEN 'EUR' THEN 25.0 WHEN 'PLN' THEN 5.8 WHEN 'USD' THEN 23.0 END) AS DOUBLE) AS rate FROM r)
SELECT p_partkey, CAST(CASE code WHEN 'CZK' THEN amount ELSE floor((amount * rate + 50) / 100) * 100 END AS BIGINT) AS price_czk, CASE WHEN code <> 'CZK' THEN amount END AS price_foreign, CASE WHEN code <> 'CZK' THEN rate END AS fx_czk_per_unit, CASE WHEN code <> 'CZK' THEN '2001-05-04' END AS fx_rate_date FROM s""")
def import_fx(spark, sf_dir):
    """Foreign prices in crowns, with the rate behind them."""
    key = F.col("p_partkey")
    code = F.get(F.array(*(F.lit(c) for c in ("EUR", "PLN", "USD", "Kč"))), F.pmod(key, F.lit(4)).cast("int"))
    out = ingest.import_fields((1000 + key % 9000).cast("double"), code, F.when(key % 6 == 0, 24.5), F.when(key % 4 == 0, 25.2), F.lit("2001-05-04").cast("date"))
    out["fx_rate_date"] = out["fx_rate_date"].cast("string")
    return views.table(spark, sf_dir, "part").select("p_partkey", *(out[c].alias(c) for c in ("price_czk", "price_foreign", "fx_czk_per_unit", "fx_rate_date")))


@query("""SELECT c.c_custkey AS plate, o.fuel FROM customer c LEFT JOIN (SELECT o_custkey, o_orderpriority AS fuel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o ON o.o_custkey = c.c_custkey AND n = 1""")
def plate_fuel(spark, sf_dir):
    """Plates with the first fuel that a register has for them."""
    fuels = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plate"), "o_orderkey", F.col("o_orderpriority").alias("fuel"))
    return ingest.first_fuel(views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plate")), fuels, "plate", ["o_orderkey"]).select("plate", "fuel")


VARIANTS = f"""{L}, r AS (SELECT *, CASE WHEN power_kw % 4 <> 0 THEN power_kw * 20 END AS cc, CASE WHEN power_kw % 4 <> 0 THEN power_kw * 20 || ' ccm ' ELSE '' END || power_kw || ' kW' AS label, CASE WHEN power_kw % 2 = 0 THEN upper(make) ELSE make END AS written FROM listings),
 k AS (SELECT *, sha256(concat_ws('|', lower(make), lower(model), 'osobni')) AS mk FROM r),
 v AS (SELECT *, sha256(mk || '|' || year || '|' || lower(coalesce(body, '')) || '|' || lower(strip_accents(coalesce(fuel, ''))) || '|' || lower(strip_accents(coalesce(transmission, ''))) || '|' || lower(label) || '|' || power_kw || '|' || coalesce(cc, -1)) AS vk FROM k)"""


@query(f"""{VARIANTS} SELECT sha256(lower(make)) AS make_key, mk AS model_key, vk AS variant_key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(last_seen) AS first_seen, max(last_seen) AS last_seen, any_value(written) AS make, any_value(model) AS model, any_value(category) AS category,
 any_value(year) AS year, any_value(body) AS body, any_value(fuel) AS fuel, any_value(transmission) AS transmission, any_value(label) AS motor_label, any_value(power_kw) AS power_kw, any_value(cc) AS displacement_cc FROM v GROUP BY lower(make), mk, vk""")
def merged_variants(spark, sf_dir):
    """Variants of all sources in one row each, under keys made of all that tells them apart."""
    rows = views.listings(spark, sf_dir).withColumn("displacement_cc", F.expr("CASE WHEN power_kw % 4 <> 0 THEN power_kw * 20 END")).withColumn("seen", F.col("last_seen"))
    rows = rows.withColumn("motor_label", catalog.engine_label(F.col("displacement_cc"), F.col("power_kw"), F.col("fuel"), F.col("title")))
    # sources write names in their own ways
    return ingest.merged_variants(ingest.variant_keys(rows.withColumn("make", F.when(F.col("power_kw") % 2 == 0, F.upper("make")).otherwise(F.col("make")))))


@query("""SELECT p_partkey, CASE WHEN cc > 0 AND fuel <> 'Elektro' AND kw > 0 THEN cc || ' ccm ' || kw || ' kW' WHEN cc > 0 AND fuel <> 'Elektro' THEN cc || ' ccm' WHEN kw > 0 THEN kw || ' kW' WHEN name IS NOT NULL THEN array_to_string(w[greatest(1, len(w) - 2):len(w)], ' ')
  WHEN fuel = 'Neuvedeno' THEN 'Základní' ELSE fuel END AS label, CASE p_partkey % 3 WHEN 0 THEN 'Mercedes-Benz' WHEN 1 THEN NULL ELSE p_brand END AS make
 FROM (SELECT *, string_split(name, ' ') AS w FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 3000 END AS cc, CASE WHEN p_partkey % 5 < 3 THEN p_size - 10 END AS kw, ['Nafta', 'Elektro', 'Neuvedeno', 'Benzín'][p_partkey % 4 + 1] AS fuel, CASE WHEN p_partkey % 7 < 3 THEN p_name END AS name FROM part) p) q""")
def motor_labels(spark, sf_dir):
    """Labels of motors from displacement and power, else from the end of a name, else the fuel; and makes as they are shown."""
    p, key = views.table(spark, sf_dir, "part"), F.col("p_partkey")
    fuel = F.get(F.array(*(F.lit(x) for x in ("Nafta", "Elektro", "Neuvedeno", "Benzín"))), (key % 4).cast("int"))
    label = catalog.engine_label(F.when(key % 3 == 0, key % 3000), F.when(key % 5 < 3, F.col("p_size") - 10), fuel, F.when(key % 7 < 3, F.col("p_name")))
    make = F.when(key % 3 == 0, " MERCEDES ").when(key % 3 == 1, F.concat("p_brand", F.lit(" GmbH"))).otherwise(F.upper("p_brand"))
    return p.select("p_partkey", label.alias("label"), catalog.display_make(make).alias("make"))


@query("SELECT p_brand AS make, p_type AS model, p_size % 6 AS stratum, count(*) AS n FROM part GROUP BY ALL")
def register_counts(spark, sf_dir):
    """Vehicles of a register by make, model and stratum."""
    return views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model"), (F.col("p_size") % 6).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'passenger' WHEN 1 THEN 'van' WHEN 2 THEN 'motorcycle' ELSE 'caravan' END AS category, count(DISTINCT (p_brand, p_type)) AS variants FROM part GROUP BY ALL")
def variants_by_category(spark, sf_dir):
    category = F.get(F.array(*(F.lit(c) for c in ("passenger", "van", "motorcycle", "caravan"))), F.pmod("p_size", F.lit(4)).cast("int"))
    return views.table(spark, sf_dir, "part").groupBy(category.alias("category")).agg(F.count_distinct("p_brand", "p_type").alias("variants"))


@query(f"""{L}, rows AS (SELECT id, year, mileage_km, fuel, body FROM listings), d AS (SELECT id, mileage_km + 1 AS mileage_km, CASE WHEN power_kw % 2 = 0 THEN ' ' ELSE 'LPG' END AS fuel, NULL::VARCHAR AS body FROM listings WHERE year IS NULL OR mileage_km IS NULL OR fuel IS NULL)
SELECT rows.id, year, coalesce(d.mileage_km, rows.mileage_km) AS mileage_km, coalesce(nullif(trim(d.fuel), ''), rows.fuel) AS fuel, coalesce(d.body, rows.body) AS body FROM rows LEFT JOIN d ON d.id = rows.id""")
def detail_enrich(spark, sf_dir):
    """Rows that lack a year, mileage or fuel, filled from their details."""
    rows = views.listings(spark, sf_dir).select("id", "year", "mileage_km", "fuel", "body", "power_kw")
    lacking = rows.where(F.col("year").isNull() | F.col("mileage_km").isNull() | F.col("fuel").isNull())
    details = lacking.select("id", (F.col("mileage_km") + 1).alias("mileage_km"), F.when(F.col("power_kw") % 2 == 0, " ").otherwise("LPG").alias("fuel"), F.lit(None).cast("string").alias("body"))
    return ingest.enriched(rows, details, "id", ["mileage_km", "fuel", "body"]).drop("power_kw")


@query("""SELECT event_type AS source, count(*) FILTER (event_type <> 'error' AND value >= 5 AND event_id % 10 <> 0) AS ingested, count(*) FILTER (event_type = 'error' OR event_id % 10 = 0) AS error, count(*) FILTER (event_type <> 'error' AND value < 5 AND event_id % 10 <> 0) AS skipped FROM events GROUP BY event_type""")
def ingest_counters(spark, sf_dir):
    """Rows ingested, skipped and failed by source; an unknown source is an error, and no error stops the batch."""
    e = views.table(spark, sf_dir, "events")
    known = ["click", "view", "purchase", "signup", "scroll", "login", "logout", "search", "cart", "hover"]
    rows = e.withColumn("outcome", ingest.outcome(F.col("event_type"), known, F.col("event_id") % 10 == 0, F.col("value") < 5))
    return ingest.counters(rows.withColumnRenamed("event_type", "source"))


@query("SELECT DISTINCT w AS key, replace(w, '_', ' ') AS label FROM (SELECT regexp_replace(unnest(string_split(p_name, ' ')), '[^a-z0-9]+', '_', 'g') AS w FROM part) x WHERE w NOT IN ('red', 'ring')")
def feature_tags(spark, sf_dir):
    """Features that the dictionary doesn't have yet."""
    found = views.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("raw")).select(slug(F.col("raw"), "_").alias("key")).distinct()
    known = spark.createDataFrame([("red",), ("ring",)], "key string")
    return found.join(known, "key", "left_anti").select("key", F.replace("key", F.lit("_"), F.lit(" ")).alias("label"))


@query(f"{L} SELECT id, price_czk FROM listings WHERE status = 'active' AND source = 'autobazar_eu' AND price_czk >= 900000 ORDER BY price_czk DESC, id LIMIT 500")
def price_suspects(spark, sf_dir):
    """The dearest active offers of a source above a price."""
    rows = views.listings(spark, sf_dir).where("status = 'active' AND source = 'autobazar_eu' AND price_czk >= 900000")
    return rows.orderBy(F.desc("price_czk"), "id").limit(500).select("id", "price_czk")


@query(f"{L} SELECT id, title FROM listings WHERE status = 'active' AND source = 'bazos' ORDER BY last_seen DESC NULLS LAST, id LIMIT 50000")
def parts_scan(spark, sf_dir):
    """The newest active offers of a source, as many as a scan looks at."""
    rows = views.listings(spark, sf_dir).where("status = 'active' AND source = 'bazos'")
    return rows.orderBy(F.desc_nulls_last("last_seen"), "id").limit(50_000).select("id", "title")


@query("""SELECT page_id, url FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN url || '/a.svg?x' ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'key' END AS k, CASE page_id % 2 WHEN 0 THEN 'bazos' ELSE 'sauto' END AS source FROM pages) x
WHERE (k IS NULL OR lower(url) LIKE '%.svg%') AND (trim(coalesce(url, '')) <> '' OR source = 'bazos') ORDER BY page_id DESC LIMIT 1000""")
def thumbs_needed(spark, sf_dir):
    """The newest rows that lack a picture and can get one."""
    rows = views.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 5 == 1, F.concat("url", F.lit("/a.svg?x"))).otherwise(F.col("url")).alias("url"))
    lacks = (F.col("page_id") % 3 == 0) | F.coalesce(F.col("url").ilike("%.svg%"), F.lit(False))
    can = (F.trim(F.coalesce("url", F.lit(""))) != "") | (F.col("page_id") % 2 == 0)
    return rows.where(lacks & can).orderBy(F.desc("page_id")).limit(1000)


@query(f"{L} SELECT source, count(*) AS n, CAST(sum(CASE WHEN (epoch(TIMESTAMP '{NOW}') - epoch(last_seen)) // 86400 > 14 THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM listings GROUP BY source")
def stale_by_source(spark, sf_dir):
    """Offers of each source, and those not seen for more than 14 whole days."""
    stale = F.floor((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("last_seen")) / 86_400) > 14
    return views.listings(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(stale, 1).otherwise(0)).alias("stale"))
