"""Queries over captured pages of portals: records of shapes that vary, as listings.

A page per customer holds a record for every order of theirs, written from the order's own numbers by one of a portal's templates;
the SQL says what each template must give, or that it gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records, views
from .ads import filled

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RATE = 25.0


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


NUMBERS = """SELECT o_orderkey AS k, o_custkey AS page, CAST(floor(o_totalprice / 20) AS BIGINT) + 600 AS euros, o_custkey * 1000 % 300000 + 1 AS km, 1995 + o_orderkey % 30 AS y FROM orders"""
COLUMNS = ["external_id", "url", "make", "model", "year", "mileage_km", "fuel", "transmission", "drive", "power_kw", "displacement_cc", "body", "seller_type", "region", "price_czk", "image_url", "title"]
KINDS = {"year": "INT", "mileage_km": "BIGINT", "power_kw": "BIGINT", "displacement_cc": "BIGINT", "price_czk": "BIGINT"}


def pages(spark: SparkSession, sf_dir: str, templates: list[str], page: Column) -> DataFrame:
    """(page, html): a page's records joined by commas stand where {records} is in `page`; odd pages write them as members of an object."""
    o = views.table(spark, sf_dir, "orders")
    euros = F.floor(F.col("o_totalprice") / 20) + 600
    km, y = F.col("o_custkey") * 1000 % 300_000 + 1, 1995 + F.col("o_orderkey") % 30
    dotted = F.replace(F.format_number(km, 0), F.lit(","), F.lit("."))
    blanks = {"k": F.col("o_orderkey").cast("string"), "n": (F.col("o_orderkey") + 100_000).cast("string"), "p": euros.cast("string"), "czk": (euros * 25).cast("string"), "km": km.cast("string"), "dotted": dotted, "y": y.cast("string")}
    one = o.select(F.col("o_custkey").alias("page"), "o_orderkey", filled(templates, F.col("o_orderkey"), blanks).alias("json"))
    listed = one.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "json"))).alias("held"))
    members = F.transform("held", lambda h, i: F.concat(F.when(F.col("page") % 2 == 1, F.concat(F.lit('"'), i, F.lit('":'))).otherwise(F.lit("")), h["json"]))
    return listed.select("page", F.replace(page, F.lit("{records}"), F.array_join(members, ",")).alias("html"))


def expected(templates: list[tuple[str, dict | None]]) -> str:
    """SQL: the rows that the templates give, from the same numbers."""
    cases = []
    for i, (_, gives) in enumerate(templates):
        if gives is not None:
            values = [f"CAST({gives.get(c, 'NULL')} AS {KINDS.get(c, 'VARCHAR')}) AS {c}" for c in COLUMNS]
            cases.append(f"SELECT page, {', '.join(values)} FROM o WHERE k % {len(templates)} = {i}")
    return f"WITH o AS ({NUMBERS}) {' UNION ALL '.join(cases)}"


FRAMEWORK = '<html><title>x</title><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{%s}}}</script></html>'
CZK = "CAST(floor((euros * 25.0 + 50) / 100) * 100 AS BIGINT)"
BAZAR = [
    (
        '{"id":{k},"sefName":"/skoda-x/","finalPrice":{p}.0,"brandValue":"skoda","carModelValue":"Octavia","yearValue":"rok {y}","mileage":{km},"fuelValue":"Nafta","gearboxValue":"Automat DSG","driveValue":"4x4","enginePower":"110 kW",'
        '"engineCapacity":1968,"bodyworkValue":"Combi","userSubjectType":30852,"locationIds":[1,200000000],"location":{"name":"Brno"},"image":{"previewUrls":{"orig":"//img/o.jpg","record_premium":"//img/x.jpg"}},"title":"Octavia tel 777 123 456"}',
        {
            "external_id": "k", "url": "'https://www.autobazar.eu/cs/detail/skoda-x/' || k || '/'", "make": "'Škoda'", "model": "'Octavia'", "year": "y", "mileage_km": "km", "fuel": "'Nafta'", "transmission": "'DSG'", "drive": "'4×4'",
            "power_kw": "110", "displacement_cc": "1968", "body": "'Kombi'", "seller_type": "'dealer'", "region": "'Brno'", "price_czk": CZK, "image_url": "'https://img/x.jpg'", "title": "'Octavia tel [redacted]'",
        },
    ),
    (
        '{"id":"{k}","unitPrice":1,"price":{czk},"finalPrice":{p},"brandValue":"Audi","yearValue":{y},"mileage":"dojezd 400 km","user":{"subjectType":"23348"},"location":{"parentNames":["Česká republika","Jihomoravský"]},"gearboxValue":"Manuál","driveValue":["4x4"]}',
        {"external_id": "k", "url": "'https://www.autobazar.eu/cs/detail/' || k || '/'", "make": "'Audi'", "year": "y", "transmission": "'Manuální'", "seller_type": "'private'", "region": "'Jihomoravský'", "price_czk": "euros * 25"},
    ),
    ('{"id":{k},"finalPrice":{p},"location":{"name":"Žilina","parentNames":["Slovensko"]}}', None),
    ('{"id":{k},"finalPrice":{p},"location":"Praha"}', None),
    ('{"id":{k},"priceCurrency":"Kč","price":4000,"locationIds":["200000000"]}', None),
    (
        '{"id":{k},"priceCurrent":"9 900,50","images":[{"url":"https://i/1.jpg"}],"image":"none","user":{"packages":{"hasBasicPackage":false,"hasMasterPackage":true}},"location":{"parents":[200000000]},"enginePower":2000,"bodyworkValue":"SUV / Off-road"}',
        {"external_id": "k", "url": "'https://www.autobazar.eu/cs/detail/' || k || '/'", "body": "'SUV'", "seller_type": "'dealer'", "price_czk": "247500", "image_url": "'https://i/1.jpg'"},
    ),
    ('{"finalPrice":{p},"locationIds":[200000000]}', None),
    ('["no record"]', None),
    ("null", None),
]


@query(expected(BAZAR))
def autobazar_records(spark, sf_dir):
    """Offers of pages' framework data in euros, crowns or both, in the country only."""
    # this portal's lists are lists: pages with an object in their place have no records, so every page gets a list here
    html = F.lit(FRAMEWORK % '"searchRecords":{"data":[{records}]}')
    rows = pages(spark, sf_dir, [t for t, _ in BAZAR], html).withColumn("html", F.regexp_replace("html", r'(?<=[\[,])"\d+":(?=[\[{n])', ""))
    return records.autobazar(rows, RATE).select("page", *COLUMNS)


SCOUT = [
    (
        '{"id":"{k}","url":"/angebote/x?y=1","price":{"priceRaw":{p}},"vehicle":{"make":"Opel","model":"Corsa","modelVersionInput":"1.2","mileageInKm":"{dotted} km","fuel":"Benzin","transmission":"Schaltgetriebe","engineDisplacementInCCM":"1.199 cm³"},'
        '"vehicleDetails":[{"iconName":"calendar","data":"05/{y}"},{"iconName":"speedometer","data":"110 kW (150 PS)"},"x"],"seller":{"type":"Dealer"},"location":{"city":"Ulm"},"images":["https://i/1.jpg"]}',
        {
            "external_id": "k", "url": "'https://www.autoscout24.de/angebote/x'", "make": "'Opel'", "model": "'Corsa'", "year": "y", "mileage_km": "km", "fuel": "'Benzín'", "transmission": "'Manuální'", "power_kw": "110",
            "displacement_cc": "1199", "seller_type": "'dealer'", "region": "'Ulm'", "price_czk": CZK, "image_url": "'https://i/1.jpg'", "title": "'Opel Corsa 1.2'",
        },
    ),
    ('{"id":"{k}","url":"/a","price":{"priceRaw":{p}},"vehicle":{"make":"Opel","isCurrentlyDamaged":true}}', None),
    (
        '{"identifier":{"legacyId":{k}},"id":"no","url":"https://www.autoscout24.de/b","price":{"priceRaw":"{p}"},"vehicle":{"make":"BMW","modelGroup":"3er","variant":"Touring","mileageInKm":{km},"firstRegistration":"03-{y}","bodyType":"Kombi","driveTrain":"Allrad","engineDisplacementInCCM":1995},"vehicleDetails":{},"seller":"private","images":[]}',
        {"external_id": "k", "url": "'https://www.autoscout24.de/b'", "make": "'BMW'", "model": "'3er'", "year": "y", "mileage_km": "km", "drive": "'4x4'", "displacement_cc": "1995", "body": "'Kombi'", "seller_type": "'unknown'", "price_czk": CZK, "title": "'BMW Touring'"},
    ),
    ('{"id":"{k}","url":"/a","price":{"priceRaw":{p}},"vehicle":"x"}', None),
    ('{"id":"{k}","url":"/a","price":{"priceRaw":{p}},"vehicle":{"make":"Opel"},"specialConditions":["accident"]}', None),
    ('{"id":"{k}","url":"/a","price":{"priceRaw":250},"vehicle":{"make":"Opel"}}', None),
    ('{"id":"{k}","url":"/a","price":{"priceRaw":{p}},"vehicle":{"make":"Opel","subtitle":"Motorschaden, Klima"}}', None),
]


@query(expected(SCOUT))
def autoscout_records(spark, sf_dir):
    """Offers of a German portal, years and power from lists of details, damaged ones left out."""
    html = F.lit(FRAMEWORK % '"listings":[{records}]')
    rows = pages(spark, sf_dir, [t for t, _ in SCOUT], html).withColumn("html", F.regexp_replace("html", r'(?<=[\[,])"\d+":(?=\{)', ""))
    return records.autoscout(rows, RATE).select("page", *COLUMNS)


OFFER = '"offers":{"price":"{czk}","priceCurrency":"CZK","seller":{"@type":"Organization","name":"hidden","address":{"addressLocality":"Plzeň"}}}'
TIP = [
    (
        '{"item":{"@type":"Product","url":"https://www.tipcars.com/osobni/kombi/nafta/skoda-{n}.html","sku":"octavia-{n}","name":"Skoda Octavia, 2.0",' + OFFER + ',"additionalProperty":[{"name":"Najeto","value":"{dotted} km"},{"name":"Uvedení do provozu","value":"5/{y}"},'
        '{"name":"Převodovka","value":"automat"},{"name":"Výkon","value":"110 kW"},{"name":"Objem","value":"1 968 ccm"},{"name":"Pohon","value":"přední"},"x"],"image":["/img/1.jpg"]}}',
        {
            "external_id": "k + 100000", "url": "'https://www.tipcars.com/osobni/kombi/nafta/skoda-' || (k + 100000) || '.html'", "make": "'Škoda'", "model": "'Octavia'", "year": "y", "mileage_km": "km", "fuel": "'Nafta'", "transmission": "'Automatická'",
            "drive": "'Přední'", "power_kw": "110", "displacement_cc": "1968", "body": "'Kombi'", "seller_type": "'dealer'", "region": "'Plzeň'", "price_czk": "euros * 25", "image_url": "'https://www.tipcars.com/img/1.jpg'", "title": "'Skoda Octavia, 2.0'",
        },
    ),
    (
        '{"item":{"@type":"Product","@id":"//www.tipcars.com/suv/audi-{n}.html?x","brand":{"name":"Audi"},"model":"A4","name":"Audi A4 Avant","offers":{"price":{czk}},"additionalProperty":[{"name":"Palivo","value":"Benzín"},{"name":"tachometr","value":"dojezd 400 km"},{"name":"rok výroby","value":"{y}"}],"image":{"url":"x"}}}',
        {
            "external_id": "k + 100000", "url": "'https://www.tipcars.com/suv/audi-' || (k + 100000) || '.html?x'", "make": "'Audi'", "model": "'A4'", "year": "y", "fuel": "'Benzín'", "body": "'SUV'", "seller_type": "'unknown'", "price_czk": "euros * 25",
            "title": "'Audi A4 Avant'",
        },
    ),
    ('{"item":{"@type":"Product","sku":"a-{n}","offers":{"price":"{p}","priceCurrency":"EUR"}}}', None),
    ('{"item":{"@type":"Offer","sku":"a-{n}",' + OFFER + "}}", None),
    ('{"item":{"@type":"Product","url":"https://www.tipcars.com/x.html",' + OFFER + "}}", None),
    ('{"name":"no item"}', None),
    ('"text"', None),
]
ITEM_LIST = '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":%s}</script><script type="application/ld+json">{"@type":"Product","sku":"a-99999"}</script>'


@query(expected(TIP))
def tipcars_records(spark, sf_dir):
    """Products of linked data, of lists and of objects in the place of lists, beside broken blocks."""
    html = F.when(F.col("page") % 2 == 1, ITEM_LIST % "{{records}}").otherwise(ITEM_LIST % "[{records}]")
    return records.tipcars(pages(spark, sf_dir, [t for t, _ in TIP], html)).select("page", *COLUMNS)


@query(f"""WITH o AS ({NUMBERS}) SELECT CAST(k AS VARCHAR) AS external_id, {CZK} + 1000 * (k % 2) AS old_price, CASE WHEN k % 3 = 0 THEN 'CZK' ELSE 'EUR' END AS old_currency, {CZK} AS new_price, 'EUR' AS new_currency
 FROM o WHERE k % {len(BAZAR)} = 0 AND (k % 2 = 1 OR k % 3 = 0)""")
def price_repairs(spark, sf_dir):
    """Stored prices that the offers' detail pages contradict."""
    o = views.table(spark, sf_dir, "orders").where(F.col("o_orderkey") % len(BAZAR) == 0)
    czk = F.floor((F.floor(F.col("o_totalprice") / 20) * 25 + 600 * 25 + 50) / 100) * 100
    stored = o.select(F.col("o_orderkey").cast("string").alias("external_id"), (czk + 1000 * (F.col("o_orderkey") % 2)).alias("price_czk"), F.when(F.col("o_orderkey") % 3 == 0, "CZK").otherwise("EUR").alias("currency"))
    euros, km, y = F.floor(F.col("o_totalprice") / 20) + 600, F.lit("1"), 1995 + F.col("o_orderkey") % 30
    blanks = {"k": F.col("o_orderkey").cast("string"), "p": euros.cast("string"), "km": km, "y": y.cast("string")}
    detail = F.replace(F.lit(FRAMEWORK % '"advertisement":{record}'), F.lit("{record}"), filled([BAZAR[0][0]], F.lit(0), blanks))
    return records.repriced(stored, records.autobazar(o.select(detail.alias("html")), RATE))
