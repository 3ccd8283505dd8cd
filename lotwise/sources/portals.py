"""Captured records of portals, JSON texts, as listings: read with a schema, mapped by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, features, labels
from ..functions.text import amount, redact_contacts, whole_number, year_of_text
from ..operators import gates, ingest

NAMED = "struct<name:string,seo_name:string>"
SAUTO = f"""struct<id:string,price:string,price_without_vat:string,price_is_without_vat:boolean,price_is_vat_deductible:boolean,operating_lease:boolean,manufacturer_cb:{NAMED},model_cb:{NAMED},
  additional_model_name:string,locality:struct<region:string,district:string>,manufacturing_date:string,in_operation_date:string,tachometer:string,fuel_cb:{NAMED},gearbox_cb:{NAMED},drive_cb:{NAMED},
  vehicle_body_cb:{NAMED},engine_power:string,engine_volume:string,premise:string,image:string,images:array<struct<url:string>>,equipment_cb:array<{NAMED}>,create_date:string,sorting_date:string>"""
MOBILE = """struct<id:string,url:string,title:string,make:string,model:string,price:struct<gross:string,amount:string>,firstRegistration:string,mileage:string,fuel:string,transmission:string,drive:string,
  category:string,power:string,contact:struct<type:string>,attr:struct<cn:string,city:string>,features:array<string>,isAccidentDamaged:string,accidentDamaged:string,damageUnrepaired:string>"""
AUTOBAZAR = "struct<currency:string,finalPrice:string,priceCurrent:string,price:string,unitPrice:string>"
# Limits of what is plausible.
KILOMETRES, KILOWATTS, EUROS, CROWNS, CUBIC = (1, 1_999_999), (15, 800), (500, 500_000), (5_000, 50_000_000), (500, 10_000)


def within(c: Column, limits: tuple[int, int]) -> Column:
    return F.when(c.between(*limits), c)


def filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def absolute(url: Column) -> Column:
    whole = F.when(F.startswith(F.trim(url), F.lit("//")), F.concat(F.lit("https:"), F.trim(url))).otherwise(F.trim(url))
    return F.when(whole.rlike("^https?://"), whole)


def sauto(captured: DataFrame, text: str = "json") -> DataFrame:
    """Listings of captured rows; those without an id or a plausible price, and leases, are left out."""
    r = captured.select(F.from_json(text, SAUTO).alias("r"))
    get = lambda path: F.col(f"r.{path}")
    prices = ingest.resolved_prices(whole_number(get("price")), whole_number(get("price_without_vat")), get("price_is_without_vat"), get("price_is_vat_deductible"))
    path = [F.url_encode(F.coalesce(get(f"{k}.seo_name"), F.lit(d))) for k, d in (("manufacturer_cb", "auto"), ("model_cb", "model"))]
    title = F.concat_ws(" ", filled(get("manufacturer_cb.name")), filled(get("model_cb.name")), filled(get("additional_model_name")))
    out = r.select(
        F.lit("sauto").alias("source"), get("id").alias("external_id"), F.concat(F.lit("https://www.sauto.cz/osobni/detail/"), path[0], F.lit("/"), path[1], F.lit("/"), get("id")).alias("url"),
        filled(get("manufacturer_cb.name")).alias("make"), filled(get("model_cb.name")).alias("model"), filled(get("additional_model_name")).alias("trim"),
        F.coalesce(year_of_text(get("manufacturing_date")), year_of_text(get("in_operation_date"))).alias("year"), whole_number(get("tachometer")).alias("mileage_km"),
        filled(get("fuel_cb.name")).alias("fuel"), filled(get("gearbox_cb.name")).alias("transmission"), filled(get("drive_cb.name")).alias("drive"), filled(get("vehicle_body_cb.name")).alias("body"),
        whole_number(get("engine_power")).alias("power_kw"), whole_number(get("engine_volume")).alias("displacement_cc"), labels.seller_type(get("premise"), F.lit("")).alias("seller_type"),
        F.coalesce(filled(get("locality.region")), filled(get("locality.district"))).alias("region"), *(c.alias(n) for n, c in prices.items()),
        F.array_distinct(F.filter(F.transform(F.coalesce(get("equipment_cb.name"), F.array().cast("array<string>")), features.feature_key), lambda k: k.isNotNull())).alias("feature_keys"),
        F.coalesce(absolute(get("image")), absolute(F.get(get("images.url"), F.lit(0)))).alias("image_url"), filled(title).alias("title"),
        extract.moment(F.coalesce(get("create_date"), get("sorting_date"))).alias("published_at"), F.coalesce(get("operating_lease"), F.lit(False)).alias("lease"),
    )
    return out.where(F.col("external_id").isNotNull() & F.col("price_czk").isNotNull() & ~F.col("lease")).drop("lease")


def mobile(captured: DataFrame, rate: float, text: str = "json") -> DataFrame:
    """Listings of captured records in euros; damaged ones and implausible prices are left out."""
    r = captured.select(F.from_json(text, MOBILE).alias("r"))
    get = lambda path: F.col(f"r.{path}")
    euros = within(whole_number(F.coalesce(get("price.gross"), get("price.amount"))), EUROS)
    fx = ingest.import_fields(euros, F.lit("EUR"), F.lit(rate), F.lit(None).cast("double"), F.lit(None).cast("date"))
    flags = F.create_map(*(x for n in ("isAccidentDamaged", "accidentDamaged") for x in (F.lit(n), F.coalesce(get(n), F.lit("")))))
    kind = F.upper(F.coalesce(get("contact.type"), F.lit("")))
    out = r.select(
        F.lit("mobile_de").alias("source"), filled(get("id")).alias("external_id"), get("url").alias("url"), filled(redact_contacts(get("title"))).alias("title"), filled(get("make")).alias("make"), filled(get("model")).alias("model"),
        year_of_text(get("firstRegistration")).alias("year"), within(whole_number(get("mileage")), KILOMETRES).alias("mileage_km"), labels.portal_fuel(get("fuel")).alias("fuel"),
        labels.portal_transmission(get("transmission")).alias("transmission"), labels.german_drive(get("drive")).alias("drive"), labels.portal_body(get("category")).alias("body"),
        within(whole_number(get("power")), KILOWATTS).alias("power_kw"), F.when(kind.rlike("DEALER|HAENDLER|HÄNDLER"), "dealer").when(kind.rlike("PRIVAT"), "private").otherwise("unknown").alias("seller_type"),
        F.coalesce(filled(get("attr.cn")), filled(get("attr.city"))).alias("region"), within(fx["price_czk"], CROWNS).alias("price_czk"), fx["price_foreign"].alias("price_foreign"),
        F.array_distinct(F.filter(F.transform(F.coalesce(get("features"), F.array().cast("array<string>")), features.known_feature), lambda k: k.isNotNull())).alias("feature_keys"),
        gates.accident(get("title"), [get("make"), get("model")], F.array().cast("array<string>"), flags, F.array().cast("array<string>")).alias("damaged"),
    )
    return out.where(F.col("external_id").isNotNull() & F.col("url").isNotNull() & F.col("price_czk").isNotNull() & ~F.col("damaged")).drop("damaged")


def offer_price(record: Column) -> Column:
    """Amount and currency of an offer that may state euros, crowns or both: struct<amount, currency>, null if neither is plausible.

    `unitPrice` 1 beside a price of three times the euros or more says that the price is in crowns.
    """
    hinted = labels.currency(record["currency"])
    hinted = F.when(~labels.blank(record["currency"]) & hinted.isin("CZK", "EUR"), hinted)
    final, current, price = (amount(record[c]) for c in ("finalPrice", "priceCurrent", "price"))
    euros = F.coalesce(final, current)
    mirror = (whole_number(record["unitPrice"]) == 1) & price.between(*CROWNS) & (euros.isNull() | (price >= euros * 3)) & ~F.coalesce(hinted == "EUR", F.lit(False))
    pair = lambda a, c: F.struct(a.alias("amount"), c.alias("currency"))
    crowns = F.coalesce(*(within(c, CROWNS) for c in (price, final, current)))
    none = F.lit(None).cast("struct<amount:double,currency:string>")
    return (
        F.when(F.coalesce(mirror, F.lit(False)), pair(price, F.lit("CZK")))
        .when(hinted == "CZK", F.when(crowns.isNotNull(), pair(crowns, F.lit("CZK"))).otherwise(none))
        .when(euros.between(*EUROS), pair(euros, F.lit("EUR")))
        .when(price.between(*EUROS), pair(price, F.coalesce(hinted, F.lit("EUR"))))
        .when(price.between(*CROWNS), pair(price, F.lit("CZK")))
    )


def scout_mileage(raw: Column) -> Column:
    """Kilometres as a portal writes them; consumption isn't mileage."""
    return F.when(~raw.rlike(r"(?i)l\s*/\s*100"), within(whole_number(F.substring_index(F.lower(raw), "km", 1)), KILOMETRES))


def scout_power(raw: Column) -> Column:
    return within(F.regexp_extract(raw, r"(?i)(\d+)\s*kW", 1).try_cast("int"), KILOWATTS)


def scout_displacement(raw: Column) -> Column:
    """Cubic centimetres; a point may part thousands or litres."""
    n = F.regexp_extract(raw, r"(?i)([\d.]+)\s*cm", 1).try_cast("double")
    return within(F.round(F.when(n < 20, n * 1000).otherwise(n)).cast("int"), CUBIC)
