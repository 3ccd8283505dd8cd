"""Records of three portals, from whole captured pages, as listings.

Records vary: a list may come as an object with numbers for keys, a level may be missing or hold something else, a number may be
a text. So pages are read as variants, and each field is asked for by its path and kind; what isn't there is null and stops nothing.
Contacts, names and addresses of sellers are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, features, labels
from ..functions.text import let, redact_contacts, whole_number, year_of_text
from ..operators import gates, ingest
from .portals import absolute, filled, offer_price, scout_displacement, scout_mileage, scout_power, within

# Where records stand in pages, the code of the country, kinds of sellers, limits of what is plausible, names of attributes.
NEXT_DATA = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
LINKED_DATA = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
CZECHIA, DEALER_CODE, PRIVATE_CODE = "200000000", 30852, 23348
PACKAGES = ["hasBasicPackage", "hasCompactPackage", "hasComfortPackage", "hasPremiumPackage", "hasMasterPackage", "hasProfessionalPackage"]
PREVIEWS = ["record_preview", "record_premium", "orig", "record_premium_thumb"]
CURRENCY_NAMES = ["currency", "priceCurrency", "currencyCode", "currency_code", "price_currency"]
CROWNS, KILOMETRES, POWER, CUBIC, SCOUT_EUROS = (5_000, 50_000_000), (0, 2_000_000), (20, 1_500), (600, 10_000), (300, 500_000)
TRANSMISSIONS = [("DSG", "dsg|dvojspoj"), ("CVT", "cvt"), ("Automatická", "aut|tiptronic|eat|pdk"), ("Manuální", "man")]
DRIVES = [("4×4", "4x4|4wd|awd|quattro|xdrive"), ("Přední", "přední|predni|fwd"), ("Zadní", "zadní|zadni|rwd")]
BODIES = [("SUV", "suv|off-road|terén|teren"), ("Kombi", "kombi|combi|touring"), ("Hatchback", "hatch"), ("Sedan", "sedan|limuz"), ("Coupe", "coup"), ("Cabrio", "cabrio|roadster"), ("MPV", "mpv|van|minivan"), ("Pick-up", "pick")]
LIST_TRANSMISSIONS = [("DSG", "dsg|dvojspoj"), ("CVT", "cvt"), ("Automatická", "aut|automat"), ("Manuální", "man")]
LIST_DRIVES = [("4×4", "4x4|4wd|awd|všech|vsech"), ("Přední", "přední|predni|fwd"), ("Zadní", "zadní|zadni|rwd")]
PATH_BODIES = {
    "suv": "SUV", "kombi": "Kombi", "hatchback": "Hatchback", "sedan": "Sedan", "limuzina": "Sedan", "coupe": "Coupe", "cabrio": "Cabrio", "mpv": "MPV", "pick-up": "Pick-up", "pickup": "Pick-up", "dodavka": "Dodávka",
}
PATH_FUELS = ["nafta", "benzin", "benzín", "hybrid", "elektro", "lpg", "cng"]
MAKES = [
    "Alfa Romeo", "Mercedes-Benz", "Land Rover", "Aston Martin", "Volkswagen", "Škoda", "Skoda", "Citroën", "Citroen", "Hyundai", "Renault", "Peugeot", "Toyota", "Nissan", "Mazda", "Honda", "Suzuki", "Subaru",
    "Mitsubishi", "Porsche", "Jaguar", "Lexus", "Volvo", "Dacia", "Cupra", "Seat", "Audi", "BMW", "Ford", "Opel", "Fiat", "Kia", "Mini", "Tesla", "Jeep",
]
MAKE_SPELLINGS = {"Skoda": "Škoda", "Citroen": "Citroën"}
NOT_AN_ODOMETER = r"(?i)dojezd|wltp|bater"


def text(record: Column, path: str) -> Column:
    """A number's or text's value as text; null for lists, objects and what is missing."""
    plain = F.try_variant_get(record, path, "array<variant>").isNull() & F.try_variant_get(record, path, "map<string,variant>").isNull()
    return F.when(plain, filled(F.try_variant_get(record, path, "string")))


def items(record: Column, path: str) -> Column:
    """A list's members, or those of an object with numbers for keys in the order of the numbers; null for anything else."""
    by_key = F.map_entries(F.try_variant_get(record, path, "map<string,variant>"))
    keys = F.array_sort(F.transform(by_key, lambda e: e["key"].try_cast("int")))
    listed = F.transform(keys, lambda k: F.try_variant_get(record, path, "map<string,variant>")[k.cast("string")])
    numbered = F.when(F.forall(by_key, lambda e: e["key"].rlike(r"^\d{1,9}$")), listed)
    return F.coalesce(F.try_variant_get(record, path, "array<variant>"), numbered)


def texts(record: Column, path: str) -> Column:
    return F.transform(F.try_variant_get(record, path, "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))


def true(record: Column, path: str) -> Column:
    """Whether a value is true, a number beside 0 or a text with anything in it."""
    return F.coalesce(~F.lower(text(record, path)).isin("false", "0"), F.lit(False))


def ordered(raw: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for label, needles in reversed(table):
        out = F.when(F.lower(raw).rlike(needles), label).otherwise(out)
    return out


def stated_fuel(raw: Column) -> Column:
    return F.when(~labels.blank(raw), F.nullif(labels.catalog_fuel(raw), F.lit(labels.UNSTATED)))


def framework_data(html: Column) -> Column:
    return F.try_parse_json(F.nullif(F.regexp_extract(html, NEXT_DATA, 1), F.lit("")))


def records_of(pages: DataFrame, data: Column, lists: list[str], single: list[str], html: str = "html") -> DataFrame:
    """(the pages' columns without html, record): the members of the first list there is, and single records, of each page."""
    held = pages.withColumn("_data", data)
    listed = F.coalesce(*(F.try_variant_get("_data", p, "array<variant>") for p in lists), F.array().cast("array<variant>"))
    ones = F.filter(F.array(*(F.try_variant_get("_data", p, "variant") for p in single)), lambda v: v.isNotNull()) if single else F.array().cast("array<variant>")
    return held.select(*(c for c in pages.columns if c != html), F.explode(F.concat(listed, ones)).alias("record"))


def mapped(rows: DataFrame, raw: dict[str, Column], body: Callable[[Column], dict[str, Column]], keep: Callable[[Column], Column]) -> DataFrame:
    """The rows' columns and a listing made of each record: its raw fields are read once, then mapped, and only what `keep` likes stays."""
    listing = let(raw, lambda t: F.struct(*(c.alias(n) for n, c in body(t).items())))
    return rows.select(*(c for c in rows.columns if c != "record"), F.inline(F.filter(F.array(listing), lambda m: F.coalesce(keep(m), F.lit(False)))))


# --- Autobazar.eu


def in_czechia(r: Column) -> Column:
    """By the ids of the record's places, or those above its place, or their names."""
    ids, above = texts(r, "$.locationIds"), texts(r, "$.location.parents")
    names = F.lower(F.array_join(texts(r, "$.location.parentNames"), " "))
    here = lambda c: F.coalesce(F.array_contains(c, CZECHIA), F.lit(False))
    return here(ids) | here(above) | F.coalesce(names.rlike("česká republika|ceska republika"), F.lit(False))


def place(r: Column) -> Column:
    """A town or region; no country."""
    above = F.filter(F.transform(texts(r, "$.location.parentNames"), F.trim), lambda n: (n != "") & ~F.lower(n).rlike("republika|slovensko"))
    return F.coalesce(text(r, "$.location.name"), F.get(above, F.lit(0)))


def seller(r: Column) -> Column:
    code = F.coalesce(text(r, "$.userSubjectType"), text(r, "$.user.subjectType")).try_cast("int")
    dealer = true(r, "$.user.authorizedDealer.isAuthorized")
    for name in PACKAGES:
        dealer = dealer | true(r, f"$.user.packages.{name}")
    return F.when(code == DEALER_CODE, "dealer").when(code == PRIVATE_CODE, "private").when(dealer, "dealer").otherwise("unknown")


def cover(r: Column) -> Column:
    def of(at: str) -> list[Column]:
        return [absolute(text(r, f"{at}.previewUrls.{p}")) for p in PREVIEWS] + [absolute(text(r, f"{at}.url"))]

    return F.coalesce(*of("$.image"), *of("$.images[0]"), absolute(text(r, "$.images[0]")))


def autobazar(pages: DataFrame, rate: float, czech_only: bool = True) -> DataFrame:
    """Listings of list and detail pages: the pages' columns and the listing's. Offers abroad, without an id or with an implausible price are left out."""
    r = F.col("record")
    rows = records_of(pages, framework_data(F.col("html")), ["$.props.pageProps.searchRecords.data"], ["$.props.pageProps.advertisement"])
    names = [
        "id", "sefName", "brandValue", "carModelValue", "yearValue", "mileage", "fuelValue", "gearboxValue", "driveValue", "enginePower", "engineCapacity", "bodyworkValue", "title", "clientCreatedAt", "createdAt",
        "finalPrice", "priceCurrent", "price", "unitPrice", *CURRENCY_NAMES,
    ]
    raw = {n: text(r, f"$.{n}") for n in names} | {"seller": seller(r), "place": place(r), "cover": cover(r), "here": in_czechia(r)}

    def offer(t: Column) -> Column:
        codes = [F.when(t[n].isNotNull(), labels.currency(t[n])) for n in CURRENCY_NAMES]
        hint = F.coalesce(*(F.when(c.isin("CZK", "EUR"), c) for c in codes))
        unit = F.when(t["unitPrice"].try_cast("double").cast("int") == 1, "1")
        return let({"currency": hint, "finalPrice": t["finalPrice"], "priceCurrent": t["priceCurrent"], "price": t["price"], "unitPrice": unit}, offer_price)

    def body(t: Column) -> dict[str, Column]:
        def crowns(o: Column) -> Column:
            fx = ingest.import_fields(o["offer"]["amount"], o["offer"]["currency"], F.when(o["offer"]["currency"] == "EUR", F.lit(rate)), F.lit(None).cast("double"), F.lit(None).cast("date"))
            return F.struct(within(fx["price_czk"], CROWNS).alias("price_czk"), o["offer"]["currency"].alias("currency"), fx["price_foreign"].alias("price_foreign"))

        path = F.coalesce(F.concat(F.nullif(F.trim(t["sefName"], F.lit("/")), F.lit("")), F.lit("/")), F.lit(""))
        return {
            "source": F.lit("autobazar_eu"), "external_id": t["id"], "url": F.concat(F.lit("https://www.autobazar.eu/cs/detail/"), path, t["id"], F.lit("/")),
            "make": F.when(F.lower(t["brandValue"]) == "skoda", "Škoda").otherwise(t["brandValue"]), "model": t["carModelValue"], "year": year_of_text(t["yearValue"]),
            "mileage_km": within(F.when(~t["mileage"].rlike(NOT_AN_ODOMETER), whole_number(t["mileage"])), KILOMETRES), "fuel": stated_fuel(t["fuelValue"]), "transmission": ordered(t["gearboxValue"], TRANSMISSIONS),
            "drive": ordered(t["driveValue"], DRIVES), "power_kw": within(whole_number(t["enginePower"]), POWER), "displacement_cc": within(whole_number(t["engineCapacity"]), CUBIC), "body": ordered(t["bodyworkValue"], BODIES),
            "seller_type": t["seller"], "region": t["place"], "price": let({"offer": offer(t)}, crowns), "image_url": t["cover"], "title": filled(redact_contacts(t["title"])),
            "published_at": extract.moment(F.coalesce(t["clientCreatedAt"], t["createdAt"])), "here": t["here"],
        }

    keep = lambda m: m["external_id"].isNotNull() & m["price"]["price_czk"].isNotNull() & (m["here"] | F.lit(not czech_only))
    found = mapped(rows, raw, body, keep)
    return found.select(*(f"{c}.*" if c == "price" else c for c in found.columns if c != "here"))


def repriced(stored: DataFrame, details: DataFrame) -> DataFrame:
    """Stored offers (external_id, price_czk, currency) whose detail page says another price or currency now: old and new ones."""
    new = details.select("external_id", F.col("price_czk").alias("new_price"), F.coalesce("currency", F.lit("EUR")).alias("new_currency"))
    both = stored.select("external_id", F.col("price_czk").alias("old_price"), F.col("currency").alias("old_currency")).join(new, "external_id")
    return both.where((F.col("new_price") != F.col("old_price")) | (F.col("new_currency") != F.coalesce("old_currency", F.lit(""))))


# --- AutoScout24


def autoscout(pages: DataFrame, rate: float) -> DataFrame:
    """Listings of list pages in euros; damaged ones and implausible prices are left out."""
    r = F.col("record")
    rows = records_of(pages, framework_data(F.col("html")), ["$.props.pageProps.listings"], [])
    names = [
        "make", "model", "modelGroup", "modelVersionInput", "variant", "subtitle", "firstRegistration", "mileageInKm", "fuel", "transmission", "drive", "driveTrain", "engineDisplacementInCCM", "bodyType", "body",
        "isCurrentlyDamaged", "accidentDamaged",
    ]
    identity = F.coalesce(text(r, "$.identifier.crossReferenceId"), text(r, "$.identifier.legacyId"), text(r, "$.crossReferenceId"), text(r, "$.id"))
    details = F.transform(
        F.try_variant_get(r, "$.vehicleDetails", "array<variant>"), lambda d: F.struct(*(F.coalesce(F.try_variant_get(d, f"$.{n}", "string"), F.lit("")).alias(n) for n in ("iconName", "ariaLabel", "data")))
    )
    raw = {f"v_{n}": text(r, f"$.vehicle.{n}") for n in names} | {
        "id": identity, "path": text(r, "$.url"), "euros": within(whole_number(text(r, "$.price.priceRaw")), SCOUT_EUROS), "details": details, "tags": F.coalesce(texts(r, "$.specialConditions"), F.array().cast("array<string>")),
        "kind": F.lower(text(r, "$.seller.type")), "city": text(r, "$.location.city"), "image": absolute(text(r, "$.images[0]")), "vehicle": F.try_variant_get(r, "$.vehicle", "map<string,variant>").isNotNull(),
    }

    def body(t: Column) -> dict[str, Column]:
        v = lambda name: t[f"v_{name}"]
        fx = ingest.import_fields(t["euros"], F.lit("EUR"), F.lit(rate), F.lit(None).cast("double"), F.lit(None).cast("date"))
        dated = F.filter(t["details"], lambda d: d["iconName"].contains("calendar") | d["ariaLabel"].rlike("Erstzulassung|(?i:registration)"))
        years = F.filter(F.transform(dated, lambda d: year_of_text(d["data"])), lambda y: y.isNotNull())
        powers = F.filter(F.transform(F.filter(t["details"], lambda d: d["iconName"].contains("speedometer") | d["ariaLabel"].contains("Leistung")), lambda d: scout_power(d["data"])), lambda p: p.isNotNull())
        flags = F.create_map(*(x for n in ("isCurrentlyDamaged", "accidentDamaged") for x in (F.lit(n), F.coalesce(v(n), F.lit("")))))
        title = redact_contacts(filled(F.concat_ws(" ", v("make"), v("model"), F.coalesce(v("modelVersionInput"), v("variant")))))
        names = F.filter(F.transform(F.split(F.coalesce(v("subtitle"), F.lit("")), ","), F.trim), lambda n: n != "")
        address = F.when(F.startswith(t["path"], F.lit("/")), F.concat(F.lit("https://www.autoscout24.de"), t["path"])).when(F.startswith(t["path"], F.lit("http")), t["path"])
        return {
            "source": F.lit("autoscout24"), "external_id": t["id"], "url": F.substring_index(address, "?", 1), "make": filled(v("make")), "model": F.coalesce(v("model"), v("modelGroup")),
            "year": F.coalesce(F.get(years, F.lit(0)), year_of_text(v("firstRegistration"))), "mileage_km": scout_mileage(v("mileageInKm")), "fuel": labels.german_fuel(v("fuel")),
            "transmission": labels.german_transmission(v("transmission")), "drive": labels.german_drive(F.coalesce(v("drive"), v("driveTrain"))), "power_kw": F.try_element_at(powers, F.lit(-1)),
            "displacement_cc": F.coalesce(within(v("engineDisplacementInCCM").try_cast("int"), (500, 10_000)), scout_displacement(v("engineDisplacementInCCM"))), "body": labels.german_body(F.coalesce(v("bodyType"), v("body"))),
            "seller_type": F.when(t["kind"].isin("dealer", "private"), t["kind"]).otherwise("unknown"), "region": t["city"], "price_czk": within(fx["price_czk"], CROWNS), "currency": F.lit("EUR"), "price_foreign": fx["price_foreign"],
            "feature_keys": F.array_distinct(F.filter(F.transform(names, features.known_feature), lambda k: k.isNotNull())), "image_url": t["image"], "title": title,
            "damaged": gates.accident(title, [v("subtitle"), v("modelVersionInput")], F.array().cast("array<string>"), flags, t["tags"]), "vehicle": t["vehicle"],
        }

    keep = lambda m: m["vehicle"] & m["external_id"].isNotNull() & m["url"].isNotNull() & m["price_czk"].isNotNull() & ~m["damaged"]
    return mapped(rows, raw, body, keep).drop("damaged", "vehicle")


# --- TipCars


def products(pages: DataFrame) -> DataFrame:
    """(the pages' columns without html, record): products of the pages' linked data, those of the first item list, else a single one."""
    blocks = F.filter(F.transform(F.regexp_extract_all("html", F.lit(LINKED_DATA), 1), F.try_parse_json), lambda b: b.isNotNull())
    held = pages.withColumn("_blocks", blocks)
    kind = lambda v, k: F.try_variant_get(v, "$['@type']", "string") == k
    lists = F.filter("_blocks", lambda b: kind(b, "ItemList"))
    inner = F.filter(F.transform(items(F.get(lists, F.lit(0)), "$.itemListElement"), lambda e: F.try_variant_get(e, "$.item", "variant")), lambda p: F.coalesce(kind(p, "Product"), F.lit(False)))
    single = F.slice(F.filter("_blocks", lambda b: kind(b, "Product")), 1, 1)
    found = F.when(F.size(lists) > 0, F.coalesce(inner, F.array().cast("array<variant>"))).otherwise(single)
    return held.select(*(c for c in pages.columns if c != "html"), F.explode(found).alias("record"))


def known_make(title: Column) -> Column:
    """The make, as it is written in MAKES, that a title begins with; the longest first."""
    out = F.lit(None).cast("string")
    for make in sorted(MAKES, key=len):
        out = F.when(F.startswith(F.lower(title), F.lit(make.lower())), make).otherwise(out)
    return out


def model_after(title: Column, make: Column) -> Column:
    """The word after the make that a title begins with."""
    rest = F.regexp_replace(F.substr(title, F.length(make) + 1), "^[ \\-–|/]+|[ \\-–|/]+$", "")
    return F.when(F.startswith(F.lower(title), F.lower(make)), F.nullif(F.regexp_replace(F.substring_index(rest, " ", 1), "^[,.;]+|[,.;]+$", ""), F.lit("")))


def tipcars(pages: DataFrame) -> DataFrame:
    """Listings of products in crowns; those without a number in their address or SKU, or with an implausible price, are left out."""
    r = F.col("record")
    given = F.coalesce(text(r, "$.url"), text(r, "$['@id']"))
    pairs = F.transform(
        F.try_variant_get(r, "$.additionalProperty", "array<variant>"), lambda p: F.struct(F.lower(F.trim(F.try_variant_get(p, "$.name", "string"))).alias("name"), F.trim(F.try_variant_get(p, "$.value", "string")).alias("value"))
    )
    raw = {
        "given": given, "props": F.filter(pairs, lambda p: (p["name"] != "") & (p["value"] != "")), "sku": text(r, "$.sku"), "title": text(r, "$.name"), "brand": F.coalesce(text(r, "$.brand.name"), text(r, "$.brand")),
        "model": F.coalesce(text(r, "$.model.name"), text(r, "$.model")), "currency": F.upper(F.coalesce(text(r, "$.offers.priceCurrency"), F.lit("CZK"))), "price": text(r, "$.offers.price"),
        "organization": F.try_variant_get(r, "$.offers.seller['@type']", "string") == "Organization", "locality": text(r, "$.offers.seller.address.addressLocality"),
        "image": F.coalesce(text(r, "$.image"), text(r, "$.image[0]"), *(text(r, f"$.image[0]{k}") for k in (".url", ".contentUrl", "['@id']"))),
    }
    home = F.lit("https://www.tipcars.com")
    number = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))

    def body(t: Column) -> dict[str, Column]:
        def prop(*names: str) -> Column:
            # of repeated names the last one counts
            return F.coalesce(*(F.try_element_at(F.transform(F.filter(t["props"], lambda p: p["name"] == n), lambda p: p["value"]), F.lit(-1)) for n in names))  # noqa: B023

        def first_number(c: Column, *patterns: str, limits: tuple[int, int]) -> Column:
            return let({"c": c}, lambda x: F.coalesce(*(within(whole_number(number(x["c"], p)), limits) for p in patterns)))

        whole = F.when(F.startswith(t["given"], F.lit("//")), F.concat(F.lit("https:"), t["given"])).when(F.startswith(t["given"], F.lit("/")), F.concat(home, t["given"])).otherwise(t["given"])

        def by_address(x: Column) -> Column:
            path = F.lower(F.regexp_replace(x["url"], r"^[a-zA-Z]+://[^/]*|[?#].*$", ""))
            kind = let({"path": path}, lambda y: F.coalesce(*(F.when(F.contains(y["path"], F.lit(f"/{token}/")), label) for token, label in PATH_BODIES.items())))
            fuel = let({"path": path}, lambda y: F.coalesce(*(F.when(F.contains(y["path"], F.lit(f"/{token}/")), labels.catalog_fuel(F.lit(token))) for token in PATH_FUELS)))
            return F.struct(x["url"].alias("url"), number(x["url"], r"(?i)-(\d{5,})\.html(?:[?#].*)?$").alias("number"), kind.alias("body"), fuel.alias("fuel"))

        def named(x: Column) -> Column:
            make = F.coalesce(t["brand"], labels.exact(x["titled"], MAKE_SPELLINGS), x["titled"])
            return F.struct(make.alias("make"), F.coalesce(t["model"], model_after(t["title"], make), model_after(t["title"], x["titled"])).alias("model"))

        def of(x: Column) -> dict[str, Column]:
            picture = F.when(F.startswith(t["image"], F.lit("/")) & ~F.startswith(t["image"], F.lit("//")), F.concat(home, t["image"])).otherwise(t["image"])
            made, mileage = x["made"], F.when(~x["mileage"].rlike(NOT_AN_ODOMETER), x["mileage"])
            return {
                "source": F.lit("tipcars"), "external_id": F.coalesce(number(t["sku"], r"(?:^|-)(\d{5,})$"), x["at"]["number"]), "url": x["at"]["url"], "make": x["name"]["make"], "model": x["name"]["model"],
                "year": F.coalesce(year_of_text(number(made, r"(?:^|\D)\d{1,2}\s*/\s*((?:19|20)\d{2})")), year_of_text(made)), "mileage_km": within(whole_number(number(mileage, r"(?i)(\d[\d\s. ]{0,12})\s*km")), KILOMETRES),
                "fuel": F.coalesce(let({"fuel": prop("palivo", "druh paliva", "typ paliva", "fuel", "typ_paliva")}, lambda y: stated_fuel(y["fuel"])), x["at"]["fuel"]),
                "transmission": ordered(prop("převodovka", "prevodovka", "transmission", "gearbox"), LIST_TRANSMISSIONS), "drive": ordered(prop("pohon", "drive", "pohon kol"), LIST_DRIVES),
                "power_kw": first_number(prop("výkon", "vykon", "výkon motoru", "vykon motoru", "power", "kw"), r"(?i)(\d{2,3})\s*kW\b", r"^(\d{2,3})$", limits=POWER),
                "displacement_cc": first_number(prop("objem", "objem motoru", "zdvihový objem", "zdvihovy objem", "ccm", "cm3"), r"(?i)(\d[\d\s. ]{0,8})\s*(?:ccm|cm\s*3|cm³)", r"^(\d{3,4})$", limits=CUBIC),
                "body": x["at"]["body"], "seller_type": F.when(t["organization"], "dealer").otherwise("unknown"), "region": t["locality"],
                "price_czk": within(F.when(t["currency"].isin("CZK", "KC", "KČ"), whole_number(t["price"])), CROWNS), "image_url": absolute(picture), "title": t["title"],
            }

        made, mileage = prop("uvedení do provozu", "uvedeni do provozu", "rok výroby", "rok vyroby", "výroba", "vyroba"), prop("najeto", "nájezd", "najezd", "tachometr", "mileage")
        known = {"at": let({"url": whole}, by_address), "name": let({"titled": known_make(t["title"])}, named), "made": made, "mileage": mileage}
        return {"listing": let(known, lambda x: F.struct(*(c.alias(n) for n, c in of(x).items())))}

    keep = lambda m: m["listing"]["external_id"].isNotNull() & m["listing"]["price_czk"].isNotNull() & F.coalesce(F.startswith(m["listing"]["url"], F.lit("http")), F.lit(True))
    found = mapped(products(pages), raw, body, keep)
    return found.select(*(f"{c}.*" if c == "listing" else c for c in found.columns))


def with_details(rows: DataFrame, details: DataFrame, key: str = "external_id") -> DataFrame:
    """Listings of list pages with what their detail pages know better; of several details of one listing the greatest value counts."""
    columns = [c for c in details.columns if c in rows.columns and c != key and c not in ("source", "url")]
    once = details.groupBy(key).agg(*(F.max(c).alias(c) for c in columns))
    return ingest.enriched(rows, once, key, columns)
