"""Labels of catalogue feeds and foreign portals: exact names first, then needles within longer ones."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ACCENTED, FOLDED

# Feed names and their labels. The order counts where needles are looked for within longer names.
CATALOG_FUELS = {
    "benzine": "Benzín", "benzín": "Benzín", "benzin": "Benzín", "gasoline": "Benzín", "petrol": "Benzín", "diesel": "Nafta", "nafta": "Nafta",
    "elektriciteit": "Elektro", "electriciteit": "Elektro", "electric": "Elektro", "elektro": "Elektro", "elektrisch": "Elektro", "lpg": "LPG", "cng": "CNG",
    "waterstof": "Vodík", "hydrogen": "Vodík", "vodík": "Vodík", "alcohol": "Ostatní", "lng": "Ostatní", "hybride": "Hybrid", "hybrid": "Hybrid",
}
CATALOG_BODIES = {
    "hatchback": "Hatchback", "sedan": "Sedan", "stationwagen": "Kombi", "stationwagen / combi": "Kombi", "combi": "Kombi", "kombi": "Kombi", "coupe": "Coupe",
    "coupé": "Coupe", "cabriolet": "Cabrio", "cabrio": "Cabrio", "mpv": "MPV", "suv": "SUV", "terreinwagen": "SUV", "terreinvoertuig": "SUV", "limousine": "Sedan",
    "pick-up": "Pick-up", "pickup": "Pick-up", "bestel": "Dodávka", "gesloten opbouw": "Dodávka", "open laadbak": "Pick-up", "chassis cabine": "Dodávka",
    "woonwagen": "Karavan", "caravan": "Karavan", "kampeerwagen": "Karavan", "motorfiets": "Motocykl",
}
BODIES_OFF = ["voor rolstoelen toegankelijk voertuig", "niet geregistreerd", "lijkwagen", "ambulance", "speciale groep", "niet nader aangeduid", "bergingsvoertuig", "voor vervoer voertuigen", "bus"]
CATEGORY_BODIES = {"motorcycle": "Motocykl", "caravan": "Karavan", "van": "Dodávka"}
GERMAN_FUELS = {
    "benzin": "Benzín", "super": "Benzín", "super plus": "Benzín", "super e10": "Benzín", "diesel": "Nafta", "elektro": "Elektro", "electric": "Elektro",
    "hybrid": "Hybrid", "plugin hybrid": "Hybrid", "plug-in-hybrid": "Hybrid", "plug in hybrid": "Hybrid", "erdgas": "CNG", "autogas": "LPG", "lpg": "LPG",
    "cng": "CNG", "wasserstoff": "Vodík", "andere": "Ostatní",
}
GERMAN_TRANSMISSIONS = {
    "schaltgetriebe": "Manuální", "manual": "Manuální", "manuell": "Manuální", "automatik": "Automatická", "automatic": "Automatická",
    "automatisiertes schaltgetriebe": "Automatická", "halbautomatik": "Automatická", "doppelkupplung": "DSG / dvojspojka", "dsg": "DSG / dvojspojka",
    "pdk": "DSG / dvojspojka", "cvt": "CVT",
}
GERMAN_DRIVES = {
    "frontantrieb": "Přední", "front": "Přední", "heckantrieb": "Zadní", "rear": "Zadní", "allrad": "4x4", "allradantrieb": "4x4", "4x4": "4x4", "4wd": "4x4",
    "awd": "4x4", "quattro": "4x4", "xdrive": "4x4", "4motion": "4x4",
}
GERMAN_BODIES = {
    "limousine": "Sedan", "kleinwagen": "Hatchback", "kombi": "Kombi", "estate": "Kombi", "gelaendewagen": "SUV", "geländewagen": "SUV", "suv": "SUV", "van": "MPV",
    "minivan": "MPV", "hochdachkombi": "MPV", "cabrio": "Cabrio", "cabriolet": "Cabrio", "coupe": "Coupe", "coupé": "Coupe", "transporter": "Dodávka",
    "lieferwagen": "Dodávka", "pickup": "Pick-up", "pick-up": "Pick-up",
}
PORTAL_FUELS = {
    "diesel": "Nafta", "petrol": "Benzín", "gasoline": "Benzín", "benzin": "Benzín", "electric": "Elektro", "elektro": "Elektro", "hybrid": "Hybrid", "plugin_hybrid": "Hybrid", "lpg": "LPG", "cng": "CNG", "hydrogen": "Vodík",
}
PORTAL_GEARS = {"manual_gear": "Manuální", "manual": "Manuální", "automatic_gear": "Automatická", "automatic": "Automatická", "semi_automatic": "Automatická"}
PORTAL_BODIES = {
    "estatecar": "Kombi", "estate": "Kombi", "limousine": "Sedan", "smallcar": "Hatchback", "suv": "SUV", "offroad": "SUV", "van": "MPV", "cabrio": "Cabrio", "sportscar": "Coupe", "other": "",
}
ENGINE_TAIL = r"(?i)\s+\d+[.,]\d+\s*(tdi|tsi|tfsi|tdci|scti|dci|hdi|cdi|gti|gtd|i|t|d)?\b.*$"
CURRENCIES = {"KC": "CZK", "KČ": "CZK", "Kč": "CZK", "CZ": "CZK", "CZK": "CZK", "EURO": "EUR", "EUR": "EUR", "€": "EUR", "ZL": "PLN", "ZŁ": "PLN", "PLN": "PLN", "$": "USD", "USD": "USD"}
UNSTATED = "Neuvedeno"


def name_key(raw: Column) -> Column:
    """Lower case without accents, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(raw), ACCENTED, FOLDED), r"\s+", " "))


def keyed(table: dict[str, str]) -> dict[str, str]:
    """The table under names without accents, the first of equal ones."""
    out: dict[str, str] = {}
    for name, label in table.items():
        out.setdefault(name.translate(str.maketrans(ACCENTED, FOLDED)), label)
    return out


def exact(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def within(key: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for needle, label in reversed(table):
        out = F.when(F.contains(key, F.lit(needle)), label).otherwise(out)
    return out


def blank(raw: Column) -> Column:
    return F.coalesce(F.trim(raw), F.lit("")) == ""


def catalog_fuel(raw: Column) -> Column:
    """A feed's fuel; names that no needle knows are capitalised, blank ones unstated."""
    key, table = name_key(raw), keyed(CATALOG_FUELS)
    return F.when(blank(raw), UNSTATED).otherwise(F.coalesce(exact(key, table), within(key, list(table.items())), F.initcap(F.trim(raw))))


def catalog_body(raw: Column, category: Column) -> Column:
    """A feed's body; blank ones follow from the category, special vehicles are unstated."""
    key, table = name_key(raw), keyed(CATALOG_BODIES)
    known = F.when(key.isin(BODIES_OFF), UNSTATED).otherwise(F.coalesce(exact(key, table), within(key, list(table.items())), F.lit(UNSTATED)))
    return F.when(blank(raw), F.coalesce(exact(category, CATEGORY_BODIES), F.lit(UNSTATED))).otherwise(known)


def inferred_transmission(name: Column) -> Column:
    key = F.coalesce(name_key(name), F.lit(""))
    automatic = key.rlike("dsg|cvt|automaat|automatic|tiptronic|pdk")
    kind = F.when(F.contains(key, F.lit("cvt")), "CVT").when(F.contains(key, F.lit("dsg")), "DSG / dvojspojka").otherwise("Automatická")
    return F.when(automatic, kind).when(key.rlike("handgeschakeld|manual|manueel"), "Manuální").otherwise(UNSTATED)


def catalog_category(kind: Column, body: Column) -> Column:
    """A register's kind of vehicle as a category; trailers that aren't caravans have none."""
    kind, body = F.coalesce(name_key(kind), F.lit("")), F.coalesce(name_key(body), F.lit(""))
    out = F.when(kind.rlike("motorfiets|bromfiets|driewielig"), "motorcycle").when(body.rlike("woon|caravan|kampeer"), "caravan")
    return out.when(F.contains(kind, F.lit("aanhangwagen")), F.lit(None)).when(kind.isin("bedrijfsauto", "bus"), "van").when(kind == "personenauto", "passenger")


def clean_model(raw: Column, make: Column) -> Column:
    """A model's name without its make, power and engine tails; three words at most; capitals only become title case."""
    name, prefix = F.coalesce(F.trim(raw), F.lit("")), F.concat(F.upper(F.trim(make)), F.lit(" "))
    name = F.when(F.startswith(F.upper(name), prefix), F.trim(F.substr(name, F.length(prefix)))).otherwise(name)
    name = F.regexp_replace(name, r"\s+", " ")
    for tail in (r"\s+\d{2,4}\s*k[wW]\b.*$", ENGINE_TAIL, r"(?i)\s+\d+[.,]\d+\s*v\d\b.*$", r"(?i)\s+v[68]\b.*$"):
        name = F.trim(F.regexp_replace(name, tail, ""))
    words = F.array_join(F.slice(F.split(name, " "), 1, 3), " ")
    shouted = (words == F.upper(words)) & (words != F.lower(words))
    return F.when(F.replace(name, F.lit(" "), F.lit("")).rlike(r"^\d{3,}$"), name).when(shouted, F.initcap(words)).otherwise(words)


def german(raw: Column, table: dict[str, str], needles: bool) -> Column:
    """A German portal's name: exact, else by the longest needle within it if these are asked for; null for unknown ones."""
    key, table = name_key(raw), keyed(table)
    found = exact(key, table)
    if needles:
        found = F.coalesce(found, within(key, sorted(table.items(), key=lambda x: -len(x[0]))))
    return F.when(~blank(raw), found)


def german_fuel(raw: Column) -> Column:
    return F.coalesce(german(raw, GERMAN_FUELS, False), F.when(~blank(raw), F.nullif(catalog_fuel(raw), F.lit(UNSTATED))))


def german_transmission(raw: Column) -> Column:
    return german(raw, GERMAN_TRANSMISSIONS, True)


def german_drive(raw: Column) -> Column:
    return german(raw, GERMAN_DRIVES, True)


def german_body(raw: Column) -> Column:
    return F.coalesce(german(raw, GERMAN_BODIES, False), F.when(~blank(raw), F.nullif(catalog_body(raw, F.lit("passenger")), F.lit(UNSTATED))))


def seller_type(premise: Column, hints: Column) -> Column:
    """dealer by a premise or a company's words, private if there are other words, else unknown."""
    company = F.lower(F.coalesce(hints, F.lit(""))).rlike(r"autosalon|autobazar|s\.r\.o|a\.s\.|dealer")
    return F.when(~blank(premise) | company, "dealer").when(F.coalesce(hints, F.lit("")) != "", "private").otherwise("unknown")


def currency(raw: Column) -> Column:
    """A currency's code: known spellings, else its letters; crowns for blank ones."""
    letters = F.upper(F.regexp_replace(F.trim(raw), "[^A-Za-z]", ""))
    return F.when(blank(raw), "CZK").otherwise(F.coalesce(exact(F.trim(raw), CURRENCIES), exact(letters, CURRENCIES), F.nullif(letters, F.lit("")), F.lit("CZK")))


def portal_fuel(raw: Column) -> Column:
    """A portal's code of a fuel, else its German name."""
    return F.coalesce(exact(F.translate(F.lower(F.trim(raw)), "-", "_"), PORTAL_FUELS), german_fuel(raw))


def portal_transmission(raw: Column) -> Column:
    return F.coalesce(exact(F.translate(F.lower(F.trim(raw)), "-", "_"), PORTAL_GEARS), german_transmission(F.translate(raw, "_", " ")))


def portal_body(raw: Column) -> Column:
    """A portal's code of a body, else its German name; the code for others has none."""
    code = exact(F.translate(F.lower(F.trim(raw)), "-_", ""), PORTAL_BODIES)
    return F.when(code.isNotNull(), F.nullif(code, F.lit(""))).otherwise(german_body(raw))
