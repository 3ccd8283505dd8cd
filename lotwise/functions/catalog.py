"""Names of the vehicle catalogue: makes as they are shown, natural keys, engine labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_spaces

# Makes that are written in a way of their own, by folded name. Names whose shown form is the name with a capital are
# left out, since that is what every other name gets; so are accented spellings, since names are folded before they are looked up.
MAKES = {
    "vw": "Volkswagen", "mercedes-benz": "Mercedes-Benz", "mercedes": "Mercedes-Benz", "mercedes-amg": "Mercedes-Benz", "bmw": "BMW", "bmw i": "BMW", "skoda": "Škoda", "citroen": "Citroën",
    "quattro": "Audi", "ford-cng-technik": "Ford", "daimlerchrysler ag": "Chrysler", "daimlerchrysler": "Chrysler", "daimlerchrysler (usa)": "Chrysler", "jaguar cars": "Jaguar", "jaguar land rover": "Land Rover",
    "mc laren": "McLaren", "rolls royce": "Rolls-Royce", "ds": "DS",
}
BLOCKED = ["3a3", "concorde reisemobile gmbh", "b-style & flex-i-trans", "yueda-human horizons"]
#: Company words, which stand alone: "ag" within a name is no reason to drop it.
COMPANY = r"( gmbh\b| ag\b| technik|cng-technik|\(usa\)|\(su\))"


def display_make(raw: Column) -> Column:
    """A make as it is shown; null for companies and blocked names."""
    key = fold_spaces(raw)
    shown = F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(MAKES.items()))), key)
    return F.when(key.isin(BLOCKED) | (key == ""), None).when(shown.isNotNull(), shown).when(key.rlike(COMPANY), None).otherwise(F.initcap(F.regexp_replace(F.trim(raw), r"\s+", " ")))


def natural_key(*parts: Column) -> Column:
    """Folded parts joined by bars, -1 for missing numbers and '' for missing texts."""
    return F.concat_ws("|", *(F.coalesce(fold_spaces(p.cast("string")), F.lit("")) for p in parts))


def engine_label(cubic: Column, kilowatts: Column, fuel: Column, name: Column) -> Column:
    """Like `1968 ccm 110 kW`, of what is known; else the end of the commercial name, else the fuel. Electric cars have no displacement."""
    known = F.concat_ws(" ", F.when((cubic > 0) & ~F.coalesce(fuel == "Elektro", F.lit(False)), F.concat(cubic.cast("string"), F.lit(" ccm"))), F.when(kilowatts > 0, F.concat(kilowatts.cast("string"), F.lit(" kW"))))
    words = F.split(F.regexp_replace(F.trim(name), r"\s+", " "), " ")
    end = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3), " ")
    tail = F.when((end == F.upper(end)) & (end != F.lower(end)), F.initcap(end)).otherwise(end)
    stated = F.when(F.coalesce(fuel, F.lit("Neuvedeno")) != "Neuvedeno", fuel).otherwise("Základní")
    return F.coalesce(F.nullif(known, F.lit("")), F.nullif(tail, F.lit("")), stated)
