"""Vocabularies of vehicle attributes: ordered patterns over folded text, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_or_unknown, fold

# Label, pattern over the folded text, in order.
FUELS = [
    ("Elektro", "elektro|electric|battery|bev"),
    ("Hybrid", "hybrid|phev|mhev"),
    ("Benzín+LPG", r"benz.*lpg|lpg.*benz|ba[ ]*[+]?[ ]*lpg"),
    ("LPG", r"\blpg\b"),
    ("CNG", r"\bcng\b|zemni plyn|natural gas"),
    ("Nafta", r"nafta|diesel|nm\b|gasoil"),
    ("Benzín", r"benz|gasoline|petrol|ba[ ]*9|ba95|ba98"),
]
BODIES = [
    ("Kombi", r"\bkombi\b|\bcombi\b|\bwagon\b|\bestate\b"),
    ("Hatchback", r"\bhatchback\b|\bhatch\b"),
    ("Sedan", r"\bsedan\b|\blimousine\b|\blimuzina\b"),
    ("SUV", r"\bsuv\b|\bterenn"),
    ("MPV", r"\bmpv\b|\bvan\b|\bminivan\b"),
    ("Coupe", r"\bcoupe\b"),
    ("Cabrio", r"\bcabrio|\bconvertible\b"),
    ("Pick-up", r"\bpick[ -]?up\b"),
    ("Dodávka", r"\bdodavka\b|\bcargo\b"),
]
TRANSMISSIONS = [
    ("DSG / dvojspojka", "dsg|dct|dual.?clutch|dvojspoj"),
    ("CVT", "cvt|variator"),
    ("Automatická", "auto"),
    ("Manuální", r"manual|mt\b"),
]
DRIVES = [
    ("4×4 / AWD", "awd|4x4|4wd|all.?wheel|vsech"),
    ("Přední", "fwd|predni|front"),
    ("Zadní", "rwd|zadni|rear"),
]
FUEL_KEYS = {"Elektro": "elektro", "Hybrid": "hybrid", "Benzín+LPG": "benzin+lpg", "LPG": "lpg", "CNG": "cng", "Nafta": "nafta", "Benzín": "benzin"}
BODY_KEYS = {"Kombi": "kombi", "Hatchback": "hatchback", "Sedan": "sedan", "SUV": "suv", "MPV": "mpv", "Coupe": "coupe", "Cabrio": "cabrio", "Pick-up": "pick-up", "Dodávka": "dodavka"}
TRANSMISSION_KEYS = {"DSG / dvojspojka": "dsg", "CVT": "cvt", "Automatická": "automatic", "Manuální": "manual"}
DRIVE_KEYS = {"4×4 / AWD": "awd", "Přední": "fwd", "Zadní": "rwd"}
DRIVE_EXTRA = [("awd", "quattro|xdrive|4motion")]
#: Wanted and offered transmissions that go together although they differ.
COMPATIBLE = [("automatic", "dsg"), ("automatic", "cvt"), ("dsg", "automatic"), ("cvt", "automatic")]


def first_match(folded: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(table):
        out = F.when(folded.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def label_of(raw: Column, table: list[tuple[str, str]]) -> Column:
    return first_match(fold(raw), table)


def key_of(raw: Column, table: list[tuple[str, str]], keys: dict[str, str]) -> Column:
    renamed = [(keys[label], pattern) for label, pattern in table]
    return F.when(~blank_or_unknown(raw), first_match(fold(raw), renamed))


def fuel_key(raw: Column) -> Column:
    """A fuel's key; texts that no pattern knows are their own key, blank and unknown ones null."""
    return F.when(~blank_or_unknown(raw), F.coalesce(key_of(raw, FUELS, FUEL_KEYS), fold(raw)))


def body_key(raw: Column) -> Column:
    return key_of(raw, BODIES, BODY_KEYS)


def transmission_key(raw: Column) -> Column:
    return key_of(raw, TRANSMISSIONS, TRANSMISSION_KEYS)


def drive_key(raw: Column) -> Column:
    return F.coalesce(key_of(raw, DRIVES, DRIVE_KEYS), first_match(fold(raw), DRIVE_EXTRA))


def transmissions_agree(want: Column, have: Column) -> Column:
    """Unknown on either side passes; an automatic takes its kinds and they take it."""
    pairs = F.lit(False)
    for a, b in COMPATIBLE:
        pairs = pairs | ((want == a) & (have == b))
    return want.isNull() | have.isNull() | (want == have) | pairs
