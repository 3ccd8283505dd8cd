"""Equipment: canonical keys of free-form feature names, and tests on sets of features."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

# Canonical keys and the names that mean them.
ALIASES = {
    "keyless": ["keyless_entry", "bezklicove_odemykani", "bezklicovy_pristup"],
    "blind_spot": ["mrtvy_uhel", "blind_spot_monitor", "bsm"],
    "electric_tailgate": ["kufr", "power_tailgate", "elektricky_kufr", "elektricke_otevirani_kufru"],
    "massage_seats": ["masazni_sedadla", "masazni_kresla", "massage"],
    "lane_assist": ["jizda_v_pruhu", "jizda_v_pruzich", "lane_keep", "lane_keeping", "lka"],
    "aux_heater": ["nezavisle_topeni", "webasto", "parking_heater", "standheizung"],
    "tow_hitch": ["tazne_zarizeni", "tazne", "towbar"],
    "panorama": ["panoramaticka_strecha", "panoramic_roof", "sunroof"],
    "parking_camera": ["parkovaci_kamera", "kamera", "rear_camera"],
    "cruise_control": ["tempomat", "adaptive_cruise", "adaptivni_tempomat"],
    "heated_seats": ["vyhrivana_sedadla", "vyhrivan", "heated_seat"],
    "ventilated_seats": ["ventilovana_sedadla", "ventilated_seat"],
    "factory_warranty": ["tovarni_zaruka", "zaruka_vyrobce", "manufacturer_warranty"],
    "air_suspension": ["vzduchovy_podvozek", "air_ride", "pneumatic_suspension"],
}


def canonical(name: Column) -> Column:
    """The canonical key of a feature's name, null for names that no item has."""
    known = {a: key for key, names in ALIASES.items() for a in (key, *names)}
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(sorted(known.items()))))
    return F.try_element_at(table, slug(name, "_"))


def keys(features: Column) -> Column:
    """Canonical keys of features, their own slugs where no item has them; '' for names without a letter."""
    return F.transform(F.coalesce(features, F.array().cast("array<string>")), lambda x: F.coalesce(canonical(x), slug(x, "_")))


def has_all(features: Column, wanted: Column) -> Column:
    """Whether every wanted feature is among a listing's, whatever either calls it; nothing wanted passes."""
    named = lambda c: F.filter(keys(c), lambda k: k != "")
    return F.size(F.array_except(named(wanted), named(features))) == 0


def stable_index(text: Column, choices: int) -> Column:
    """A choice by the 32-bit FNV-1a hash of a text's characters, the same in every run."""
    start = F.lit(2166136261).cast("long")
    step = lambda h, ch: F.pmod(h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(16777619).cast("long"), F.lit(4294967296))
    return F.pmod(F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step), F.lit(choices)).cast("int")
