"""Feature names of portals as stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import exact, name_key
from .text import ACCENTED, FOLDED, slug

# Names without accents and the keys they stand for.
NAMES = {
    "kozene sedacky": "leather_seats", "kuze": "leather_seats", "vyhrivana sedadla": "heated_seats", "vyhrivana predni sedadla": "heated_seats", "vyhrivan": "heated_seats",
    "ventilovana sedadla": "ventilated_seats", "ventilovan": "ventilated_seats", "parkovaci kamera": "parking_camera", "kamera": "parking_camera", "360 kamera": "camera_360",
    "parkovaci senzory": "parking_sensors", "navigace": "navigation", "apple car play": "apple_carplay", "apple carplay": "apple_carplay", "android auto": "android_auto",
    "matrix": "matrix_lights", "matrix svetlomety": "matrix_lights", "led svetlomety": "led_lights", "xenonove svetlomety": "xenon_lights", "keyless": "keyless",
    "keyless entry": "keyless", "keyless go": "keyless", "bezklicove odemykani": "keyless", "bezklicovy pristup": "keyless", "sportline": "sportline", "rs": "rs_package",
    "m sport": "m_sport", "amg": "amg", "s-line": "s_line", "s line": "s_line", "4x4": "awd", "pohon vsech kol": "awd", "quattro": "awd", "xdrive": "awd", "4motion": "awd",
    "servisni knizka": "service_book", "tepelne cerpadlo": "heat_pump", "adaptivni tempomat": "cruise_control", "tempomat": "cruise_control", "panorama": "panorama",
    "panoramaticka strecha": "panorama", "tazne zarizeni": "tow_hitch", "tazne": "tow_hitch", "head-up display": "hud", "head up display": "hud", "hud": "hud", "abs": "abs", "esp": "esp",
    "mrtvy uhel": "blind_spot", "hlidani mrtveho uhlu": "blind_spot", "blind spot": "blind_spot", "bsm": "blind_spot", "elektricke otevirani kufru": "electric_tailgate",
    "elektricky kufr": "electric_tailgate", "el kufr": "electric_tailgate", "power tailgate": "electric_tailgate", "vyklopne viko": "electric_tailgate", "masazni sedadla": "massage_seats",
    "masazni kresla": "massage_seats", "masaz": "massage_seats", "massage": "massage_seats", "jizda v pruhu": "lane_assist", "jizda v pruzich": "lane_assist", "lane assist": "lane_assist",
    "lane keep": "lane_assist", "lane keeping": "lane_assist", "udrzovani v pruhu": "lane_assist", "nezavisle topeni": "aux_heater", "webasto": "aux_heater", "parking heater": "aux_heater",
    "pridavne topeni": "aux_heater", "tovarni zaruka": "factory_warranty", "zaruka vyrobce": "factory_warranty", "manufacturer warranty": "factory_warranty",
    "vzduchovy podvozek": "air_suspension", "vzduchove odpruzeni": "air_suspension", "air suspension": "air_suspension",
    "sitzheizung": "heated_seats", "geheizte sitze": "heated_seats", "sitzbeluftung": "ventilated_seats", "beluftete sitze": "ventilated_seats", "ledersitze": "leather_seats",
    "leder": "leather_seats", "navigationssystem": "navigation", "navigation": "navigation", "navi": "navigation", "panoramadach": "panorama", "panorama-dach": "panorama",
    "schiebedach": "panorama", "abstandstempomat": "cruise_control", "adaptiver tempomat": "cruise_control", "einparkhilfe": "parking_sensors", "parkassistent": "parking_sensors",
    "ruckfahrkamera": "parking_camera", "parkkamera": "parking_camera", "spurhalteassistent": "lane_assist", "spurassistent": "lane_assist", "totwinkelassistent": "blind_spot",
    "blindspot": "blind_spot", "schlusseloses zugangssystem": "keyless", "anhangerkupplung": "tow_hitch", "anhaengerkupplung": "tow_hitch", "standheizung": "aux_heater",
    "luftfederung": "air_suspension", "massagesitze": "massage_seats", "elektrische heckklappe": "electric_tailgate",
}
HINTS = [
    "panorama", "panoramatick", "sportline", "tažné", "tazne", "kamera", "navigace", "matrix", "keyless", "carplay", "android auto", "vyhřívan", "vyhrivan", "ventilovan", "kůže", "kuze",
    "tepelné čerpadlo", "tepelne cerpadlo", "4x4", "quattro", "xdrive", "4motion", "m sport", "amg", "s-line", "rs", "tempomat", "mrtvý úhel", "mrtvy uhel", "blind spot", "masáž", "masaz",
    "jízda v pruhu", "jizda v pruhu", "lane assist", "lane keep", "nezávislé topení", "nezavisle topeni", "webasto", "tovární záruka", "tovarni zaruka", "záruka výrobce",
    "vzduchový podvozek", "vzduchovy podvozek", "elektrický kufr", "elektricky kufr", "el. kufr", "power tailgate",
]
LONGEST_FIRST = sorted(NAMES, key=lambda n: -len(n))


def known_feature(name: Column) -> Column:
    """The key of a name, or of the longest known one within it; null for others."""
    key = name_key(name)
    found = F.lit(None).cast("string")
    for alias in reversed(LONGEST_FIRST):
        found = F.when(F.contains(key, F.lit(alias)), NAMES[alias]).otherwise(found)
    return F.coalesce(exact(key, NAMES), found)


def feature_key(name: Column) -> Column:
    """A known feature's key, else a name of its own made of the text; null for blank ones."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.coalesce(known_feature(name), slug(name, "_", 64)))


def key_of_hint(hint: str) -> str:
    bare = hint.translate(str.maketrans(ACCENTED, FOLDED))
    return NAMES.get(bare) or next((NAMES[n] for n in LONGEST_FIRST if n in bare), bare.replace(". ", "_").replace(" ", "_"))


def features_of_text(text: Column) -> Column:
    """Keys of the features that a text hints at, each once, in the order of the hints."""
    low = F.lower(text)
    found = F.array(*(F.when(F.contains(low, F.lit(h)), key_of_hint(h)) for h in HINTS))
    return F.array_distinct(F.filter(found, lambda k: k.isNotNull()))
