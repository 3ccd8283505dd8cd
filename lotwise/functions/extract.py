"""Attributes from the free text of an advertisement: ordered patterns, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# Label and pattern, in order; patterns ignore case.
FUELS = [
    ("Hybrid", r"\bplug[-\s]?in\b|\bphev\b|\bhybrid\b|\bmhev\b"), ("Elektro", r"\belektro\b|\belectric\b|\bbev\b"), ("LPG", r"\blpg\b"), ("CNG", r"\bcng\b"),
    ("Nafta", r"\bnafta\b|\bdiesel\b|\btdi\b|\bhdi\b|\bdci\b|\bbluehdi\b|\bcdti\b"), ("Benzín", r"\bbenz[ií]n\b|\btsi\b|\btfsi\b|\bgdi\b|\bmpi\b|\bfsi\b"),
]
TRANSMISSIONS = [("Automatická", r"\bautomatick|\bautomat\b|\bdsg\b|\bpdk\b|\bcvt\b|\btiptronic\b|\be[- ]?tronik\b"), ("Manuální", r"\bmanuál|\bmanual|\bp[řr]evodovka\s+manu")]
BODIES = [
    ("Kombi", r"\b(?:combi|kombi)\b"), ("Sedan", r"\bsedan\b|\blimuz[ií]na\b"), ("Hatchback", r"\bhatchback\b|\bliftback\b"), ("SUV", r"\bsuv\b|\bcrossover\b"),
    ("Coupe", r"\b(?:coup[eé]|kupe)\b"), ("Cabrio", r"\b(?:cabrio|kabriolet|cabriolet)\b"), ("MPV", r"\bmpv\b|\bvan\b|\bmonovolum"), ("Pick-up", r"\bpick[-\s]?up\b"),
]
DRIVES = [("4x4", r"\b4x4\b|\bquattro\b|\bxdrive\b|\b4motion\b|\b4wd\b|\bawd\b|\bpohon\s+v[šs]ech\s+kol\b")]
ENGINES = "tsi|tfsi|tdi|hdi|dci|gdi|mpi|fsi|cdti|bluehdi|multijet|ecoboost|skyactiv"
CUBIC = (600, 8000)
CONTACT = r"(?i)(\b(tel|telefon|mobil|email|e-mail)\b|@|\d{6,}|\+?\d[\d\s/-]{8,}\d|\bul\.?\s|\bulice\b)"


def labelled(text: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(table):
        out = F.when(text.rlike("(?iu)" + pattern), label).otherwise(out)
    return out


def displacement(text: Column) -> Column:
    """Cubic centimetres: stated with their unit, else litres before an engine family's name."""
    stated = F.regexp_extract(text, r"(?i)\b(\d{3,4})\s*(?:ccm|cm\s*3|cm³|cm3)\b", 1).try_cast("int")
    litres = F.regexp_extract(text, rf"(?i)\b([1-6][.,]\d)\s*(?:{ENGINES})\b", 1)
    by_litres = F.round(F.replace(litres, F.lit(","), F.lit(".")).try_cast("double") * 1000).cast("int")
    return F.coalesce(F.when(stated.between(*CUBIC), stated), F.when(by_litres.between(*CUBIC), by_litres))


def region(raw: Column) -> Column:
    """A place's name without its post code; null for addresses and contacts."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^\d{3}\s*\d{2}\s*", ""))
    name = F.trim(F.substring_index(bare, "(", 1))
    bad = bare.rlike(CONTACT) | name.rlike(r"\d{5,}") | (name == "")
    return F.when(~F.coalesce(bad, F.lit(True)), name)


def moment(raw: Column) -> Column:
    """An ISO 8601 time; without a zone it is UTC. Null for blank and other texts."""
    return F.try_to_timestamp(F.when(F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(raw)))


def title_hits(title: Column, tokens: list[Column]) -> Column:
    """How many of the tokens a folded title holds, with all their parts; short and numeric ones don't count."""
    def hit(raw: Column) -> Column:
        token = fold(raw)
        parts = F.filter(F.split(token, r"[\s/-]+"), lambda p: F.length(p) >= 2)
        held = F.when(F.size(parts) > 1, F.forall(parts, lambda p: F.contains(title, p))).otherwise(F.contains(title, token))
        return F.when((F.length(token) >= 2) & ~token.rlike(r"^\d+$") & held, 1).otherwise(0)

    total = F.lit(0)
    for token in tokens:
        total = total + hit(token)
    return total


def usable_cover(url: Column) -> Column:
    """Whether a picture's address is absolute and no drawing or logo."""
    value = F.trim(url)
    whole = F.lower(F.when(F.startswith(value, F.lit("//")), F.concat(F.lit("https:"), value)).otherwise(value))
    return F.coalesce(whole.rlike("^https?://") & ~F.endswith(whole, F.lit(".svg")) & ~F.contains(whole, F.lit("bazos.svg")) & ~F.contains(whole, F.lit("/kosik.svg")), F.lit(False))


def guessed_cover(external_id: Column) -> Column:
    """Where a portal keeps the first picture of a numbered advertisement."""
    number = F.trim(external_id)
    return F.when(number.rlike(r"^\d+$"), F.concat(F.lit("https://www.bazos.cz/img/1/"), F.right(number, F.lit(3)), F.lit("/"), number, F.lit(".jpg")))
