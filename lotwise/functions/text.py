"""Folding, tokens and parsing of listing texts as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "áàâãäåāăąçćčďđéèêëēėęěğíìîïīįıľĺłñńňóòôõöøōőŕřśšşșťţțúùûüūůűųýÿžźż"
UNKNOWN_WORDS = ["", "neuvedeno", "neznamo", "unknown", "-"]


#: Letters that have no decomposition of their own.
WHOLE = {"đ": "d", "ı": "i", "ł": "l", "ø": "o"}
FOLDED = "".join(WHOLE.get(c, unicodedata.normalize("NFD", c)[0]) for c in ACCENTED)


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of a struct of the values, each of which is computed once however often the body names it."""
    held = F.struct(*(c.alias(n) for n, c in values.items()))
    return F.element_at(F.transform(F.array(held), body), 1)


def fold(c: Column, sharp_s: bool = False) -> Column:
    """Lower case without accents, trimmed; null stays null. `sharp_s` also writes ß as ss."""
    out = F.trim(F.translate(F.lower(c), ACCENTED, FOLDED))
    return F.replace(out, F.lit("ß"), F.lit("ss")) if sharp_s else out


def fold_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def slug(c: Column, gap: str = "-", most: int | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", gap), f"^{gap}+|{gap}+$", "")
    return F.substring(out, 1, most) if most else out


def token_present(haystack: Column, token: Column) -> Column:
    """Whether a folded text holds a folded token, or every part of two letters or more of a compound one."""
    parts = F.filter(F.split(token, r"[\s/-]+"), lambda p: F.length(p) >= 2)
    every = (F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(haystack, p))
    found = F.contains(haystack, token) | every
    return F.when(F.coalesce(token, F.lit("")) == "", True).otherwise(F.coalesce(found, F.lit(False)))


def blank_or_unknown(c: Column) -> Column:
    return F.coalesce(fold(c), F.lit("")).isin(UNKNOWN_WORDS)


def redact_contacts(c: Column) -> Column:
    """E-mail addresses and phone-like runs of digits become [redacted]."""
    mails = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")
    return F.regexp_replace(mails, r"(\+?[0-9]{1,3}[ ])?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{3,4}", "[redacted]")


def whole_number(c: Column) -> Column:
    """The digits of a text as one number; null without any."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def year_of_text(c: Column) -> Column:
    """The first year from 1950 to 2100 written in a text."""
    found = F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1).try_cast("int")
    return F.when(found.between(1950, 2100), found)


def amount(c: Column) -> Column:
    """A positive amount written with European or American separators.

    The later of comma and point is the decimal mark if one or two digits follow it.
    """
    kept = F.regexp_replace(c, "[^0-9,.]", "")
    comma = F.regexp_extract(kept, r"^(.*),([0-9]{1,2})$", 1) != ""
    point = F.regexp_extract(kept, r"^(.*)\.([0-9]{1,2})$", 1) != ""
    european = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    american = F.replace(kept, F.lit(","), F.lit(""))
    plain = F.regexp_replace(kept, "[,.]", "")
    out = F.when(comma, european).when(point, american).otherwise(plain).try_cast("double")
    return F.when(out > 0, out)


def kilowatts(c: Column) -> Column:
    """Power in kW, or in horse powers times 0.73549875; from 20 to 800."""
    text = fold(c)
    kw = F.regexp_extract(text, r"([0-9]{2,3})[ ]*kw\b", 1).try_cast("double")
    ps = F.regexp_extract(text, r"([0-9]{2,3})[ ]*(?:ps|hp|koni|k)\b", 1).try_cast("double")
    out = F.bround(F.coalesce(kw, ps * 0.73549875), 0).cast("int")
    return F.when(out.between(20, 800), out)
