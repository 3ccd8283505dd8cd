"""Gates that keep non-comparable stock out: damage, leases, parts and implausible fields.

Texts are folded first (lower case, no accents, ß as ss), so patterns are plain ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold_spaces, let
from . import parts

# Patterns over folded text, flags of leases and what counts as set.
FINANCE_OPTION = [r"moznost\s+(?:operativniho\s+|financniho\s+)?leasing", r"\bfinancovani\b", r"\blze\s+(?:i\s+)?na\s+splatky", r"\bsplatky\s+mozne", r"\buver\b"]
LEASE_PRODUCT = [
    r"\boperak", r"\bpredplatn", r"na\s+splatky\s+formou\s+operak", r"formou\s+operak", r"kc\s*/\s*mes", r"/\s*mesic", r"mesicni\s+splatka", r"leasingrat", r"eur\s*/\s*(?:monat|month|mes)",
    r"€\s*/\s*(?:monat|month)", r"car\s+subscription", r"autoabo\b", r"operativni\s+pronajem", r"pronajem\s+(?:vozidla|auta|automobilu)",
]
OPERATING_LEASE = [r"operativni\s+leasing", r"operating\s+lease"]
LEASE_FLAGS, LEASE_FLAG_SET = ["operatinglease", "isoperatinglease", "lease", "leasing", "subscription", "carsubscription"], ["1", "true", "yes", "ja", "y"]
YEARS, KILOMETRES, PRICES = (1990, 1), (1, 1_500_000), (5_000, 50_000_000)


def any_of(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(c.rlike("|".join(patterns)), F.lit(False))


# Signs of damage in a folded text, and keys and flags of it.
ACCIDENT_SIGNS = [
    r"\bhavarovan", r"\bhavarie\b", r"\bhavarii\b", r"\bpo\s+nehod", r"\bposkozen", r"\bpo\s+totalce\b", r"\bpo\s+totalni", r"\btotalk[ae]\b", r"\bna\s+nahradni\s+dily\b", r"\bna\s+nahradni\b",
    r"\bdemontovan", r"\bbouran", r"\bvrak\b", r"\bunfallwagen\b", r"\bunfallfahrzeug\b", r"\bunfall\b", r"\bunfallschaden\b", r"\bbeschadig", r"\bbastlerfahrzeug\b",
    r"\bbastler\b", r"\bfrontschaden\b", r"\bheckschaden\b", r"\bgetriebeschaden\b", r"\bmotorschaden\b", r"\btotalschaden\b", r"\baccident[- ]?damaged\b", r"\bsalvage\b", r"\brepairable\s+write[- ]?off\b",
]
ACCIDENT_KEYS = ["accident_damaged", "accident", "damaged", "unfall", "unfallwagen", "bastlerfahrzeug", "totalschaden", "iscurrentlydamaged", "accidentdamaged"]
ACCIDENT_FLAGS = ["iscurrentlydamaged", "currentlydamaged", "accidentdamaged", "hasaccident", "hasaccidents", "accident", "damaged", "isdamaged", "unfallwagen", "unfall", "bastlerfahrzeug"]
ACCIDENT_TAGS = ["accidentdamaged", "accident", "damaged", "unfall", "unfallwagen", "bastlerfahrzeug", "totalschaden", "iscurrentlydamaged"]
TRUE_WORDS = ["1", "true", "yes", "ja", "y", "accident", "damaged", "unfall", "unfallwagen", "accidentdamaged", "bastlerfahrzeug"]


def accident_text(text: Column) -> Column:
    """Whether a text has a sign of damage. The stems come first: few texts have one, and those alone are matched."""
    norm = fold_spaces(text)
    stems = r"havar|nehod|poskoz|total|nahradni|demont|bour|vrak|unfall|beschad|bastl|schaden|accident|salvage|write"
    return F.coalesce(norm.rlike(stems) & norm.rlike("|".join(ACCIDENT_SIGNS)), F.lit(False))


def accident_keys(keys: Column) -> Column:
    """Whether any feature is a key of damage or reads like one."""
    return F.coalesce(F.exists(keys, lambda k: F.replace(fold_spaces(k), F.lit(" "), F.lit("_")).isin(ACCIDENT_KEYS) | accident_text(k)), F.lit(False))


def accident_flags(flags: Column, tags: Column) -> Column:
    """Whether a flag of damage is set (a map of texts), or a tag names damage."""
    bare = lambda c: F.regexp_replace(fold_spaces(c), "[ _-]", "")
    is_set = F.map_filter(flags, lambda k, v: bare(v).isin(TRUE_WORDS) & (bare(k).isin(ACCIDENT_FLAGS) | accident_text(k)))
    return F.coalesce(F.size(is_set) > 0, F.lit(False)) | F.coalesce(F.exists(tags, lambda t: bare(t).isin(ACCIDENT_TAGS) | accident_text(t)), F.lit(False))


def accident(title: Column, texts: list[Column], keys: Column, flags: Column, tags: Column) -> Column:
    out = accident_keys(keys) | accident_flags(flags, tags) | accident_text(title)
    for text in texts:
        out = out | accident_text(text)
    return out


def lease_flag(flags: Column) -> Column:
    """Whether a map of texts sets a flag of leases or subscriptions."""
    bare = lambda c, signs: F.regexp_replace(parts.folded(c), signs, "")
    return F.coalesce(F.size(F.map_filter(flags, lambda k, v: bare(k, "[ _-]").isin(LEASE_FLAGS) & bare(v, " ").isin(LEASE_FLAG_SET))) > 0, F.lit(False))


def lease_reason(title: Column, description: Column | None = None, flags: Column | None = None) -> Column:
    """Offers that are leases or subscriptions, by a flag or the headline; a sale that offers to be financed isn't one."""
    none = F.lit(None).cast("string")
    by_flag = F.lit(False) if flags is None else lease_flag(flags)

    def judged(t: Column) -> Column:
        text = t["text"]
        return F.when(any_of(text, LEASE_PRODUCT), "lease_product").when(any_of(text, OPERATING_LEASE) & ~any_of(text, FINANCE_OPTION), "operating_lease")

    return F.when(by_flag, "operating_lease_flag").otherwise(let({"text": parts.folded(parts.headline(title, none if description is None else description))}, judged))


def field_reason(year: Column, km: Column, price: Column, this_year: int) -> Column:
    """Fields outside their windows; unknown fields pass."""
    out = lambda c, low, high: F.coalesce(~c.between(low, high), F.lit(False))
    late = this_year + YEARS[1]
    return F.when(out(year, YEARS[0], late), "implausible_year").when(out(km, *KILOMETRES), "implausible_mileage").when(out(price, *PRICES), "implausible_price")


def reject(title: Column, description: Column, year: Column, km: Column, price: Column, this_year: int, flags: Column | None = None) -> Column:
    """The first gate's reason, prefixed with the gate: leases, parts, fields. Null passes."""
    prefixed = lambda gate, reason: F.concat(F.lit(f"{gate}:"), reason)
    return F.coalesce(
        prefixed("leasing", lease_reason(title, description, flags)), prefixed("parts", parts.verdict(title, description, price)["reason"]), prefixed("fields", field_reason(year, km, price, this_year))
    )
