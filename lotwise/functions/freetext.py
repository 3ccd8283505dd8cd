"""Year and mileage from the free text of an advertisement.

Every number that may be one is found with its surroundings, and those that stand for something else are rejected by
them: a service at so many kilometres, a range per charge, the end of an inspection's validity. Precision goes before
recall: what stays ambiguous is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matches import matches
from .text import let

# Limits, and patterns over the text as written; they ignore case.
YEAR_LEAST, KM_LEAST, KM_MOST, THOUSANDS_BELOW = 1990, 1_000, 1_500_000, 2_000
YEAR_LABELS = [
    r"rok\s*v[yý]roby\s*:?\s*([12]\d{3})\b",
    r"\bro[čc]n[ií]k\s*:?\s*([12]\d{3})\b",
    r"\brok\s*:?\s*([12]\d{3})\b",
    r"\br\.?\s*v\.?\s*:?\s*([12]\d{3})\b",
    r"\brv\s*:?\s*([12]\d{3})\b",
    r"\bv[yý]roba\s*:?\s*([12]\d{3})\b",
    r"\bv[yý]robeno\s*:?\s*([12]\d{3})\b",
    r"\b(?:1\.?\s*)?regist\w*\s*:?\s*([12]\d{3})\b",
]
YEAR_MONTH = r"\b(0?[1-9]|1[0-2])[./]([12]\d{3})\b"
YEAR_BARE = r"\b(19[9]\d|20[0-3]\d)\b"
YEAR_NOT_AFTER = r"(?:\bstk\b|\btk\b|\btechnick\w*|\bplatn\w*|\bzn[áa]mk\w*|\bpojistk\w*|\bgaranc\w*|\btel\b|\btelefon\w*|\bdo\b)\s*[:.]?\s*$"
YEAR_NOT_NEAR = r"\b(?:stk|tk|zn[áa]mk\w*|pojistk\w*|garanc\w*|tel|telefon|d[áa]lni[čc]n\w*)\b"
MONTH_BEFORE = r"\d{1,2}[./]\s*$"
KM_NUMBER = r"(\d[\d\s. ]{0,11})\s*(tis\.?|tisíc)?"
KM_LABELLED = rf"(?:\bn[áa]jezd\b\s*:?\s*|\bnajeto\b\s*:?\s*|\btachometr\b\s*:?\s*|\bstav\s+(?:tachometru|km)\s*:?\s*|\bkm\s*:?\s*){KM_NUMBER}(?:\s*t?km\b)?"
KM_UNLABELLED = rf"(?<![/\d]){KM_NUMBER}\s*(t?km)\b"
KM_SERVICE_BEFORE = r"(?:\bpo\s+(?:najet[ií]\s+)?|\bv\s+|\bp[řr]i\s+|\brozvody?\s+(?:v|po)\s*)$"
KM_RANGE_BEFORE = r"(?:\b(?:elektrick\w+\s+)?dojezd(?:\s+a[žz])?(?:\s+na(?:\s+(?:n[áa]drž|baterii?))?)?(?:\s+cca)?|\bwltp|\bnedc|\brange|\bbaterie)\s*$"
KM_RANGE_AFTER = r"^\s*(?:\(?\s*)?(?:wltp|nedc|epa)\b"
KM_ODOMETER = r"^(?:n[áa]jezd|najeto|tachometr|stav\s+(?:tachometru|km))\b"
KM_REPAIR_NEAR = r"\b(?:oprav\w*|vym[ěe]n\w*|rozvod\w*)\b"
YEAR_MONTH_LEFT, YEAR_LEFT, KM_LEFT, KM_RIGHT = 24, 28, 64, 16

#: Classes of letters, digits and blanks are those of Unicode, as in the texts.
ANY_CASE = "(?iU)"


def holds(text: Column, pattern: str) -> Column:
    return text.rlike(ANY_CASE + pattern)


def one_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def year(text: Column, this_year: int) -> Column:
    """The year a car was made in: a labelled one, else the first month and year that isn't an expiry, else the only bare year, or
    the only one not in the future. Null for null, empty and ambiguous texts."""

    def plausible(y: Column) -> Column:
        return y.between(YEAR_LEAST, this_year + 1) & y.between(1950, 2100)

    labelled = [F.regexp_extract(text, ANY_CASE + p, 1).try_cast("int") for p in YEAR_LABELS]
    months = F.filter(matches(text, ANY_CASE + YEAR_MONTH, YEAR_MONTH_LEFT, 0), lambda m: ~holds(one_blank(m["left"]), YEAR_NOT_AFTER))
    dated = F.filter(F.transform(months, lambda m: F.right(m["match"], F.lit(4)).cast("int")), plausible)
    bare = F.filter(
        matches(text, ANY_CASE + YEAR_BARE, YEAR_LEFT, 0),
        lambda m: ~reduce(lambda a, b: a | b, (holds(one_blank(m["left"]), p) for p in (MONTH_BEFORE, YEAR_NOT_AFTER, YEAR_NOT_NEAR))),
    )
    years = F.filter(F.transform(bare, lambda m: m["match"].cast("int")), plausible)

    def only(t: Column) -> Column:
        past = F.filter(t["years"], lambda y: y <= this_year)
        several = let({"past": past}, lambda p: F.when(F.size(p["past"]) == 1, F.get(p["past"], F.lit(0))))
        return F.when(F.size(t["years"]) == 1, F.get(t["years"], F.lit(0))).when(F.size(t["years"]) > 1, several)

    alone = let({"years": years}, only)
    # one cheap look keeps texts without four digits together from all the others
    return F.when(text.rlike(r"(?U)\d{4}"), F.coalesce(F.get(F.filter(F.array(*labelled), plausible), F.lit(0)), F.get(dated, F.lit(0)), alone))


def mileage(text: Column) -> Column:
    """Kilometres on the clock: the largest labelled reading, else the largest other one. Null for null and empty texts."""

    def readings(pattern: str) -> Column:
        def stands_for_else(m: Column) -> Column:
            def by(t: Column) -> Column:
                reach = ~holds(m["match"], KM_ODOMETER) & (holds(t["left"], KM_RANGE_BEFORE) | holds(m["right"], KM_RANGE_AFTER))
                return holds(t["left"], KM_SERVICE_BEFORE) | reach | holds(t["left"], KM_REPAIR_NEAR)

            return let({"left": one_blank(m["left"])}, by)

        def value(m: Column) -> Column:
            group = lambda i: F.regexp_extract(m["match"], ANY_CASE + pattern, i)
            number = F.regexp_replace(group(1), r"[^\d]", "").try_cast("long")
            thousands = (group(2) != "") | holds(m["match"], r"tkm\b")
            km = let({"n": number}, lambda t: F.when((t["n"] < THOUSANDS_BELOW) & thousands, t["n"] * 1000).otherwise(t["n"]))
            return let({"km": km}, lambda t: F.when(t["km"].between(KM_LEAST, KM_MOST), t["km"]))

        kept = F.filter(matches(text, ANY_CASE + pattern, KM_LEFT, KM_RIGHT), lambda m: ~stands_for_else(m))
        return F.array_max(F.transform(kept, value))

    named = text.rlike(r"(?iu)km|n[áa]jezd|najeto|tachometr") & text.rlike(r"(?U)\d")
    return F.when(named, F.coalesce(readings(KM_LABELLED), readings(KM_UNLABELLED)))
