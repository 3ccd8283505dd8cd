"""Advertisements of parts and wrecks among those of whole cars: ordered rules over folded headlines.

A headline is the title and the first line of the description; the text below it isn't looked at, since whole cars' service
histories name parts. The rules go from strong to weak, and the first that applies decides: a group of phrases that sell a part,
signs of a whole car on sale, and weak words, which count by the price and by what else the headline says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, let

# Prices, lengths, and patterns over folded text in the order in which they are tried.
LOW_PRICE, CAR_PRICES, HEADLINE_MOST = 20_000, (25_000, 5_000_000), 240
SELL = r"\b(?:prodam|prodavam|nabizim|prodej)\s+"
STRONG = [
    ("nahradni_dily_phrase", r"\bnahradni\s+dily\b|\bdily\s+na\s+|\bbazar\s+dil|\bautodily\b|\bautodilna\b|\bna\s+nahradni\s+dily\b|\bna\s+dily\b"),
    ("rozborka_vrak", r"\brozborka\b|\brozebirka\b|\bvrakovan|\bvrakovist|\bvrak\b|\bautovrak\b|\bdemontaz"),
    (
        "sell_major_unit",
        SELL + r"(?:kompletni\s+)?(?:motor|prevodovk|motorov\w*\s+hlav|turbo|turbodmychad|diferencial|naprava|poloos|vstrikovac|alternator|starter|katalyzator|vyfuk|chladic|kompresor)\b"
        r"|\bmotor\s+na\s+|\bprevodovk[ay]\s+na\s+",
    ),
    (
        "body_panel_part",
        SELL + r"(?:predni\s+|zadni\s+|leve\s+|prav[e]\s+|l\.\s*|p\.\s*)?(?:kapot|naraznik|blatnik|dvere|zrcatko|svetlomet|mask[ayu]|kufr(?:ove)?\s+viko|bocni\s+sklo|celni\s+sklo|strecha)\b"
        r"|\b(?:kapota|naraznik|blatnik)\s+na\s+|\b(?:svetlomet|zrcatko)s?\s+na\s+|\bdvere\s+na\s+",
    ),
    (
        "wheels_tires_main",
        SELL + r"(?:sad[ayu]\s+)?(?:kol|disky|disk[u]|pneu|pneumatik|alu\s*kola|lita\s*kola|zimni\s+kola|letni\s+kola|zimni\s+pneu|letni\s+pneu)\b"
        r"|\bsada\s+(?:kol|disku|pneu|pneumatik)\b|\b\d{2,3}\s*/\s*\d{2,3}\s*r\d{2}\b",
    ),
    (
        "interior_electronics_part",
        SELL + r"(?:predni\s+|zadni\s+)?(?:sedack\w*|palubni\s+desk\w*|volant|radi[oa]|navigaci|navigace|display|displej|ridici\s+jednotk\w*|abs\s+jednotk\w*|generator|alternator)\b",
    ),
]
TITLE_LEAD = (
    r"^(?:(?:prodam|prodavam|nabizim|prodej)\s+)?(?:kompletni\s+|origo\s+|originalni\s+|nove\s+)?(?:sada\s+|sad[ayu]\s+)?"
    r"(?:alu\s*kola|lita\s*kola|zimni\s+kola|letni\s+kola|(?:zimni|letni)\s+alu\s*kola|zimni\s+pneu|letni\s+pneu|\bpneu\b|pneumatik|disky|disku|rafky|felny|kola\s+\d{2}"
    r"|vin\s*(?:tabulk|stitek|plate|znacka)|vyrobni\s+stitek|tazne\s+zarizeni|stresni\s+(?:box|nosic)|autokamera|autoradio|koberec|nosic\s+kol|plachta\s+na\s+auto|ramecek\s+spz|spz\s+ramecek"
    r"|celni\s+sklo|bocni\s+sklo|katalyzator|alternator|starter|airbag|ridici\s+jednotk)"
)
SERVICED = (
    r"\bvymen[eany]\w*\b|\bvymena\b|\bnov[aey]\s+(?:rozvody|spojk|brzd|tlumi|olej|pneumatik|pneu|disky|kola)\b|\brozvody\b|\brozvodov\w*|\bspojk[ay]\b|\bservisn\w*\s+kni[z]\w*|\bserviska\b"
    r"|\bfull\s*servis\b|\bregularne\s+servis|\bstk\b|\bnajeto\b|\bnajezd\b|\btachometr\b|\b1\.\s*majitel\b|\bprvni\s+majitel\b|\bbez\s+nehody\b|\bnebourane\b"
)
WHOLE_CAR = (
    r"\bprodam\b|\bprodavam\b|\bauto\s+na\s+prodej\b|\bna\s+prodej\b|\bcombi\b|\bkombi\b|\bsedan\b|\bhatchback\b|\bsuv\b|\bcoupe\b|\bkabriolet\b|\blimuzina\b|\b\d\.\d\s*(?:tsi|tdi|tfsi|hdi|dci|cdi|gdi|mpi)\b"
    r"|\b\d{2,3}\s*kw\b|\b\d{1,3}\s*tis\.?\s*km\b|\b\d{4,7}\s*km\b|\br\.?\s*v\.?\b|\brv\s*\d{4}\b|\b20[0-2]\d\b|\b199\d\b"
)
WEAK = (
    r"\bdil\b|\bdily\b|\bnahradn|\bmotor\b|\bprevodovk|\bkapot|\bnarazn|\bzrcatk|\bsvetlomet|\bblatnik|\bpoloos|\bnaprav[ay]\b|\balu\s*kola\b|\blita\s*kola\b|\bdisky\b|\brafky\b|\bfelny\b"
)
WEAK_SERVICED = r"vymen\w*\s+(?:\w+\s+){0,3}(?:dil|dily|motor|spojk|rozvod|brzd|tlumi)|(?:dil|dily)\s+vymen|\bnov[e]\s+(?:dily|rozvody|spojky)\b|\boriginalni\s+dily\b"
EQUIPMENT = r"^(?:alu\s*kola|lita\s*kola|disky|rafky|felny)$"


def headline(title: Column, description: Column) -> Column:
    """The title and the description's first line with anything in it, each trimmed; '' where there is neither."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(description, F.lit("")), "[\r\n]"), bare), lambda line: line != "")
    first = F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(HEADLINE_MOST)), F.lit(""))
    return F.array_join(F.filter(F.array(bare(title), first), lambda part: part != ""), "\n")


def folded(text: Column) -> Column:
    return fold(text, sharp_s=True)


def verdict(title: Column, description: Column, price: Column) -> Column:
    """A struct of `reason` and `token`, the words that decided; both null for whole cars and for empty headlines.

    A weak word's reason holds the word. A null price is no evidence either way.
    """
    has = lambda text, pattern: text.rlike("(?U)" + pattern)
    found = lambda text, pattern: F.regexp_extract(text, "(?U)" + pattern, 0)
    none = F.lit(None).cast("struct<reason:string,token:string>")
    reason = lambda name, token: F.struct(name.alias("reason"), token.alias("token"))

    def judged(t: Column) -> Column:
        whole, own, weak = t["whole"], t["own"], F.coalesce(F.nullif(found(t["own"], WEAK), F.lit("")), F.nullif(found(t["whole"], WEAK), F.lit("")))
        out = F.when(whole == "", none)
        for name, pattern in STRONG:
            out = out.when(has(whole, pattern), reason(F.lit(name), found(whole, pattern)))
        out = out.when(has(own, TITLE_LEAD), reason(F.lit("parts_title_lead"), found(own, TITLE_LEAD)))
        return out.otherwise(let({"whole": whole, "own": own, "weak": weak, "car": has(own, WHOLE_CAR) & F.coalesce(price.between(*CAR_PRICES), F.lit(True))}, weakly))

    def weakly(t: Column) -> Column:
        whole, own, weak, car = (t[n] for n in ("whole", "own", "weak", "car"))
        out = F.when(has(whole, SERVICED) & car, none).when(car & ~has(own, WEAK), none).when(weak.isNull() | has(whole, WEAK_SERVICED), none)
        # a weak word in the title of a car at a car's price
        out = out.when(car, none)
        out = out.when(price < LOW_PRICE, reason(F.concat(F.lit("weak_parts_low_price:"), weak), weak)).when(has(weak, EQUIPMENT), none)
        return out.otherwise(reason(F.concat(F.lit("weak_parts_title:"), weak), weak))

    return let({"whole": folded(headline(title, description)), "own": folded(F.coalesce(title, F.lit("")))}, judged)
