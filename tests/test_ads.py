"""Free text, parts, leases and price bands: the rules on single texts, and all documents against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from lotwise.functions import freetext
from lotwise.functions.matches import matches
from lotwise.operators import gates, parts, slices
from lotwise.plans import ads
from lotwise.sources import views

YEAR = 2026


def found(pattern, text):
    return re.compile(pattern, re.I).finditer(text)


def plain_year(text):
    ok = lambda y: 1990 <= y <= YEAR + 1
    flat = lambda m, n: re.sub(r"\s+", " ", text[max(0, m.start() - n) : m.start()])
    hit = lambda p, t: re.search(p, t, re.I)
    for label in freetext.YEAR_LABELS:
        m = next(found(label, text), None)
        if m and ok(int(m[1])):
            return int(m[1])
    for m in found(freetext.YEAR_MONTH, text):
        if ok(int(m[2])) and not hit(freetext.YEAR_NOT_AFTER, flat(m, 24)):
            return int(m[2])
    years = [int(m[1]) for m in found(freetext.YEAR_BARE, text) if ok(int(m[1])) and not any(hit(p, flat(m, 28)) for p in (freetext.MONTH_BEFORE, freetext.YEAR_NOT_AFTER, freetext.YEAR_NOT_NEAR))]
    if len(years) == 1:
        return years[0]
    past = [y for y in years if y <= YEAR]
    return past[0] if len(past) == 1 and len(years) > 1 else None


def plain_mileage(text):
    for pattern in (freetext.KM_LABELLED, freetext.KM_UNLABELLED):
        values = []
        for m in found(pattern, text):
            left, right = re.sub(r"\s+", " ", text[max(0, m.start() - 64) : m.start()]), text[m.end() : m.end() + 16]
            hit = lambda p, t: re.search(p, t, re.I)
            if hit(freetext.KM_SERVICE_BEFORE, left) or hit(freetext.KM_REPAIR_NEAR, left):
                continue
            if not hit(freetext.KM_ODOMETER, m[0]) and (hit(freetext.KM_RANGE_BEFORE, left) or hit(freetext.KM_RANGE_AFTER, right)):
                continue
            n = int(re.sub(r"\D", "", m[1]))
            n = n * 1000 if (m[2] or hit(r"tkm\b", m[0])) and n < 2000 else n
            if 1_000 <= n <= 1_500_000:
                values.append(n)
        if values:
            return max(values)
    return None


TEXTS = {
    "Najeto 185 000 km, r.v. 2018, nafta, automat": (2018, 185_000),
    "Škoda Octavia 3 Combi 1.4 TSI 110 kW\n09/2016 | 134 288 km | Benzín | STK 05/2028 | manuální převodovka": (2016, 134_288),
    "po 8050 km se opravoval motor": (None, None),
    "Po 8 050km se opravoval motor, jinak OK": (None, None),
    "po 120 000 km vyměněny rozvody": (None, None),
    "rozvody v 150000 km, spojka v pořádku": (None, None),
    "při 90000 km výměna oleje": (None, None),
    "Najeto 185 000 km. Po 80 000 km vyměněny rozvody.": (None, 185_000),
    "nájezd 145 tis. km": (None, 145_000),
    "Najeto 98 tis km, r.v. 2015": (2015, 98_000),
    "EQC 400, dojezd 1310 km, r.v. 2020": (2020, None),
    "dojezd až 410 km, WLTP": (None, None),
    "420 km WLTP, pěkné auto": (None, None),
    "Mercedes-Benz EQC 400, dojezd 1310 km, najeto 184.000 km, r.v. 2020": (2020, 184_000),
    "VW ID.3 dojezd WLTP 420 km / 98000 km": (None, 98_000),
    "BMW iX3, dojezd 460 km, najeto 12 000 km": (None, 12_000),
    "stav tachometru 156000": (None, 156_000),
    "Passat B8 ročník 2017 nafta": (2017, None),
    "STK do 05/2026, servisní knížka": (None, None),
    "auto z 2019, dálniční známka 2026": (2019, None),
    "Octavia 2016, najeto 200000 km, platná STK 2027": (2016, 200_000),
    "auto 2015 nebo 2016 dle TP": (None, None),
    "Prodám Octavia. Tel: 777 123 456, email prodej@example.com. Po 8050 km se opravoval motor.": (None, None),
    "  ": (None, None),
    "rok 1960, 2016": (2016, None),
    "2016 " * 300 + "12 000 km " * 300: (None, 12_000),
    "\x01 najeto \x02 12 000 km": (None, 12_000),
}


def test_year_and_mileage_of_texts(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    got = {r["text"]: (r["y"], r["km"]) for r in rows.select("text", freetext.year(F.col("text"), YEAR).alias("y"), freetext.mileage(F.col("text")).alias("km")).collect()}
    assert got == {**TEXTS, None: (None, None)}
    assert all((plain_year(t), plain_mileage(t)) == want for t, want in TEXTS.items() if "\x01" not in t)


def test_documents_with_planted_facts_are_like_the_plain_loop(spark, sf):
    texts = sorted(t for t in TEXTS if "\x01" not in t)
    planted = F.get(F.array(*(F.lit(t) for t in texts)), (F.col("doc_id") % len(texts)).cast("int"))
    docs = views.table(spark, sf, "documents")
    docs = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat_ws(" ", F.substring("text", 1, 900), planted, F.substring("text", 900, 40_000))).alias("text"))
    got = docs.select("text", freetext.year(F.col("text"), YEAR).alias("y"), freetext.mileage(F.col("text")).alias("km")).collect()
    assert [(r["y"], r["km"]) for r in got] == [(plain_year(r["text"]), plain_mileage(r["text"])) for r in got]
    assert sum(r["km"] is not None for r in got) > 50


def test_document_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in views.table(spark, sf, "documents").collect()}
    for r in ads.document_fields(spark, sf).collect():
        text = texts[r["doc_id"]]
        want = plain_year(text), plain_mileage(text), len(list(found(freetext.YEAR_BARE, text))), len(list(found(freetext.KM_UNLABELLED, text)))
        assert tuple(r)[1:] == want


@pytest.mark.parametrize("before, after", [(0, 0), (1, 2), (7, 3), (64, 16)])
def test_matches_know_their_surroundings(spark, before, after):
    text = "a1bb22ccc333" * 6 + "\n4"
    got = spark.range(1).select(matches(F.lit(text), r"\d+", before, after).alias("m")).first()["m"]
    want = [(text[max(0, m.start() - before) : m.start()], m[0], text[m.end() : m.end() + after]) for m in re.finditer(r"\d+", text)]
    assert [(m["left"], m["match"], m["right"]) for m in got] == want


REJECTED = [
    ("Díly na VW Golf 5 1.9 TDI", None, 8000), ("Motor na Škoda Fabia 1.2 HTP", None, 12_000), ("Převodovka na BMW E90 320d", None, 9000), ("Prodám zrcátko levé Octavia 3", None, 1200),
    ("Prodám světlomet pravý Golf 7", None, 3500), ("Bazar dílů BMW E46", None, 500), ("Ford Focus 1.6 na díly", None, 5000), ("Prodám volant s airbagem Golf 6", None, 3000), ("Blatník Fabia", None, 40_000),
    ("ALU kola 17 Octavia", None, 90_000), ("VIN tabulka", None, None),
]
KEPT = [
    ("Škoda Octavia 2.0 TDI 110 kW Combi", "Najeto 185 000 km. Po 180 tkm vyměněny rozvody, spojka OK.", 289_000), ("VW Golf 7 1.4 TSI 92 kW", "Pravidelný servis, vyměněny díly brzd, nové spojky, STK do 2027.", 245_000),
    ("BMW 320d xDrive Touring 140 kW", "Motor bez vůlí, převodovka výborná, najeto 162000 km.", 420_000), ("Toyota Corolla 1.8 Hybrid", "1. majitel, nebourané, STK 11/2027, serviska", 399_000), (None, None, 100_000), ("", "\r\n ", None),
    ("Octavia RS", "x" * 300 + " prodám motor", None),
]


def test_parts_and_whole_cars(spark):
    rows = spark.createDataFrame([(*r, i < len(REJECTED)) for i, r in enumerate([*REJECTED, *KEPT])], "title string, popis string, price long, bad boolean")
    out = rows.select("title", "bad", parts.verdict(F.col("title"), F.col("popis"), F.col("price")).alias("v")).collect()
    assert [r["title"] for r in out if (r["v"] is not None and r["v"]["reason"] is not None) != r["bad"]] == []


def test_leases_by_flag_without_a_text(spark):
    flags = F.create_map(F.lit("isOperatingLease"), F.lit("True"))
    none = F.lit(None).cast("string")
    row = spark.range(1).select(gates.lease_reason(none, none, flags), gates.lease_reason(none, none, F.create_map(F.lit("abs"), F.lit("true"))), gates.lease_reason(F.lit("")))
    assert tuple(row.first()) == ("operating_lease_flag", None, None)


def test_bands_cover_every_price_and_stop_at_single_ones(spark):
    rows = [("new", p) for p in [0, 49_999, 50_000, 7_000_000, 30_000_000, *[123_456] * 9, *range(60_000, 60_040)]] + [("none", None), (None, 5), ("low", -3)]
    out = slices.sliced(spark.createDataFrame(rows, "c string, p long"), "c", "p", wall=4).collect()
    for condition in ("new", "none", "low", None):
        bands = sorted((r["low"], r["high"]) for r in out if r["c"] == condition)
        assert bands[0][0] == 0 and bands[-1][1] is None
        assert all(a[1] + 1 == b[0] for a, b in zip(bands, bands[1:]))  # noqa: B905
    for r in out:
        inside = [p for c, p in rows if c == r["c"] and p is not None and p >= r["low"] and (r["high"] is None or p <= r["high"])]
        assert r["n"] == len(inside) and r["over"] == (r["n"] > 4) and (not r["over"] or r["low"] == r["high"] == 123_456)
    assert slices.sliced(spark.createDataFrame([], "c string, p long"), "c", "p").count() == 0


def test_bands_send_nothing_to_the_driver(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("c"), (F.col("id") * 7919 % 9_000_000).alias("p"))
    out = slices.sliced(rows, "c", "p", wall=4)
    found = [(r["c"], r["low"], r["high"], r["n"]) for r in out.collect()]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sum(n for *_, n in found) == 20_000 and len(found) == len(set(found)) and max(n for *_, n in found) <= 4


def test_phrases_in_a_pages_own_text_are_no_answer(spark, tmp_path):
    import duckdb

    own = ["<title>Seite NICHT  gefunden</title>", "<p>4044708081027813</p>", "40404 ınzerát není", "Access denied", ' \n{"status":"sold"}', "<title>Stránka\nneexistuje</title> Page not found", "x" * 12_000 + "<title>gelöscht</title>", None, "", "<title>a</title>"]
    rows = [(i, "u", own[i // 70 % len(own)]) for i in range(1400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("probe_verdict", "probe_stats", "probe_state"):
        got = ads.QUERIES[name](spark, str(tmp_path)).toPandas()
        want = con.sql(ads.ORACLE_SQL[name]).df()[list(got.columns)]
        assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
