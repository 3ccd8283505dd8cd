"""Queries over texts, pages, rates and literal fixtures, each with SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import freetext
from ..functions import money as m
from ..functions import text as t
from ..functions import vocabulary as v
from ..operators import fx, gates
from ..sources import pages, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def literals(spark, values: str, names: str):
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def dealt(spark, sf_dir, values: str, names: str, n: int):
    """The values, numbered from 1, dealt over the parts by their keys; a bounded list of phrases is what is broadcast."""
    parts = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % n + 1).alias("i"))
    return parts.join(F.broadcast(literals(spark, values, names)), "i")


def dealt_same(values: str, names: str, n: int) -> str:
    shown = ", ".join(x.strip() for x in names.split(",")[1:])
    return f"SELECT p_partkey, {shown} FROM part JOIN (VALUES {values}) AS t({names}) ON p_partkey % {n} + 1 = i"


def same(values: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {values}) AS t({names})"


@query("SELECT doc_id, md5(trim(lower(strip_accents(text)))) AS folded FROM documents")
def fold_tokens(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(t.fold(F.col("text"))).alias("folded"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugify(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", t.slug(F.col("p_name"), "_").alias("slug"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g'), '(\+?[0-9]{1,3}[ ])?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{3,4}', '[redacted]', 'g')) AS redacted FROM documents""")
def redact_contacts(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(t.redact_contacts(F.col("text"))).alias("redacted"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def page_title(spark, sf_dir):
    return pages.titles(views.table(spark, sf_dir, "pages"))


FUEL_IN = "(1,'Nafta'),(2,'Benzín + LPG'),(3,'Plug-in hybrid'),(4,'elektromotor'),(5,'LPG'),(6,'CNG'),(7,'BA95'),(8,'neuvedeno'),(9,'vodík'),(10,NULL)"
FUEL_OUT = "(1,'Nafta','nafta'),(2,'Benzín+LPG','benzin+lpg'),(3,'Hybrid','hybrid'),(4,'Elektro','elektro'),(5,'LPG','lpg'),(6,'CNG','cng'),(7,'Benzín','benzin'),(8,NULL,NULL),(9,NULL,'vodik'),(10,NULL,NULL)"


@query(dealt_same(FUEL_OUT, "i, label, key", 10))
def vocab_fuel(spark, sf_dir):
    return dealt(spark, sf_dir, FUEL_IN, "i, raw", 10).select("p_partkey", v.label_of(F.col("raw"), v.FUELS).alias("label"), v.fuel_key(F.col("raw")).alias("key"))


BODY_IN = "(1,'Octavia Combi'),(2,'coupé'),(3,'Limuzína'),(4,'pick up'),(5,'terénní'),(6,'Dodávka'),(7,'roadster'),(8,'minivan')"


@query(dealt_same("(1,'Kombi','kombi'),(2,'Coupe','coupe'),(3,'Sedan','sedan'),(4,'Pick-up','pick-up'),(5,'SUV','suv'),(6,'Dodávka','dodavka'),(7,NULL,NULL),(8,'MPV','mpv')", "i, label, key", 8))
def vocab_body(spark, sf_dir):
    return dealt(spark, sf_dir, BODY_IN, "i, raw", 8).select("p_partkey", v.label_of(F.col("raw"), v.BODIES).alias("label"), v.body_key(F.col("raw")).alias("key"))


GEARS = ["manual", "automatic", "dsg", "cvt", None]


GEAR = "['manual', 'automatic', 'dsg', 'cvt', NULL]"


@query(f"""SELECT a AS want, b AS have, count(*) AS n, CAST(a IS NULL OR b IS NULL OR a = b OR (a = 'automatic' AND b IN ('dsg', 'cvt')) OR (a IN ('dsg', 'cvt') AND b = 'automatic') AS INT) AS ok
  FROM (SELECT {GEAR}[l_partkey % 5 + 1] AS a, {GEAR}[l_orderkey % 5 + 1] AS b FROM lineitem) x GROUP BY a, b""")
def transmission_compat(spark, sf_dir):
    """Which gearboxes stand for each other, over the pairs that lines make."""
    gear = lambda c: F.get(F.array(*(F.lit(g) for g in GEARS)), (F.col(c) % 5).cast("int"))
    pairs = views.table(spark, sf_dir, "lineitem").select(gear("l_partkey").alias("want"), gear("l_orderkey").alias("have")).groupBy("want", "have").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("ok", F.coalesce(v.transmissions_agree(F.col("want"), F.col("have")), F.lit(False)).cast("int"))


@query("""SELECT doc_id, CAST(coalesce(regexp_matches(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'), '\\b(havarovan|havarie\\b|havarii\\b|po nehod|poskozen|po totalce\\b|po totalni|totalka\\b|totalke\\b|na nahradni dily\\b|demontovan|bouran|vrak\\b|unfall(wagen|fahrzeug|schaden)?\\b|beschadig|bastler(fahrzeug)?\\b|(front|heck|getriebe|motor|total)schaden\\b|accident[- ]?damaged\\b|salvage\\b)'), false) AS INT) AS damaged FROM documents""")
def accident_gate(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", gates.accident_text(F.col("text")).cast("int").alias("damaged"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN n + 0.25 WHEN 1 THEN n + 0.5 WHEN 4 THEN NULL ELSE n END AS amount, CASE o_orderkey % 5 WHEN 0 THEN n * 100 + 25 WHEN 1 THEN n * 10 + 5 WHEN 4 THEN NULL ELSE n END AS digits
 FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders) o""")
def parse_money(spark, sf_dir):
    """Amounts as texts of several kinds write them, and their digits."""
    n, key = F.floor("o_totalprice"), F.col("o_orderkey") % 5
    apart = lambda mark: F.replace(F.format_number(n, 0), F.lit(","), F.lit(mark))
    raw = F.when(key == 0, F.concat(n, F.lit(".25"))).when(key == 1, F.concat(apart(" "), F.lit(",5"))).when(key == 2, F.concat(apart("."), F.lit(" Kč"))).when(key == 3, F.concat(n, F.lit(" EUR"))).otherwise("dohodou")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", t.amount(raw).alias("amount"), t.whole_number(raw).alias("digits"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN CAST(year(o_orderdate) AS INT) END AS year FROM orders")
def parse_int_year(spark, sf_dir):
    """The first year in texts of several kinds."""
    y, key = F.year("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(key == 0, F.date_format("o_orderdate", "MM/yyyy")).when(key == 1, F.concat(F.lit("auto z "), y)).when(key == 2, "bez roku").otherwise(F.concat(y, F.lit(" nebo "), y + 1))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", t.year_of_text(raw).alias("year"))


@query("SELECT o_orderkey, CAST(n * 1000 AS BIGINT) AS km, CAST(40 + o_custkey % 200 AS INT) AS kw FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 + o_custkey % 300 END AS n FROM orders) o")
def extract_mileage(spark, sf_dir):
    """Labelled mileage and power from one text."""
    o, n = views.table(spark, sf_dir, "orders"), F.col("o_custkey") % 300 + 1
    km = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("dojezd až "), n, F.lit(" km, WLTP"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("najeto "), n, F.lit(" tkm"))).otherwise(F.concat(F.lit("Nájezd: "), n, F.lit(" tis. km")))
    raw = F.concat(km, F.lit(", "), 40 + F.col("o_custkey") % 200, F.lit(" kW"))
    return o.select("o_orderkey", freetext.mileage(raw).alias("km"), t.kilowatts(raw).alias("kw"))


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d, CAST(20 + month(o_orderdate) AS DOUBLE) AS czk FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS quoted_on, c AS currency, CAST(czk / r AS DECIMAL(12,6)) AS czk_per_unit FROM m, (VALUES ('EUR', 1.0::DOUBLE), ('PLN', 4.25), ('USD', 1.10)) x(c, r)""")
def ecb_cross_rates(spark, sf_dir):
    """Crown rates of every month that has an order, crossed from documents that quote per euro."""
    months = views.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("d")).distinct()
    cube = lambda code, rate: F.concat(F.lit(f'<Cube currency="{code}" rate="'), rate, F.lit('"/>'))
    xml = F.concat(F.lit('<Envelope><Cube><Cube time="'), F.col("d"), F.lit('">'), cube("USD", F.lit("1.10")), cube("CZK", 20 + F.month("d")), cube("PLN", F.lit("4.25")), F.lit("</Cube></Cube></Envelope>"))
    return fx.cross_rates(months.select(xml.alias("xml"))).withColumn("quoted_on", F.col("quoted_on").cast("string"))


FXV = "(DATE '2000-01-01', 'EUR', 24.000000), (DATE '2000-02-01', 'EUR', 25.000000), (DATE '2000-02-01', 'PLN', 5.750000), (DATE '2000-01-15', 'USD', 22.100000)"


@query(f"""WITH r AS (SELECT * FROM (VALUES {FXV}) AS r(quoted_on, currency, rate)), now AS (SELECT * FROM r WHERE quoted_on = (SELECT max(quoted_on) FROM r)),
 l AS (SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'CZK' WHEN 1 THEN 'eur' WHEN 2 THEN 'PLN' ELSE 'USD' END AS currency, o_totalprice AS price_foreign, CAST(o_orderdate AS DATE) AS fx_rate_date, CAST(floor(o_totalprice) AS BIGINT) AS price_czk FROM orders)
SELECT id, price_czk AS old_price, CAST(floor((price_foreign * rate::DOUBLE + 50) / 100) * 100 AS BIGINT) AS new_price, CAST(quoted_on AS VARCHAR) AS rate_date, CAST(floor((price_foreign * rate::DOUBLE + 50) / 100) * 100 <> price_czk AS INT) AS changed
FROM l JOIN now ON upper(l.currency) = now.currency WHERE l.currency <> 'CZK' AND price_foreign > 0 AND fx_rate_date < quoted_on""")
def latest_rate_requote(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    currency = F.element_at(F.array(F.lit("CZK"), F.lit("eur"), F.lit("PLN"), F.lit("USD")), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("id"), currency.alias("currency"), F.col("o_totalprice").alias("price_foreign"), F.to_date("o_orderdate").alias("fx_rate_date"), F.floor("o_totalprice").cast("long").alias("price_czk"))
    quoted = fx.requote(rows, literals(spark, FXV, "quoted_on, currency, czk_per_unit"))
    return quoted.withColumn("rate_date", F.col("rate_date").cast("string"))


@query(f"""WITH r AS (SELECT * FROM (VALUES {FXV}) AS r(quoted_on, currency, rate)), a AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT id, a.currency, CAST(day AS VARCHAR) AS day, CAST(r.rate AS DOUBLE) AS rate FROM a ASOF LEFT JOIN r ON a.currency = r.currency AND a.day >= r.quoted_on""")
def rate_as_of(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "EUR").otherwise("USD").alias("currency"), F.to_date("o_orderdate").alias("day"))
    found = fx.rate_as_of(o, literals(spark, FXV, "quoted_on, currency, czk_per_unit"))
    return found.withColumn("day", F.col("day").cast("string"))


PAGE = """<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"pages":12,"listings":[{"id":"a%s","make":"Opel","model":"Corsa","year":2019,"mileage":"148 500 km","price":380,"currency":"EUR","fuel":"Benzin","region":"Berlin","damaged":false},{"id":"b","make":"Opel","price":100,"damaged":true}]}}}</script></html>"""


def page_of(template: str):
    """The template with a part's key in its blank; every seventh part has a page without data, every eleventh none."""
    before, after = template.split("%s", 1)
    key = F.col("p_partkey")
    return F.when(key % 11 == 0, None).when(key % 7 == 0, "<html></html>").otherwise(F.concat(F.lit(before), key, F.lit(after)))


@query("SELECT p_partkey AS page_id, 'a' || p_partkey AS id, 'Opel' AS make, 'Corsa' AS model, CAST(2019 AS INT) AS year, '148 500 km' AS mileage, 380.0::DOUBLE AS price, 'EUR' AS currency, 'Benzin' AS fuel, 'Berlin' AS region FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def embedded_json_explode(spark, sf_dir):
    """Undamaged records of the framework data of a page for every part."""
    return pages.framework_records(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page_of(PAGE).alias("html")))


LD = """<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"sku":"%s","name":"Octavia","offers":{"price":"389000"}},{"sku":"2","name":"Fabia","offers":{"price":"150000"}}]}</script><script type="application/ld+json">{"@type":"Organization"}</script>"""
LD_OBJECT = """<script type="application/ld+json">{"@type":"ItemList","itemListElement":{"0":{"sku":"%s","name":"Superb","offers":{"price":"500000"}}}}</script>"""


@query("""SELECT p_partkey AS page_id, CAST(i AS INT) AS position, CASE i WHEN 0 THEN CAST(p_partkey AS VARCHAR) ELSE '2' END AS sku, CASE WHEN p_partkey % 2 = 1 THEN 'Superb' WHEN i = 0 THEN 'Octavia' ELSE 'Fabia' END AS name,
 CASE WHEN p_partkey % 2 = 1 THEN 500000.0::DOUBLE WHEN i = 0 THEN 389000.0 ELSE 150000.0 END AS price FROM part, range(0, 2) r(i) WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND (i = 0 OR p_partkey % 2 = 0)""")
def json_ld_products(spark, sf_dir):
    """Products of item lists, given as lists and as objects, in a page for every part."""
    html = F.when(F.col("p_partkey") % 2 == 1, page_of(LD_OBJECT)).otherwise(page_of(LD))
    return pages.linked_products(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, CAST(floor(x + 0.5) AS BIGINT) AS half_up, CAST(round_even(x, 0) AS BIGINT) AS half_even, CAST(floor((x * 10 + 50) / 100) * 100 AS BIGINT) AS hundred
 FROM (SELECT *, l_quantity / 2.0::DOUBLE - 10 AS x FROM lineitem) l""")
def roundings(spark, sf_dir):
    """Halves up, halves to even, and whole hundreds, over positive and negative halves."""
    x = F.col("l_quantity") / 2 - 10
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), m.half_up(x).alias("half_up"), m.half_even(x).alias("half_even"), m.to_hundred(x * 10).alias("hundred"))


@query("""SELECT p_partkey, CAST(list_contains(string_split(p_name, ' '), string_split(p_type, ' ')[1]) AS INT) AS has_first, len(list_distinct(string_split(concat(p_name, ' ', p_type), ' '))) AS distinct_words FROM part""")
def equipment_all(spark, sf_dir):
    """Whether all wanted features are there, and how many different ones."""
    p = views.table(spark, sf_dir, "part")
    have, want = F.split("p_name", " "), F.slice(F.split("p_type", " "), 1, 1)
    return p.select("p_partkey", (F.size(F.array_except(want, have)) == 0).cast("int").alias("has_first"), F.size(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))).cast("long").alias("distinct_words"))


CONF = {
    "sample": "CAST(l_quantity AS INT)", "win": "l_linenumber % 3 * 2 + 2", "low": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 300000 - l_partkey % 90 * 1000 END", "high": "300000 + l_suppkey % 90 * 1000",
    "typical": "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 300000 END", "features": "l_suppkey % 5", "weak": "l_partkey % 5 * (l_suppkey % 5) // 5", "km": "l_orderkey % 3", "sold": "l_orderkey % 7",
}


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"{e} AS {n}" for n, e in CONF.items())} FROM lineitem), p AS (SELECT *,
 CASE WHEN sample >= 25 THEN 3 WHEN sample >= 15 THEN 2 WHEN sample >= 8 THEN 1 WHEN sample >= 5 THEN 0 ELSE -2 END + CASE WHEN win <= 2 THEN 1 WHEN win >= 6 THEN -1 ELSE 0 END
 + CASE WHEN typical IS NULL OR low IS NULL THEN 0 WHEN (high - low) / typical::DOUBLE < 0.18 THEN 1 WHEN (high - low) / typical::DOUBLE > 0.55 THEN -2 WHEN (high - low) / typical::DOUBLE > 0.4 THEN -1 ELSE 0 END
 + CASE WHEN features <= 0 THEN 0 WHEN weak / features::DOUBLE > 0.6 THEN -1 WHEN weak / features::DOUBLE < 0.25 AND features >= 2 THEN 1 ELSE 0 END - km AS pts FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN pts >= 3 AND km = 0 AND sold >= 3 THEN 'high' WHEN pts >= 1 OR (km > 0 AND pts >= 0) THEN 'medium' ELSE 'low' END AS level FROM p""")
def confidence(spark, sf_dir):
    """How sure an estimate is, over samples, windows, bands, features and sales made of the lines' numbers."""
    from ..operators.pricing import confidence as level

    rows = views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(f"{e.replace('//', 'div')} AS {n}" for n, e in CONF.items()))
    features = F.nullif("features", F.lit(0))
    args = [F.coalesce(features, F.lit(0)) if n == "features" else F.col(n) for n in CONF]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", level(*args).alias("level"))


@query(dealt_same("(1,'heated_seats'),(2,'cruise_control'),(3,'massage_seats'),(4,NULL),(5,'tow_hitch'),(6,NULL)", "i, key", 6))
def equipment_keys(spark, sf_dir):
    from ..functions.equipment import canonical

    rows = dealt(spark, sf_dir, "(1,'vyhrivana_sedadla'),(2,'Adaptivní tempomat'),(3,'Masážní sedadla'),(4,'okna'),(5,'Tažné zařízení'),(6,NULL)", "i, name", 6)
    return rows.select("p_partkey", canonical(F.col("name")).alias("key"))


@query("""SELECT p_partkey, CAST(p_partkey % 3 = 0 OR p_partkey % 2 = 1 AND p_name LIKE '%a%' AND p_partkey % 3 = 1 AS INT) AS ok FROM part""")
def equipment_wanted(spark, sf_dir):
    from ..functions.equipment import has_all

    key, names = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x))
    have = F.when(key % 2 == 1, F.when(F.contains("p_name", F.lit("a")), names("Tempomat", "abs")).otherwise(names("abs")))
    want = F.when(key % 3 == 1, names("cruise_control")).when(key % 3 == 2, names("cruise_control", "keyless")).otherwise(F.array().cast("array<string>"))
    rows = views.table(spark, sf_dir, "part").select("p_partkey", have.alias("have"), want.alias("want"))
    return rows.select("p_partkey", has_all(F.col("have"), F.col("want")).cast("int").alias("ok"))


@query()
def placeholder_hash(spark, sf_dir):
    """A stable picture number per part; tests hold it against a plain loop."""
    from ..functions.equipment import stable_index

    return views.table(spark, sf_dir, "part").select("p_partkey", stable_index(F.col("p_name"), 9).alias("icon"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Škoda' WHEN 1 THEN 'Mercedes-Benz' WHEN 3 THEN p_brand END AS make, CASE p_partkey % 4 WHEN 0 THEN 'skoda' WHEN 1 THEN 'mercedes' WHEN 2 THEN 'concorde reisemobile gmbh' ELSE lower(p_brand) END || '|' || lower(p_type) || '|-1' AS key FROM part""")
def catalog_names(spark, sf_dir):
    """Makes as they are shown, and keys made of folded names."""
    from ..functions.catalog import display_make, natural_key

    key = F.col("p_partkey") % 4
    raw = F.when(key == 0, "ŠKODA").when(key == 1, "  Mercedes ").when(key == 2, "Concorde  Reisemobile GmbH").otherwise(F.upper("p_brand"))
    return views.table(spark, sf_dir, "part").select("p_partkey", display_make(raw).alias("make"), natural_key(raw, F.col("p_type"), F.lit(-1)).alias("key"))
