"""Every registered query against its SQL, and the literal expectations of single functions."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise import registry
from lotwise.functions import money as m
from lotwise.functions import text as t
from lotwise.operators import gates, matching, pricing, state
from lotwise.sources import snapshot, views
from lotwise.sources.adapter import ListingSource
from lotwise.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if not isinstance(value, (list, dict)) and pd.isna(value):
        return None
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(x) for x in row]) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_money(spark):
    lit = F.lit
    assert one(spark, m.with_vat(lit(100000), lit(False)), m.with_vat(lit(250000), lit(True)), m.with_vat(lit(250000), lit(None).cast("boolean"))) == (121000, 250000, 250000)
    assert one(spark, *(m.haircut(lit(d).cast("int")) for d in (7, 30, 90, None))) == (0.05, 0.08, 0.12, 0.08)
    assert one(spark, m.after_haircut(lit(400000), lit(10)), m.to_thousand(lit(253400)), m.assumed_km(lit(2023), 2026)) == (380000, 253000, 60000)
    assert one(spark, *(m.half_up(lit(x)) for x in (-2.5, 2.5)), *(m.half_even(lit(x)) for x in (-2.5, 2.5))) == (-2, 3, -2, 2)
    assert one(spark, m.calibrated_haircut(lit(0.08), lit(400000), lit(360000), lit(0)), F.round(m.calibrated_haircut(lit(0.08), lit(400000), lit(360000), lit(5)), 4)) == (0.08, 0.1)
    advice = m.dealer_advice(lit(400000), lit(10.0), lit(5000))
    assert one(spark, advice["list_at"], advice["buy_in"], advice["commission"]) == (400000, 355000, 45000)


def test_sold_proxy_and_blend(spark):
    lit = F.lit

    def judged(days, dropped, ask):
        out = pricing.sold_proxy(lit(days), lit(dropped), lit(None).cast("int"), lit(ask))
        return one(spark, out["kind"], out["proxy"])

    assert judged(1, False, 400000) == ("withdrawn", None)
    assert judged(20, True, 280000) == ("likely_sold", 280000)
    assert judged(45, False, 400000) == ("likely_sold", 380000)
    assert judged(5, False, 400000) == ("ignore", None)
    blended = [pricing.blend(*(lit(x) for x in row)) for row in ((300000, 250000, 1, 320000, 280000), (400000, 200000, 8, 410000, 390000), (500000, 480000, 4, 450000, 400000))]
    assert one(spark, *blended) == (300000, 260000, 450000)


def test_outlier_fences(spark):
    rows = spark.createDataFrame([("a", v) for v in (200000, 210000, 220000, 230000, 1000000)] + [("b", 1), ("b", 10**9)], "k string, v long")
    assert sorted((r["k"], r["v"]) for r in pricing.inside_fences(rows, ["k"], "v").collect()) == [("a", 200000), ("a", 210000), ("a", 220000), ("a", 230000), ("b", 1), ("b", 10**9)]


def test_texts(spark):
    lit = F.lit
    assert one(spark, t.fold(lit(" Škoda ")), t.slug(lit("Octavia  Combi!"), "_"), t.fold(lit("Straße"), sharp_s=True)) == ("skoda", "octavia_combi", "strasse")
    assert one(spark, t.token_present(lit("skoda octavia combi"), lit("octavia-combi")), t.token_present(lit("fabia"), lit("octavia"))) == (True, False)
    assert one(spark, t.redact_contacts(lit("+420 603 589 309 a test@example.com"))) == ("[redacted] a [redacted]",)
    assert one(spark, gates.accident_keys(F.array(lit("abs"), lit("salvage")))) == (True,)


def subject(**more):
    base = {"subject": 1, "make": "Škoda", "model": "Octavia", "year": 2019, "mileage_km": 120000, "fuel": "Nafta", "transmission": "Automatická", "body": "Kombi", "power_kw": 110}
    return base | more


def listing(i, **more):
    base = {
        "id": f"l{i}", "source": "sauto", "make": "Škoda", "model": "Octavia", "title": "Škoda Octavia 2.0 TDI", "year": 2018 + i % 3, "mileage_km": 100000 + 3000 * i, "price_czk": 280000 + 5000 * i, "fuel": "Nafta",
        "transmission": "DSG", "body": "Kombi", "power_kw": 110, "status": "active", "first_seen": "2026-01-01 00:00:00", "last_seen": "2026-08-01 00:00:00", "published_at": "2026-01-01 00:00:00", "price_includes_vat": True,
    }
    return base | more


SUBJECT = "subject long, make string, model string, year int, mileage_km long, fuel string, transmission string, body string, power_kw int"
LISTING = "id string, source string, make string, model string, title string, year int, mileage_km long, price_czk long, fuel string, transmission string, body string, power_kw int, status string, first_seen string, last_seen string, published_at string, price_includes_vat boolean"


def listed(spark, rows):
    frame = spark.createDataFrame([[r[c.split(" ")[0]] for c in LISTING.split(", ")] for r in rows], LISTING)
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen", "published_at")})


def asked(spark, **more):
    row = subject(**more)
    return spark.createDataFrame([[row[c.split(" ")[0]] for c in SUBJECT.split(", ")]], SUBJECT)


def test_hard_rules_name_the_first_that_breaks(spark):
    rows = [listing(0, title="Škoda Fabia"), listing(1, fuel="Benzín"), listing(2, transmission="Manuální"), listing(3, body="Sedan"), listing(4, year=None, fuel="neuvedeno"), listing(5)]
    found = matching.retrieve(matching.keyed_subjects(asked(spark)), matching.keyed_listings(listed(spark, rows)))
    assert {r["id"]: r["reason"] for r in found.select("id", matching.reject_reason().alias("reason")).collect()} == {"l0": "model_title", "l1": "fuel", "l2": "transmission", "l3": "body", "l4": None, "l5": None}


def test_appraisal_of_sixteen_asks(spark):
    ranked = matching.ranked(asked(spark), listed(spark, [listing(i) for i in range(16)]), windows=pricing.WINDOWS)
    out = pricing.appraise(ranked, "2026-08-17 00:00:00", 2026).first()
    assert out["live_asks"] >= 8 and out["fair_value"] > 200000 and out["year_window"] == 2
    assert out["price_low"] <= out["price_typical"] <= out["price_high"]


def test_sold_listings_lower_the_value(spark):
    rows = [listing(i) for i in range(10)] + [listing(20 + i, status="removed", price_czk=230000) for i in range(8)]
    out = pricing.appraise(matching.ranked(asked(spark), listed(spark, rows), windows=pricing.WINDOWS), "2026-08-17 00:00:00", 2026).first()
    assert out["sold_count"] == 8 and out["fair_value"] < out["price_typical"]


def test_snapshot_round_trip(spark, tmp_path):
    rows = listed(spark, [listing(i) for i in range(4)] + [listing(9, status="removed")])
    points = spark.createDataFrame([("l0", "2026-01-01", 1), ("l0", "2026-01-02", 2)], "listing_id string, observed_at string, price_czk long")
    snapshot.export(rows, points, str(tmp_path))
    assert tuple(snapshot.counts(spark, str(tmp_path)).first()) == (4, 1, 2)
    back, log = snapshot.restore(spark, str(tmp_path), listed(spark, [listing(0, price_czk=1), listing(77)]), points)
    assert back.count() == 6 and back.where("id = 'l0'").first()["price_czk"] == 280000 and log.count() == 2


def test_stream_ends_in_the_batch_result(spark, sf, tmp_path):
    from lotwise.sources import views

    observed = views.observations(spark, sf).drop("kind").select(*(c.split(" ")[0] for c in ingest.SCHEMA.split(", ")))
    for part, low, high in ((0, 0, 400), (1, 400, 10**9)):
        ordered = observed.withColumn("n", F.expr("row_number() over (order by observed_at, seq)")).where(F.col("n").between(low + 1, high)).drop("n")
        ordered.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r["listing"]: r.asDict() for r in ingest.read_state(spark, str(tmp_path / "out")).collect()}
    want = {r["listing"]: r.asDict() for r in state.fold_state(observed).collect()}
    assert got == want
    log = spark.read.parquet(str(tmp_path / "out/log"))
    assert log.count() == state.price_log(observed).count()


def test_late_batches_change_nothing_that_is_newer(spark, sf, tmp_path):
    observed = views.observations(spark, sf).drop("kind").select(*(c.split(" ")[0] for c in ingest.SCHEMA.split(", ")))
    seen = []
    for when in ("seq % 3 = 2", "seq % 3 = 0", "seq % 3 = 1"):
        rows = observed.where(when)
        if when == "seq % 3 = 0":
            rows = rows.union(spark.createDataFrame([(None, None, 1, 5, None, None), (1, None, 2, -5, None, None)], ingest.SCHEMA))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), after=lambda state, number: seen.append((number, state.count())))
    got = {r["listing"]: r.asDict() for r in ingest.read_state(spark, str(tmp_path / "out")).collect()}
    assert got == {r["listing"]: r.asDict() for r in state.fold_state(observed).collect()}
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 2 and seen[-1][1] == len(got)


def test_records_come_through_a_data_source(spark):
    class Fake(ListingSource):
        """Two listings on every page."""

        FIELDS = "page int, number int, title string"

        @classmethod
        def name(cls):
            return "fake"

        def pages(self):
            return list(range(int(self.options.get("pages", "1"))))

        def listings(self, page):
            return [(page, i, f"{page}-{i}") for i in range(2)]

    spark.dataSource.register(Fake)
    rows = spark.read.format("fake").option("pages", "3").load()
    assert sorted(map(tuple, rows.collect())) == [(p, i, f"{p}-{i}") for p in range(3) for i in range(2)]


def test_placeholder_hash_is_fnv(spark, sf):
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    for r in registry.QUERIES["placeholder_hash"](spark, sf).collect():
        h = 2166136261
        for c in names[r["p_partkey"]]:
            h = (h ^ ord(c)) * 16777619 % 2**32
        assert r["icon"] == h % 9
