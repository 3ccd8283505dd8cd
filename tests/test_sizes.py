"""What queries move: names and rows that don't travel more often than they must, with the results of a plain loop."""

import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.operators import appraisal, ingest, matching

SHOWN = ["make", "model", "category", "year", "body", "fuel", "transmission", "motor_label", "power_kw", "displacement_cc"]


def test_variants_carry_their_names_once(spark):
    rows = [(s, t, m, "a|b", None, y, "Kombi", None, "x", None, kw, None) for s, t, m, y, kw in [("b", 3, "Škoda", 1, 5), ("a", 3, "SKODA", 1, 5), ("a", None, "skoda", 1, 5), ("c", 1, " škoda", 1, 5), ("a", 2, "Audi", 2, None), ("a", 2, "AUDI", 2, None)]]
    frame = spark.createDataFrame(rows, "source string, seen int, make string, model string, category string, year int, body string, fuel string, transmission string, motor_label string, power_kw int, displacement_cc int")
    out = ingest.merged_variants(ingest.variant_keys(frame))
    assert "max_by(" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["sources"], r["first_seen"], r["last_seen"], *(r[c] for c in SHOWN)) for r in out.collect())
    assert got == [("a", 2, 2, "Audi", "a|b", None, 2, "Kombi", None, "x", None, None, None), ("a,b,c", 1, 3, "Škoda", "a|b", None, 1, "Kombi", None, "x", None, 5, None)]
    keys = {r["variant_key"] for r in ingest.variant_keys(frame).collect()}
    assert {r["variant_key"] for r in out.collect()} == keys and len(keys) == 2
    assert out.select(F.length("make_key")).distinct().collect()[0][0] == 64


@pytest.fixture
def shuffled(spark):
    """Joins of unknown sides are left to shuffles, as those of large tables are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("windows", [(), (2, 6)])
def test_only_listings_of_the_newest_months_travel(spark, shuffled, windows):
    day = lambda i: None if i % 61 == 0 else datetime.datetime(2018, 1, 1) + datetime.timedelta(days=i * 37 % 2500)
    rows = [(f"l{i:04d}", ["Škoda", "skoda auto", "Audi"][i % 3], ["Octavia", "octavia combi"][i % 2], None if i % 41 == 0 else 2010 + i % 14, ["active", "removed", None][i % 7 % 3], day(i)) for i in range(900)]
    listings = spark.createDataFrame(rows, "id string, make string, model string, year int, status string, last_seen timestamp")
    listings = listings.withColumns({c: F.lit(None).cast("string") for c in ("title", "fuel", "transmission", "body")})
    asked = [(1, "Skoda", "Octavia", 2012), (2, "škoda", "combi", 2019), (3, "Audi", "Octavia", 2015), (4, "Tatra", "Octavia", 2015)]
    subjects = spark.createDataFrame(asked, "subject long, make string, model string, year int")
    subjects = matching.keyed_subjects(subjects.withColumns({c: F.lit(None).cast("string") for c in ("fuel", "transmission", "body")}))
    out = matching.retrieve(subjects, listings, most=5, windows=windows)
    assert "BroadcastHashJoin [make_norm" in out._jdf.queryExecution().executedPlan().toString()

    want, plain = set(), lambda x: x.lower().replace("š", "s")
    for s, make, model, year in asked:
        held = [r for r in rows if plain(make) in plain(r[1]) and plain(model) in plain(r[2]) and abs((r[3] or year) - year) <= 6]
        groups = [(st, w) for st in ("active", "removed", None) for w in windows] or [None]
        for g in groups:
            found = [r for r in held if g is None or (r[4] == g[0] and abs((r[3] or year) - year) <= g[1])]
            found.sort(key=lambda r: (r[5] is None, -(r[5] or datetime.datetime(1970, 1, 1)).timestamp(), r[0]))
            want |= {(s, g and g[1], r[0], n + 1) for n, r in enumerate(found[:5])}
    got = [(r["subject"], r["window"] if windows else None, r["id"], r["recency"]) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_histories_are_looked_up_for_the_few_removed(spark, shuffled):
    at = "timestamp '2020-01-01'"
    comps = spark.range(6).selectExpr("1 AS subject", "concat('l', id) AS id", "if(id < 4, 'removed', 'active') AS status", "id AS rank", "100 AS price_czk", f"{at} AS published_at", f"{at} AS first_seen", "timestamp '2020-03-01' AS last_seen")
    points = spark.range(600).selectExpr("concat('l', id % 300) AS id", "timestamp_seconds(id) AS observed_at", "1 AS seq", "if(id < 300, 100, if(id % 2 = 0, 90, 110)) AS price")
    out = appraisal.with_histories(comps, points, "2020-04-01 00:00:00")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id#" in plan and "LeftSemi, BuildRight" in plan
    assert sorted((r["id"], r["dropped"], r["last_price"]) for r in out.collect()) == [("l0", True, 90), ("l1", False, 110), ("l2", True, 90), ("l3", False, 110), ("l4", None, None), ("l5", None, None)]
