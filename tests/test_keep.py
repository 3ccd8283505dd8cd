"""Kept tables over repeated and broken runs, the run log, market days and price histories on awkward requests."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lotwise.operators import history, keep, rollup

LISTED = "make string, model string, year int, fuel string, transmission string, body string, category string, price_czk long, status string, last_seen timestamp, currency string"


def listed(spark, rows):
    """(price, last_seen, currency) as listings of one model."""
    return spark.createDataFrame([("Opel", "Corsa", 2015, "Nafta", None, None, "osobni", p, "active", datetime.datetime.fromisoformat(at), c) for p, at, c in rows], LISTED)


def test_a_day_is_replaced_and_others_stay_though_a_run_breaks(spark, tmp_path):
    path, shape = str(tmp_path / "days"), "day date, n int"
    day = datetime.date
    keep.replace_days(spark.createDataFrame([(day(2026, 1, 1), 1), (day(2026, 1, 2), 2)], shape), path, "day")
    broken = spark.createDataFrame([(day(2026, 1, 2), 9)], shape).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        keep.replace_days(broken, path, "day")
    for _ in range(2):
        keep.replace_days(spark.createDataFrame([(day(2026, 1, 2), 3), (day(2026, 1, 3), 4)], shape), path, "day")
    assert sorted((r["day"].day, r["n"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 3), (3, 4)]


def test_foreign_prices_stay_out_and_days_are_those_of_the_market(spark, tmp_path):
    rows = listed(spark, [(100_000, "2026-01-01T22:00:00", "CZK"), (300_000, "2026-01-01T22:00:00", None), (5_000_000, "2026-01-01T22:00:00", "eur"), (200_000, "2025-12-01T00:00:00", "CZK")])
    path = str(tmp_path / "daily")
    rollup.write_daily(rows, F.lit("2026-01-01 23:30:00").cast("timestamp"), path)
    got = spark.read.parquet(path).where("dimension_mask = 0").collect()
    assert [(str(r["observed_date"]), r["median_czk"], r["active_count"]) for r in got] == [("2026-01-02", 200_000, 2)]


def test_runs_are_logged_with_what_they_counted_or_why_they_failed(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.range(10)
    stats = keep.logged(rows, "good", lambda out: out.write.parquet(str(tmp_path / "out")), log, seen=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    assert stats == {"seen": 10, "even": 5}
    with pytest.raises(ValueError, match="no room"):
        keep.logged(rows, "bad", lambda out: (_ for _ in ()).throw(ValueError("no room")), log, seen=F.count(F.lit(1)))
    found = [(r["name"], r["status"], json.loads(r["stats"])) for r in keep.runs(spark, log).collect()]
    assert found == [("bad", "failed", {"error": "ValueError: no room"}), ("good", "finished", {"seen": 10, "even": 5})]
    assert all(r["started_at"] <= r["finished_at"] for r in keep.runs(spark, log).collect())


def test_histories_of_named_ranges_and_without_a_car(spark):
    asked = [("d", "Opel", "Corsa", 2015, "day"), ("m", "Opel", "Corsa", 2015, "month"), ("none", "Fiat", "Uno", 2015, "year"), ("far", "Opel", "Corsa", 1999, "month")]
    requests = spark.createDataFrame([(*r, None, None) for r in asked], "request string, make string, model string, year int, range string, start date, end date")
    for column in history.DIMENSIONS:
        requests = requests.withColumn(column, F.lit(None).cast("string"))
    seen = listed(spark, [(100_000, "2026-01-10T00:00:00", None), (200_000, "2026-01-10T05:00:00", None), (50_000, "2026-01-20T00:00:00", None)]).withColumn("day", F.to_date("last_seen")).withColumn("title", F.lit("Opel Corsa"))
    got = history.price_history(requests, seen, "2026-01-30").orderBy("request", "date").collect()
    assert {r["request"] for r in got} == {"m"}
    # from the first car on there is a point for every day
    assert [r["date"].day for r in got] == list(range(10, 31))
    assert [(r["median"], r["sample_size"], r["filled"], r["widened"]) for r in (got[0], got[1], got[10], got[20])] == [(150_000, 2, False, True), (150_000, 0, True, True), (50_000, 1, False, True), (50_000, 0, True, True)]
