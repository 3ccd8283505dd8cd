"""Streams: price points in any order, listings in the state store, pages read once over restarts."""

import os

import pytest
from pyspark.sql import functions as F

from lotwise.operators import state
from lotwise.sources import views
from lotwise.sources.adapter import ListingSource
from lotwise.streaming import current, ingest


def arrive(spark, rows, path):
    rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    ingest.ingest(spark, f"{path}/in", f"{path}/out")


def log_of(spark, path):
    return sorted((r["listing"], r["observed_at"], r["seq"], r["price"]) for r in ingest.read_log(spark, f"{path}/out").collect())


def test_a_late_price_makes_the_log_that_all_rows_make(spark, tmp_path):
    at = lambda m: f"2026-01-01 00:{m:02}:00"
    batches = [[(1, at(1), 1, 100), (1, at(20), 2, 200), (2, at(3), 1, 7)], [(1, at(10), 3, 200)], [(1, at(15), 4, 100), (2, at(1), 9, 7)], [(1, at(20), 2, 200)], [(1, at(30), 5, 200), (2, at(9), 2, 8)]]
    every = []
    for rows in batches:
        every += [r for r in rows if r not in every]
        part = spark.createDataFrame([(*r, None, None) for r in rows], "listing long, observed_at string, seq long, price long, region string, features string").withColumn("observed_at", F.to_timestamp("observed_at"))
        arrive(spark, part, tmp_path)
        whole = spark.createDataFrame(every, "listing long, observed_at string, seq long, price long").withColumn("observed_at", F.to_timestamp("observed_at"))
        assert log_of(spark, tmp_path) == sorted(tuple(r) for r in state.price_log(whole).collect())


@pytest.mark.parametrize("order", [(2, 0, 1), (0, 1, 2)])
def test_log_of_events_in_any_order(spark, sf, tmp_path, order):
    observed = views.observations(spark, sf).drop("kind").select(*(c.split(" ")[0] for c in ingest.SCHEMA.split(", ")))
    for part in order:
        arrive(spark, observed.where(F.col("seq") % 3 == part), tmp_path)
    assert log_of(spark, tmp_path) == sorted((r["listing"], r["observed_at"], r["seq"], r["price"]) for r in state.price_log(observed).collect())


def sightings(spark, sf):
    """Events as sightings, probes and removals of listings, some columns known, some empty."""
    e = views.table(spark, sf, "events")
    n = F.col("event_id")
    kind = F.when(n % 11 == 0, "gone").when(n % 13 == 0, "rejected").when(n % 7 == 0, "live").when(n % 17 == 0, "thumb").otherwise("seen")
    columns = {
        "url": F.concat(F.lit("u"), n), "price_czk": F.floor("value"), "currency": F.when(n % 2 == 0, "CZK"), "category": F.lit("osobni"), "make": F.when(n % 3 == 0, F.col("event_type")),
        "year": F.when(n % 4 == 0, 2000 + n % 20), "thumb_key": F.when(n % 2 == 0, F.concat(F.lit("t"), n)),
        "feature_keys": F.when(n % 5 == 0, F.array("event_type")).when(n % 5 == 1, F.array().cast("array<string>")),
    }
    made = [columns.get(c, F.lit(None)).cast(current.TYPES.get(c, "string")).alias(c) for c in current.COLUMNS]
    return e.select(F.when(F.col("user_id") % 2 == 0, "sauto").otherwise("bazos").alias("source"), F.col("user_id").cast("string").alias("external_id"), kind.alias("kind"), F.col("ts").alias("observed_at"), n.alias("seq"), *made)


def test_listings_in_the_state_store_are_those_of_one_fold(spark, sf, tmp_path):
    observed = sightings(spark, sf)
    none = lambda c: F.lit(None).cast(dict(observed.dtypes)[c]).alias(c)
    broken = observed.limit(3).select(*(none(c) if c == "observed_at" else F.col(c) for c in observed.columns))
    broken = broken.unionByName(observed.limit(2).withColumn("kind", F.lit("unheard of")))
    for part in (2, 0, 1, 1):  # late rows, then rows that come twice
        observed.where(F.col("seq") % 3 == part).unionByName(broken).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        current.run(spark, spark.readStream.schema(observed.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    order = lambda rows: sorted(map(repr, (tuple(r) for r in rows.collect())))
    got, want = current.read_current(spark, f"{tmp_path}/out"), current.fold_batch(observed)
    assert order(got) == order(want)
    assert {r["status"] for r in want.collect()} == {"active", "removed"}


def capture_source():
    class Capture(ListingSource):
        """Pages of a folder, each read noted beside it."""

        FIELDS = "page string, number int"
        SEARCHED = frozenset({"number"})

        @classmethod
        def name(cls):
            return "capture"

        def pages(self):
            return sorted(p for p in os.listdir(self.options["path"]) if p.endswith(".txt"))

        def listings(self, page):
            with open(f"{self.options['path']}/{page}.reads", "a") as note:
                note.write("x")
            limit = [v for c, kind, v in self.search if (c, kind) == ("number", "=")]
            for line in open(f"{self.options['path']}/{page}"):
                if not limit or int(line) in limit:
                    yield page, int(line)

    return Capture


def test_a_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(capture_source())
    pages, out = tmp_path / "pages", str(tmp_path / "out")
    pages.mkdir()

    def go():
        rows = spark.readStream.format("capture").option("path", str(pages)).option("pages_per_batch", "2").load()
        running = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).start()
        running.processAllAvailable()
        running.stop()

    for some in (["a", "b", "c"], [], ["d"]):
        for name in some:
            (pages / f"{name}.txt").write_text("1\n2\n")
        go()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(f"{p}.txt", n) for p in "abcd" for n in (1, 2)]
    assert {p: (pages / f"{p}.txt.reads").read_text() for p in "abcd"} == dict.fromkeys("abcd", "x")


def test_filters_are_pushed_into_the_source(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(capture_source())
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    rows = spark.read.format("capture").option("path", str(tmp_path)).load()
    found = rows.where((F.col("number") == 2) & (F.col("page") > ""))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a.txt", 2)]
    # the portal searches by number itself, the page stays with Spark
    kept = plan.split("Filter", 1)[1].split("\n")[0]
    assert "page" in kept and "= 2" not in kept
