"""Price histories, tables kept over runs and the log of runs, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, keep, rollup
from ..sources import views
from ..sources.shared import folder
from .appraisals import HELD
from .comparables import FULL_SUBJECTS
from .market import ROLLUP, L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "2001-12-01"


def query(sql: str):
    def hold(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return hold


#: Named and custom ranges in turn, one of them the wrong way round.
ASKED = f"""SELECT concat(make, '|', model) AS request, make, model, CAST(year AS INT) AS year, fuel, CASE power_kw % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'year' ELSE 'custom' END AS range,
  CASE power_kw % 3 WHEN 0 THEN DATE '1998-01-15' WHEN 2 THEN DATE '1999-12-01' END AS "start", CASE power_kw % 3 WHEN 0 THEN DATE '1999-12-20' WHEN 2 THEN DATE '1999-01-01' END AS "end", power_kw % 3 AS kind FROM ({FULL_SUBJECTS}) s"""


@query(f"""{L}, r AS (SELECT *, CASE kind WHEN 0 THEN 'month' ELSE 'week' END AS g, CASE WHEN kind = 1 THEN DATE '{TODAY}' - 364 ELSE least("start", "end") END AS a, CASE WHEN kind = 1 THEN DATE '{TODAY}' ELSE greatest("start", "end") END AS b FROM ({ASKED}) q),
 spine AS (SELECT request, CAST(unnest(CASE g WHEN 'month' THEN generate_series(date_trunc('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH) ELSE generate_series(date_trunc('week', a), CAST(b AS TIMESTAMP), INTERVAL 7 DAY) END) AS DATE) AS date FROM r),
 f AS (SELECT s.request, CAST(date_trunc(g, CAST(l.last_seen AS DATE)) AS DATE) AS date, price_czk, abs(l.year - s.year) <= 2 AS near FROM r s JOIN listings l ON {HELD} AND abs(l.year - s.year) <= 6 AND CAST(l.last_seen AS DATE) BETWEEN a AND b AND (s.fuel IS NULL OR s.fuel = l.fuel)),
 p AS (SELECT request, date, count(*) FILTER (near) AS few, count(*) AS many, quantile_cont(price_czk, [0.25, 0.5, 0.75]) FILTER (near) AS nq, quantile_cont(price_czk, [0.25, 0.5, 0.75]) AS fq FROM f GROUP BY request, date),
 v AS (SELECT request, date, CASE WHEN few < 8 THEN fq ELSE nq END AS q, CASE WHEN few < 8 THEN many ELSE few END AS n, few < 8 AS w FROM p),
 o AS (SELECT spine.request, spine.date, n, v.q IS NULL AS filled, last_value(v.q IGNORE NULLS) OVER k AS q, last_value(w IGNORE NULLS) OVER k AS widened FROM spine LEFT JOIN v ON v.request = spine.request AND v.date = spine.date
   WINDOW k AS (PARTITION BY spine.request ORDER BY spine.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT request, strftime(date, '%Y-%m-%d') AS date, CAST(floor(q[1] + .5) AS BIGINT) AS p25, CAST(floor(q[2] + .5) AS BIGINT) AS median, CAST(floor(q[3] + .5) AS BIGINT) AS p75, coalesce(n, 0) AS sample_size, widened, filled FROM o WHERE q IS NOT NULL""")
def price_histories(spark, sf_dir):
    """Weekly and monthly price lines of every make and model, gaps filled, years widened point by point."""
    asked = views.over_tables(spark, sf_dir, ASKED.replace("FROM part", "FROM {part}").replace('"start"', "start").replace('"end"', "end"), "part")
    asked = asked.withColumn("transmission", F.lit(None).cast("string")).withColumn("body", F.lit(None).cast("string")).drop("kind")
    seen = views.listings(spark, sf_dir).withColumn("day", F.to_date("last_seen"))
    return history.price_history(asked, seen, TODAY).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS quoted_on, CASE o_custkey % 3 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(max(o_totalprice) AS DOUBLE) AS czk_per_unit FROM orders WHERE o_custkey % 3 <> 2 GROUP BY ALL""")
def kept_rates(spark, sf_dir):
    """Rates kept by day and currency: an old state, the full run over it, and a part of the run again."""
    o = views.table(spark, sf_dir, "orders")
    currency = F.get(F.array(F.lit("eur"), F.lit("USD"), F.lit("czk")), (F.col("o_custkey") % 3).cast("int"))
    rates = o.select(F.trunc("o_orderdate", "month").alias("quoted_on"), currency.alias("currency"), F.col("o_totalprice").cast("double").alias("czk_per_unit"))
    path = f"{folder(spark)}/rates"
    keep.keep_rates(rates.withColumn("czk_per_unit", F.lit(1.0)), path)
    keep.keep_rates(rates, path)
    keep.keep_rates(rates.where(F.month("quoted_on") == 1), path)
    return spark.read.parquet(path).select(F.date_format("quoted_on", "yyyy-MM-dd").alias("quoted_on"), "currency", "czk_per_unit")


@query(ROLLUP.format(extra="last_seen >= TIMESTAMP '2000-06-01 23:30:00' - INTERVAL 7 DAY").replace("SELECT c AS category_key", "SELECT '2000-06-02' AS observed_date, c AS category_key"))
def daily_store(spark, sf_dir):
    """The daily roll-up as it is kept: a day that is run again is replaced, another day stays as it was."""
    listings, path = views.listings(spark, sf_dir), f"{folder(spark)}/daily"
    at = lambda text: F.lit(text).cast("timestamp")
    rollup.write_daily(listings.where("year < 1996"), at("2000-06-01 23:30:00"), path)
    rollup.write_daily(listings, at("2000-05-20 10:00:00"), path)
    rollup.write_daily(listings, at("2000-06-01 23:30:00"), path)
    return spark.read.parquet(path).where("observed_date = '2000-06-02'").withColumn("observed_date", F.date_format("observed_date", "yyyy-MM-dd"))


@query("""SELECT event_type AS source, CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (value < 5) AS BIGINT) AS skipped, CAST(count(*) FILTER (value >= 5) AS BIGINT) AS ingested, 'finished' AS status FROM events GROUP BY event_type""")
def ingest_runs(spark, sf_dir):
    """A logged run for every source, its counters gathered while its rows are written."""
    e, at = views.table(spark, sf_dir, "events"), folder(spark)
    sources = [r["event_type"] for r in e.select("event_type").distinct().collect()]  # the few portals that there are
    for name in sources:
        rows = e.where(F.col("event_type") == name)
        write = lambda out: out.where("value >= 5").write.mode("append").parquet(f"{at}/rows")
        keep.logged(rows, name, write, f"{at}/log", seen=F.count(F.lit(1)), skipped=F.count_if(F.col("value") < 5), ingested=F.count_if(F.col("value") >= 5))
    stat = lambda k: F.get_json_object("stats", f"$.{k}").cast("long").alias(k)
    return keep.runs(spark, f"{at}/log").select(F.col("name").alias("source"), stat("seen"), stat("skipped"), stat("ingested"), "status")
