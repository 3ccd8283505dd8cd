"""The driver's star schema seen as listings, observations, subjects and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01"
AS_OF_YEAR = 2002


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same rows in both engines: only functions that agree in Spark and DuckDB are used.
LISTINGS_SQL = """
SELECT
  concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)),
            CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)), CAST(CAST(floor(l_extendedprice * 12 + 0.5) AS BIGINT) AS VARCHAR(20))) AS id,
  CASE l_suppkey % 6 WHEN 0 THEN 'sauto' WHEN 1 THEN 'bazos' WHEN 2 THEN 'tipcars' WHEN 3 THEN 'autobazar_eu' WHEN 4 THEN 'autoscout24' ELSE 'mobile_de' END AS source,
  'osobni' AS category,
  p_brand AS make, p_type AS model, concat(p_brand, ' ', p_type, ' ', p_name) AS title,
  CAST(year(o_orderdate) AS INT) AS year,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_quantity * 5000 AS BIGINT) END AS mileage_km,
  CAST(floor(l_extendedprice * 12 + 0.5) AS BIGINT) AS price_czk,
  CASE l_returnflag WHEN 'A' THEN 'Nafta' WHEN 'N' THEN 'Benzín' ELSE NULL END AS fuel,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'Manuální' ELSE 'DSG / dvojspojka' END AS transmission,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Kombi' WHEN '2' THEN 'Hatchback' WHEN '3' THEN 'SUV' WHEN '5' THEN 'Sedan' ELSE NULL END AS body,
  CASE WHEN l_suppkey % 5 = 0 THEN '4x4' WHEN l_suppkey % 5 = 1 THEN NULL ELSE 'Přední' END AS drive,
  CAST(p_size * 3 AS INT) AS power_kw,
  CASE l_suppkey % 3 WHEN 0 THEN 'dealer' WHEN 1 THEN 'private' ELSE NULL END AS seller_type,
  CASE WHEN l_tax < 0.02 THEN FALSE WHEN l_tax > 0.06 THEN NULL ELSE TRUE END AS price_includes_vat,
  CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status,
  o_orderdate AS first_seen,
  l_shipdate AS last_seen,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE o_orderdate END AS published_at,
  p_name AS features
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""


def over_tables(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The SQL over tables read by their paths, so that no view of the session is replaced."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: the id holds all that tells two of them apart."""
    sql = LISTINGS_SQL.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}").replace("JOIN part", "JOIN {part}")
    return over_tables(spark, sf_dir, sql, "lineitem", "orders", "part")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of a listing (user): a price in steps, sometimes a region, sometimes features."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("listing"),
        F.col("ts").alias("observed_at"),
        F.col("event_id").alias("seq"),
        (F.floor(F.col("value") / 50) * 50).cast("long").alias("price"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("region"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.col("event_type"), F.lit(",abs"))).otherwise(F.lit("")).alias("features"),
        F.when(F.col("event_id") % 97 == 0, "gone").when(F.col("event_id") % 53 == 0, "rejected").when(F.col("event_id") % 31 == 0, "live").otherwise("seen").alias("kind"),
    )


#: Subjects of an appraisal: id, make, model, year, km, fuel, transmission, body, kW.
SUBJECTS_SQL = """
SELECT CAST(row_number() OVER (ORDER BY p_brand, p_type) AS BIGINT) AS subject,
       p_brand AS make, p_type AS model,
       CAST(1996 + length(p_type) % 5 AS INT) AS year,
       CASE WHEN length(p_type) % 4 = 0 THEN NULL ELSE CAST(60000 + 10000 * (length(p_type) % 9) AS BIGINT) END AS mileage_km,
       CASE WHEN length(p_type) % 3 = 0 THEN 'Nafta' ELSE NULL END AS fuel,
       CASE WHEN length(p_brand) % 2 = 0 THEN 'Automatická' ELSE NULL END AS transmission,
       CASE WHEN length(p_type) % 5 = 0 THEN 'Kombi' ELSE NULL END AS body,
       CAST(60 + length(p_type) AS INT) AS power_kw
FROM (SELECT DISTINCT p_brand, p_type FROM part) p
"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_tables(spark, sf_dir, SUBJECTS_SQL.replace("FROM part)", "FROM {part})"), "part")
