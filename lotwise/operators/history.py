"""Extension: price histories on a calendar. The reports that ask for them have a contract and no computation of their own.

A request names a make, a model, a year and what it filters by, and gets a point for every day, week or month of its range. A
point's prices come from cars two years around, or six where those are few, decided point by point. Buckets without a car carry
the last point on, with a sample of none, so that the line has no holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import matching, pricing

#: Days back from the last one, and the granularity, of each named range; custom ranges get theirs by their length.
RANGES = {"day": (1, "day"), "week": (7, "day"), "month": (30, "day"), "year": (364, "week")}
DAILY_MOST, WEEKLY_MOST = 31, 366
FEW = pricing.FEW_COMPS
DIMENSIONS = ["fuel", "transmission", "body"]


def bounded(requests: DataFrame, today: str) -> DataFrame:
    """Requests with `start`, `end` and `granularity` by their `range`; custom ones bring start and end, whichever order they are in."""
    known = F.create_map(*(x for k, (days, step) in RANGES.items() for x in (F.lit(k), F.struct(F.lit(days).alias("days"), F.lit(step).alias("step")))))
    preset, last = F.try_element_at(known, F.col("range")), F.lit(today).cast("date")
    start = F.when(preset.isNotNull(), F.date_sub(last, preset["days"])).otherwise(F.least("start", "end"))
    end = F.when(preset.isNotNull(), last).otherwise(F.greatest("start", "end"))
    length = F.date_diff(end, start)
    step = F.when(preset.isNotNull(), preset["step"]).when(length <= DAILY_MOST, "day").when(length <= WEEKLY_MOST, "week").otherwise("month")
    return requests.withColumns({"start": start, "end": end, "granularity": step})


def bucket(day: Column, granularity: Column) -> Column:
    return F.when(granularity == "month", F.trunc(day, "month")).when(granularity == "week", F.trunc(day, "week")).otherwise(day).cast("date")


def spine(requests: DataFrame) -> DataFrame:
    """(request, date): every bucket of each request's range."""
    first, last = bucket(F.col("start"), F.col("granularity")), bucket(F.col("end"), F.col("granularity"))
    days = F.when(F.col("granularity") == "month", F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).otherwise(F.sequence(first, last, F.when(F.col("granularity") == "week", F.expr("INTERVAL 7 DAY")).otherwise(F.expr("INTERVAL 1 DAY"))))
    return requests.select("request", F.explode(days).alias("date"))


def price_history(requests: DataFrame, seen: DataFrame, today: str) -> DataFrame:
    """(request, date, p25, median, p75, sample_size, widened, filled) for every bucket from the first that has a car on.

    requests: request, make, model, year, fuel, transmission, body (null: any), range, start, end. seen: make, model, year, fuel,
    transmission, body, title, price_czk, day, the asking prices of each day.
    """
    keyed = matching.keyed_subjects(bounded(requests, today).withColumnRenamed("request", "subject")).withColumnRenamed("subject", "request")
    rows = matching.keyed_listings(seen)
    pairs = matching.name_pairs(keyed, rows)
    found = rows.join(pairs, ["make_norm", "model_norm"]).join(keyed, ["s_make_norm", "s_model_norm"])
    asked = lambda d: F.col(f"s_{d}_key").isNull() | F.col(f"s_{d}_key").eqNullSafe(F.col(f"{d}_key"))
    apart = F.abs(F.col("year") - F.col("s_year"))
    found = found.where((apart <= pricing.WIDE) & F.col("day").between(F.col("s_start"), F.col("s_end")) & (F.col("price_czk") > 0))
    for d in DIMENSIONS:
        found = found.where(asked(d))
    found = found.withColumn("date", bucket(F.col("day"), F.col("s_granularity")))
    narrow = F.when(apart <= pricing.NARROW, F.col("price_czk"))
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    points = found.groupBy("request", "date").agg(F.count(narrow).alias("few"), F.count("price_czk").alias("many"), F.percentile(narrow, quarters).alias("near"), F.percentile("price_czk", quarters).alias("far"))
    wide = F.col("few") < FEW
    values = F.when(wide, F.col("far")).otherwise(F.col("near"))
    points = points.select("request", "date", values.alias("q"), F.when(wide, F.col("many")).otherwise(F.col("few")).alias("sample_size"), wide.alias("widened"))
    days = spine(keyed.select("request", F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("s_granularity").alias("granularity")))
    # a request has at most a bucket for each day of its range
    before = W.partitionBy("request").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    out = days.join(points, ["request", "date"], "left").withColumn("filled", F.col("q").isNull())
    out = out.withColumn("q", F.last("q", ignorenulls=True).over(before)).withColumn("widened", F.last("widened", ignorenulls=True).over(before)).where(F.col("q").isNotNull())
    value = lambda i: pricing.m.half_up(F.col("q")[i])
    return out.select("request", "date", value(0).alias("p25"), value(1).alias("median"), value(2).alias("p75"), F.coalesce("sample_size", F.lit(0)).cast("long").alias("sample_size"), "widened", "filled")
