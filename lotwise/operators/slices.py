"""Price bands that a paged search can read to the end: none holds more rows than its offsets reach.

A search answers offsets below a wall only. Bands start from fixed edges per condition, and a band with more rows is cut in
halves until each fits, or is a single price. Every price knows the bands that it would come into, cut by cut, from its value
alone, so all cuts are counted in one aggregation over the distinct prices, and no band is searched twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wall, the edges of the bands at first (the last band is open), and the least step into the open band.
OFFSET_WALL = 10_000
PRICE_EDGES = [
    0, 50_000, 100_000, 150_000, 200_000, 250_000, 300_000, 350_000, 400_000, 450_000, 500_000, 600_000, 700_000, 800_000, 1_000_000, 1_250_000, 1_500_000, 2_000_000, 3_000_000, 5_000_000, None,
]
OPEN_STEP = 500_000
#: Cuts of one band, one after the other, at most; what is still over the wall then is marked.
CUTS = 32


def first_bands(edges: list[int | None]) -> Column:
    bands = [F.struct(F.lit(low).cast("long").alias("low"), F.lit(None if high is None else high - 1).cast("long").alias("high")) for low, high in zip(edges, edges[1:])]  # noqa: B905
    return F.array(*bands)


def halves(band: Column) -> tuple[Column, Column]:
    """Both halves of a band; the open band gives a closed one and an open rest."""
    low, high = band["low"], band["high"]
    middle = F.when(high.isNull(), low + F.greatest(F.lit(OPEN_STEP), F.floor(low / 2))).otherwise(F.floor((low + high) / 2)).cast("long")
    part = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
    return part(low, middle), part(middle + 1, high)


def can_be_cut(band: Column) -> Column:
    return F.coalesce(band["high"] > band["low"], F.lit(True))


def inside(price: Column, band: Column) -> Column:
    return (price >= band["low"]) & F.coalesce(price <= band["high"], F.lit(True))


def path(price: Column, edges: list[int | None], cuts: int) -> Column:
    """The bands that a price comes into, each half of the one before."""
    start = F.filter(first_bands(edges), lambda b: inside(price, b))

    def cut(bands: Column, _: Column) -> Column:
        last = F.element_at(bands, -1)
        left, right = halves(last)
        return F.when(can_be_cut(last), F.concat(bands, F.array(F.when(inside(price, left), left).otherwise(right)))).otherwise(bands)

    return F.when(F.size(start) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(cuts)), start, cut))


def sliced(rows: DataFrame, condition: str, price: str, wall: int = OFFSET_WALL, edges: list[int | None] | None = None, cuts: int = CUTS) -> DataFrame:
    """(condition, low, high, n, over): bands that cover all prices from the first edge on without overlap, by condition.

    `over` marks bands that can't be cut further and still hold more than the wall. Empty bands are listed too; prices
    that are null or below the first edge are in none.
    """
    edges = PRICE_EDGES if edges is None else edges
    prices = rows.groupBy(condition, F.col(price).cast("long").alias("_price")).agg(F.count(F.lit(1)).alias("_n"))
    steps = prices.select(condition, "_n", F.posexplode(path(F.col("_price"), edges, cuts)).alias("_step", "_band"))
    # a band that can't be cut ends its path, so each band stands at one step only
    counted = steps.groupBy(condition, "_step", "_band").agg(F.sum("_n").alias("n"))
    full = (F.col("n") > wall) & can_be_cut(F.col("_band")) & (F.col("_step") < cuts)
    piece = lambda step, band, n, wanted: F.struct(step.cast("int").alias("_step"), band.alias("_band"), n.cast("long").alias("n"), F.lit(wanted).alias("_wanted"))
    itself, next_step, none = piece(F.col("_step"), F.col("_band"), F.col("n"), False), F.col("_step") + 1, F.lit(0)
    # a full band asks for both of its halves, in rows without a count that meet the halves' own: one more aggregation, no join and no broadcast
    asked = F.when(full, F.array(itself, *(piece(next_step, half, none, True) for half in halves(F.col("_band"))))).otherwise(F.array(itself))
    pieces = counted.select(condition, F.inline(asked))
    roots = rows.select(condition).distinct().select(condition, F.explode(first_bands(edges)).alias("_band")).select(condition, F.lit(0).alias("_step"), "_band", F.lit(0).cast("long").alias("n"), F.lit(True).alias("_wanted"))
    found = roots.unionByName(pieces).groupBy(condition, "_step", "_band").agg(F.sum("n").alias("n"), F.bool_or("_wanted").alias("_wanted"))
    # a half of a full band, or a first band, that isn't full itself; halves of bands within the wall have no full parent
    done = found.where(F.col("_wanted") & ~full)
    return done.select(condition, F.col("_band.low").alias("low"), F.col("_band.high").alias("high"), "n", (F.col("n") > wall).alias("over"))
