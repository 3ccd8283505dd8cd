"""Whether listings still exist, from what their pages answer, and what follows for their state.

Errors of transport, blocks and overload never count as gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# States that an item of the first portal names, and phrases of pages of listings that are gone, by portal.
ITEM_GONE = ["deleted", "inactive", "deactivated", "removed", "expired", "sold"]
ITEM_LIVE = ["active", "published", "visible", "edit"]
GONE_TITLES = {
    "bazos": r"neexistuje|inzer[aá]t\s+byl\s+ukon|inzer[aá]t\s+nen[ií]|odstraněn",
    "tipcars": r"neexistuje|nenalezen|nen[ií]\s+k\s+dispozici|inzer[aá]t\s+byl\s+ukon|inzer[aá]t\s+nen[ií]|odstraněn|stránka\s+neexistuje",
    "autobazar_eu": r"neexistuje|nenalezen|nebyla\s+nalezena|nen[ií]\s+k\s+dispozici|inzer[aá]t\s+byl\s+ukon|inzer[aá]t\s+nen[ií]|odstraněn|stránka\s+neexistuje|404",
    "mobile_de": r"nicht\s+gefunden|seite\s+nicht\s+gefunden|anzeige\s+nicht\s+mehr|inserat\s+nicht\s+mehr|gel[oö]scht|nicht\s+verf[uü]gbar|no\s+longer\s+available|page\s+not\s+found|404",
    "autoscout24": r"nicht\s+gefunden|seite\s+nicht\s+gefunden|anzeige\s+nicht\s+mehr|inserat\s+nicht\s+mehr|gel[oö]scht|nicht\s+verf[uü]gbar|no\s+longer\s+available|page\s+not\s+found|404",
}
BLOCKED, GUARDED = ["Access denied", "Zugriff verweigert"], ["mobile_de", "autoscout24"]
HEAD, SHORT_PAGE = 4_000, 12_000


def by_status(status: Column) -> Column:
    """What the answer's code alone says; null stands for no answer."""
    return F.when(status == 200, "live").when(status.isin(404, 410), "gone").otherwise("uncertain")


def item_state(body: Column) -> Column:
    """live or gone where an item's JSON names a known state, null elsewhere: for other states, other texts and none."""
    whole = F.try_parse_json(body)
    empty = lambda v: v.isNull() | F.is_variant_null(v)
    inner = [F.try_variant_get(whole, f"$.{name}", "variant") for name in ("result", "item")]
    state = F.coalesce(*(F.when(~empty(v), F.try_variant_get(v, "$.status", "string")) for v in inner), F.when(empty(inner[0]) & empty(inner[1]), F.try_variant_get(whole, "$.status", "string")))
    word = F.lower(F.trim(state))
    return F.when(word.isin(ITEM_GONE), "gone").when(word.isin(ITEM_LIVE), "live")


def verdict(source: Column, status: Column, body: Column, url: Column) -> Column:
    """live, gone or uncertain. Other portals than the first are asked by their pages' addresses; a portal that isn't known is uncertain."""
    text = F.coalesce(body, F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))

    def read(t: Column) -> Column:
        page = F.lit("live")
        for portal, phrases in GONE_TITLES.items():
            hit = lambda c: c.rlike("(?iu)" + phrases)  # noqa: B023, E731
            page = F.when((source == portal) & (hit(t["title"]) | (hit(t["head"]) & t["short"])), "gone").otherwise(page)
        blocked = source.isin(GUARDED) & (F.contains(t["head"], F.lit(BLOCKED[0])) | F.contains(t["head"], F.lit(BLOCKED[1])))
        return F.when(blocked, "uncertain").otherwise(page)

    page = let({"title": title, "head": F.left(text, F.lit(HEAD)), "short": F.length(text) < SHORT_PAGE}, read)
    by_page = F.when(F.coalesce(url, F.lit("")) == "", "uncertain").when(by_status(status) != "live", by_status(status)).otherwise(page)
    by_item = F.when(by_status(status) != "live", by_status(status)).otherwise(F.coalesce(item_state(body), F.lit("live")))
    return F.when(source == "sauto", by_item).when(source.isin(list(GONE_TITLES)), by_page).otherwise("uncertain")


def due(listings: DataFrame, limit: int | None = None, source: str = "source") -> DataFrame:
    """Active listings, those longest unseen first in each source; at most `limit` of a source where one is given."""
    from pyspark.sql import Window as W

    active = listings.where("status = 'active'")
    if limit is None:
        return active
    order = F.row_number().over(W.partitionBy(source).orderBy(F.col("last_seen").asc_nulls_first(), "id"))
    return active.withColumn("_n", order).where(F.col("_n") <= limit).drop("_n")


def events(verdicts: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """What the verdicts do to the listings' state, as events that state.status_of folds: gone removes, live is a sighting; uncertain does nothing."""
    return verdicts.where(F.col("verdict").isin("gone", "live")).select(F.col(key), "source", F.col("verdict").alias("kind"), at.alias("observed_at"))


def counts(verdicts: DataFrame) -> DataFrame:
    """Checked, live, gone and uncertain by source."""
    each = [F.count_if(F.col("verdict") == v).alias(v) for v in ("live", "gone", "uncertain")]
    return verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("checked"), *each)
