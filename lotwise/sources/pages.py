"""Listings from pages with embedded data: JSON of a web framework, JSON-LD blocks, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEXT_DATA = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
JSON_LD = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
RECORD = "id string, make string, model string, year int, mileage string, price double, currency string, fuel string, region string, damaged boolean"
NEXT_SHAPE = f"props struct<pageProps: struct<listings: array<struct<{', '.join(c.replace(' ', ': ', 1) for c in RECORD.split(', '))}>>, pages: int>>"


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"))


def framework_records(pages: DataFrame) -> DataFrame:
    """(page_id, record fields): the listings in a page's framework JSON; damaged ones and pages without JSON give none."""
    data = F.from_json(F.regexp_extract("html", NEXT_DATA, 1), NEXT_SHAPE)
    records = pages.select("page_id", F.explode(data["props"]["pageProps"]["listings"]).alias("r")).select("page_id", "r.*")
    return records.where(~F.coalesce("damaged", F.lit(False))).drop("damaged")


def linked_products(pages: DataFrame) -> DataFrame:
    """(page_id, position, sku, name, price): products of JSON-LD item lists, given as a list or as an object with numbers for keys."""
    blocks = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(JSON_LD), 1)).alias("block"))
    kind = F.get_json_object("block", "$['@type']")
    items = F.get_json_object("block", "$.itemListElement")
    listed = F.when(F.substring(F.trim(items), 1, 1) == "[", F.from_json(items, "array<string>")).otherwise(F.map_values(F.from_json(items, "map<string,string>")))
    rows = blocks.where(kind == "ItemList").select("page_id", F.posexplode(listed).alias("position", "item"))
    field = lambda path: F.get_json_object("item", path)
    return rows.select("page_id", "position", field("$.sku").alias("sku"), field("$.name").alias("name"), field("$.offers.price").cast("double").alias("price"))
