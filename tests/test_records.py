"""Records of portals: pages without any, broken ones, detail pages, and what details add."""

import json

from lotwise.plans.captures import FRAMEWORK
from lotwise.sources import records

SHAPE = "page int, html string"


def framework(**props):
    return FRAMEWORK % json.dumps(props)[1:-1]


def test_pages_without_records_give_none(spark):
    pages = [None, "", "<html/>", FRAMEWORK % "broken", framework(searchRecords=[1]), framework(searchRecords={"data": {"0": {}}}, listings="x"), framework(advertisement=None), '<script type="application/ld+json">[1]</script>']
    rows = spark.createDataFrame(list(enumerate(pages)), SHAPE)
    assert records.autobazar(rows, 25.0).count() == records.autoscout(rows, 25.0).count() == records.tipcars(rows).count() == 0


def test_a_detail_page_and_foreign_offers(spark):
    offer = {"id": " 7 ", "finalPrice": 2270.98, "location": {"parentNames": ["Slovensko"], "name": " "}, "mileage": "120 000 km", "user": {"authorizedDealer": {"isAuthorized": True}}}
    rows = spark.createDataFrame([(1, framework(advertisement=offer)), (1, framework(advertisement=offer))], SHAPE)
    assert records.autobazar(rows, 25.0).count() == 0
    got = records.autobazar(rows, 25.0, czech_only=False).collect()
    assert [(r["external_id"], r["price_czk"], r["price_foreign"], r["mileage_km"], r["seller_type"], r["region"]) for r in got] == [("7", 56_800, 2270.98, 120_000, "dealer", None)] * 2


def test_one_product_on_a_page(spark):
    product = {"@type": "Product", "sku": "x-123456", "name": "Land Rover Defender 110", "offers": {"price": 900000}, "additionalProperty": [{"name": "Výkon", "value": "1 kW"}, {"name": "objem", "value": "2996"}]}
    html = f"<script type='application/ld+json'>{json.dumps(product)}</script>"
    row = records.tipcars(spark.createDataFrame([(1, html)], SHAPE)).first()
    assert (row["external_id"], row["url"], row["make"], row["model"], row["power_kw"], row["displacement_cc"], row["price_czk"]) == ("123456", None, "Land Rover", "Defender", None, 2996, 900_000)


def test_details_fill_what_lists_lack(spark):
    shape = "source string, external_id string, url string, fuel string, year int"
    rows = spark.createDataFrame([("t", "1", "u", None, 2010), ("t", "2", "u", "Nafta", None)], shape)
    details = spark.createDataFrame([("t", "1", "other", "Benzín", None), ("t", "1", "other", "Benzín", 2011), ("t", "9", "u", "LPG", 1)], shape)
    assert sorted(map(tuple, records.with_details(rows, details).collect())) == [("t", "1", "u", "Benzín", 2011), ("t", "2", "u", "Nafta", None)]
