"""WARC records keep their ids and revisits whatever pieces the pages are read in."""

from pyspark.sql import functions as F

from lotwise.llm import warc


def test_no_page_is_lost_when_files_are_cut_otherwise(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    again = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000)
    pages.union(again).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    stored = spark.read.parquet(f"{tmp_path}/pages.parquet")
    old, found, ids = spark.conf.get("spark.sql.files.maxPartitionBytes"), [], []
    try:
        for size in ("128m", "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted(tuple(r) for r in warc.op8_arc_to_warc(spark, str(tmp_path)).collect()))
            ids.append({r["record_id"] for r in warc.convert(warc.pages_to_arc(stored)).select("record_id").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(found[0]) == stored.count() and found[0] == found[1] and ids[0] == ids[1]
    revisits = {r[0]: r[4] for r in found[0] if r[3] == "revisit"}
    copied = {r["page_id"] for r in pages.where("page_id % 3 = 0").collect()}
    assert copied <= set(revisits) and all(revisits[p] >= p + 100_000 for p in copied)


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    shape = "page_id long, url string, html string, order string"
    rows = [(1, "http://a/", "<p>same</p>", "x"), (1, "http://a/", "<p>same</p>", "x"), (2, None, "<p>same</p>", "x"), (None, "http://a/", None, None)]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, shape).write.parquet(f"{tmp_path}/{name}/pages.parquet")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.op8_arc_to_warc(spark, f"{tmp_path}/some").collect()), key=str)
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (None, "response", None)]
    assert warc.op8_arc_to_warc(spark, f"{tmp_path}/none").count() == 0
