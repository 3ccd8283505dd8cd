"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that one Arrow batch may hold: bounds a Python worker's memory for long texts.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most BATCH_ROWS rows and about BATCH_BYTES, from now on in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    # a few very long texts make a batch of their own
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the driver is all there is (tests, benchmarks) is a local folder chosen, once per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lotwise.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lotwise-")
        spark.conf.set("lotwise.shared.dir", root)
    return f"{root.rstrip('/')}/lotwise-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends there,
    and a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def kept_aside(df: DataFrame, *names: str) -> DataFrame:
    """Columns of these names get underscores before them, so that an operator can add its own under the names."""
    taken = {n.lower() for n in names}
    old = [c for c in df.columns if c.lower() in taken]
    return df.withColumnsRenamed(dict(zip(old, unused([*df.columns, *names], *old), strict=True))) if old else df


def is_stored(docs: DataFrame) -> bool:
    """Whether rows of `docs` carry the place they were read from. Only for a table as read, with columns or rows left out at most:
    a join or generator makes several rows of one place."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def placed(docs: DataFrame, file: str = "file", at: str = "at", stored: bool = False) -> DataFrame:
    """Adds two numbers that identify a row in every scan, however files are split: its file's hash and its place in the file.

    Where `docs` isn't a stored table as read, its rows are written out first.
    """
    docs = docs if stored else materialise(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))


def count_class(n: Column) -> Column:
    """A count as a class: itself up to 2^16, steps of a thousandth beyond, so that few classes hold any counts."""
    return F.when(n <= 1 << 16, n).otherwise((1 << 16) + F.floor(F.log(n / F.lit(float(1 << 16))) * 1000)).cast("long")


def least_class(counts: DataFrame, n: str, most: int) -> int:
    """The least class such that it and those above have `most` rows at most; classes stay whole."""
    classes = counts.groupBy(count_class(F.col(n)).alias("class")).count().toPandas().sort_values("class", ascending=False)
    fits = classes["count"].cumsum() <= most
    return int(classes["class"][fits].min()) if fits.any() else int(classes["class"].max() if len(classes) else 0) + 1


def fold_of(column: str, modulus: int):
    """crc32 of the key as text, modulo: a split that depends on the key alone. Null keys count as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Rows of one key that a task of a salted join may get.
ROWS_PER_SALT = 5_000


def salted_lookup(left: DataFrame, right: DataFrame, key: str, count: str, spread: list[str], per_salt: int = ROWS_PER_SALT, how: str = "inner") -> DataFrame:
    """left ⋈ right on `key`, where `right` has one row per key and in `count` the number of left rows with it.

    With `how` left, rows that find nothing stay.

    Keys with more than `per_salt` rows are dealt over several tasks. They are at most
    rows / per_salt many; the bar is raised with the number of rows so that their list stays
    below 20,000 keys, which is what is broadcast. Null keys find nothing.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    bar = max(per_salt, total // 20_000)
    salts = F.ceil(F.col(count) / F.lit(bar)).cast("int")
    heavy = right.where(F.col(count) > bar).select(F.col(key).alias("_key"), salts.alias("_salts"))
    dealt = left.join(F.broadcast(heavy), left[key] == heavy["_key"], "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))).drop("_key", "_salts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of links between long ids: (node, component), component the least id.

    Every node takes the least label among itself and its neighbours, then the label of its
    label; few rounds suffice, since labels travel twice as far each time. Each round's
    labels are written out. A node with very many links is no problem: links are joined to
    the labels, which are unique, and minima are taken map-side first.
    """
    there = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where(F.col("src") != F.col("dst"))
    both = materialise(there.union(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["src"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        nearer = least.join(jump, least["label"] == jump["to"]).select("node", "old", F.least("label", "further").alias("label"))
        nearer = materialise(nearer, "labels")
        labels = nearer.select("node", "label")
        if nearer.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
