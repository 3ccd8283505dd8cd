"""Nearest neighbours by a permutation index (Chavez, Figueroa and Navarro, 2008; inverted
files after Amato and Savino, 2008).

A vector is represented by the order of its nearest pivots. Each block of rows keeps an
inverted file: for every pivot, the rows that have it among their nearest, and at which
place. A query scans the files of its own nearest pivots and sums up the footrule distance
between the two orders; the rows with the least distance are reranked by the inner product
of the original vectors, in double precision.

Pivots are a bounded sample; every row is indexed. Blocks are dealt by a hash of the id, so
equal vectors, however many, spread over all blocks. Each query visits every block; queries
come in blocks too, so that one task holds BLOCK_ROWS rows and QUERY_ROWS queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, read_table

PIVOTS = 256
#: Places of a row's or query's order that the index keeps.
PLACES = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
#: Share of a block that is reranked, and at least this many rows for each neighbour asked for.
RERANK_SHARE = 0.2
RERANK_LEAST = 8


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (vec_id, embedding) that take part: an id, finite components, not all zero, and the most common length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    length = rows.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size(v) == (length["length"] if length else 0))


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """Distinct vectors with the least hashes of vector; at most `pivots`, a matrix."""
    few = rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("embedding"), "vec_id").limit(pivots).collect()
    return np.array([r["embedding"] for r in few], dtype=np.float64)


def orders(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of every vector, nearest first, ties by number."""
    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    return np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :places].astype(np.int32)


def footrule(rows: np.ndarray, queries: np.ndarray, pivots: int, places: int) -> np.ndarray:
    """Footrule distances, a line per query, of orders cut after `places`: a pivot that is missing stands at `places`.

    Only shared pivots are visited: without them two orders are as far as can be.
    """
    own = np.full((len(queries), len(rows)), places * (places + 1), dtype=np.int32)
    row_at, row_pivot = np.nonzero(np.ones_like(rows))[0], rows.ravel()
    row_place = np.tile(np.arange(rows.shape[1], dtype=np.int32), len(rows))
    query_at, query_pivot = np.nonzero(np.ones_like(queries))[0], queries.ravel()
    query_place = np.tile(np.arange(queries.shape[1], dtype=np.int32), len(queries))
    by_row, by_query = np.argsort(row_pivot, kind="stable"), np.argsort(query_pivot, kind="stable")
    row_cut = np.searchsorted(row_pivot[by_row], np.arange(pivots + 1))
    query_cut = np.searchsorted(query_pivot[by_query], np.arange(pivots + 1))
    for p in range(pivots):
        file, asked = by_row[row_cut[p] : row_cut[p + 1]], by_query[query_cut[p] : query_cut[p + 1]]
        if len(file) and len(asked):
            a, b = row_place[file][None, :], query_place[asked][:, None]
            own[np.ix_(query_at[asked], row_at[file])] += np.abs(a - b) - (places - a) - (places - b)
    return own


def nearest_in_block(rows: pd.DataFrame, queries: pd.DataFrame, pivots: int, places: int, k: int) -> pd.DataFrame:
    """The k best rows of a block for every query of a block: a line per query with ids and scores."""
    empty = pd.DataFrame({"query_id": [], "ids": [], "scores": []})
    if not len(rows) or not len(queries):
        return empty
    rows = rows.sort_values("vec_id", kind="stable")
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy())
    order = np.stack(rows["nearest"].to_numpy())
    out = []
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        distance = footrule(order, np.stack(part["nearest"].to_numpy()), pivots, places)
        most = max(k * RERANK_LEAST, math.ceil(RERANK_SHARE * len(ids)))
        for i, (query, vector) in enumerate(zip(part["vec_id"], part["embedding"], strict=True)):
            # rows stand by id, so that of equally distant ones (equal vectors too) those with smaller ids stay
            far = distance[i].astype(np.int64) * len(ids) + np.arange(len(ids))
            far[ids == query] = np.iinfo(np.int64).max
            some = np.sort(np.argpartition(far, most - 1)[:most]) if most < len(ids) else np.arange(len(ids))
            some = some[ids[some] != query]
            score = (vectors[some] * vector).sum(axis=1)
            best = np.lexsort((ids[some], -score))[:k]
            out.append((query, ids[some[best]], score[best]))
    return pd.DataFrame(out, columns=["query_id", "ids", "scores"])


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, places: int = PLACES) -> DataFrame:
    """The k nearest rows of every query by inner product: query_id, rank, vec_id, score.

    A query's own id is no candidate. Ids that repeat count each time. Unusable vectors, see
    usable(), take no part on either side; with no usable vector the result is empty.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, vec_id, embedding), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = choose_pivots(rows, pivots)
    many, kept = len(chosen), min(places, len(chosen))
    held = spark.sparkContext.broadcast(chosen)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(list(orders(np.stack(v.to_numpy()), held.value, kept))) if len(v) else pd.Series([], dtype=object)

    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    asked = usable(queries, vec_id, embedding).dropDuplicates(["vec_id"])
    groups = max(1, math.ceil(asked.count() / QUERY_ROWS))
    posted = rows.withColumn("nearest", nearest("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    posted = posted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("nearest", nearest("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_block(a, b, many, kept, k)

    found = posted.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(one, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
