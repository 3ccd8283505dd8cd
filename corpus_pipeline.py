"""A corpus pipeline of five stages, each an operator of lotwise.llm.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept;
run() writes each stage's result as Parquet to the shared folder and reads it for the next.
Stages 1 to 4 return the columns of `documents`; the last one returns tokens instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, decontaminate, jaccard, langid, linededup
from lotwise.llm.common import is_stored, materialise, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless ones. The model learns from two folds of three."""
    return langid.keep_identified(docs, langid.fit_on_folds(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of every group of near lines; documents that lose all their words go."""
    return linededup.dedup_lines(docs, stored=is_stored(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every group of near documents."""
    return jaccard.keep_one_of_group(docs, stored=is_stored(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; documents that are mostly such passages go."""
    return decontaminate.remove_overlap(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document's text: doc_id, lang, source, ids, n_tokens."""
    coded = bpe.encode(docs, bpe.default_vocabulary())
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: Models and automata are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole `documents` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
