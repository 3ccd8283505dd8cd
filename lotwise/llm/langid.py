"""Language identification by error-correcting output codes (Dietterich and Bakiri, 1995;
loss-based decoding after Allwein, Schapire and Singer, 2000).

Every language gets a codeword of bits. One binary classifier per bit, over hashed letter
bigrams and trigrams, predicts whether a text's language has that bit set; the text's
language is the codeword with the least weighted logistic loss, and a small margin to the
second is flagged as ambiguous.

Training is one pass of Spark over all training rows: n-gram counts per language. A bit's
classifier is the log ratio of the mean n-gram distributions of the languages on its two
sides, scaled so that the two sides' nearest languages answer -1 and 1; bits whose sides
are far apart weigh more. The model's size depends on the languages and on BUCKETS alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, read_table, small_batches

#: Hash buckets of n-grams.
BUCKETS = 1 << 14
#: Texts whose two best languages are closer than this in score are ambiguous.
MARGIN = 0.1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a Unicode letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None) -> np.ndarray:
    """Buckets of the bigrams and trigrams of a whole text's letters; runs of other characters are one boundary.

    Null, empty and letterless texts have none.
    """
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[np.minimum(codes, 0x10FFFF)], codes, np.uint32(0))
    if not codes.any():
        return np.empty(0, np.int64)
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    two = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ codes[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    both = np.concatenate([two, three])
    both *= np.uint32(0x165667B1)
    both >>= shift
    return both.astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """A matrix of -1 and 1, a row per language: every split in two for up to six languages, else random ones far apart."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        return np.array([[1.0, *bits] for bits in product((1.0, -1.0), repeat=languages - 1) if -1.0 in bits]).T
    bits = 6 * int(np.ceil(np.log2(languages)))
    best, apart = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], size=(languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        near = min((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(languages - 1))
        if near > apart:
            best, apart = code, near
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    half: np.ndarray
    worth: np.ndarray

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score from 0 to 1 and whether the choice is ambiguous."""
        found = grams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        if len(found) < BUCKETS // 16:
            total = self.weights[found].sum(axis=0)
        else:
            total = np.bincount(found, minlength=BUCKETS).astype(np.float32) @ self.weights
        bit = np.clip((total / len(found) - self.middle) / self.half, -4, 4)
        sure = np.sqrt(min(len(found), 400))
        loss = (self.worth * np.logaddexp(0, -self.code * bit * min(sure, 4.0))).sum(axis=1) * sure
        odds = np.exp(loss.min() - loss)
        odds /= odds.sum()
        first, second = np.argsort(-odds, kind="stable")[:2]
        return self.languages[first], float(odds[first]), bool(odds[first] - odds[second] < MARGIN)


def train(rows: DataFrame, text: str, lang: str) -> LanguageModel:
    """Learns from all rows with a language; texts without letters add nothing. No rows: a model that knows no language."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch["lang"], batch["text"], strict=True):
                table = tables.setdefault(name, np.zeros(BUCKETS, np.int64))
                table += np.bincount(grams(value), minlength=BUCKETS)
        for name, table in tables.items():
            some = np.flatnonzero(table)
            yield pd.DataFrame({"lang": name, "bucket": some.astype(np.int32), "n": table[some]})

    chosen = rows.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = chosen.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    share = np.full((len(names), BUCKETS), 0.5)
    share[counts["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=np.int64), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(names))
    if code.shape[1] == 0:
        none = np.zeros((BUCKETS, 0))
        return LanguageModel(names, code, none, none[0], none[0], none[0])
    weights = np.stack([np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)) for bit in code.T], axis=1)
    answer = share @ weights
    low = np.array([answer[bit > 0, b].min() for b, bit in enumerate(code.T)])
    high = np.array([answer[bit < 0, b].max() for b, bit in enumerate(code.T)])
    half = np.maximum((low - high) / 2, 1e-3)
    return LanguageModel(names, code, weights.astype(np.float32), (low + high) / 2, half, half / half.sum())


def identify(text: Column, model: LanguageModel) -> Column:
    """A struct of lang_pred, score and ambiguous for every text; `und`, 0 and true for null and letterless ones."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.classify(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return predict(text.cast("string"))


def fit_on_folds(docs: DataFrame) -> LanguageModel:
    """The model of the documents whose key's checksum modulo 3 is not 1."""
    return train(docs.where(fold_of("doc_id", 3) != 1), "text", "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from two of three folds."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_on_folds(docs)
    found = docs.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Drops documents that have no language: null, empty and letterless texts.

    Ambiguous ones stay, since short clean texts are often ambiguous. The columns stay as they are.
    """
    return docs.where(identify(F.col("text"), model)["lang_pred"] != UNKNOWN)
