"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Fitted on a sample of labelled rows, of at most SAMPLE_ROWS: one half teaches the lexicon,
the words and stems far more frequent among toxic texts; the other half teaches the trees,
which so see the lexicon as it will act on unseen texts; the last fifth, unseen by both,
teaches the calibration. Features of every whole text: lexicon densities, lexicon words
near a second person, capitals, punctuation and obfuscation rates, length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, kept_aside, materialise, read_table, small_batches

#: Labelled rows that the classifier is fitted on, at most (chosen by a hash of the key).
SAMPLE_ROWS = 20_000
#: Lexicon entries, at most, and how many toxic texts must hold one.
LEXICON_ENTRIES = 5_000
LEAST_TEXTS = 4
#: How much more likely a toxic text must hold an entry.
LEAST_RATIO = 6.0
STEM = 5
NEAR = 5

#: Insults known from the start, second persons of four languages, look-alikes of letters.
INSULTS = ["bastard", "bitch", "clown", "damn", "disgusting", "dumb", "filth", "fool", "freak", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros", "tus"]
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}

FEATURES = ["word_density", "stem_density", "any_word", "any_stem", "near_second_person", "second_person", "capitals", "shouted", "exclaimed", "punctuation", "runs", "obfuscated", "unmasked", "log_words"]

APART = {c: " " for c in map(chr, range(128)) if not c.isalnum() and c != "'"}
TO_SPACE = str.maketrans(APART)
UNMASK = str.maketrans(LOOKALIKES)
MASKED = re.compile(r"[A-Za-zÀ-ɏ]+[0-9@$*|+€][0-9@$*|+€A-Za-zÀ-ɏ]*[A-Za-zÀ-ɏ]")
RUNS = re.compile(r"([!?*#$%&.])\1\1")
UPPER = bytes(range(65, 91))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: str) -> list[str]:
    return text.lower().translate(TO_SPACE).split()


@dataclass
class Lexicon:
    words: set[str] = field(default_factory=lambda: set(INSULTS))
    stems: set[str] = field(default_factory=set)

    def features(self, text: str | None) -> list[float]:
        """All zero for null and empty texts."""
        if not text or not (words := words_of(text)):
            return [0.0] * len(FEATURES)
        n, raw = len(words), text.encode("utf-8", "replace")
        distinct = set(words)
        bad = self.words & distinct
        roots = {w for w in distinct if w[:STEM] in self.stems and len(w) >= STEM}
        masked = MASKED.findall(text)
        unmasked = sum(m.lower().translate(UNMASK).replace("*", "") in self.words or self._matches(m.lower()) for m in masked)
        hits = [i for i, w in enumerate(words) if w in bad] if bad else []
        stemmed = sum(w in roots for w in words) if roots else 0
        persons = [i for i, w in enumerate(words) if w in PERSONS] if PERSONS & distinct else []
        near = 0
        if hits and persons:
            close = {j for i in persons for j in range(i - NEAR, i + NEAR + 1)}
            near = sum(i in close for i in hits)
        capitals = len(raw) - len(raw.translate(None, UPPER))
        marks = len(raw) - len(raw.translate(None, PUNCTUATION))
        shouted = sum(map(str.isupper, text.split())) if capitals > 3 else 0
        return [
            len(hits) / n, stemmed / n, math.log1p(len(hits)), math.log1p(stemmed), near / n, len(persons) / n, capitals / len(raw), shouted / n,
            text.count("!") / n, marks / len(raw), len(RUNS.findall(text)) / n, len(masked) / n, math.log1p(unmasked), math.log(n),
        ]

    def _matches(self, masked: str) -> bool:
        """Whether stars stand for letters of a lexicon word."""
        if "*" not in masked or masked.count("*") > 4:
            return False
        return any(len(w) == len(masked) and all(a in ("*", b) for a, b in zip(masked, w)) for w in self.words if w[:1] == masked[:1])


PERSONS = frozenset(SECOND_PERSON)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries that toxic texts hold far more often than others, from rows of (text, toxic)."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        texts = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(words_of(text or ""))
                found = {("w", w) for w in words} | {("s", w[:STEM]) for w in words if len(w) > STEM}
                seen[toxic].update(found)
                texts[toxic] += 1
        keys = [*set(seen[0]) | set(seen[1]), ("n", "")]
        of = lambda t: [seen[t][k] for k in keys[:-1]] + [texts[t]]
        yield pd.DataFrame({"kind": [k for k, _ in keys], "entry": [e for _, e in keys], "clean": of(0), "toxic": of(1)})

    counts = rows.select("text", "toxic").mapInPandas(count, "kind string, entry string, clean long, toxic long").groupBy("kind", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts, "lexicon")
    total = counts.where(F.col("kind") == "n").first()
    ratio = ((F.col("toxic") + 0.5) / F.lit(total["toxic"] + 1.0)) / ((F.col("clean") + 0.5) / F.lit(total["clean"] + 1.0))
    chosen = counts.where((F.col("kind") != "n") & (F.col("toxic") >= LEAST_TEXTS)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    found = chosen.orderBy(F.desc("toxic"), F.desc("ratio"), "kind", "entry").limit(LEXICON_ENTRIES).collect()
    return Lexicon(set(INSULTS) | {r["entry"] for r in found if r["kind"] == "w"}, {r["entry"] for r in found if r["kind"] == "s"})


def with_features(rows: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    small_batches(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.features(t) for t in texts])

    return rows.withColumn("dense", dense(F.col(text).cast("string")))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    constant: float = 0.0

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Adds `score`, from 0 to 1. A model that saw one class alone gives its share to every text.

        Other columns stay, whatever their names, one named `score` with an underscore before it.
        """
        rows = kept_aside(rows, "score")
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.constant))
        # the trees add columns of their own names: the input's columns stand under numbers meanwhile
        plain = rows.toDF(*(f"_{i}" for i in range(len(rows.columns))))
        at = next(i for i, c in enumerate(rows.columns) if c.lower() == text.lower())
        dense = with_features(plain, self.lexicon, f"_{at}").withColumn("features", array_to_vector("dense"))
        raw = self.trees.transform(dense).withColumn("margin", vector_to_array("probability")[1])
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated")))
        return self.calibration.transform(raw).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(rows.columns)), score.alias("score"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on labelled rows (doc_id, toxic of 0 or 1) of documents (doc_id, text); other labels, and ids with both, are left out."""
    usable = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("toxic"), F.max(F.col("toxic").cast("int")).alias("most"))
    usable = usable.where(F.col("toxic") == F.col("most")).select("doc_id", "toxic")
    total = usable.count()
    share = min(1.0, 0.97 * sample_rows / max(total, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", part).coalesce(12), "labelled")
    lexicon = learn_lexicon(rows.where(F.col("part") < 4))
    rest = with_features(rows.where(F.col("part") >= 4), lexicon).select("part", "toxic", "dense")
    rest = materialise(rest.coalesce(4), "dense").withColumn("features", array_to_vector("dense")).withColumn("label", F.col("toxic").cast("double"))
    fit, held = rest.where(F.col("part") < 8).cache(), rest.where(F.col("part") >= 8)
    seen = {int(r["toxic"]): r["count"] for r in fit.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return ToxicityModel(lexicon, constant=float(next(iter(seen), 0)))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, maxBins=32, seed=7, subsamplingRate=1.0).fit(fit)
    margins = trees.transform(held if held.count() else fit).select(vector_to_array("probability")[1].alias("margin"), "label")
    isotonic = IsotonicRegression(featuresCol="margin", predictionCol="calibrated", labelCol="label").fit(margins)
    fit.unpersist()
    return ToxicityModel(lexicon, trees, isotonic)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document, learned from labels of four of five folds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold_of("doc_id", 5) != 0))
    scored = model.score(docs)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
