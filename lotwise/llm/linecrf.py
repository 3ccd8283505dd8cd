"""Content or boilerplate, line by line, by a linear-chain conditional random field.

A text's lines are a sequence. Each line has some of FEATURES, yes-or-no statements about
its words and marks; the field weighs them, the label of the line before and the first
label, and Viterbi decoding finds the best labels of all lines together. A text is kept
where the words of content lines are a large enough share of all its words.

Trained on a sample of labelled rows, of at most SAMPLE_ROWS: lines of good texts are
content and lines of bad ones boilerplate at first, and the weights of the features are
trained alone; by these the lines of bad texts are labelled anew, since bad texts have good
lines too, and the whole field is trained on the sequences that come out. Likelihood and gradient are sums over texts that tasks compute by the forward and
backward recursions; L-BFGS moves the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, kept_aside, materialise, read_table, small_batches
from .windows import in_repeats, number_words

#: Labelled rows that the field is fitted on, at most (chosen by a hash of the key).
SAMPLE_ROWS = 20_000
#: Evaluations of likelihood and gradient per round at most, and the gain in likelihood a line that another one is worth.
EVALUATIONS, GAIN = (16, 12), 1e-4
#: Weight of the squared weights, per line.
PRIOR = 1e-4
#: Cells of lines that an evaluation holds side by side.
CELLS_AT_ONCE = 400_000
#: Share of a text's words that must be content.
LEAST_SHARE = 0.5

#: The characters that the base rule counts as symbols.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
DIGITS = b"0123456789"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS)
BOILERPLATE, CONTENT = 0, 1

#: Upper bounds of the classes of a line's measures, each one a feature; what is above the last bound is one more.
CLASSES = {
    "symbols_a_word": (0.0, 0.05, 0.2, 0.5),
    "marks_a_word": (0.05, 0.2, 0.5, 1.0),
    "digits_a_word": (0.0, 0.1, 0.5),
    "shouted_words": (0.02, 0.1, 0.3, 0.6),
    "words": (1, 3, 7, 15, 31),
    "letters_a_word": (2.5, 4.0, 6.0, 9.0),
    "distinct_words": (0.3, 0.6, 0.9),
    "repeated_words": (0.0, 0.2, 0.6),
}
FLAGS = ["sentence_end", "capital_start", "seen_before", "first", "last", "address", "bias"]
FEATURES = [f"{name}_{i}" for name, bounds in CLASSES.items() for i in range(len(bounds) + 1)] + FLAGS
START = {name: FEATURES.index(f"{name}_0") for name in CLASSES}
AT = {name: FEATURES.index(name) for name in FLAGS}
#: The field's parameters: features' weights for content against boilerplate, transitions from label to label, first label.
PARAMETERS = len(FEATURES) + 4 + 2


@dataclass
class Measured:
    """What the base rule counts, and for every line with a word its number, words and features."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lines: list[int]
    words: list[int]
    features: list[list[int]]


def measure(text: str | None) -> Measured:
    """Counts of a whole text; all zero for null and empty ones."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    repeated = in_repeats(number_words(words), 5)
    out = Measured(len(words), len(text or "") - (len(data) - len(data.translate(None, BLANKS))), len(data) - len(data.translate(None, SYMBOLS)), 0, int(repeated.sum()), [], [], [])
    before = np.concatenate([[0], np.cumsum(repeated)]).tolist()
    seen: set[bytes] = set()
    place = 0
    for number, line in enumerate(data.split(b"\n")):
        own = line.split()
        if not own:
            continue
        n, again = len(own), line in seen
        seen.add(line)
        out.n_dup_lines += again
        size = len(line)
        symbols, marks, digits = (size - len(line.translate(None, kind)) for kind in (SYMBOLS, MARKS, DIGITS))
        shown = line.decode("utf-8", "surrogatepass")
        measures = {
            "symbols_a_word": symbols / n,
            "marks_a_word": marks / n,
            "digits_a_word": digits / n,
            "shouted_words": sum(map(str.isupper, shown.split())) / n,
            "words": n,
            "letters_a_word": (size - (size - len(line.translate(None, BLANKS))) - symbols - marks - digits) / n,
            "distinct_words": len(set(own)) / n,
            "repeated_words": (before[place + n] - before[place]) / n,
        }
        found = [START[name] + sum(value > bound for bound in CLASSES[name]) for name, value in measures.items()]
        end = own[-1].rstrip(b"\"')]")[-1:]
        flags = {
            "sentence_end": end in (b".", b"!", b"?"),
            "capital_start": shown.lstrip()[:1].isupper(),
            "seen_before": again,
            "first": not out.lines,
            "address": b"http" in line or b"www." in line or b"@" in line,
            "bias": True,
        }
        out.features.append(found + [AT[name] for name, yes in flags.items() if yes])
        out.lines.append(number)
        out.words.append(n)
        place += n
    if out.features:
        out.features[-1].append(AT["last"])
    return out


@dataclass
class LineField:
    """Weights by PARAMETERS; without any, every line is content."""

    weights: np.ndarray | None

    def label(self, features: list[list[int]]) -> list[int]:
        """Viterbi decoding: the most likely labels of a text's lines, boilerplate where both are as likely."""
        if self.weights is None or not features:
            return [CONTENT] * len(features)
        own = self.weights[: len(FEATURES)].tolist()
        (bb, bc, cb, cc), (b, c) = self.weights[len(FEATURES) : -2].tolist(), self.weights[-2:].tolist()
        back = []
        for i, line in enumerate(features):
            score = sum([own[f] for f in line])
            if i:
                to_b, to_c = (b + bb, b + bc), (c + cb, c + cc)
                back.append((to_c[0] > to_b[0], to_c[1] > to_b[1]))
                b, c = max(to_b[0], to_c[0]), max(to_b[1], to_c[1])
            c += score
        label = int(c > b)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def likelihood(weights: np.ndarray, sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of labelled texts and its gradient. A text: flat features, their line numbers, the lines' labels.

    Texts of about one length go through the recursions side by side.
    """
    loss, gradient = 0.0, np.zeros(PARAMETERS)
    own, step, first = weights[: len(FEATURES)], weights[len(FEATURES) : -2].reshape(2, 2), weights[-2:]
    factor = np.exp(step)
    sequences = sorted(sequences, key=lambda s: len(s[2]))
    at = 0
    while at < len(sequences):
        count = 1
        while at + count < len(sequences) and (count + 1) * len(sequences[at + count][2]) <= CELLS_AT_ONCE:
            count += 1
        some, at = sequences[at : at + count], at + count
        steps = len(some[-1][2])
        flat = np.concatenate([s[0] for s in some])
        cell = np.concatenate([s[1] + i * steps for i, s in enumerate(some)])
        score = np.bincount(cell, own[flat], count * steps).reshape(count, steps)
        length = np.array([len(s[2]) for s in some])
        live = np.arange(steps) < length[:, None]
        label = np.zeros((count, steps), np.int64)
        label[live] = np.concatenate([s[2] for s in some])
        # scaled recursions; a line's own factor is divided by the larger of its two
        top = np.maximum(score, 0.0)
        line = np.stack([np.exp(-top), np.exp(score - top)], axis=2)
        ahead, scale = np.empty((count, steps, 2)), np.ones((count, steps))
        for t in range(steps):
            now = np.exp(first) * line[:, 0] if not t else (ahead[:, t - 1] @ factor) * line[:, t]
            scale[:, t] = np.where(live[:, t], now.sum(axis=1), 1.0)
            ahead[:, t] = np.where(live[:, t, None], now / scale[:, t, None], ahead[:, t - 1] if t else now)
        behind, pairs = np.ones((count, 2)), np.zeros((2, 2))
        posterior = np.zeros((count, steps))
        for t in range(steps - 1, -1, -1):
            on = live[:, t]
            posterior[:, t] = np.where(on, ahead[:, t, 1] * behind[:, 1], 0.0)
            if t:
                reach = line[:, t] * behind / scale[:, t, None]
                pairs += (ahead[on, t - 1].T @ reach[on]) * factor
                behind = np.where(on[:, None], reach @ factor.T, behind)
            else:
                start = np.array([(ahead[:, 0, 0] * behind[:, 0]).sum(), posterior[:, 0].sum()])
        loss += float((np.log(scale) + np.where(live, top, 0.0)).sum() - (score * label)[live].sum() - first[label[:, 0]].sum())
        both = live[:, 1:]
        seen = np.bincount((label[:, :-1] * 2 + label[:, 1:])[both], minlength=4)
        loss -= float((seen * step.ravel()).sum())
        gradient[: len(FEATURES)] += np.bincount(flat, (posterior - label).ravel()[cell], len(FEATURES))
        gradient[len(FEATURES) : -2] += pairs.ravel() - seen
        gradient[-2:] += start - np.bincount(label[:, 0], minlength=2)
    return loss, gradient


def lbfgs(evaluate, weights: np.ndarray, evaluations: int, gain: float, memory: int = 8) -> np.ndarray:
    """Minimises by L-BFGS with halved steps; ends after so many evaluations or when a step gains less than `gain`."""
    value, slope = evaluate(weights)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    used, step = 1, min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-12))
    while used < evaluations:
        direction, factors = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            factors.append(a)
            direction -= a * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(factors), strict=True):
            direction += s * (a - (y @ direction) / (s @ y))
        while used < evaluations:
            moved = weights - step * direction
            new, steep = evaluate(moved)
            used += 1
            if new <= value - 1e-4 * step * (slope @ direction):
                break
            step /= 2
        else:
            return weights
        if (moved - weights) @ (steep - slope) > 1e-12:
            pairs = [*pairs[1 - memory :], (moved - weights, steep - slope)]
        gained, weights, value, slope, step = value - new, moved, new, steep, 1.0
        if gained < gain:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LineField:
    """Fits on documents (doc_id, text) with a quality of 0 or 1 (doc_id, quality); other labels, ids with both, and texts without a
    word are left out. Where one quality alone is seen, every line counts as content."""
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("quality").cast("int")).alias("most"))
    usable = usable.where(F.col("quality") == F.col("most")).select("doc_id", "quality")
    share = min(1.0, 0.97 * sample_rows / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    small_batches(spark)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, quality in zip(batch["text"], batch["quality"], strict=True):
                lines = measure(text).features
                if lines:
                    rows.append((int(quality), [f for line in lines for f in line], [len(line) for line in lines], [int(quality)] * len(lines)))
            yield pd.DataFrame(rows, columns=["quality", "features", "sizes", "labels"])

    shape = "quality int, features array<int>, sizes array<int>, labels array<int>"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")
    stored = materialise(texts.mapInPandas(features, shape).coalesce(12), "lines")
    counts = {r["quality"]: r["n"] for r in stored.groupBy("quality").agg(F.sum(F.size("labels")).alias("n")).collect()}
    if len(counts) < 2:
        return LineField(None)
    total = sum(counts.values())

    def evaluator(rows: DataFrame, transitions: bool):
        def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
            def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                loss, gradient = 0.0, np.zeros(PARAMETERS)
                for batch in batches:
                    some = [(f, np.repeat(np.arange(len(s)), s), np.asarray(y)) for f, s, y in zip(batch["features"], batch["sizes"], batch["labels"], strict=True)]
                    l, g = likelihood(weights, some)  # noqa: E741
                    loss, gradient = loss + l, gradient + g
                yield pd.DataFrame({"loss": [loss], "gradient": [gradient.tolist()]})

            parts = rows.select("features", "sizes", "labels").mapInPandas(sums, "loss double, gradient array<double>").collect()
            loss = sum(r["loss"] for r in parts) / total + PRIOR / 2 * float(weights @ weights)
            slope = np.sum([r["gradient"] for r in parts], axis=0) / total + PRIOR * weights
            if not transitions:
                slope[len(FEATURES) :] = 0.0
            return loss, slope

        return evaluate

    weights = lbfgs(evaluator(stored, False), np.zeros(PARAMETERS), EVALUATIONS[0], GAIN)
    field = LineField(weights)

    def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = []
            for quality, found, sizes, old in zip(batch["quality"], batch["features"], batch["sizes"], batch["labels"], strict=True):
                lines = np.split(found, np.cumsum(sizes)[:-1])
                labels = old if quality else field.label([line.tolist() for line in lines])
                # a bad text has some boilerplate: where the field sees none, all of it stays
                new.append(old if BOILERPLATE not in labels else labels)
            yield batch.assign(labels=new)

    again = materialise(stored.mapInPandas(relabel, shape), "relabelled")
    return LineField(lbfgs(evaluator(again, True), weights, EVALUATIONS[1], GAIN))


BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_labels", "content_words", "content_text"]


def label_lines(docs: DataFrame, field: LineField, text: str = "text", with_text: bool = True) -> DataFrame:
    """Adds the base rule's counts, `line_labels` (for every \\n-split line: true for content, false for boilerplate, null for a line
    without a word), `content_words` and, if wanted, `content_text`, the lines that aren't boilerplate.

    Null texts have no lines and a null content_text, empty ones a line without a word. Rows stay as they are; columns of these
    names get an underscore before them.
    """
    names = JUDGED if with_text else JUDGED[:-1]
    docs = kept_aside(docs, *names)
    small_batches(docs.sparkSession)
    shape = f"{BASE}, line_labels array<boolean>, content_words bigint" + (", content_text string" if with_text else "")

    @F.pandas_udf(shape)
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            found = measure(value)
            labels = field.label(found.features)
            lines = value.split("\n") if value is not None else []
            shown: list[bool | None] = [None] * len(lines)
            for number, label in zip(found.lines, labels, strict=True):
                shown[number] = label == CONTENT
            row = (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, shown, sum(n for n, label in zip(found.words, labels, strict=True) if label == CONTENT))
            rows.append((*row, "\n".join(line for line, keep in zip(lines, shown, strict=True) if keep is not False) if value is not None else None) if with_text else row)
        return pd.DataFrame(rows, columns=names)

    # marked so that Spark evaluates it once a row, before the columns that use it
    once = judged.asNondeterministic()
    return docs.withColumn("_judged", once(F.col(text).cast("string"))).select(*docs.columns, *(f"_judged.{n}" for n in names))


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> LineField:
    """The field of the labelled documents whose key's checksum modulo 5 is not 0."""
    return train(docs, labels.where(fold_of("doc_id", 5) != 0))


def op13_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rule's counts of every whole document and whether it is kept: not failed by the base rule, and half its words in content lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit_on_folds(docs, read_table(spark, sf_dir, "labels"))
    rows = label_lines(docs, field, with_text=False)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0)
    rows = rows.withColumn("base_failed", failed).withColumn("content_share", share)
    kept = ~F.col("base_failed") & (F.col("content_share") >= LEAST_SHARE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "content_share")
