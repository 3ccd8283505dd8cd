"""Scores texts under a hidden Markov language model.

Words are counted over the whole corpus. The most frequent ones are symbols of the model
on their own; all others share one symbol and are told apart by their counts; a last symbol
ends every text. Baum-Welch runs as one Spark job per iteration: tasks sum up expected
counts over their texts, Spark adds them by symbol, and the driver holds no more than the
model. Both the E-step and the scores run the scaled recursions over whole texts, exactly;
of very long ones the forward messages are kept at some places only and computed again
from there. Training ends when an iteration gains little likelihood.

The counts of words beyond the broadcast table stay a table that is joined, so nothing on
the driver or in a task grows with the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_class, fold_of, least_class, materialise, read_table, small_batches

STATES = 8
#: Words with a symbol of their own, and words whose counts go to every task; the rest is joined.
SYMBOL_WORDS = 20_000
KNOWN_WORDS = 200_000
#: Iterations at most, and the gain of log10-likelihood a token that another one is worth.
ITERATIONS, GAIN = 6, 0.002
#: Tokens per symbol that a state's emissions are drawn towards the words' frequencies with.
PRIOR = 0.5
#: Tokens that an E-step sorts by the length of their texts, and whose messages it holds at once.
SORTED_TOKENS, HELD_TOKENS = 2_000_000, 200_000
#: Texts that a scoring step handles side by side, and their symbols, one longer text aside.
TEXTS_AT_ONCE, SCORED_TOKENS = 4000, 2_000_000
COUNT_ENTRIES = 500_000
END, RARE = 0, 1


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case; none for null and empty texts."""
    return text.lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n_train, n_all) over all texts of (text binary, held_out)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            words = list(set(seen[0]) | set(seen[1]))
            train, held = ([s[w] for w in words] for s in seen)
            for s in seen:
                s.clear()
            return pd.DataFrame({"word": words, "n_train": train, "n_all": [a + b for a, b in zip(train, held, strict=True)]})

        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"], strict=True):
                seen[bool(held)].update(tokens_of(text))
                if len(seen[0]) + len(seen[1]) > COUNT_ENTRIES:
                    yield flush()
        yield flush()

    return docs.select("text", "held_out").mapInPandas(count, "word binary, n_train long, n_all long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


@dataclass
class Vocabulary:
    words: list[bytes]
    """The known words, most frequent first; the first `symbols` of them are symbols of their own."""
    counts: np.ndarray
    symbols: int
    tokens: int
    distinct: int
    texts: int
    rest_mass: float
    """The sum of count + 1 over training words without a symbol of their own, and 1 for all unseen ones."""
    bar: int
    """Words of lower classes of counts are in the joined table alone."""

    @property
    def size(self) -> int:
        return self.symbols + 2


def build_vocabulary(counts: DataFrame, texts: int, symbol_words: int = SYMBOL_WORDS, known_words: int = KNOWN_WORDS) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    bar, own_bar = least_class(counts, "n_all", known_words), least_class(counts, "n_train", symbol_words)
    is_own = (F.col("n_train") > 0) & (count_class(F.col("n_train")) >= own_bar)
    known = counts.where((count_class(F.col("n_all")) >= bar) | is_own).withColumn("own", is_own).orderBy(F.desc("own"), F.desc("n_train"), "word").toPandas()
    own = known[known["own"]]
    outside = int(sums["n"]) + int(sums["v"]) - int(own["n_train"].sum()) - int((own["n_train"] > 0).sum())
    return Vocabulary([bytes(w) for w in known["word"]], known["n_train"].to_numpy(dtype=np.int64), len(own), int(sums["n"]) + texts, int(sums["v"]) + (texts > 0), texts, outside + 1.0, bar)


CODED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, log_rest double, n_rest long, "
    "codes binary, rare array<binary>, rare_n array<int>"
)


def code_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as symbols, with sums of log10(count + 1) over known words and the words that are left to the join."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = held.value
        place = {w: i for i, w in enumerate(v.words)}
        logs = np.append(np.log10(v.counts + 1.0), 0.0)
        seen = np.append(v.counts > 0, False)
        symbol = np.full(len(v.words) + 1, RARE, dtype="<u2")
        symbol[: v.symbols] = np.arange(2, v.symbols + 2)
        end = np.array([END], dtype="<u2").tobytes()
        end_log = float(np.log10(v.texts + 1.0))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [tokens_of(text) for text in batch["text"]]
            length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            at = np.fromiter(map(place.get, chain.from_iterable(texts), repeat(-1)), dtype=np.int64, count=int(length.sum()))
            codes, log = symbol[at], logs[at]
            of = np.repeat(np.arange(len(texts)), length)
            rest = codes == RARE
            sums = (np.bincount(of, weights=w, minlength=len(texts)).tolist() for w in (seen[at], log, log * rest, rest))
            out, begin = [], 0
            # a text's words without a count, where it has any
            missed = np.flatnonzero(at < 0)
            bounds = np.searchsorted(missed, np.cumsum(length)).tolist()
            first = 0
            for doc, held_out, words, last, known, log_all, log_rest, n_rest in zip(batch["doc_id"], batch["held_out"], texts, bounds, *sums, strict=True):
                rare = Counter([words[i - begin] for i in missed[first:last].tolist()]) if last > first else {}
                coded = codes[begin : begin + len(words)].tobytes() + end
                out.append((row, doc, bool(held_out), len(words) + 1, int(known) + (v.texts > 0), log_all + end_log, log_rest, int(n_rest), coded, list(rare), list(rare.values())))
                row, begin, first = row + 1, begin + len(words), last
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in CODED.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "held_out", "text").mapInPandas(code, CODED)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    """A line per symbol, a column per state."""


def initial(unigram: np.ndarray, states: int) -> Model:
    """Every state starts from the words' frequencies, each shaken by noise of its own, and tends to stay."""
    emit = unigram[:, None] * np.exp(np.random.default_rng(0).normal(0, 0.7, (len(unigram), states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def segments(live: np.ndarray, held: int) -> list[tuple[int, int]]:
    """Steps cut so that no segment has over `held` tokens, or one step."""
    cuts, tokens = [0], 0
    for t, n in enumerate(live.tolist()):
        if tokens and tokens + n > held:
            cuts.append(t)
            tokens = 0
        tokens += n
    return list(zip(cuts, [*cuts[1:], len(live)], strict=True))


def expect(texts: list[np.ndarray], model: Model, held: int = HELD_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of emissions, moves and starts over whole texts, and the log10-likelihood of all."""
    texts = sorted(texts, key=len, reverse=True)
    length = np.array([len(t) for t in texts])
    flat = np.concatenate(texts).astype(np.int64)
    begin = np.cumsum(length) - length
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    states, symbols = len(model.move), len(model.emit)
    emit, into = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)

    def forward(first: int, after: int, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Of steps [first, after), one after the other: where each begins, codes, their emissions, scaled forward messages and scales; a line per state."""
        n = live[first:after]
        at = np.concatenate([[0], np.cumsum(n)])
        row = np.arange(at[-1]) - np.repeat(at[:-1], n)
        codes = flat[begin[row] + np.repeat(np.arange(first, after), n)]
        shown = np.take(emit, codes, axis=1)
        alpha, scale = np.empty_like(shown), np.empty(len(codes))
        for x, y in pairwise(at.tolist()):
            now = alpha[:, x:y]
            np.multiply(model.start[:, None] if before is None else into @ before[:, : y - x], shown[:, x:y], out=now)
            now /= np.add.reduce(now, axis=0, out=scale[x:y])
            before = now
        return at, codes, shown, alpha, scale

    cuts = segments(live, held)
    marks: list[np.ndarray | None] = [None]
    for first, after in cuts[:-1]:
        at, _, _, alpha, _ = forward(first, after, marks[-1])
        marks.append(alpha[:, at[-2] :].copy())
    emissions, moves, starts, likelihood = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states), 0.0
    later = np.ones((states, len(texts)))
    for (first, after), mark in zip(reversed(cuts), reversed(marks), strict=True):
        at, codes, ahead, alpha, scale = forward(first, after, mark)
        ahead /= scale
        beta = np.ones_like(alpha)
        beta[:, at[-2] :] = later[:, : live[after - 1]]
        steps = at.tolist()
        for i in range(after - first - 1, -1, -1):
            x, y = steps[i], steps[i + 1]
            now = ahead[:, x:y]
            now *= beta[:, x:y]
            if i:
                beta[:, steps[i - 1] : steps[i - 1] + y - x] = model.move @ now
        # every message but those of the first step, with the one before it of the same text
        same = np.arange(at[1], at[-1]) - np.repeat(np.diff(at[:-1]), live[first + 1 : after])
        moves += np.take(alpha, same, axis=1) @ ahead[:, at[1] :].T
        beta *= alpha
        if first:
            moves += mark[:, : at[1]] @ ahead[:, : at[1]].T
            later[:, : at[1]] = model.move @ ahead[:, : at[1]]
        else:
            starts += beta[:, : at[1]].sum(axis=1)
        likelihood += float(np.log10(scale).sum())
        emissions += np.stack([np.bincount(codes, weights=b, minlength=symbols) for b in beta], axis=1)
    return emissions, moves * model.move, starts, likelihood


def train(coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all training texts, until an iteration gains less than GAIN. Without texts, the initial model over uniform words."""
    context = coded.sparkSession.sparkContext
    # every count and one more, as in the base score: states are drawn towards these shares
    unigram = np.concatenate([[vocabulary.texts + 1.0, vocabulary.rest_mass], vocabulary.counts[: vocabulary.symbols] + 1.0])
    unigram = unigram / unigram.sum()
    model = initial(unigram, states)
    names = [f"e{k}" for k in range(states)]
    texts = coded.where(~F.col("held_out")).select("codes")
    reached = -np.inf
    for _ in range(iterations if vocabulary.texts else 0):
        held = context.broadcast(model)

        def estep(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            now = held.value
            total = [np.zeros_like(now.emit), np.zeros_like(now.move), np.zeros_like(now.start), 0.0]
            waiting: list[np.ndarray] = []

            def add() -> None:
                waiting.sort(key=len, reverse=True)
                some, tokens = [], 0
                for codes in [*waiting, None]:
                    if some and (codes is None or tokens + len(codes) > HELD_TOKENS):
                        for i, more in enumerate(expect(some, now)):
                            total[i] += more
                        some, tokens = [], 0
                    if codes is not None:
                        some.append(codes)
                        tokens += len(codes)
                waiting.clear()

            tokens = 0
            for batch in batches:
                for raw in batch["codes"]:
                    waiting.append(np.frombuffer(raw, dtype="<u2"))
                    tokens += len(waiting[-1])
                    if tokens > SORTED_TOKENS:
                        add()
                        tokens = 0
            add()
            some = np.flatnonzero(total[0].any(axis=1))
            keys = np.concatenate([some, -1 - np.arange(states), [-1 - states, -2 - states]])
            values = np.concatenate([total[0][some], total[1], total[2][None, :], np.eye(1, states) * total[3]])
            yield pd.DataFrame(values, columns=names).assign(key=keys.astype(np.int32))

        schema = ", ".join([*(f"{n} double" for n in names), "key int"])
        sums = texts.mapInPandas(estep, schema).groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).toPandas().set_index("key")
        held.destroy()
        counts = np.zeros_like(model.emit)
        at = sums.index.to_numpy()
        counts[at[at >= 0]] = sums[names].to_numpy()[at >= 0]
        moves = sums.loc[[-1 - k for k in range(states)], names].to_numpy() + 1.0
        starts = sums.loc[-1 - states, names].to_numpy() + 1.0
        emit = counts + PRIOR * len(unigram) * unigram[:, None]
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        before, reached = reached, float(sums.loc[-2 - states, names[0]]) / vocabulary.tokens
        if reached - before < GAIN:
            break
    return model


def log_likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of every whole sequence, by the scaled forward recursion."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    length = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(length)
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begin = ends - length
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    result = np.zeros(len(order))
    alpha = np.broadcast_to(model.start, (len(order), len(model.start)))
    held = np.ones(len(order))
    for t in range(int(length[0])):
        n = int(live[t])
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[flat[begin[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        held[:n] *= scale
        if t % 8 == 7:
            result += np.log10(held)
            held[:] = 1.0
    result += np.log10(held)
    out = np.empty(len(order))
    out[order] = result
    return out


def side_by_side(batches: Iterator[pd.DataFrame], most_texts: int = TEXTS_AT_ONCE, most_tokens: int = SCORED_TOKENS) -> Iterator[pd.DataFrame]:
    """The rows of all batches in order, put together or cut so that none has more texts or symbols than that; a longer text stands alone."""
    waiting, texts, tokens = [], 0, 0
    for batch in batches:
        lengths = batch["codes"].map(len).to_numpy(dtype=np.int64) // 2
        first = 0
        for i, n in enumerate(lengths):
            if texts and (texts == most_texts or tokens + n > most_tokens):
                yield pd.concat([*waiting, batch.iloc[first:i]], ignore_index=True)
                waiting, texts, tokens, first = [], 0, 0, i
            texts, tokens = texts + 1, tokens + int(n)
        waiting.append(batch.iloc[first:])
    if texts:
        yield pd.concat(waiting, ignore_index=True)


def score_texts(coded: DataFrame, model: Model) -> DataFrame:
    """Adds `forward`, the log10 probability of a text's symbols."""
    held = coded.sparkSession.sparkContext.broadcast(model)
    kept = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_rest", "n_rest"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in side_by_side(batches):
            rows["forward"] = log_likelihoods([np.frombuffer(c, dtype="<u2") for c in rows["codes"]], held.value)
            yield rows[[*kept, "forward"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields if f.name in kept) + ", forward double"
    return coded.select(*kept, "codes").mapInPandas(score, schema)


def score_corpus(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, symbol_words: int = SYMBOL_WORDS, known_words: int = KNOWN_WORDS) -> DataFrame:
    """Scores of all texts of (doc_id, text, held_out), learned from those not held out.

    Null texts are empty: their one token is the end. Rows that repeat are scored each; without
    training texts every count is zero.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "held_out")
    counts = materialise(count_words(docs), "counts")
    texts = docs.where(~F.col("held_out")).count()
    vocabulary = build_vocabulary(counts, texts, symbol_words, known_words)
    coded = materialise(code_texts(docs, vocabulary), "coded")
    model = train(coded, vocabulary, states, iterations)
    # words beyond the broadcast table occur fewer than `bar` times, so no key of this join is large
    rare = coded.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    found = rare.join(counts.where(count_class(F.col("n_all")) < vocabulary.bar).select("word", "n_train"), "word")
    rest = found.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("n_train") + 1.0)).alias("more"), F.sum(F.when(F.col("n_train") > 0, F.col("n")).otherwise(0)).alias("known"))
    scored = score_texts(coded, model).join(rest, "rid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    below = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("log_all") + F.col("more") - F.col("n_tokens") * below).alias("base_score"),
        (F.col("forward") + F.col("log_rest") + F.col("more") - F.col("n_rest") * float(np.log10(vocabulary.rest_mass))).alias("score"),
    )


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents; those whose key's checksum modulo 7 is 2 are held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_corpus(docs.withColumn("held_out", fold_of("doc_id", 7) == 2))
