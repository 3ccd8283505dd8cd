"""Periodic runs of words in texts, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q, at least twice as long, that
no neighbouring word extends. Each text gets a suffix automaton of its words. The states'
end positions are merged up the suffix links, the smaller ordered set into the larger; two
positions that become neighbours in a state have just that state's length as their longest
common suffix, so where their distance is not above the length, the words before them form
a square that can't be extended to the left. Seeds of one distance and one start belong to
one stretch, and the last one that the next word doesn't extend ends it: a run, unless the
stretch has a smaller period, under which it is found too.

Only words in places that can lie in a run go through the automaton: with at least
LEAST_LENGTH words to a run, every word of one is covered by a sequence of half as many
words that occurs again within the stretch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_aside, read_table, small_batches
from .windows import in_repeats, number_words

#: Words of a run at least.
LEAST_LENGTH = 12
#: Positions of a block of an ordered set: what an insertion moves at most.
BLOCK = 1024

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class EndPositions:
    """An ordered set of positions in blocks; add() tells the neighbours that a new one gets."""

    __slots__ = ("blocks", "least", "size")

    def __init__(self, position: int):
        self.blocks, self.least, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int, int]:
        """The positions before and after, -1 where there is none."""
        at = max(bisect_left(self.least, position) - 1, 0)
        block = self.blocks[at]
        place = bisect_left(block, position)
        before = block[place - 1] if place else -1
        if place < len(block):
            after = block[place]
        else:
            after = self.least[at + 1] if at + 1 < len(self.least) else -1
        block.insert(place, position)
        if not place:
            self.least[at] = position
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.least.insert(at + 1, block[half])
        return before, after


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for clones) of every state; state 0 is the initial one.

    Most states have a single transition, which is held in two lists; further ones are in a dict of their own.
    """
    length, link, end = [0], [-1], [-1]
    first_word, first_to, more = [-1], [0], {}
    last = 0
    for i, word in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        first_word.append(-1)
        first_to.append(0)
        state, to = last, -1
        while state >= 0:
            if first_word[state] == word:
                to = first_to[state]
                break
            if first_word[state] < 0:
                first_word[state], first_to[state] = word, new
            else:
                others = more.get(state)
                if others is None:
                    more[state] = {word: new}
                elif word in others:
                    to = others[word]
                    break
                else:
                    others[word] = new
            state = link[state]
        if to >= 0:
            if length[state] + 1 == length[to]:
                link[new] = to
            else:
                clone = len(length)
                length.append(length[state] + 1)
                link.append(link[to])
                end.append(-1)
                first_word.append(first_word[to])
                first_to.append(first_to[to])
                if to in more:
                    more[clone] = dict(more[to])
                while state >= 0:
                    if first_word[state] == word:
                        if first_to[state] != to:
                            break
                        first_to[state] = clone
                    else:
                        others = more.get(state)
                        if others is None or others.get(word) != to:
                            break
                        others[word] = clone
                    state = link[state]
                link[to] = link[new] = clone
        last = new
    return length, link, end


def square_seeds(words: list[int]) -> np.ndarray:
    """Rows of (earlier end, later end, length of the common suffix), the distance of the ends not above the length."""
    length, link, end = suffix_automaton(words)
    order = np.argsort(-np.asarray(length), kind="stable").tolist()
    # a set of one position is the position itself
    sets: list[EndPositions | int | None] = [e if e >= 0 else None for e in end]
    seeds: list[tuple[int, int, int]] = []
    for state in order:
        parent = link[state]
        held = sets[state]
        sets[state] = None
        if parent <= 0 or held is None:
            continue
        other = sets[parent]
        if other is None:
            sets[parent] = held
            continue
        suffix = length[parent]
        if isinstance(other, int):
            other = EndPositions(other)
        if isinstance(held, int):
            small, large = (held,), other
        elif held.size <= other.size:
            small, large = held, other
        else:
            small, large = other, held
        previous = -1
        for position in small:
            before, after = large.add(position)
            # neighbours that stood in one set before have a longer suffix in common, and were met with it
            if before != previous and position - before <= suffix:
                seeds.append((before, position, suffix))
            previous = position
            if 0 <= after <= position + suffix:
                seeds.append((position, after, suffix))
        sets[parent] = large
    return np.array(seeds, np.int64).reshape(-1, 3)


def runs_of_stretch(words: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows of (start, length, period) of one stretch of word numbers, by start, then period."""
    seeds = square_seeds(words.tolist())
    if not len(seeds):
        return seeds
    earlier, later, suffix = seeds.T
    # a seed that the next word extends is the beginning of another seed's stretch
    following = np.append(words, -1)
    ends = following[np.minimum(later + 1, len(words))] != following[earlier + 1]
    period = (later - earlier)[ends]
    start, stop = (earlier - suffix + 1)[ends], later[ends] + 1
    rows = np.unique(np.stack([start, stop, period], axis=1), axis=0)
    # of several periods of one stretch the smallest counts
    first = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    start, stop, period = rows[first].T
    long = stop - start >= np.maximum(least, 2 * period)
    rows = np.stack([start, stop - start, period], axis=1)[long]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(words: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int]]:
    """The places (start, stop) where runs can lie, at least `least` words each."""
    size = max(least // 2, 1)
    found, open_ = [], [(0, len(words))]
    while open_:
        start, stop = open_.pop()
        if stop - start < least:
            continue
        edges = np.diff(in_repeats(words[start:stop], size).astype(np.int8), prepend=0, append=0)
        pieces = list(zip((np.flatnonzero(edges == 1) + start).tolist(), (np.flatnonzero(edges == -1) + start).tolist(), strict=True))
        if pieces == [(start, stop)]:
            found.append((start, stop))
        else:
            open_.extend(pieces)
    return sorted(found)


def runs_of(words: list[bytes], least: int = LEAST_LENGTH) -> np.ndarray:
    """All runs of a text's words: rows of (start, length, period), by start, then period."""
    none = np.empty((0, 3), np.int64)
    if len(words) < least:
        return none
    numbers = number_words(words)
    parts = [none]
    for start, stop in stretches(numbers, least):
        rows = runs_of_stretch(numbers[start:stop], least)
        if len(rows):
            parts.append(rows + [start, 0, 0])
    return np.concatenate(parts)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run holds beyond its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """Adds `runs`, an array of start, length and period by start, then period, and `collapsed`, the text without what runs repeat.

    Words are what ASCII blanks part. Null and empty texts have no runs and collapse to ''. Rows stay as they are, repeated
    ones included; columns of the two names get an underscore before them. A text is worked on whole by one task.
    """
    docs = kept_aside(docs, "runs", "collapsed")
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"runs {RUN}, collapsed string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            words = value.encode("utf-8", "surrogatepass").split() if value else []
            runs = runs_of(words, least)
            rows.append(([{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], collapse(words, runs).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    # marked so that Spark evaluates it once a row, before the columns that use it
    once = found.asNondeterministic()
    return docs.withColumn("_found", once(F.col(text).cast("string"))).select(*docs.columns, "_found.runs", "_found.collapsed")


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text, for documents whose id's checksum ends in 0 with a periodic tail: words from place a on repeat with period p."""

    @F.pandas_udf("string")
    def planted(texts: pd.Series, checksums: pd.Series) -> pd.Series:
        def one(value: str | None, h: int) -> str | None:
            words = value.encode("utf-8", "surrogatepass").split() if value and h % 10 == 0 else []
            if not words:
                return value
            g, n = h // 10, len(words)
            a = g % n
            head, tail = words[:a], words[a : a + 1 + (n - a) // (3 + g % 8)]
            times = -(-(n - a) // len(tail))
            return b" ".join(head + (tail * times)[: n - a]).decode("utf-8", "surrogatepass")

        return pd.Series([one(v, h) for v, h in zip(texts, checksums, strict=True)])

    return planted(text, F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole document, those of one tenth with planted repetitions."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs)
    # the greatest length; of equal ones the least start, then the least period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = F.col("best")["length"], -F.col("best")["col2"], -F.col("best")["col3"]
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
