"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items, lower-cased, are compiled into one suffix automaton
(Blumer et al., 1985; generalised after Mohri et al., 2009). A document's words stream
through it; at each word the automaton knows the longest run ending there that occurs in
some item. A window is `window` consecutive words of an item, or all words of a shorter
item; words inside an occurrence of a window are hit.

The automaton's size follows the benchmark alone. Up to BLOCK_WORDS item words it goes to
the executors as one broadcast; a larger benchmark is compiled in blocks of that size, and
every document streams through each block in turn, in whole items, so that no window is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_aside, materialise, placed, read_table, small_batches, unused

#: Item words that one automaton holds, about 200 MB of Python objects at most.
BLOCK_WORDS = 400_000
WINDOW = 10
OVERLAP = "n_words long, n_hit long, items array<string>, spans array<struct<start:int, end:int>>"
#: A document of which more than this share of words is hit goes as a whole.
MAX_COVERAGE = 0.5

#: ASCII letters to lower case, ASCII digits and all bytes of other characters kept, the rest to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class SuffixAutomaton:
    """All substrings of a set of word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        sequences = []
        for name, words in items:
            if words:
                self.names.append(name)
                sequences.append([self.ids.setdefault(w, len(self.ids) + 1) for w in words])
        self.shortest = min((min(len(s), window) for s in sequences), default=window)
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        # what ends in a state: (length, item numbers) of windows; a window of one length lies in one state
        ends: list[dict[int, set[int]]] = [{} for _ in self.next]
        for number, sequence in enumerate(sequences):
            size, state, at = min(len(sequence), window), 0, 0
            for word in sequence:
                state, at = self._step(state, at, word)
                if at >= size:
                    home = state
                    while self.length[self.link[home]] >= size:
                        home = self.link[home]
                    ends[home].setdefault(size, set()).add(number)
        self.ends: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple(sorted((size, tuple(sorted(found))) for size, found in ends[state].items()))
            self.ends[state] = self.ends[self.link[state]] + own

    def _extend(self, last: int, word: int) -> int:
        """Appends a word to the sequence that ends in `last`; the state of the longer sequence."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _step(self, state: int, at: int, word: int) -> tuple[int, int]:
        """The state and length of the longest run of items that ends with this word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            at = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], at + 1
        return 0, 0

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Whether each word is hit, and the numbers of the items whose windows occur."""
        get = self.ids.get
        codes = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        found: set[int] = set()
        # an unknown word ends every run: only runs of known words that could hold a window are streamed
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]])))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start < self.shortest:
                continue
            state = at = 0
            for place, word in enumerate(codes[start:end].tolist(), int(start) + 1):
                state, at = self._step(state, at, word)
                if at >= self.shortest:
                    for size, numbers in self.ends[state]:
                        if size <= at:
                            hit[place - size] += 1
                            hit[place] -= 1
                            found.update(numbers)
        return np.cumsum(hit[:-1]) > 0, found


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[SuffixAutomaton]:
    """Automata over all items, BLOCK_WORDS words each; items come in a stream, one partition at a time."""
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("binary").alias("text")).toLocalIterator():
        words = words_of(None if row["text"] is None else bytes(row["text"]))
        if not words:
            continue
        if held and total + len(words) > BLOCK_WORDS:
            yield SuffixAutomaton(held, window)
            held, total = [], 0
        held.append(("" if row["id"] is None else row["id"], words))
        total += len(words)
    yield SuffixAutomaton(held, window)


def find_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, stored: bool = False) -> DataFrame:
    """Adds a column `overlap`: n_words, n_hit, items (ids as sorted strings) and spans, the
    character positions [start, end) of maximal runs of hit words.

    Null and empty texts have no words; an empty benchmark hits nothing; an item with a null
    id counts as ''; repeated items are named once. A column `overlap` that was there gets an
    underscore before its name. A benchmark of several blocks takes a pass over the documents for
    each, one automaton at a time; their rows are written out first then, unless `docs` is `stored`.
    """
    small_batches(docs.sparkSession)
    docs = kept_aside(docs, "overlap")
    found = blocks(benchmark, item_id, item_text, window)
    first, second = next(found), next(found, None)
    if second is None:
        return in_one_pass(docs, first, text)
    return in_passes(docs, chain([first, second], found), text, stored)


def in_one_pass(docs: DataFrame, automaton: SuffixAutomaton, text: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf(OVERLAP)
    def overlap(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            words = words_of(value)
            hit, items = held.value.matches(words)
            rows.append((len(words), int(hit.sum()), sorted({held.value.names[n] for n in items}), spans_of(value, hit) if hit.any() else []))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return docs.withColumn("overlap", overlap(F.col(text).cast("binary")))


def hits_of(held: Broadcast):
    """A function that finds the runs of hit words, starts and ends in turn, and the items, by one automaton."""

    @F.pandas_udf("runs array<int>, names array<string>")
    def hits(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            hit, items = held.value.matches(words_of(value))
            out.append((np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).astype(np.int32), [held.value.names[n] for n in items]))
        return pd.DataFrame(out, columns=["runs", "names"])

    return hits


def in_passes(docs: DataFrame, automata: Iterator[SuffixAutomaton], text: str, stored: bool) -> DataFrame:
    """A pass for every automaton, which finds runs of hit words; a last one joins a document's runs."""
    context = docs.sparkSession.sparkContext
    file, at, runs, names = unused([*docs.columns, "overlap"], "file", "at", "runs", "names")
    rows = placed(docs, file, at, stored)
    found = None
    for automaton in automata:
        held = context.broadcast(automaton)
        part = rows.select(F.col(file).alias("file"), F.col(at).alias("at"), hits_of(held)(F.col(text).cast("binary")).alias("h")).where(F.size("h.runs") > 0)
        part = materialise(part.select("file", "at", "h.*"), "hits")
        found = part if found is None else found.union(part)
        held.destroy()
    joined = found.groupBy("file", "at").agg(F.flatten(F.collect_list("runs")).alias(runs), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(names))
    rows = rows.join(joined.withColumnsRenamed({"file": file, "at": at}), [file, at], "left")

    @F.pandas_udf(OVERLAP)
    def overlap(texts: pd.Series, runs: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for value, ends, items in zip(texts, runs, names, strict=True):
            words = words_of(value)
            hit = np.zeros(len(words), dtype=bool)
            for start, end in np.reshape([] if ends is None else ends, (-1, 2)).astype(np.int64):
                hit[start:end] = True
            out.append((len(words), int(hit.sum()), [] if items is None else list(items), spans_of(value, hit) if hit.any() else []))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])

    return rows.withColumn("overlap", overlap(F.col(text).cast("binary"), runs, names)).drop(file, at, runs, names)


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Character positions of the runs of hit words."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    cut = [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return [{"start": len(text[:a].decode("utf-8", "replace")), "end": len(text[:b].decode("utf-8", "replace"))} for a, b in cut]


def remove_overlap(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents without benchmark windows, with the same columns: hit spans are cut out of `text`,
    and documents of which more than `max_coverage` of the words are hit go altogether.

    Documents without a hit, null and empty ones included, stay as they are.
    """
    kept = docs.columns
    found = find_overlap(docs, benchmark)
    found = found.where((F.col("overlap.n_hit") == 0) | (F.col("overlap.n_hit") <= F.col("overlap.n_words") * max_coverage))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(value, gone):
            if value is None or gone is None or not len(gone):
                return value
            out, at = [], 0
            for span in gone:
                out.append(value[at : span["start"]])
                at = span["end"]
            return "".join([*out, value[at:]])

        return pd.Series([one(*x) for x in zip(texts, spans, strict=True)], dtype=object)

    clean = found.withColumn("text", F.when(F.col("overlap.n_hit") > 0, cut("text", "overlap.spans")).otherwise(F.col("text"))).drop("overlap")
    # the columns stand in the input's order, under its names
    return clean.toDF(*kept)


def op3_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of all whole documents with all benchmark items, in windows of ten words."""
    found = find_overlap(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    o = F.col("overlap")
    return found.select(
        "doc_id",
        o["n_words"].alias("n_words"),
        o["n_hit"].alias("n_hit"),
        F.size(o["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(o["items"], ","), 256).alias("items_sha256"),
        (o["n_hit"] > 0).alias("contaminated"),
    )
