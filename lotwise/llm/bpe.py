"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled, with their token ids, into a minimal acyclic
automaton that shares suffixes (Daciuk et al., 2000); numbers on its arcs sum up to a
word's place in a table of id sequences, so equal suffixes are shared although outputs
differ. The automaton is one file of flat arrays, which every Python worker memory-maps;
many words are looked up at once, a byte of each at a time. Words outside the lexicon are
merged exactly, pair by pair in order of rank. Vocabulary and merges come from a public
tokenizer's file, whose path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_class, kept_aside, least_class, materialise, read_table, small_batches, unused

#: Words that the lexicon may hold; the count a word needs is chosen so that no more have it.
LEXICON_WORDS = 150_000
#: Entries of a worker's table of chunks already encoded; it starts anew when full.
CACHE_ENTRIES = 200_000
#: Distinct words that the counting of one partition holds before it passes them on.
COUNT_ENTRIES = 500_000

#: Fixed values of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    others = iter(range(256, 512))
    shown = set(PRINTABLE)
    return [chr(b if b in shown else next(others)) for b in range(256)]


#: The rank of a pair that never merges.
NONE = np.iinfo(np.int64).max


class Merges:
    """Exact BPE of single words, by the vocabulary, merges and word-end mark of a tokenizer's file.

    Supported: byte-level models that compose (NFC), fold white space and lower-case first,
    drop white space, and have special tokens that are found in the raw text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens are expected to be plain strings")
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], dtype=np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        #: By rank, what a pair becomes; pairs sorted, and their ranks.
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pairs, self.ranks = np.unique([vocab[a] << 32 | vocab[b] for a, b in pairs], return_index=True)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split.replace("\\s", "\\p{White_Space}"))
        self.apart = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        marks = "|".join(sorted(regex.escape(s[:2]) for s in self.special))
        #: Finds where a special token may begin; nothing if there are none.
        self.mark = re.compile(marks or "(?!)").search

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word, little-endian and 32 bits wide, by merging pairs in order of rank.

        All words are merged side by side: each round joins, in every word, the pair of least
        rank wherever it stands, from the left, until no word has a pair with a rank.
        """
        if not words:
            return []
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(length) - 1
        ids[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), length)
        rank = np.full(len(ids), NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.repeat(least, sizes)
            over = least == NONE
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, least = ids[~over], word[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            hit = rank == least
            both = np.flatnonzero(hit[1:] & hit[:-1])
            if len(both):  # a pair of equal letters in a run of them: every other one from the left
                place = np.flatnonzero(hit)
                run = np.concatenate([[True], np.diff(place) > 1])
                first = place[np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))]
                hit[place[(place - first) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where the joined ones stand once the second halves are gone
            ids, word, rank = ids[keep], word[keep], rank[keep]
            rank[new] = NONE
            for left in (new, new[new > 0] - 1):
                left = left[left + 1 < len(ids)]
                left = left[word[left] == word[left + 1]]
                rank[left] = self._rank(ids[left], ids[left + 1])
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])).tolist()
        return [flat[x:y] for x, y in zip(cuts, cuts[1:])]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk without white space, special tokens as ids."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if not self.mark(chunk):
                return self.word.findall(chunk.lower())
        found: list[str | int] = []
        for part in self.apart.split(chunk) if self.mark(chunk) else [chunk]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                # letters are lower-cased one by one: a capital sigma never becomes a final one
                found.extend(self.word.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()))
        return found

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.token.__getitem__, ids.tolist()))


SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile("[\x1c-\x1f]")


def chunks_of(text: str) -> list[str]:
    """The runs of a text without white space; Python's own split also parts at four control characters."""
    return [c for c in SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]], path: str) -> None:
    """Writes the minimal automaton of the words, which come sorted and distinct, and their ids."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    size: list[int] = []
    # a word's path that may still grow: [is a word's end, arcs so far]
    open_path: list[list] = [[False, []]]
    previous = b""
    starts, ids = [0], []

    def close(down_to: int) -> None:
        while len(open_path) > down_to + 1:
            final, arcs = open_path.pop()
            key = (final, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs_of)
                arcs_of.append(key)
                size.append(final + sum(size[t] for _, t in arcs))
            open_path[-1][1].append((previous[len(open_path) - 1], state))

    for word, sequence in entries:
        shared = len(os.path.commonprefix([previous, word]))
        close(shared)
        open_path.extend([False, []] for _ in range(len(word) - shared))
        open_path[-1][0] = True
        previous = word
        ids.append(sequence)
        starts.append(starts[-1] + len(sequence) // 4)
    close(0)
    root = len(arcs_of)
    arcs_of.append((False, tuple(open_path[0][1])))
    keys, targets, outputs = [], [], []
    for state, (final, arcs) in enumerate(arcs_of):
        before = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            outputs.append(before)
            before += size[target]
    finals = np.array([final for final, _ in arcs_of], dtype=np.int64)
    parts = [np.array(x, dtype=np.int64) for x in (keys, targets, outputs, finals, starts)] + [np.frombuffer(b"".join(ids), dtype="<u4")]
    with open(path, "wb") as file:
        np.array([root, *(len(p) for p in parts)], dtype=np.int64).tofile(file)
        for part in parts:
            part.tofile(file)


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, dtype=np.uint32, mode="r"))
        self.root, *sizes = (int(x) for x in data[:14].view(np.int64))
        cuts = np.cumsum([7, *sizes])
        self.keys, self.targets, self.outputs, self.finals, self.starts = (data[2 * a : 2 * b].view(np.int64) for a, b in zip(cuts[:-2], cuts[1:-1]))
        self.ids = data[2 * cuts[-2] :]

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of every word, -1 if it isn't in the lexicon."""
        place = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys) or not words:
            return place
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.cumsum(length) - length
        live, state, sum_ = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), dtype=np.int64)
        at = 0
        while len(live):
            done = length[live] == at
            if done.any():
                ends = done & (self.finals[state] == 1)
                place[live[ends]] = sum_[ends]
                live, state, sum_ = live[~done], state[~done], sum_[~done]
            key = state << 8 | data[start[live] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            arc = arc[known]
            live, state, sum_ = live[known], self.targets[arc], sum_[known] + self.outputs[arc]
            at += 1
        return place


class Encoder:
    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.chunks: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Token ids of every whole text; none for null and empty texts."""
        parts = [chunks_of(t) if t else [] for t in texts]
        met = set().union(*parts)
        new = met.difference(self.chunks)
        if len(self.chunks) + len(new) > CACHE_ENTRIES:
            # what is met again now is likely frequent, and stays
            self.chunks = {c: self.chunks[c] for c in met.intersection(self.chunks)}
        if new:
            self._learn(new)
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), dtype="<u4") for p in parts]

    def _learn(self, chunks: set[str]) -> None:
        # most chunks are one word, known by a lower-case form
        plain = [(c, c.lower()) for c in chunks if c.isalpha() and c.isascii()]
        parts = [(c, self.merges.words(c)) for c in chunks if not (c.isalpha() and c.isascii())]
        words = list({w for _, w in plain}.union(w for _, found in parts for w in found if isinstance(w, str)))
        data = list(map(str.encode, words))
        place = self.lexicon.find(data) if self.lexicon else np.full(len(words), -1)
        known = np.flatnonzero(place >= 0)
        ids: dict[str | int, bytes] = {}
        if len(known):
            flat = memoryview(self.lexicon.ids).cast("B")
            start, end = (4 * self.lexicon.starts[place[known]]).tolist(), (4 * self.lexicon.starts[place[known] + 1]).tolist()
            ids = {words[i]: bytes(flat[a:b]) for i, a, b in zip(known.tolist(), start, end, strict=True)}
        unseen = np.flatnonzero(place < 0).tolist()
        ids.update(zip((words[i] for i in unseen), self.merges.merge([data[i] for i in unseen]), strict=True))
        for word in {w for _, found in parts for w in found if not isinstance(w, str)}:
            ids[word] = word.to_bytes(4, "little")
        get = ids.__getitem__
        self.chunks.update((c, ids[w]) for c, w in plain)
        self.chunks.update((c, ids[found[0]] if len(found) == 1 else b"".join(map(get, found))) for c, found in parts)


_MERGES: dict[str, Merges] = {}


def merges_of(vocabulary: str) -> Merges:
    """The merges of the file of this name, which Spark has sent to the worker; a worker keeps those of one vocabulary."""
    if vocabulary not in _MERGES:
        _MERGES.clear()
        _MERGES[vocabulary] = Merges(SparkFiles.get(vocabulary))
    return _MERGES[vocabulary]


def encoder(vocabulary: str, lexicon: str | None) -> Encoder:
    """A task's encoder; its table of chunks goes when the task ends."""
    return Encoder(merges_of(vocabulary), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def send(spark: SparkSession, path: str) -> str:
    """Has Spark carry a driver's file to every executor, under a name of its own."""
    folder = tempfile.mkdtemp(prefix="lotwise-")
    name = f"{uuid.uuid4().hex}-{os.path.basename(path)}"
    shutil.copyfile(path, f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def count_words(docs: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """Every word of all texts with its count: (word binary, n)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges = merges_of(vocabulary)
        seen: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            words: Counter[str | int] = Counter()
            for chunk, n in seen.items():
                for word in merges.words(chunk):
                    words[word] += n
            seen.clear()
            return pd.DataFrame([(w.encode(), n) for w, n in words.items() if isinstance(w, str)], columns=["word", "n"])

        for batch in batches:
            for value in batch["text"]:
                if value:
                    seen.update(chunks_of(value))
                if len(seen) > COUNT_ENTRIES:
                    yield flush()
        yield flush()

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, vocabulary: str, most: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words of all texts and sends the automaton out; the name of its file."""
    counts = materialise(count_words(docs, text, vocabulary), "words")
    least = least_class(counts, "n", most)

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merge = merges_of(vocabulary).merge
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": merge([bytes(w) for w in batch["word"]])})

    frequent = counts.where(count_class(F.col("n")) >= least).select("word").mapInPandas(ids, "word binary, ids binary").toPandas()
    entries = sorted((bytes(w), bytes(x)) for w, x in zip(frequent["word"], frequent["ids"], strict=True))
    path = f"{tempfile.mkdtemp(prefix='lotwise-')}/lexicon.bin"
    compile_lexicon(entries, path)
    return send(docs.sparkSession, path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text, array<int>; empty for null and empty texts. Other columns stay, one named `out` with an underscore before it."""
    small_batches(docs.sparkSession)
    vocabulary = send(docs.sparkSession, path)
    lexicon = build_lexicon(docs, text, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = encoder(vocabulary, lexicon)
        for texts in batches:
            yield pd.Series(list(worker.encode(texts)), dtype=object).map(lambda x: x.astype(np.int32))

    (raw,) = unused([*docs.columns, out], "raw")
    return kept_aside(docs.withColumn(raw, F.col(text).cast("string")), out).withColumn(out, ids(raw)).drop(raw)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of token ids, special tokens included, tokens joined by a blank; '' for null and empty ids."""
    vocabulary = send(docs.sparkSession, path)

    @F.pandas_udf("string")
    def text(sequences: pd.Series) -> pd.Series:
        merges = merges_of(vocabulary)
        return pd.Series(["" if x is None else merges.decode(np.asarray(x, dtype=np.int64)) for x in sequences], dtype=object)

    return docs.withColumn(out, text(F.col(ids)))


def digests(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Adds a struct `out`: the number of tokens, and checksums of the ids and of the text decoded from them,
    without the ids leaving the worker."""
    small_batches(docs.sparkSession)
    vocabulary = send(docs.sparkSession, path)
    lexicon = build_lexicon(docs, text, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = encoder(vocabulary, lexicon)
        for texts in batches:
            rows = []
            for ids in worker.encode(texts):
                back = worker.merges.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    (raw,) = unused([*docs.columns, out], "raw")
    return kept_aside(docs.withColumn(raw, F.col(text).cast("string")), out).withColumn(out, both(raw)).drop(raw)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes and decodes every whole document; null and empty texts have no tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, path or default_vocabulary()).select("doc_id", "bpe.*")
