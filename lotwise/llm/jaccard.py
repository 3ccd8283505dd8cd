"""Self-join of documents by Jaccard similarity of their word 5-grams: a size-aware heavy-light
join (after Deng, Tao and Li, 2018), exact.

Documents with equal sets form one class, and classes are joined. Two sets of sizes s <= t
link only if they share at least o = ceil(3 (s + t) / 7) elements (for a similarity of 3/4).

* Small classes list all their subsets of o elements, for every size a partner can have: two
  of them link if and only if they list a common subset. Nothing is left to verify.
* Large classes are posted in inverted lists, one for each element of a prefix: the
  s - ceil(3 s / 4) + 1 first elements in an order that puts rare elements first. Linked
  sets share an element of both prefixes, at places that leave room for o common elements.
  Pairs of a list that pass this are verified on whole texts.
* The boundary between the two is the size that minimises the estimated cost over the
  sizes at hand: subsets listed, against prefix elements posted and candidates verified.

Elements are rare or frequent by a table of counts in hashed buckets, summed over all
documents; its size follows the corpus. A list of frequent elements, or of over SHORT classes,
is heavy: its members are first verified against one of them, the one with the earliest
place; only members not connected to it by then meet all others of the list, in the join
that finds them. So a group of near copies costs a star, not all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, is_stored, materialise, placed, read_table, salted_lookup, small_batches, unused

WORDS = 5
#: Classes in a list up to which all its pairs are taken.
SHORT = 8
#: Subset keys that verifying a small class's candidates is worth.
VERIFY_COST = 32
#: Bits of a bucket's number, by elements per bucket aimed at; a task counts in a table of 64 MB at most.
BUCKET_BITS = (16, 23)
PER_BUCKET = 128
CHUNK = 8192
#: Bytes of a text hashed at once.
PIECE = 1 << 19
#: Elements of sets that a worker keeps while it verifies pairs, 32 MB.
HELD_ELEMENTS = 4_000_000
#: Rows of lists that a worker scans at once, and members of a heavy list that meet the rest of it in one task.
LIST_ROWS, PER_SALT = 200_000, 512

BASE = 0x9E3779B97F4A7C15
#: Whether a byte belongs to a word, and a random value for each byte.
WORD_BYTE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
BYTE_VALUE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < size:
        size = max(size, 1 << 16)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every word of lower-cased bytes, from the difference of two running sums."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = WORD_BYTE[raw]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(BASE))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word 5-grams; of its one sequence if it has fewer words."""
    if not text:
        return np.empty(0, np.uint64)
    data, parts = text.lower(), []
    while len(data) > PIECE:  # very long texts go piece by piece, cut before white space
        cut = max(data.rfind(c, 0, PIECE) for c in (b" ", b"\n", b"\t"))
        if cut <= 0:
            break
        parts.append(word_hashes(data[:cut]))
        data = data[cut:]
    codes = np.concatenate([*parts, word_hashes(data)])
    if not len(codes):
        return np.empty(0, np.uint64)
    size = min(WORDS, len(codes))
    total = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for i in range(size):
        total ^= codes[i : len(codes) - size + 1 + i]
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total += np.uint64(size)
    mixed(total).sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signature(elements: np.ndarray) -> int:
    """A class's number: 64 bits of its whole set."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def needed(s, t):
    """Elements that sets of these sizes must share."""
    return -(-3 * (s + t) // 7)


def prefix_length(s):
    return s - (-(-3 * s // 4)) + 1


def partner_sizes(s: int) -> range:
    return range(-(-3 * s // 4), 4 * s // 3 + 1)


def subset_cost(s: int) -> int:
    return sum(math.comb(s, needed(s, t)) for t in partner_sizes(s))


def boundary(sizes: dict[int, int]) -> int:
    """The largest size of small classes: the one with the least total cost."""
    best, least, gained = 0, 0.0, 0.0
    for s in range(1, 25):
        gained += sizes.get(s, 0) * (subset_cost(s) - prefix_length(s) - VERIFY_COST)
        if gained < least:
            best, least = s, gained
    return best


def bucket_bits(docs: DataFrame) -> int:
    """So many bits that a bucket gets PER_BUCKET elements or so, going by the texts' bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return int(min(BUCKET_BITS[1], max(BUCKET_BITS[0], math.log2(max(size / 6, 1) / PER_BUCKET))))


def classify(docs: DataFrame, bits: int) -> DataFrame:
    """(file, at, doc_id, size, cid) of all documents and, in rows with a chunk, each partition's counts
    of the elements of its classes by bucket."""
    shift = np.uint64(64 - bits)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << bits, dtype=np.int64)
        seen: set[int] = set()
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            cids = [signature(s) for s in sets]
            new = [s for c, s in zip(cids, sets, strict=True) if not (c in seen or seen.add(c))]
            if new:
                table += np.bincount((np.concatenate(new) >> shift).astype(np.int64), minlength=len(table))
            ids = {"file": batch["file"], "at": batch["at"], "doc_id": batch["doc_id"].astype("Int64"), "size": [len(s) for s in sets], "cid": cids}
            yield pd.DataFrame(ids).assign(chunk=None, part=None, counts=None)
        part = TaskContext.get().partitionId() % 64
        for at in range(0, len(table), CHUNK):
            piece = table[at : at + CHUNK]
            if piece.any():
                yield pd.DataFrame({"file": [None], "at": [None], "doc_id": [None], "size": [None], "cid": [None], "chunk": [at // CHUNK], "part": [part], "counts": [piece.astype("<i8").tobytes()]})

    return docs.select("file", "at", "doc_id", "text").mapInPandas(one, "file long, at long, doc_id long, size long, cid long, chunk int, part int, counts binary")


def new_sets(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The classes of a partition's texts, each once, batch by batch."""
    seen: set[int] = set()
    for batch in batches:
        found = []
        for text in batch["text"]:
            elements = shingles(text)
            cid = signature(elements)
            if len(elements) and cid not in seen:
                seen.add(cid)
                found.append((cid, elements))
        yield found


def frequent_buckets(counts: DataFrame, bits: int) -> np.ndarray:
    """For each bucket of elements, whether far more than the average of them fall into it."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype="<i8") for c in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    schema = "chunk int, part int, counts binary"
    sums = counts.groupBy("chunk", "part").applyInPandas(add, schema).withColumn("part", F.lit(0)).groupBy("chunk").applyInPandas(add, schema)
    table = np.zeros(1 << bits)
    for row in sums.toLocalIterator():
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], dtype="<i8")
    middle = float(np.median(table))
    return table > middle + max(32.0, 6 * math.sqrt(middle))


def subset_keys(elements: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(key, smaller size) for every subset that a small class lists; partners up to the boundary `limit`."""
    s = len(elements)
    for t in partner_sizes(s):
        if t <= limit:
            for chosen in combinations(elements.tolist(), needed(s, t)):
                data = np.array(chosen, dtype=np.uint64).tobytes() + bytes((min(s, t), max(s, t)))
                yield xxhash.xxh3_64_intdigest(data) - (1 << 63), min(s, t)


def post(docs: DataFrame, frequent: np.ndarray, bits: int, limit: int) -> DataFrame:
    """Rows of kind 0, subsets of small classes (n: the smaller size), and of kinds 1 and 2, rare
    and frequent prefix elements (n: the place)."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.unpackbits(held.value)
        shift = np.uint64(64 - bits)
        for found in new_sets(batches):
            parts = []
            for cid, elements in found:
                s = len(elements)
                if s <= limit:
                    listed = list(subset_keys(elements, limit))
                    parts.append((np.array([k for k, _ in listed], dtype=np.int64), np.array([n for _, n in listed]), np.zeros(len(listed), dtype=np.int64), cid, s))
                if 4 * s // 3 > limit:
                    flag = flags[(elements >> shift).astype(np.int64)]
                    order = np.argsort(flag, kind="stable")[: prefix_length(s)]
                    parts.append((elements[order].view(np.int64), np.arange(len(order)), 1 + flag[order].astype(np.int64), cid, s))
            if parts:
                lengths = [len(p[0]) for p in parts]
                yield pd.DataFrame(
                    {
                        "key": np.concatenate([p[0] for p in parts]),
                        "n": np.concatenate([p[1] for p in parts]).astype(np.int32),
                        "kind": np.concatenate([p[2] for p in parts]).astype(np.int8),
                        "cid": np.repeat(np.array([p[3] for p in parts], dtype=np.int64), lengths),
                        "size": np.repeat(np.array([p[4] for p in parts], dtype=np.int32), lengths),
                    }
                )

    return docs.select("text").mapInPandas(one, "key long, n int, kind byte, cid long, size int")


def fits(s, i, t, j):
    """Whether classes of sizes s and t that first meet at places i and j can link (numpy or Column)."""
    least = np.minimum(s - i, t - j)
    return (4 * np.minimum(s, t) >= 3 * np.maximum(s, t)) & (7 * least >= 3 * (s + t))


def fits_sql(s: str, i: str, t: str, j: str):
    s, i, t, j = (F.col(c) for c in (s, i, t, j))
    return (4 * F.least(s, t) >= 3 * F.greatest(s, t)) & (7 * F.least(s - i, t - j) >= 3 * (s + t))


def scan_lists(posted: DataFrame) -> DataFrame:
    """From lists that come one after the other: pairs (a, b) of short lists with long null, and the rows of long lists."""

    def out(a: np.ndarray, b: np.ndarray, size: np.ndarray, n: np.ndarray, long: bool) -> pa.RecordBatch:
        columns = [a, b, size.astype(np.int32), n.astype(np.int32), np.full(len(a), long)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "size", "n", "long"])

    def pairs_of(rows: list[np.ndarray], long_key: int | None) -> Iterator[pa.RecordBatch]:
        # most elements stand in one class only
        beside = rows[0][1:] == rows[0][:-1]
        shared = np.append(beside, False) | np.append(False, beside) if len(rows[0]) else np.empty(0, bool)
        if long_key is not None:
            shared |= rows[0] == long_key
        key, n, cid, size = (c[shared].astype(np.int64) for c in rows)
        order = np.lexsort((cid, key))
        key, n, cid, size = key[order], n[order], cid[order], size[order]
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
        key, n, cid, size = key[once], n[once], cid[once], size[once]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        length = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
        long = length > SHORT
        if long_key is not None:
            long |= key == long_key
        yield out(cid[long], key[long], size[long], n[long], True)
        left, right = [], []
        for gap in range(1, SHORT):
            i = np.flatnonzero((key[gap:] == key[:-gap]) & ~long[gap:]) if len(key) > gap else np.empty(0, np.int64)
            j = i + gap
            fine = fits(size[i], n[i], size[j], n[j])
            left.append(cid[i[fine]])
            right.append(cid[j[fine]])
        pairs = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()
        none = np.zeros(len(pairs))
        yield out(pairs["a"].to_numpy(), pairs["b"].to_numpy(), none, none, False)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held, long_key = 0, None
        for batch in batches:
            if batch.num_rows:
                waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                held += batch.num_rows
            if held >= LIST_ROWS:
                rows = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                # the last list may go on; it waits, unless it is long already
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                yield from pairs_of([c[:last] for c in rows], long_key)
                rest = [c[last:] for c in rows]
                if held - last > LIST_ROWS // 2:
                    long_key = int(rest[0][0])
                    yield from pairs_of(rest, long_key)
                    waiting, held = [], 0
                else:
                    waiting, held = [rest], held - last
        if waiting:
            yield from pairs_of([np.concatenate(c) for c in zip(*waiting, strict=True)], long_key)

    # Arrow columns: batches are small for the sake of texts, and a frame for each would cost more than its rows
    return posted.mapInArrow(one, "a long, b long, size int, n int, long boolean")


def verify(pairs: DataFrame, docs: DataFrame, wanted_of: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, by their whole texts."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    # one row for each class; its text is fetched by the row's number
    rows = wanted_of.join(wanted, "cid").select("cid", "file", "at")
    rows = F.broadcast(rows) if rows.count() <= 500_000 else rows
    texts = materialise(docs.select("text", "file", "at").join(rows, ["file", "at"]).select("cid", F.col("text").cast("binary").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("y")), "b")

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held = HeldSets()
        for a, b, x, y in batches:
            yield pd.Series([similar(held.get(*s), held.get(*t)) for s, t in zip(zip(a, x), zip(b, y), strict=True)], dtype=bool)

    return both.where(linked("a", "b", "x", "y")).select("a", "b")


class HeldSets:
    """The sets of some classes; a task keeps them, since a class often stands in many pairs."""

    def __init__(self) -> None:
        self.sets: dict[int, np.ndarray] = {}
        self.elements = 0

    def get(self, cid: int, text: bytes) -> np.ndarray:
        found = self.sets.get(cid)
        if found is None:
            found = shingles(text)
            if self.elements + len(found) > HELD_ELEMENTS:
                self.sets.clear()
                self.elements = 0
            self.sets[cid] = found
            self.elements += len(found)
        return found


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets link; given up as soon as too few elements are left to look up."""
    if len(s) > len(t):
        s, t = t, s
    least, common = needed(len(s), len(t)), 0
    step = max(64, len(s) // 8)
    for at in range(0, len(s), step):
        part = s[at : at + step]
        place = np.minimum(np.searchsorted(t, part), len(t) - 1)
        common += int(np.count_nonzero(t[place] == part))
        if common + len(s) - at - len(part) < least:
            return False
    return 100 * common >= 75 * (len(s) + len(t) - common)


def link_classes(docs: DataFrame, table: DataFrame, frequent: np.ndarray, bits: int) -> DataFrame:
    """(node, component) of classes that link with others; `table` is what classify() gives for `docs`."""
    classes = materialise(table.where(F.col("size") > 0).groupBy("cid").agg(F.min("size").alias("size"), F.min(F.struct("file", "at")).alias("place")).select("cid", "size", "place.*"), "classes")
    histogram = {r["size"]: r["count"] for r in classes.groupBy(F.least("size", F.lit(1000)).alias("size")).count().collect()}
    limit = boundary(histogram)
    posted = post(docs, frequent, bits, limit)
    # small classes: everything under a subset links with its least class of the smaller size
    few = materialise(posted.where("kind <> 1").distinct(), "few")
    small = few.where("kind = 0").select("key", "cid", "size", "n")
    least = small.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("size") == F.col("n"), F.col("cid"))).alias("root")).where((F.col("rows") > 1) & F.col("root").isNotNull())
    links = salted_lookup(small.select("key", "cid"), least, "key", "rows", ["cid"]).where(F.col("cid") != F.col("root")).select(F.col("root").alias("a"), F.col("cid").alias("b"))
    links = materialise(links.distinct(), "small")
    # large classes, rare elements: lists are short or fairly so
    scanned = materialise(scan_lists(posted.where("kind = 1").select("key", "n", "cid", "size").repartition("key").sortWithinPartitions("key")), "scanned")
    heavy = few.where("kind = 2").select("key", "n", "cid", "size").union(scanned.where("long").select(F.col("b").alias("key"), "n", F.col("a").alias("cid"), "size"))
    heavy = materialise(heavy, "heavy")
    first = F.min(F.struct((F.col("n") / F.col("size")).alias("share"), "cid", "size", "n"))
    pivots = heavy.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), first.alias("p")).where(F.col("rows") > 1)
    pivots = materialise(pivots.select("key", "rows", F.col("p.cid").alias("root"), F.col("p.size").alias("root_size"), F.col("p.n").alias("root_n")), "pivots")
    star = salted_lookup(heavy, pivots, "key", "rows", ["cid"])
    star = star.where((F.col("cid") != F.col("root")) & fits_sql("size", "n", "root_size", "root_n")).select(F.least("cid", "root").alias("a"), F.greatest("cid", "root").alias("b"))
    pairs = materialise(scanned.where(~F.col("long")).select("a", "b").union(star).distinct(), "pairs")
    links = materialise(links.union(verify(pairs, docs, classes)), "links")
    labels = components(links)
    # members of heavy lists that the star left outside meet the others, now that few are left
    named = materialise(salted_lookup(heavy, pivots, "key", "rows", ["cid"]).join(labels, F.col("cid") == labels["node"], "left").select("key", "n", "cid", "size", "root", F.coalesce("component", "cid").alias("label")), "named")
    tops = named.where(F.col("cid") == F.col("root")).select("key", F.col("label").alias("top")).distinct()
    counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high"))
    mixed = materialise(salted_lookup(named, tops.join(counts.select("key", "rows"), "key"), "key", "rows", ["cid"]), "mixed")
    salts = F.ceil(F.col("rows") / PER_SALT).cast("int")
    outside = mixed.where(F.col("label") != F.col("top")).select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *(F.col(c).alias(f"o_{c}") for c in ("n", "cid", "size", "label")))
    every = mixed.withColumn("salt", F.pmod(F.xxhash64("cid"), salts).cast("int"))
    met = outside.join(every, ["key", "salt"]).where((F.col("o_label") != F.col("label")) & fits_sql("o_size", "o_n", "size", "n"))
    more = met.select(F.least("cid", "o_cid").alias("a"), F.greatest("cid", "o_cid").alias("b")).distinct()
    more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return labels
    return components(links.union(verify(more, docs, classes)))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(file, at, doc_id, n_shingles, component_id, label) for every row of (file, at, doc_id, text), see common.placed().

    Null and empty texts have no shingles and link with nothing: their component is their own
    id. Equal texts and repeated rows are linked. Null ids count as larger than all others.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("file", "at", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bits = bucket_bits(docs)
    both = materialise(classify(docs, bits), "classified")
    table = both.where("chunk IS NULL").select("file", "at", "doc_id", "size", "cid")
    frequent = frequent_buckets(both.where("chunk IS NOT NULL").select("chunk", "part", "counts"), bits)
    labels = link_classes(docs, table, frequent, bits)
    ids = table.where(F.col("size") > 0).groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    grouped = materialise(ids.join(labels, ids["cid"] == labels["node"], "left").select("cid", "least", "rows", F.coalesce("component", "cid").alias("label")), "classes")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_rows"))
    # a class's rows are found through its number, a group's through its label: both joins are salted
    per_class = salted_lookup(grouped, grouped.groupBy("label").agg(F.count(F.lit(1)).alias("classes")).join(least, "label"), "label", "classes", ["cid"])
    full = salted_lookup(table.where(F.col("size") > 0), per_class.select("cid", "rows", "component_id", "label"), "cid", "rows", ["file", "at"])
    full = full.select("file", "at", "doc_id", F.col("size").alias("n_shingles"), "component_id", "label")
    alone = table.where(F.col("size") == 0).select("file", "at", "doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return full.union(alone)


def keep_one_of_group(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One document of each group of near ones, with all its columns: the one with the least id, and of
    rows with that id the first. Documents without shingles stay. Columns of any name may stand beside
    doc_id and text. Rows are written out first, unless `docs` is `stored`, a table as read."""
    file, at = unused(docs.columns, "file", "at")
    rows = placed(docs, file, at, stored)
    found = materialise(jaccard_components(rows.select(F.col(file).alias("file"), F.col(at).alias("at"), "doc_id", "text")), "components")
    grouped = found.where(F.col("label").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")
    first = grouped.groupBy("label").agg(F.min(order).alias("kept")).select("kept.file", "kept.at")
    kept = first.union(found.where(F.col("label").isNull()).select("file", "at")).toDF(file, at)
    return rows.join(kept, [file, at], "left_semi").select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near documents among all whole documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(placed(docs, stored=is_stored(docs))).select("doc_id", "n_shingles", "component_id")
