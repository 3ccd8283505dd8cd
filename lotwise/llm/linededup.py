"""Fuzzy line dedup with SimHash (Charikar, 2002; pigeonhole blocks after Manku et al., 2007).

Lines are normalised to their words: runs of letters in lower case, all else parts them.
Lines of equal words meet by a 64-bit hash. For near ones every distinct line gets a
SimHash of 60 bits of its pairs of neighbouring words (single words are too alike within a
language) and is posted under two kinds of keys:

- blocks of the hash: two hashes that differ in at most DISTANCE bits agree in all but
  DISTANCE blocks, so every choice of so many is a key. With more lines there are more
  blocks, so that keys have more bits; which lines meet within DISTANCE stays the same;
- every TRIPLE of its TOP first words, longest first: with up to TOP - TRIPLE words
  changed, added or dropped, two lines still share a key, whatever their length.

Lines that share a block key and are within DISTANCE bits, or a triple and are within FAR
bits, are candidates. They are verified by edit similarity, links form connected groups,
and each group keeps one occurrence, the first by document id, row and line.

DataFrame operations only. Under every key each line is first compared with the key's least
line, which connects copies. Then, under keys that still hold several groups, lines that stand
side by side in turned orders of the hashes are compared, which brings families of near lines
together at a cost in proportion to their size. At last, under every key that even then holds
several groups, all near lines of different groups are candidates: no partner is left out.
They are compared where they meet, each pair under one key, and only links leave the join.
No pair is compared again once it was found not to be near. The
pairs that it looks at grow with the square of the lines outside a key's largest group: lines
that share keys and near hashes, but aren't near by their letters, are all compared. Keys that
very many lines share are found in a part of the lines and windowed in buckets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, is_stored, materialise, placed, read_table, salted_lookup, unused

#: Lines of fewer words stay: they are too short to be a passage that was copied.
MIN_WORDS = 5
DISTANCE = 3
#: Keys of blocks have at least so many values for each line.
KEY_ROOM = 8
SIMILARITY = 0.85
#: Words of a line whose triples are keys, and bits that the hashes of such candidates may differ in.
TOP, TRIPLE, FAR = 5, 3, 24
#: Edits of characters that an edit of a piece of up to three letters, with the space after it, stands for at most.
PIECE_EDITS = 4
#: Bits by which hashes are turned in each round of comparing neighbours; what they leave apart meets in full.
TURNS = ((0, 15, 30, 45), (7, 22, 37, 52))
#: Lines of a key, and of those outside its largest group, that meet in one task.
MEETING_ROWS = 256
#: Of the lines one in so many shows which keys are frequent; rows of a bucket of such a key; keys listed at most.
SHOWN, BUCKET_ROWS, LISTED = 64, 4096, 20_000
#: Rows with lines to verify that may be broadcast, tens of MB; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bits of a SimHash.
BITS = 60
#: Width of a counter in lines of up to LANE_MOST words, and in longer ones; its highest bit is spare.
LANE, LONG_LANE = 12, 30
LANE_MOST = (1 << LANE - 1) - 1
#: Bits of a SimHash's fold, where one bit of the hash changes one bit.
FOLD = 16
LINE = ["file", "at", "doc_id", "line", "key", *(f"top{i}" for i in range(TOP))]


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}]+"), "")


def hashed_words(line: Column) -> Column:
    """A long for every word: BITS bits of its hash and, above them, a rank that is smaller for longer words."""
    rank = lambda w: (F.lit(7) - F.least(F.length(w), F.lit(15))) * F.lit(1 << BITS)
    return F.transform(words_of(line), lambda w: rank(w) + F.shiftrightunsigned(F.xxhash64(w), 64 - BITS))


def hashed_lines(docs: DataFrame, chars: int) -> DataFrame:
    """(file, at, doc_id, line, words) of the lines of at least `chars` characters, words hashed. Lines too short have null words."""
    hashed = lambda x: F.when(F.length(x) >= chars, hashed_words(x)) if chars else hashed_words(x)
    docs = docs.where(F.col("text").rlike(rf"(?md)^[^\n]{{{chars}}}")) if chars else docs
    # an outer generator: nothing of the hashing is then done twice to filter its input
    return docs.select("file", "at", "doc_id", F.posexplode_outer(F.transform(F.split("text", "\n"), hashed)).alias("line", "words"))


def majority(lines: DataFrame, lane: int) -> DataFrame:
    """LINE and `sim` of lines (file, at, doc_id, line, words): bit i is set if it is in more than half of the hashes of word pairs.

    Counters of `lane` bits lie side by side in longs, so that one sum counts several bits.
    """
    lanes = sum(1 << i for i in range(0, BITS, lane))
    top = F.slice(F.array_distinct(F.sort_array("words")), 1, TOP)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.xxhash64(a, b))
    pairs = F.when(F.size("words") > 1, pairs).otherwise(F.col("words"))
    lines = lines.select("file", "at", "doc_id", "line", F.xxhash64("words").alias("key"), pairs.alias("pairs"), top.alias("top"))
    # rank and some bits of the hash fit an int; lines with fewer different words are filled up
    tops = (F.coalesce(F.shiftright(F.get("top", F.lit(i)), BITS - 27).cast("int"), F.lit(-(1 << 31) + i).cast("int")).alias(f"top{i}") for i in range(TOP))
    lines = lines.select("file", "at", "doc_id", "line", "key", *tops, "pairs")
    features = lines.select(*LINE, F.explode_outer("pairs").alias("h"))
    sums = features.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(lanes))).alias(f"s{b}") for b in range(lane)))
    # a counter's spare bit is set by adding this if it counts more than half
    sums = sums.withColumn("more", (F.lit((1 << lane - 1) - 1) - F.shiftright("n", 1)) * F.lit(lanes))
    bits = F.lit(0).cast("long")
    for b in range(lane):
        bits = bits.bitwiseOR(F.shiftrightunsigned((F.col(f"s{b}") + F.col("more")).bitwiseAND(F.lit(lanes << lane - 1)), lane - 1 - b))
    return sums.select(*LINE, bits.alias("sim"))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """LINE and `sim` of all lines that take part; `docs` has (file, at, doc_id, text)."""
    n = F.size("words")
    short = hashed_lines(docs, 0).where((n >= max(min_words, 1)) & (n <= LANE_MOST))
    long = hashed_lines(docs, 2 * LANE_MOST + 1).where((n >= max(min_words, 1)) & (n > LANE_MOST))
    return majority(short, LANE).union(majority(long, LONG_LANE))


def blocks_for(lines: int, distance: int = DISTANCE) -> int:
    """The least number of blocks with which keys have KEY_ROOM values for each line, up to ten more than the distance."""
    return next((n for n in range(distance + 2, distance + 10) if 2 ** (BITS * (n - distance) // n) >= KEY_ROOM * lines), distance + 10)


def block_keys(sim: Column, distance: int, blocks: int) -> list[Column]:
    """For every choice of blocks - distance blocks, a hash of their bits and of the choice itself."""
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    masks = (sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - distance))
    return [F.xxhash64(F.lit(number), sim.bitwiseAND(F.lit(mask).cast("long"))) for number, mask in enumerate(masks)]


def word_keys(tops: list[Column]) -> list[Column]:
    return [F.xxhash64(*(tops[i] for i in chosen)) for chosen in combinations(range(len(tops)), TRIPLE)]


def keys_of(distinct: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(posting, key, fold): every line under all its keys; the lowest bit of a block key is set, that of a triple isn't."""
    of_blocks = [k.bitwiseOR(F.lit(1).cast("long")) for k in block_keys(F.col("sim"), distance, blocks)]
    triples = [k.bitwiseAND(F.lit(-2).cast("long")) for k in word_keys([F.col(f"top{i}") for i in range(TOP)])]
    return distinct.select(F.explode_outer(F.array(*of_blocks, *triples)).alias("posting"), "key", folded(F.col("sim")).alias("fold"))


def folded(sim: Column) -> Column:
    """FOLD bits that differ in no more places than the hashes do."""
    out = sim
    for at in range(FOLD, BITS, FOLD):
        out = out.bitwiseXOR(F.shiftrightunsigned(sim, at))
    return out.bitwiseAND(F.lit((1 << FOLD) - 1)).cast("int")


def of_block(posting: Column) -> Column:
    return posting.bitwiseAND(F.lit(1).cast("long")) == 1


def near(a: Column, b: Column, posting: Column, distance: int) -> Column:
    """Whether hashes are near enough for the kind of key they share."""
    return F.bit_count(a.bitwiseXOR(b)) <= F.when(of_block(posting), distance).otherwise(FAR)


def in_buckets(posted: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds `bucket`: 0, or for keys that are frequent one of as many as keep a bucket at BUCKET_ROWS rows or so.

    Frequent keys are those that are often among the `shown` ones, the keys of one line in SHOWN; the bar rises with the lines, so that at most LISTED are broadcast.
    """
    shown = shown.groupBy("posting").count()
    shown = materialise(shown.where(F.col("count") * SHOWN >= BUCKET_ROWS), "frequent")
    bar = max(BUCKET_ROWS // SHOWN, (shown.agg(F.sum("count")).first()[0] or 0) // LISTED)
    frequent = shown.where(F.col("count") > bar).select(F.col("posting").alias("hot"), F.ceil(F.col("count") * SHOWN / BUCKET_ROWS).cast("int").alias("buckets"))
    posted = posted.join(F.broadcast(frequent), F.col("posting") == F.col("hot"), "left")
    return posted.select("posting", "key", "fold", F.when(F.col("buckets").isNull(), 0).otherwise(1 + F.pmod(F.hash("key"), F.col("buckets"))).alias("bucket"))


def compared(rows: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Adds the least line `x` of the same key, null where not near, and whether a line is that one (`leads`)."""
    least = F.first(F.struct("sim", "key")).over(W.partitionBy(*by).orderBy("sim", "key"))
    rows = rows.withColumn("least", least).withColumn("leads", F.col("least.key") == F.col("key"))
    found = ~F.col("leads") & near(F.col("sim"), F.col("least.sim"), F.col("posting"), distance)
    return rows.withColumn("x", F.when(found, F.col("least.key"))).drop("least")


def postings(distinct: DataFrame, distance: int) -> DataFrame:
    """(posting, key, sim, x, full): lines under keys that they share, and the least line if near. Two lines are `full`: they have met."""
    blocks = blocks_for(distinct.count(), distance)
    some = distinct.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SHOWN)) == 0)
    posted = in_buckets(keys_of(distinct, distance, blocks), keys_of(some, distance, blocks))
    together = W.partitionBy("posting", "bucket")
    ends = [f("fold").over(together).alias(f.__name__) for f in (F.min, F.max)]
    shared = posted.select("posting", "key", "bucket", F.count(F.lit(1)).over(together).alias("n"), *ends).where((F.col("n") > 1) | (F.col("bucket") > 0))
    # most lines that share a block key do so by chance; of two the folds tell
    chance = (F.col("bucket") == 0) & (F.col("n") == 2) & of_block(F.col("posting")) & (F.bit_count(F.col("min").bitwiseXOR(F.col("max"))) > distance)
    shared = materialise(shared.where(~chance).drop("min", "max"), "shared").join(distinct.select("key", "sim"), "key")
    seen = compared(shared, ["posting", "bucket"], distance).withColumn("full", (F.col("bucket") == 0) & (F.col("n") == 2))
    kept = materialise(seen.where(~F.col("full") | F.col("x").isNotNull()), "postings")
    leaders = compared(kept.where("bucket > 0 AND leads").select("posting", "key", "sim"), ["posting"], distance)
    columns = ["posting", "key", "sim", "x", "full"]
    return kept.select(*columns).union(leaders.withColumn("full", F.lit(False)).select(*columns))


def still_mixed(seen: DataFrame, groups: DataFrame) -> DataFrame:
    """(posting, key, sim, group, n, outside, top): lines under keys that hold several groups, the key's lines, those outside its largest group, and that group."""
    rows = seen.where(~F.col("full")).select("posting", "key", "sim").distinct()
    rows = rows.join(groups, rows["key"] == groups["node"], "left").select("posting", "key", "sim", F.coalesce("component", "key").alias("group"))
    rows = materialise(rows, "grouped")
    tops = rows.groupBy("posting", "group").agg(F.count(F.lit(1)).alias("n"))
    tops = tops.groupBy("posting").agg(F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("most"), F.count(F.lit(1)).alias("groups")).where(F.col("groups") > 1)
    tops = materialise(tops.select("posting", "n", (F.col("n") - F.col("most.n")).alias("outside"), F.col("most.group").alias("top")), "tops")
    return materialise(salted_lookup(rows, tops, "posting", "n", ["key"]), "mixed")


def neighbours(mixed: DataFrame, turns: tuple[int, ...], distance: int) -> DataFrame:
    """Pairs (x, y) of near lines of different groups that stand side by side under a key, hashes turned by each of `turns`."""
    full = (1 << BITS) - 1
    turned = [(F.shiftleft("sim", t).bitwiseAND(F.lit(full)) + F.shiftrightunsigned("sim", BITS - t)).alias(f"t{t}") for t in turns]
    rows = mixed.withColumn("salt", F.pmod(F.hash("key"), F.ceil(F.col("n") / BUCKET_ROWS).cast("int"))).select("posting", "salt", "key", "sim", "group", *turned)
    before = [F.lag(F.struct("key", "sim", "group")).over(W.partitionBy("posting", "salt").orderBy(f"t{t}", "key")).alias(f"o{t}") for t in turns]
    sides = rows.select("posting", "key", "sim", "group", *before).select("posting", "key", "sim", "group", F.explode(F.array(*(f"o{t}" for t in turns))).alias("o"))
    met = sides.where((F.col("o.group") != F.col("group")) & near(F.col("sim"), F.col("o.sim"), F.col("posting"), distance))
    return met.select(F.least("key", "o.key").alias("x"), F.greatest("key", "o.key").alias("y")).distinct()


def meeting(mixed: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines outside their key's largest group, columns with o_ before their names, and all lines, dealt so that they meet by (posting, i, j).

    `lines` has more columns for each `line`.
    """
    across, along = (F.ceil(F.col(c) / MEETING_ROWS).cast("int") for c in ("outside", "n"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    with_line = lambda rows: rows.join(lines, rows["key"] == lines["line"]).drop("line")
    outside = with_line(mixed.where(F.col("group") != F.col("top"))).withColumn("i", own(across)).withColumn("j", each(along))
    outside = outside.select("posting", "i", "j", *(F.col(c).alias(f"o_{c}") for c in ("key", "sim", "group", *lines.drop("line").columns)))
    return outside, with_line(mixed).withColumn("j", own(along)).withColumn("i", each(across)).drop("n", "outside")


def candidates(distance: int) -> Column:
    """Whether two lines that meet are a pair of different groups and near: two outside meet twice, one outside and one of the largest group once."""
    once = (F.col("o_key") < F.col("key")) | (F.col("group") == F.col("top"))
    return (F.col("o_group") != F.col("group")) & once & near(F.col("o_sim"), F.col("sim"), F.col("posting"), distance)


def partners(rejected: DataFrame) -> DataFrame:
    """(line, known): of every rejected pair (x, y) one line has the other, that of fewer pairs, so that no line has very many."""
    n = rejected.select(F.explode(F.array("x", "y")).alias("key")).groupBy("key").count()
    of = [n.select(F.col("key").alias(k), F.col("count").alias(c)) for k, c in (("x", "nx"), ("y", "ny"))]
    pairs = rejected.join(of[0], "x").join(of[1], "y")
    ends = F.when(F.col("nx") <= F.col("ny"), F.struct(F.col("x").alias("line"), F.col("y").alias("other"))).otherwise(F.struct(F.col("y").alias("line"), F.col("x").alias("other")))
    return pairs.select(ends.alias("end")).select("end.*").groupBy("line").agg(F.collect_set("other").alias("known"))


def still_open(mixed: DataFrame, texts: DataFrame, rejected: DataFrame, distance: int, similarity: float) -> DataFrame:
    """The rows of `mixed` that meet a line they may be near to, by hash and length, and were not compared with. No texts travel, nor do pairs leave."""
    lines = texts.select(F.col("key").alias("line"), F.length("norm").alias("size")).join(partners(rejected), "line", "left")
    outside, every = meeting(mixed, lines)
    known = F.coalesce(F.array_contains("known", F.col("o_key")), F.lit(False)) | F.coalesce(F.array_contains("o_known", F.col("key")), F.lit(False))
    found = candidates(distance) & (F.abs(F.col("size") - F.col("o_size")) <= most_edits(F.col("size"), F.col("o_size"), similarity)) & ~known
    outside = outside.withColumnsRenamed({c: f"o_{c}" for c in ("posting", "i", "j")})
    for c in ("posting", "i", "j"):
        found = (F.col(c) == F.col(f"o_{c}")) & found
    left = outside.join(every, found, "left_semi").select(F.col("o_posting").alias("posting"), F.col("o_key").alias("key"))
    right = every.join(outside, found, "left_semi").select("posting", "key")
    return materialise(mixed.join(left.union(right).distinct(), ["posting", "key"], "left_semi"), "open")


def still_apart(seen: DataFrame, groups: DataFrame, distance: int, texts: DataFrame | None = None, similarity: float = SIMILARITY, rejected: DataFrame | None = None) -> DataFrame:
    """All pairs (x, y) of lines of different groups that share a key and are near, and the `bits` in which their hashes differ.

    With `texts` (key, norm), the lines' own, those that are near by their letters; pairs (x, y) that are `rejected` already, x < y, aren't
    compared. Lines outside a key's largest group meet all its lines of other groups, dealt over tasks; of the keys that two lines share one
    compares them.
    """
    mixed = still_mixed(seen, groups)
    if rejected is not None:
        mixed = still_open(mixed, texts, rejected, distance, similarity)
        texts = of_keys(texts, mixed.select("key").distinct())
    under = mixed.groupBy("key").agg(F.collect_set("posting").alias("all"))
    if rejected is not None:
        under = under.join(partners(rejected), under["key"] == F.col("line"), "left").drop("line")
    outside, every = meeting(mixed, (under if texts is None else under.join(texts.select("key", "norm"), "key")).withColumnRenamed("key", "line"))
    bits = F.bit_count(F.col("sim").bitwiseXOR(F.col("o_sim")))
    shared = F.array_intersect("all", "o_all")
    first = F.array_min(F.when(bits <= distance, shared).otherwise(F.filter(shared, lambda p: ~of_block(p))))
    found = candidates(distance)
    if rejected is not None:
        for known, key in (("known", "o_key"), ("o_known", "key")):
            found = found & ~F.coalesce(F.array_contains(known, F.col(key)), F.lit(False))
    if texts is not None:
        most = most_edits(F.length("norm"), F.length("o_norm"), similarity)
        found = found & (F.abs(F.length("norm") - F.length("o_norm")) <= most)
        # the dear test comes last, and for one key
        found = F.when(~found, False).when(first != F.col("posting"), False).otherwise(F.call_function("levenshtein", "norm", "o_norm", most) >= 0)
    else:
        found = F.when(found, first == F.col("posting")).otherwise(False)
    met = outside.join(every, ["posting", "i", "j"]).where(found)
    return met.select(F.least("key", "o_key").alias("x"), F.greatest("key", "o_key").alias("y"), bits.alias("bits"))


def coded(norm: Column) -> Column:
    """A line in pieces of up to three letters of a word, each as one character by its hash."""
    codes = F.transform(F.regexp_extract_all(norm, F.lit("[^ ]{1,3}"), F.lit(0)), lambda p: F.hex(F.pmod(F.hash(p), F.lit(1 << 15)) + F.lit(1 << 12)))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def texts_of(docs: DataFrame, distinct: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, norm, code) of the lines of these keys, each once, read where `distinct` has them."""
    wanted = keys.toDF("key").distinct()
    places = distinct.select("key", "file", "at", "line").join(wanted, "key").groupBy("file", "at").agg(F.collect_list(F.struct("line", "key")).alias("wanted"))
    places = materialise(places, "wanted")
    places = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    rows = docs.select("file", "at", "text").join(places, ["file", "at"]).select(F.split("text", "\n").alias("raw"), "wanted")
    lines = F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), F.array_join(words_of(F.get("raw", w["line"])), " ").alias("norm")))
    return materialise(rows.select(F.inline_outer(lines)).select("key", "norm", coded(F.col("norm")).alias("code")), "texts")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose texts need few enough edits."""
    return verdicts(pairs, texts, similarity).where("near").select("x", "y")


def verdicts(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) and whether they are `near`: their texts need few enough edits.

    An edit of a piece of a word is worth at most PIECE_EDITS edits of characters: pairs that are near by pieces, a twelfth of the work,
    need no more. All others are compared in full, whatever their length.
    """
    ends = [texts.select(F.col("key").alias(k), F.col("norm").alias(s), F.col("code").alias(c)) for k, s, c in (("x", "s", "c"), ("y", "t", "d"))]
    both = pairs.join(ends[0], "x").join(ends[1], "y")
    both = both.withColumn("most", most_edits(F.length("s"), F.length("t"), similarity))
    apart = F.abs(F.length("s") - F.length("t")) > F.col("most")
    by_pieces = F.expr(f"levenshtein(c, d, most div {PIECE_EDITS})") >= 0
    full = within(F.col("s"), F.col("t"), F.col("most"))
    return both.select("x", "y", F.when(apart, False).when(by_pieces, True).otherwise(full).alias("near"))


def let(value: Column, f) -> Column:
    """f(value), where the value is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unlike(s: Column, t: Column) -> Column:
    """(s, t) from the first character in which they differ on, reversed."""
    longer = lambda n, w: F.when(F.substring(s, n + 1, w) == F.substring(t, n + 1, w), n + w).otherwise(n)
    alike = F.aggregate(F.array(*(F.lit(1 << i) for i in range(20, -1, -1))), F.lit(0), longer)
    tail = lambda x, n: F.reverse(F.substring(x, n + 1, F.length(x)))
    return let(F.least(alike, F.length(s), F.length(t)), lambda n: F.struct(tail(s, n).alias("s"), tail(t, n).alias("t")))


def within(s: Column, t: Column, most: Column) -> Column:
    """Whether `most` edits make s into t. What they have in common at both ends needs none, and isn't compared."""
    both = let(unlike(s, t), lambda a: unlike(a["s"], a["t"]))
    return let(both, lambda a: F.call_function("levenshtein", a["s"], a["t"], most)) >= 0


def of_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of these distinct keys, without sending all others to a join if the keys are few."""
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key", "left_semi")


def most_edits(s: Column, t: Column, similarity: float) -> Column:
    """The edits that lines of these lengths may differ in."""
    return F.floor(F.greatest(s, t) * (1 - similarity)).cast("int")


def grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) between groups; a line alone is a group by its own key."""
    merged = components(links, "a", "b")
    to = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
    both = groups.join(to, groups["component"] == to["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    return materialise(both.union(merged.join(groups.select("node"), "node", "left_anti").select("node", "component")), "groups")


def near_lines(docs: DataFrame, distinct: DataFrame, distance: int, similarity: float) -> DataFrame:
    """(node, component) of distinct lines (key, sim, top0, top1, ..., file, at, line) that have near ones."""
    seen = postings(distinct, distance)
    ends = seen.where(F.col("x").isNotNull()).select("x", F.col("key").alias("y"))
    pairs = materialise(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    texts = texts_of(docs, distinct, pairs.select("x").union(pairs.select("y")))
    tried = materialise(verdicts(pairs, texts, similarity), "tree")
    groups = components(tried.where("near"), "x", "y")
    rejected = tried.where("NOT near").select("x", "y")
    whole = None
    for turns in TURNS:
        mixed = still_mixed(seen, groups)
        if mixed.isEmpty():
            return groups
        # what was read for the tree isn't read again
        whole = texts.union(texts_of(docs, distinct, mixed.select("key").distinct().join(texts, "key", "left_anti"))) if whole is None else whole
        met = materialise(neighbours(mixed, turns, distance).join(rejected, ["x", "y"], "left_anti"), "met")
        ends = met.select(F.explode(F.array("x", "y")).alias("key")).distinct()
        tried = materialise(verdicts(met, of_keys(whole, ends), similarity), "tried")
        rejected = rejected.union(tried.where("NOT near").select("x", "y"))
        groups = joined(groups, tried.where("near"))
    return joined(groups, still_apart(seen, groups, distance, whole, similarity, rejected))


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (x, y) between lines."""
    named = [groups.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("x", "a"), ("y", "b"))]
    links = links.join(named[0], "x", "left").join(named[1], "y", "left")
    links = materialise(links.select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b")).distinct(), "found")
    return groups if links.isEmpty() else grown(groups, links)


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(file, at, removed): for each row of `docs` with lines to remove, their numbers from 0.

    `docs` has (doc_id, text) and the places of common.placed().
    """
    docs = docs.select("file", "at", F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = materialise(lines_of(docs, min_words), "lines")
    same = [F.first(c).alias(c) for c in ("sim", *(f"top{i}" for i in range(TOP)), "file", "at", "line")]
    distinct = materialise(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc"), *same), "distinct")
    groups = near_lines(docs, distinct, distance, similarity)
    grouped = distinct.join(groups, distinct["key"] == groups["node"], "left").select("key", "n", "doc", F.coalesce("component", "key").alias("group"))
    totals = grouped.groupBy("group").agg(F.sum("n").alias("total"), F.min("doc").alias("doc")).where(F.col("total") > 1)
    repeated = materialise(grouped.select("key", "n", "group").join(totals, "group"), "repeated")
    found = salted_lookup(lines.select("file", "at", "doc_id", "line", "key"), repeated, "key", "n", ["at", "line"])
    found = materialise(found.select("file", "at", "line", "group", F.col("doc_id").eqNullSafe(F.col("doc")).alias("first")), "found")
    kept = found.where("first").groupBy("group").agg(F.min(F.struct("file", "at", "line")).alias("kept")).select("kept.*")
    return found.join(kept, ["file", "at", "line"], "left_anti").groupBy("file", "at").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, distance: int = DISTANCE, similarity: float = SIMILARITY, stored: bool = False) -> DataFrame:
    """The documents with one occurrence of each group of near lines, other lines and columns as they were.

    Documents that lose all their words go. Null and empty texts have no lines and stay;
    lines of fewer than `min_words` words stay; repeated rows are copies like any others, null
    ids come last. Columns of any name may stand beside doc_id and text. Rows are written out
    first, unless `docs` is `stored`, a table as read.
    """
    file, at, removed = unused(docs.columns, "file", "at", "removed")
    rows = placed(docs, file, at, stored)
    gone = removed_lines(rows.select(F.col(file).alias("file"), F.col(at).alias("at"), "doc_id", "text"), min_words, distance, similarity)
    rows = rows.join(gone.select(F.col("file").alias(file), F.col("at").alias(at), F.col("removed").alias(removed)), [file, at], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(removed), i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(removed).isNotNull(), left).otherwise(F.col("text")))
    return rows.where(F.col(removed).isNull() | F.col("text").rlike(r"[\p{L}\p{N}]")).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the number of its lines and the numbers of those that are removed."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = placed(docs, stored=is_stored(docs))
    gone = removed_lines(docs)
    rows = docs.select("file", "at", "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long"))).join(gone, ["file", "at"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))
