"""A Merkle manifest of a table, and proofs by coordinate lookup.

Every row is a leaf: the SHA-256 of its fields, each written with its length. The leaves of
a group of rows (a source) stand in the order of their keys and every FANOUT consecutive
nodes become one of the next level, until one is left, the group's subroot. The subroots,
ordered by group, likewise give the root.

A proof looks its nodes up by coordinates: from a leaf's index, the size of its group and
the number of groups follows which siblings it needs on every level. Leaves explode into
these coordinates, join the stored node table, and what they find is ordered, concatenated
and folded.

All of it is DataFrame work. Rows get their index from sorted files: a file's rows are
counted, and the counts of the files that a group spans are summed up, so a group of any
size is numbered by many tasks. The nodes near the root are looked up by very many leaves;
the node table knows for each node by how many, and the join is salted by that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, placed, read_table, salted_lookup

FANOUT = 3
#: The table's fields that a leaf covers, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The tree of the subroots; the others have the numbers of their groups.
TOP = -1


def digest(*parts: Column) -> Column:
    """The lowercase hex SHA-256 of strings put one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**values: Column) -> Column:
    return digest(*(field(value) for value in values.values()))


def powers(fanout: int) -> list[int]:
    """All powers of the fanout that a long holds."""
    out = [1]
    while out[-1] * fanout < 1 << 63:
        out.append(out[-1] * fanout)
    return out


def height(size: Column, fanout: int) -> Column:
    """The number of levels below the root of a tree with so many leaves; 0 for one."""
    return F.size(F.filter(F.array(*(F.lit(p) for p in powers(fanout))), lambda p: p < size))


def sibling_coordinates(tree: Column, index: Column, size: Column, fanout: int, first_step: Column) -> Column:
    """The nodes that a proof needs within one tree, by index and size alone: an array of step, node (tree, level, place) and
    whether the node stands before the leaf's own."""
    sizes = F.array(*(F.lit(p) for p in powers(fanout)))

    def of_level(level: Column) -> Column:
        width = F.element_at(sizes, level + 1)
        own, count = F.floor(index / width), F.ceil(size / width)
        start = F.floor(own / fanout) * fanout
        places = F.filter(F.sequence(start, F.least(start + fanout - 1, count - 1)), lambda p: p != own)
        return F.transform(
            places,
            lambda p: F.struct((first_step + level).alias("step"), F.struct(tree.cast("long").alias("tree"), level.alias("level"), p.cast("long").alias("place")).alias("node"), (p < own).alias("before")),
        )

    levels = height(size, fanout)
    return F.when(levels > 0, F.flatten(F.transform(F.sequence(F.lit(0), levels - 1), of_level)))


def fold(leaf: Column, siblings: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings (structs of step, place, before and digest, in order) lead to."""

    def side(step: Column, before: bool) -> Column:
        wanted = F.filter(siblings, lambda s: (s["step"] == step) & (s["before"] == F.lit(before)))
        return F.array_join(F.transform(wanted, lambda s: s["digest"]), "")

    folded = F.aggregate(F.sequence(F.lit(0), steps - 1), leaf, lambda node, step: digest(side(step, True), node, side(step, False)))
    return F.when(steps > 0, folded).otherwise(leaf)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Stored rows with `index` from 0 in each group, in order, the group's size `n` and its number `group_no`, groups in order.

    The rows are sorted over all tasks and written; a file's rows of a group are one piece, and the pieces, at most as
    many as files and groups, carry the counts. Nulls come first. Rows equal in all columns of `order` may stand in any order.
    """
    stored = materialise(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order), "ordered")
    stored = placed(stored, "_file", "_at", stored=True).withColumn("_piece", F.struct("_file", *group))
    pieces = stored.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"), F.min(F.struct(*order)).alias("_least"))
    keys = [F.col("_piece")[g] for g in group]
    inside = W.partitionBy(*keys)
    pieces = pieces.select("*", (F.sum("_rows").over(inside.orderBy("_least")) - F.col("_rows")).alias("_start"), F.sum("_rows").over(inside).alias("n"))
    if group:
        names = numbered(pieces.select(*(k.alias(g) for k, g in zip(keys, group, strict=True))).distinct(), [], group).withColumnRenamed("index", "group_no").drop("n")
        same = [pieces["_piece"][g].eqNullSafe(names[g]) for g in group]
        pieces = pieces.join(names, same).select(pieces["*"], "group_no")
    found = salted_lookup(stored, materialise(pieces, "pieces"), "_piece", "_rows", ["_at"])
    return found.withColumn("index", F.col("_start") + F.col("_at") - F.col("_first")).drop("_piece", "_rows", "_first", "_least", "_start", "_file", "_at")


@dataclass
class Manifest:
    """leaves: the given columns, index, n and group_no; nodes: node (tree, level, place), digest and lookups;
    subroots: group_no, digest, n. The root is null where there is no row."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    groups: int
    fanout: int

    def proofs(self) -> DataFrame:
        """group_no, index and `siblings` of every leaf that has any: structs of step, place, before and digest, from the leaf upwards, left to right."""
        own = sibling_coordinates(F.col("group_no"), F.col("index"), F.col("n"), self.fanout, F.lit(0))
        shared = sibling_coordinates(F.lit(TOP), F.col("group_no"), F.lit(self.groups).cast("long"), self.fanout, height(F.col("n"), self.fanout))
        none = F.lit(None).cast("array<struct<step:int,node:struct<tree:bigint,level:int,place:bigint>,before:boolean>>")
        wanted = self.leaves.select("group_no", "index", F.explode(F.concat(*(F.coalesce(c, none, F.array()) for c in (own, shared)))).alias("at"))
        wanted = wanted.select("group_no", "index", "at.step", "at.node", "at.before")
        found = salted_lookup(wanted, self.nodes, "node", "lookups", ["group_no", "index"])
        sibling = F.struct("step", F.col("node.place").alias("place"), "before", "digest")
        return found.groupBy("group_no", "index").agg(F.array_sort(F.collect_list(sibling)).alias("siblings"))


def levels_of(nodes: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Groups of siblings of every level, and the roots, of trees whose nodes (tree, place, n, digest, weight) are given; no tree has more than `most`."""
    groups, roots, level = [], nodes.where("n = 1"), 0
    while most > 1:
        keys = ["tree", "n", F.floor(F.col("place") / fanout).alias("parent")]
        members = F.array_sort(F.collect_list(F.struct("place", "digest", "weight"))).alias("members")
        stored = materialise(nodes.where("n > 1").groupBy(*keys).agg(members).withColumn("level", F.lit(level)), "level")
        groups.append(stored)
        up = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
        weight = F.aggregate("members", F.lit(0).cast("long"), lambda total, m: total + m["weight"])
        nodes = stored.select("tree", F.col("parent").alias("place"), F.ceil(F.col("n") / fanout).alias("n"), up.alias("digest"), weight.alias("weight"))
        roots = roots.unionByName(nodes.where("n = 1"))
        most, level = -(-most // fanout), level + 1
    return groups, roots


def build(rows: DataFrame, leaf: str, group: str, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The manifest of rows with their leaf digests, by group, leaves ordered by the columns of `order` (null first).

    Rows that are equal in these columns are ordered by their digests; equal digests may change places, which changes
    nothing. A null group is a group. An empty table has no root. Nodes carry the number of leaves below them.
    """
    leaves = materialise(numbered(rows, [group], [*order, leaf]), "leaves")
    most = leaves.agg(F.max("n"), F.max("group_no")).first()
    start = leaves.select(F.col("group_no").alias("tree"), F.col("index").alias("place"), "n", F.col(leaf).alias("digest"), F.lit(1).cast("long").alias("weight"))
    below, roots = levels_of(start, most[0] or 0, fanout)
    subroots = materialise(roots.select(F.col("tree").alias("group_no"), "digest", F.col("weight").alias("n")), "subroots")
    groups = (most[1] + 1) if most[1] is not None else 0
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("group_no").alias("place"), F.lit(groups).cast("long").alias("n"), "digest", F.col("n").alias("weight"))
    above, top = levels_of(tops, groups, fanout)
    root = top.first()
    nodes = None
    for level in [*below, *above]:
        weights = F.aggregate("members", F.lit(0).cast("long"), lambda total, m: total + m["weight"])
        member = level.select("tree", "level", F.explode("members").alias("m"), weights.alias("all"))
        node = F.struct("tree", "level", F.col("m.place").alias("place")).alias("node")
        part = member.select(node, F.col("m.digest").alias("digest"), (F.col("all") - F.col("m.weight")).alias("lookups")).where("lookups > 0")
        nodes = part if nodes is None else nodes.unionByName(part)
    if nodes is None:
        nodes = rows.sparkSession.createDataFrame([], "node struct<tree:bigint,level:int,place:bigint>, digest string, lookups bigint")
    return Manifest(leaves, nodes, subroots, root["digest"] if root else None, groups, fanout)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; proofs of documents with an even checksum of their id are folded
    from a text that lost its line ends, which is found out wherever it had any.

    Null fields are written `-`. Repeated rows are leaves of their own; a null doc_id comes first and counts as '' in the checksum.
    """
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {name: F.col(name) for name in FIELDS}
    tampered = leaf_digest(**{**fields, "text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    leaves = docs.select("doc_id", "source", leaf_digest(**fields).alias("leaf"), F.when(even, tampered).alias("tampered"))
    made = build(leaves, "leaf", "source", ["doc_id"])
    subroots = made.subroots.select("group_no", F.col("digest").alias("subroot"), F.col("n").alias("_leaves"))
    rows = salted_lookup(made.leaves, subroots, "group_no", "_leaves", ["index"])
    rows = rows.join(made.proofs(), ["group_no", "index"], "left")
    siblings = F.coalesce("siblings", F.lit(None).cast("array<struct<step:int,place:bigint,before:boolean,digest:string>>"), F.array())
    steps = height(F.col("n"), made.fanout) + height(F.lit(made.groups).cast("long"), made.fanout)
    rows = rows.withColumn("siblings", siblings).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("siblings"), steps))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: s["digest"]), ""), 256)
    root = F.lit(made.root).cast("string")
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
