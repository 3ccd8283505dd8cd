"""The Merkle manifest against a plain tree in memory."""

import collections
import hashlib
import random
import zlib

from lotwise.llm import merkle
from lotwise.llm.common import read_table

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, index int, node string, Siblings int"


def together(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return together(*map(value, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([together(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_manifest(rows, fanout=3):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for held in by.values():
        held.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], plain_leaf(r, r["text"])))
    trees = {k: plain_tree([plain_leaf(r, r["text"]) for r in by[k]], fanout) for k in names}
    top = plain_tree([trees[k][-1][0] for k in names], fanout) if names else [[None]]
    out = []
    for number, name in enumerate(names):
        for place, r in enumerate(by[name]):
            even = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 2 == 0
            node = plain_leaf(r, r["text"].replace("\n", "") if even and r["text"] else r["text"])
            siblings = []
            for tree, i in ((trees[name], place), (top, number)):
                for level in tree[:-1]:
                    run, own = level[i // fanout * fanout :][:fanout], i % fanout
                    siblings += run[:own] + run[own + 1 :]
                    node, i = together(*run[:own], node, *run[own + 1 :]), i // fanout
            out.append((r["doc_id"], trees[name][0][place], trees[name][-1][0], top[-1][0], together(*siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_query_is_the_plain_one(spark, sf):
    got = sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, sf).collect()), key=str)
    assert got == plain_manifest(read_table(spark, sf, "documents").collect())
    assert 0 < sum(r[-1] for r in got) < len(got)


def run_on(spark, path, rows):
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(path)).collect()), key=str)


def test_awkward_rows_are_leaves_like_others(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"line\n{i}", "en", rng.choice(["hot", "hot", "é", "z", None]), i, 1, "n", 2) for i in range(120)]
    rows += [(None, None, None, None, None, None, None, None), (None, "", None, "hot", 0, 1, "n", 2), (3, "twice\n", "de", "hot", 1, 1, "n", 2), (3, "twice\n", "de", "hot", 1, 1, "n", 2)]
    rows += [(900, "alone\n" * 3, "en", "single", 1, 1, "n", 2), (901, "x" * 300_000 + "\n", "en", "z", 1, 1, "n", 2)]
    names = [c.split(" ")[0] for c in SHAPE.split(", ")]
    assert run_on(spark, tmp_path / "some", rows) == plain_manifest([dict(zip(names, r, strict=True)) for r in rows])


def test_one_row_and_none(spark, tmp_path):
    row = (7, "a\nb", "en", "s", 3, 1, "n", 2)
    names = [c.split(" ")[0] for c in SHAPE.split(", ")]
    got = run_on(spark, tmp_path / "one", [row])
    assert got == plain_manifest([dict(zip(names, row, strict=True))])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()
    assert run_on(spark, tmp_path / "none", []) == []


def test_fanouts_and_hot_nodes(spark, monkeypatch):
    # a bar of few rows deals the nodes near the root over several tasks
    monkeypatch.setattr(merkle.salted_lookup, "__defaults__", (7, "inner"))
    rows = [{"doc_id": i, "source": "ab"[i % 7 == 0], "lang": None, "n_chars": i, "text": str(i)} for i in range(100)]
    frame = spark.createDataFrame([(r["doc_id"], r["source"], plain_leaf(r, r["text"])) for r in rows], "doc_id long, source string, leaf string")
    for fanout in (2, 5):
        made = merkle.build(frame, "leaf", "source", ["doc_id"], fanout)
        want = plain_manifest(rows, fanout)
        assert {made.root} == {w[3] for w in want}
        proofs = {(r["group_no"], r["index"]): [s["digest"] for s in r["siblings"]] for r in made.proofs().collect()}
        leaves = made.leaves.collect()
        assert {r["leaf"]: together(*proofs[r["group_no"], r["index"]]) for r in leaves} == {w[1]: w[4] for w in want}
