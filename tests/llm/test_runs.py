"""Periodic runs against a plain search of every period, over random words and the whole query."""

import hashlib
import random
import zlib

import pytest

from lotwise.llm import runs
from lotwise.llm.common import read_table

SHAPE = "doc_id long, text string, runs int, Collapsed string"


def plain_runs(words, least=12):
    n, out = len(words), []
    for period in range(1, n // 2 + 1):
        i = period
        while i < n:
            if words[i] != words[i - period]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - period]:
                i += 1
            start, length = begin - period, i - begin + period
            smaller = any(all(words[j] == words[j - p] for j in range(start + p, start + length)) for p in range(1, period))
            if length >= max(least, 2 * period) and not smaller:
                out.append((start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_are_those_of_a_search_of_every_period(least):
    rng = random.Random(least)
    for _ in range(400):
        kinds, n = rng.choice([1, 2, 3, 5, 30]), rng.randint(0, 90)
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 2)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert [tuple(r) for r in runs.runs_of(words, least).tolist()] == plain_runs(words, least)


def test_positions_keep_their_order_over_many_blocks():
    rng, held = random.Random(3), [5000]
    ends = runs.EndPositions(5000)
    for p in rng.sample([*range(5000), *range(5001, 9000)], 6000):
        below, above = [x for x in held if x < p], [x for x in held if x > p]
        assert ends.add(p) == (max(below, default=-1), min(above, default=-1))
        held.append(p)
        if len(held) > 300:  # the plain search takes the square
            break
    for p in range(10_000, 14_000):
        assert ends.add(p) == (max(held) if p == 10_000 else p - 1, -1)
    assert len(ends.blocks) > 1 and list(ends) == sorted([*held, *range(10_000, 14_000)]) and ends.size == len(held) + 4000


def test_very_long_periodic_text():
    words = [b"%d" % (i % 501) for i in range(100_000)]
    assert runs.runs_of(words).tolist() == [[0, 100_000, 501]]
    assert runs.runs_of([b"a"] * 100_000).tolist() == [[0, 100_000, 1]]
    assert runs.collapse(words, runs.runs_of(words)) == b" ".join(words[:501])


def test_query_is_the_plain_one(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op11_periodic_runs(spark, sf).collect()}
    want = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect()}
    assert got == want
    assert sum(r[0] > 0 for r in want.values()) > 20


def test_nulls_repeats_and_clashing_columns(spark):
    periodic = "x y z " * 6
    rows = [(1, None, 7, "c"), (2, "", 7, "c"), (3, " \t\n", 7, None), (4, periodic, 7, "c"), (4, periodic, 7, "c"), (None, "é" * 9, None, None)]
    out = runs.find_runs(spark.createDataFrame(rows, SHAPE))
    assert out.columns == ["doc_id", "text", "_runs", "_Collapsed", "runs", "collapsed"]
    got = sorted(out.collect(), key=lambda r: r["doc_id"] or 0)
    assert [r["collapsed"] for r in got] == ["é" * 9, "", "", "", "x y z", "x y z"]
    assert got[-1]["runs"][0].asDict() == {"start": 0, "length": 18, "period": 3} and len(got[-1]["runs"]) == 1
    assert runs.find_runs(spark.createDataFrame([], SHAPE)).count() == 0


def test_query_on_awkward_and_empty_tables(spark, tmp_path):
    rows = [(None, None, "c"), (7, "", "c"), (5, "w " * 40, "c"), (5, "w " * 40, "c")]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted((tuple(r) for r in runs.op11_periodic_runs(spark, f"{tmp_path}/{name}").collect()), key=str)
        assert got == sorted(((i, *plain_row("" if i is None else i, t)) for i, t, _ in some), key=str)
