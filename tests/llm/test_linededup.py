"""Line dedup where a SimHash tells nothing: families of lines with one hash and the same longest words."""

import random

import pytest

from lotwise.llm import linededup


def letters(rng, n):
    return "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))


def edited(rng, line, edits):
    text = list(line)
    # letters of the line's own part, not of what the family has in common
    for at in rng.sample([i for i, c in enumerate(text) if c != " " and i > line.index("|")], edits):
        text[at] = rng.choice("bcdfghjk")
    return "".join(text).replace("|", "")


def family(rng, pairs, common, own):
    """Pairs of near lines; most word pairs of every line are one pair, which so decides all bits of its hash."""
    lines = []
    for _ in range(pairs):
        line = common + " aa" * own * 2 + " | " + " ".join(letters(rng, rng.randint(3, 6)) for _ in range(own))
        lines += [edited(rng, line, 4), edited(rng, line, 4)]
    return lines


def test_lines_of_one_hash_and_the_same_longest_words_meet(spark, tmp_path):
    rng = random.Random(11)
    common = " ".join(letters(rng, 14) for _ in range(5))
    lines = family(rng, 40, common, 45)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    placed = docs.selectExpr("doc_id", "text", "xxhash64(doc_id) file", "doc_id at")
    assert linededup.lines_of(placed, 5).select("sim").distinct().count() == 1
    kept = {r["doc_id"] for r in linededup.dedup_lines(docs, stored=True).collect()}
    assert kept == set(range(0, 80, 2))


def test_long_lines_with_scattered_edits_are_compared_in_full(spark):
    """One character in seven differs, so that no run of three words is left; one in six is too many."""
    rng = random.Random(5)
    line = " ".join(letters(rng, rng.randint(5, 9)) for _ in range(600))
    changed = lambda every: "".join("y" if i % every == 0 and c != " " else c for i, c in enumerate(line))
    texts = spark.createDataFrame([(1, line), (2, changed(7)), (3, changed(6).replace(" ", " y", 200))], "key long, norm string")
    texts = texts.withColumn("code", linededup.coded(texts["norm"]))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "x long, y long")
    assert [tuple(r) for r in linededup.similar(pairs, texts, linededup.SIMILARITY).collect()] == [(1, 2)]


def test_no_partner_under_a_common_key_is_left_out(spark, tmp_path):
    """60 pairs share their five longest words; a pair's hashes differ in 4 bits or more, so that other lines stand between them in any order."""
    rng = random.Random(3)
    common = " ".join(letters(rng, 14) for _ in range(5))
    lines = []
    for _ in range(60):
        line = common + " | " + " ".join(letters(rng, rng.randint(3, 6)) for _ in range(30))
        lines += [edited(rng, line, 10), edited(rng, line, 10)]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sims = [r["sim"] for r in linededup.lines_of(docs.selectExpr("doc_id", "text", "xxhash64(doc_id) file", "doc_id at"), 5).orderBy("doc_id").collect()]
    apart = [(a ^ b).bit_count() for a, b in zip(sims[::2], sims[1::2], strict=True)]
    near = {2 * i for i, bits in enumerate(apart) if 3 < bits <= linededup.FAR}
    assert len(near) > 30
    kept = {r["doc_id"] for r in linededup.dedup_lines(docs, stored=True).collect()}
    assert near <= kept and not {i + 1 for i in near} & kept


@pytest.mark.parametrize("rows", [3, 512])
def test_all_near_lines_of_different_groups_meet(spark, monkeypatch, rows):
    monkeypatch.setattr(linededup, "MEETING_ROWS", rows)
    rng = random.Random(4)
    sims = {key: sum(1 << b for b in rng.sample(range(60), 1 + key % 16)) for key in range(40)}
    members = {2: range(40), 4: range(12, 20), 7: range(20)}
    seen = spark.createDataFrame([(p, k, sims[k], None, False) for p, keys in members.items() for k in keys], "posting long, key long, sim long, x long, full boolean")
    component = {k: k // 10 * 10 for k in range(20)}
    groups = spark.createDataFrame(list(component.items()), "node long, component long")
    met = {(r["x"], r["y"], r["bits"]) for r in linededup.still_apart(seen, groups, linededup.DISTANCE).collect()}
    expected = set()
    for p, keys in members.items():
        for a in keys:
            for b in keys:
                bits = (sims[a] ^ sims[b]).bit_count()
                if a < b and component.get(a, a) != component.get(b, b) and bits <= (linededup.DISTANCE if p % 2 else linededup.FAR):
                    expected.add((a, b, bits))
    assert len(expected) > 300 and met == expected


def test_lines_that_share_keys_but_no_letters_leave_no_pairs_behind(spark, tmp_path, monkeypatch):
    """200 lines of one hash and the same longest words, near by two: their 19,900 pairs are compared, but never written as rows."""
    rng = random.Random(12)
    lines = family(rng, 100, " ".join(letters(rng, 14) for _ in range(5)), 45)
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    written, write = {}, linededup.materialise

    def counted(df, label):
        rows = write(df, label)
        written[label] = max(written.get(label, 0), rows.count())
        return rows

    monkeypatch.setattr(linededup, "materialise", counted)
    kept = {r["doc_id"] for r in linededup.dedup_lines(spark.read.parquet(str(tmp_path / "docs")), stored=True).collect()}
    assert kept == set(range(0, 200, 2))
    assert max(written.values()) <= 20 * len(lines)


def test_lines_near_by_letters_meet_under_one_key(spark):
    """With texts, of all pairs of different groups those that are near by their letters are found, each once."""
    norms = {1: "abcdefghij" * 4, 2: "abcdefghij" * 3 + "abcdefghix", 3: "klmnopqrst" * 4, 4: "klmnopqrst" * 4 + "u", 5: "abcdefghij" * 4 + "y"}
    rows = [(p, key, 0, None, False) for p in (2, 3, 4) for key in norms]
    seen = spark.createDataFrame(rows, "posting long, key long, sim long, x long, full boolean")
    groups = spark.createDataFrame([(1, 1), (5, 1)], "node long, component long")
    texts = spark.createDataFrame(list(norms.items()), "key long, norm string")
    found = [(r["x"], r["y"]) for r in linededup.still_apart(seen, groups, linededup.DISTANCE, texts).collect()]
    assert sorted(found) == [(1, 2), (2, 5), (3, 4)]


def test_pairs_that_were_rejected_are_not_compared_again(spark, tmp_path, monkeypatch):
    """Of 80 lines under common keys that are near by two, no pair of lines is compared twice."""
    rng = random.Random(21)
    lines = family(rng, 40, " ".join(letters(rng, 14) for _ in range(5)), 45)
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    compared, verdicts, still_open = [], linededup.verdicts, linededup.still_open
    left = []

    def seen(pairs, *rest):
        compared.extend((r["x"], r["y"]) for r in pairs.collect())
        return verdicts(pairs, *rest)

    def opened(mixed, texts, rejected, *rest):
        left.append({(r["x"], r["y"]) for r in rejected.collect()})
        return still_open(mixed, texts, rejected, *rest)

    monkeypatch.setattr(linededup, "verdicts", seen)
    monkeypatch.setattr(linededup, "still_open", opened)
    kept = {r["doc_id"] for r in linededup.dedup_lines(spark.read.parquet(str(tmp_path / "docs")), stored=True).collect()}
    assert kept == set(range(0, 80, 2))
    assert len(compared) == len(set(compared)) > 80
    assert len(left) == 1 and len(left[0]) > 40 and left[0] < set(compared)


def test_rejected_pairs_stay_out_of_the_last_comparison(spark):
    """Lines whose only near partners were rejected are no longer open; others meet as before."""
    norms = {1: "abcdefghij" * 4, 2: "abcdefghij" * 3 + "abcdefghix", 3: "klmnopqrst" * 4, 4: "klmnopqrst" * 4 + "u", 5: "abcdefghij" * 4 + "y"}
    seen = spark.createDataFrame([(p, key, 0, None, False) for p in (2, 3, 4) for key in norms], "posting long, key long, sim long, x long, full boolean")
    groups = spark.createDataFrame([(1, 1), (5, 1)], "node long, component long")
    texts = spark.createDataFrame(list(norms.items()), "key long, norm string")
    rejected = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 5)], "x long, y long")
    still = linededup.still_mixed(seen, groups)
    assert {r["key"] for r in linededup.still_open(still, texts, rejected, linededup.DISTANCE, 0.85).collect()} == {3, 4, 5}
    found = linededup.still_apart(seen, groups, linededup.DISTANCE, texts, 0.85, rejected).collect()
    assert [(r["x"], r["y"]) for r in found] == [(3, 4)]


def test_edits_are_counted_between_common_ends(spark):
    """Common beginnings and ends are left out, also where they overlap, where one text is all of them, and beyond ASCII."""
    texts = ["", "a", "aa", "aba", "abab", "ababab", "één", "één twee één", "één drie één", "x" * 70, "x" * 69 + "y", "y" + "x" * 70, "\U0001f600a\U0001f600", "\U0001f600"]
    pairs = spark.createDataFrame([(s, t, most) for s in texts for t in texts for most in (0, 1, 3)], "s string, t string, most int")
    rows = pairs.select(linededup.within(pairs["s"], pairs["t"], pairs["most"]).alias("got"), (linededup.F.levenshtein("s", "t") <= pairs["most"]).alias("wanted")).collect()
    assert all(r["got"] == r["wanted"] for r in rows) and 0 < sum(r["got"] for r in rows) < len(rows)
