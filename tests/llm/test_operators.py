"""Each corpus operator against a plain version, and on awkward rows."""

import collections
import gzip
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from lotwise.llm import ann, bpe, decontaminate, hmm, jaccard, langid, linededup, sharding, toxicity, warc
from lotwise.llm.common import components, count_class, least_class, placed, read_table

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
AWKWARD = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", "x"),
    (1, "the cat sat on the mat and looked at the dog", "en", "a", "x"),
    (2, None, "en", None, None),
    (3, "", None, "a", "y"),
    (4, LONG, "en", "b", None),
    (5, "*** 123 !!!", "de", "b", "z"),
    (None, "une phrase courte pour la machine et le chat", "fr", "b", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Stored rows with nulls, an empty and a long text, repeats and columns whose names clash."""
    path = str(tmp_path_factory.mktemp("awkward") / "docs")
    spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, overlap string").withColumn("rid", F.lit(7)).withColumn("sim", F.lit(1)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "docs")
    awkward.where("false").write.parquet(path)
    return spark.read.schema(awkward.schema).parquet(path)


# --- sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_walk_and_moves_only_to_the_new_shard():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *range(10, 400)], dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert all(a == b or a == 24 for a, b in zip(after, before))


def test_shards_have_gapless_slots(spark, sf):
    rows = sharding.op9_jump_sharding(spark, sf).toPandas()
    docs = read_table(spark, sf, "documents").toPandas().set_index("doc_id").text
    assert len(rows) == len(docs)
    for _, group in rows.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert all(zlib.crc32(docs[i].encode()) == c for i, c in zip(rows.doc_id, rows.text_crc32))


def test_keys_of_any_kind_and_columns_of_any_name(spark):
    rows = spark.createDataFrame([("abc", 1, "x"), ("abc", 2, "y"), (None, 3, "z")], "k string, shard int, Overlap string")
    out = sharding.assign_shards(rows, F.col("k"), 8)
    assert out.columns == ["k", "_shard", "Overlap", "shard", "grown_shard"]
    got = {r["_shard"]: r["shard"] for r in out.collect()}
    assert got[1] == got[2] and got[3] == sharding.jump(np.array([0], dtype=np.uint64), 8)[0]
    assert sharding.assign_shards(rows.where("false"), F.col("k"), 8).count() == 0
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "say a b c now", 9)], "doc_id long, text string, overlap int")
    found = decontaminate.find_overlap(docs, items)
    assert found.columns == ["doc_id", "text", "_overlap", "overlap"] and found.first()["overlap"]["n_hit"] == 3
    assert decontaminate.remove_overlap(docs, items, 1.0).first().asDict() == {"doc_id": 1, "text": "say  now", "overlap": 9}


def test_repeated_rows_get_slots_of_their_own(spark):
    rows = spark.createDataFrame([(7, 9, 1, 0, 0)] * 5 + [(8, 9, 1, 0, 0)], "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    groups = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    out = sharding.number_slots(groups, "shard", ["doc_id", "size", "text_crc32"], "_copies").collect()
    assert sorted(r["slot"] for r in out) == list(range(6))


# --- language identification


def test_languages_of_held_out_texts(spark, sf):
    found = langid.op10_language_id(spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 30 and (found.lang_pred == found.lang).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_languages_of_awkward_texts(spark, awkward, empty):
    model = langid.train(awkward, "text", "lang")
    found = [r["r"]["lang_pred"] for r in awkward.select("doc_id", langid.identify(F.col("text"), model).alias("r")).orderBy("doc_id").collect()]
    assert found.count("und") == 3
    assert langid.train(empty, "text", "lang").languages == []
    assert langid.keep_identified(awkward, model).columns == awkward.columns
    assert langid.keep_identified(awkward, model).count() == 4


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n


# --- decontamination


def plain_overlap(words, items, window):
    hit, found, windows = [0] * len(words), set(), collections.defaultdict(set)
    for name, sequence in items:
        size = min(len(sequence), window)
        for i in range(len(sequence) - size + 1) if size else []:
            windows[tuple(sequence[i : i + size])].add(name)
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if (w := tuple(words[i : i + size])) in windows:
                found |= windows[w]
                hit[i : i + size] = [1] * size
    return hit, found


def test_automaton_against_all_windows():
    rnd = random.Random(1)
    for _ in range(400):
        letters = [b"a", b"b", b"c"][: rnd.randint(2, 3)]
        items = [(str(i), [rnd.choice(letters) for _ in range(rnd.randint(0, 8))]) for i in range(rnd.randint(0, 4))]
        window = rnd.randint(1, 5)
        automaton = decontaminate.SuffixAutomaton(items, window)
        words = [rnd.choice([*letters, b"z"]) for _ in range(rnd.randint(0, 30))]
        hit, found = automaton.matches(words)
        assert (hit.astype(int).tolist(), {automaton.names[n] for n in found}) == plain_overlap(words, items, window)


def test_overlap_query_against_all_windows(spark, sf):
    rows = decontaminate.op3_benchmark_overlap(spark, sf).toPandas().set_index("doc_id")
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"].encode())) for r in read_table(spark, sf, "benchmark").collect()]
    for r in read_table(spark, sf, "documents").collect():
        words = decontaminate.words_of(r["text"].encode())
        hit, found = plain_overlap(words, items, 10)
        got = rows.loc[r["doc_id"]]
        assert (got.n_words, got.n_hit, got.n_items) == (len(words), sum(hit), len(found))
        assert got.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_overlap_in_blocks_of_items(spark, awkward, monkeypatch):
    items = spark.createDataFrame([(1, "the cat sat"), (2, "looked at the dog"), (3, None), (4, ""), (None, "la machine")], "item_id long, text string")
    want = [r["overlap"] for r in decontaminate.find_overlap(awkward.drop("overlap"), items).collect()]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    assert [r["overlap"] for r in decontaminate.find_overlap(awkward.drop("overlap"), items).collect()] == want
    kept = decontaminate.remove_overlap(awkward, items, max_coverage=0.9)
    assert kept.columns == awkward.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(AWKWARD) and " on the mat and " in texts and "une phrase courte pour  et le chat" in texts
    assert decontaminate.remove_overlap(awkward, items, max_coverage=0.5).count() == len(AWKWARD) - 2


def test_empty_benchmark_hits_nothing(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n"] for r in decontaminate.find_overlap(awkward.drop("overlap"), none).select(F.col("overlap.n_hit").alias("n")).collect()} == {0}


# --- BPE


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_encoding_equals_the_library(merges, library, tmp_path):
    rnd = random.Random(0)
    pieces = list("abÀé ÉΣςσİ\x1c\x1d\x85\xa0  '’1²٣sT\n\t<|>😀👍🏽̧́ñßﬁ가") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "aaaa"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    words = sorted({w.encode() for t in texts[:500] for c in bpe.chunks_of(t) for w in merges.words(c) if isinstance(w, str)})
    path = str(tmp_path / "lexicon.bin")
    bpe.compile_lexicon(zip(words, merges.merge(words), strict=True), path)
    lexicon = bpe.Lexicon(path)
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert set(lexicon.find([w + b"~" for w in words]).tolist()) == {-1}
    coder = bpe.Encoder(merges, lexicon)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert merges.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_lexicon_shares_suffixes(tmp_path):
    path = str(tmp_path / "lexicon.bin")
    bpe.compile_lexicon([(w, b"\0\0\0\0") for w in sorted(a + b for a in (b"ab", b"cd", b"ef") for b in (b"ing", b"ings"))], path)
    assert len(bpe.Lexicon(path).finals) < 12
    bpe.compile_lexicon([], path)
    assert bpe.Lexicon(path).find([b"a"]).tolist() == [-1]


def test_bpe_query_equals_the_library(spark, sf, library):
    rows = bpe.op7_bpe_transducer(spark, sf).toPandas().set_index("doc_id")
    for r in read_table(spark, sf, "documents").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        got = rows.loc[r["doc_id"]]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_on_awkward_rows(spark, awkward, empty):
    coded = bpe.decode(bpe.encode(awkward, bpe.default_vocabulary()), bpe.default_vocabulary())
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert list(rows[2]["ids"]) == [] == list(rows[3]["ids"]) and rows[2]["decoded"] == ""
    assert rows[1]["decoded"].replace("</w>", "") == AWKWARD[0][1]
    assert bpe.encode(empty, bpe.default_vocabulary()).count() == 0


# --- web archives

ARC1 = b"filedesc://a.arc 0.0.0.0 19960101000000 text/plain 65\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n\n"


def arc(version, *records):
    body = f"{version} 0 org\n{' '.join(warc.ARC_FIELDS[version])}\n".encode()
    return f"filedesc://a.arc 0.0.0.0 19960101 text/plain {len(body)}\n".encode() + body + b"".join(b"\n" + r for r in records)


def test_arc_records_of_both_versions_and_declared_lengths():
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhttp://trap 1.2.3.4 19990101 text/html 5\n"
    one = f"http://x/a b 1.2.3.4 19990102030405 text/html {len(body)}\n".encode() + body
    two = f"http://y/ 1.2.3.4 1999 text/html 200 - - 12 f.arc {len(body)}\n".encode() + body
    assert [(f["URL"], c) for f, c in warc.parse_arc(arc(1, one, one))] == [("http://x/a b", body)] * 2
    assert [(f["URL"], f["Result-code"], c) for f, c in warc.parse_arc(arc(2, two))] == [("http://y/", "200", body)]
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(arc(1, one[:-3])))
    with pytest.raises(ValueError, match="header line"):
        list(warc.parse_arc(arc(1, b"nonsense\n")))
    assert list(warc.parse_arc(b"")) == []
    assert warc.iso_date("1999") == "1999-01-01T00:00:00Z" and warc.iso_date("19990102030405") == "1999-01-02T03:04:05Z"


def test_pages_go_through_warc_and_back(spark, tmp_path):
    rows = [(1, "http://a/ x", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://d/", ""), (None, "http://e/", "ž\r\n\r\nWARC/1.1\r\n"), (5, "ftp:x", LONG)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"], r["intact"]) for r in warc.op8_arc_to_warc(spark, str(tmp_path)).collect())
    assert got == [(0, 16, "response", None, True), (1, 10, "revisit", 2, True), (2, 10, "response", None, True), (2, 10, "response", None, True), (3, 0, "revisit", 4, True), (4, 0, "response", None, True), (5, len(LONG), "response", None, True)]


def test_payload_digests(spark, sf):
    import base64

    found = warc.op8_arc_to_warc(spark, sf).toPandas().set_index("page_id")
    for r in read_table(spark, sf, "pages").collect():
        assert found.loc[r["page_id"]].payload_digest == base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode()


def test_bytes_of_any_kind_survive_the_sink(spark, tmp_path):
    payload = bytes(range(256)) * 3
    head = b"HTTP/1.1 200 OK\r\nX-Page-Id: 1\r\n\r\n"
    block = f"http://a/ 1.2.3.4 19990101 image/png {len(head + payload)}\n".encode() + head + payload
    records = warc.convert(spark.createDataFrame([("a", arc(1, block)), ("b", None), ("c", b"")], "archive string, content binary"))
    warc.write_warc(warc.mark_revisits(records, F.lit(1).cast("long")), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert [(r["payload_digest"], r["intact"]) for r in back] == [(warc.sha1(payload), True)]


# --- toxicity


def test_toxicity_finds_held_out_labels(spark, tmp_path):
    rnd = random.Random(3)
    plain, bad = [f"word{i}" for i in range(200)], ["grobnix", "fiesling", "idiot"]
    docs, labels = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rnd.randint(0, 40), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs += [(1000, None), (1001, ""), (1002, LONG)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op6_toxicity(spark, str(tmp_path)).toPandas().set_index("doc_id")
    assert len(rows) == 603 and rows.score.between(0, 1).all()
    held = rows[rows.held_out & (rows.index < 600)]
    truth = (held.index % 5 == 0).astype(int)
    assert (held.predicted == truth).mean() > 0.97
    assert (rows.loc[[1000, 1001, 1002]].predicted == 0).all()


def test_one_class_gives_a_constant(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(30)], "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {r["score"] for r in model.score(docs).collect()} == {0.0}


def test_features_see_masked_words_and_persons():
    found = dict(zip(toxicity.FEATURES, toxicity.Lexicon().features("You are an 1d1ot i.e. an id*ot, you IDIOT!!!"), strict=True))
    assert found["near_second_person"] > 0 and found["unmasked"] > 0 and found["shouted"] > 0 and found["runs"] > 0
    assert toxicity.Lexicon().features(None) == toxicity.Lexicon().features("") == [0.0] * len(toxicity.FEATURES)


# --- neighbours


def test_recall_against_brute_force(spark, sf):
    vectors = read_table(spark, sf, "embeddings").toPandas()
    found = ann.op4_permutation_index(spark, sf).toPandas()
    matrix = np.stack(vectors.embedding).astype(np.float64)
    ids = vectors.vec_id.to_numpy()
    recall = []
    for query, rows in found.groupby("query_id"):
        scores = (matrix * matrix[ids == query][0]).sum(axis=1)
        scores[ids == query] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        recall.append(len(set(best) & set(rows.vec_id)) / 20)
        assert rows.sort_values("rank")["rank"].tolist() == list(range(1, 21))
    assert len(recall) == sum(i % 20 == 0 for i in ids) and np.mean(recall) > 0.9


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0]), (40, [0.5, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 2.0), (0, 2, 5, 2.0), (40, 1, 4, 1.0), (40, 2, 5, 1.0)]
    assert ann.search(vectors.where("false"), vectors, 2).count() == 0


def test_footrule_is_the_sum_over_places():
    rng = np.random.default_rng(0)
    rows = np.stack([rng.permutation(12)[:5] for _ in range(9)]).astype(np.int32)
    queries = np.stack([rng.permutation(12)[:5] for _ in range(4)]).astype(np.int32)
    place = lambda o: [list(o).index(p) if p in o else 5 for p in range(12)]
    want = [[sum(abs(a - b) for a, b in zip(place(q), place(r))) for r in rows] for q in queries]
    assert ann.footrule(rows, queries, 12, 5).tolist() == want


# --- language model


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    draw = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(draw(3), draw(3, 3), draw(3, 5).T)
    texts = [np.array(rng.integers(0, 5, n), dtype="<u2") for n in (1, 4, 6, 2)]
    for text, got in zip(texts, hmm.log_likelihoods(texts, model), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for a, b, o in zip(path, path[1:], text[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
        assert abs(got - np.log10(total)) < 1e-9


def test_texts_are_scored_in_bounded_groups():
    lengths = [[3, 1, 9, 2], [], [2, 2, 2, 2, 30], [1]]
    batches, n = [], 0
    for some in lengths:
        batches.append(pd.DataFrame({"rid": range(n, n + len(some)), "codes": [bytes(2 * k) for k in some]}))
        n += len(some)
    groups = [g["codes"].map(len).tolist() for g in hmm.side_by_side(iter(batches), 3, 8)]
    assert groups == [[6, 2], [18], [4, 4, 4], [4, 4], [60], [2]]
    assert pd.concat(hmm.side_by_side(iter(batches), 3, 8))["rid"].tolist() == list(range(n))
    assert list(hmm.side_by_side(iter([]))) == []


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_expected_counts_are_those_of_all_paths(held):
    rng = np.random.default_rng(1)
    draw = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(draw(2), draw(2, 2), draw(2, 5).T)
    texts = [rng.integers(0, 5, n).astype("<u2") for n in (1, 5, 8, 3, 5)]
    emissions, moves, starts, likelihood = np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for text in texts:
        paths = list(itertools.product(range(2), repeat=len(text)))
        chance = np.array([model.start[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([model.emit[w, k] for w, k in zip(text, p)]) for p in paths])
        likelihood += np.log10(chance.sum())
        for p, share in zip(paths, chance / chance.sum()):
            starts[p[0]] += share
            for a, b in itertools.pairwise(p):
                moves[a, b] += share
            for w, k in zip(text, p):
                emissions[w, k] += share
    got = hmm.expect(texts, model, held)
    assert all(np.allclose(g, w) for g, w in zip(got, (emissions, moves, starts, likelihood), strict=True))


def test_counts_of_any_size_keep_the_limit(spark):
    counts = spark.createDataFrame([(f"w{i}", 2_000_000 + (i % 2) * 3_000_000) for i in range(50)] + [("x", 3)], "word string, n long")
    for most, kept in ((10, 0), (25, 25), (50, 50), (60, 51)):
        assert counts.where(count_class(F.col("n")) >= least_class(counts, "n", most)).count() == kept


def test_base_scores_and_held_out_gain(spark, sf):
    rows = hmm.op1_hmm_score(spark, sf).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in read_table(spark, sf, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter()
    for i, words in texts.items():
        if not held[i]:
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    for i, words in texts.items():
        got = rows.loc[i]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (held[i], len(words) + 1, sum(w in counts for w in [*words, None]), n)
        assert abs(got.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*words, None])) < 1e-6 * len(words) + 1e-6
    assert rows[rows.held_out].score.sum() > rows[rows.held_out].base_score.sum()


def test_words_beyond_the_broadcast_table_are_joined(spark, awkward):
    docs = awkward.withColumn("held_out", F.coalesce(F.col("doc_id") == 4, F.lit(False)))
    few = hmm.score_corpus(docs, states=2, iterations=1, symbol_words=3, known_words=4).toPandas()
    many = hmm.score_corpus(docs, states=2, iterations=1, symbol_words=3).toPandas()
    key = ["doc_id", "n_tokens", "n_known", "base_score"]
    pd.testing.assert_frame_equal(few[key].sort_values(key).reset_index(drop=True), many[key].sort_values(key).reset_index(drop=True))
    assert np.allclose(sorted(few.score), sorted(many.score))
    assert few[few.doc_id == 2].n_tokens.tolist() == [1]


# --- lines


def test_near_lines_keep_one(spark, tmp_path):
    rnd = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    base = " ".join(rnd.choice(words) for _ in range(300))
    near = base.replace(base.split()[150], "changed", 1)
    other = " ".join(rnd.choice(words) for _ in range(300))
    rows = [(3, f"{base}\nshort line\n{other}"), (1, f"First\n{base.upper()} !!"), (2, near), (4, f"{other}\n{other}"), (5, None), (6, ""), (7, "***\n---"), (2, near)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    kept = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.read.parquet(path)).collect() if r["text"] is not None)
    a, b = sims_of(spark, [base, near])
    assert (a ^ b).bit_count() <= linededup.DISTANCE
    assert kept == [(1, f"First\n{base.upper()} !!"), (3, f"short line\n{other}"), (6, ""), (7, "***\n---")]


def test_line_dedup_on_awkward_rows(spark, awkward, empty):
    assert linededup.dedup_lines(empty).count() == 0
    kept = linededup.dedup_lines(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 1


def sims_of(spark, texts):
    """The SimHash of every text of one line."""
    docs = spark.createDataFrame([(i, 0, i, t) for i, t in enumerate(texts)], "file long, at long, doc_id long, text string")
    return [r["sim"] for r in linededup.lines_of(docs, 1).orderBy("doc_id").collect()]


def plain_sim(spark, words):
    """The majority of 60 bits of the hashes of word pairs, counted one by one."""
    ranked = "(7 - least(length({0}), 15)) * 1152921504606846976 + shiftrightunsigned(xxhash64({0}), 4)"
    pairs = spark.createDataFrame(list(zip(words, words[1:])), "a string, b string")
    hashes = [r["h"] for r in pairs.selectExpr(f"xxhash64({ranked.format('a')}, {ranked.format('b')}) AS h").collect()]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(60))


def spelled_number(i):
    return "".join(chr(97 + int(d)) for d in str(i))


def test_simhash_is_a_majority(spark):
    words = ["a", "bb", "ccc", "dd", "a"]
    assert sims_of(spark, [" ".join(words)]) == [plain_sim(spark, words)]


@pytest.mark.parametrize("n", [400, 2046, 2047, 2048, 5000])
def test_simhash_has_one_rule_for_long_lines(spark, n):
    words = [spelled_number(i % (n - 7)) for i in range(n)]
    sims = sims_of(spark, [" ".join(words), " ".join([*words, "onemore"])])
    assert sims == [plain_sim(spark, words), plain_sim(spark, [*words, "onemore"])]
    assert (sims[0] ^ sims[1]).bit_count() <= 8


def test_block_keys_meet_within_the_distance(spark):
    rnd = random.Random(2)
    for blocks in (5, 6, 8):
        a = rnd.getrandbits(60)
        b = a
        for bit in rnd.sample(range(60), linededup.DISTANCE):
            b ^= 1 << bit
        rows = spark.createDataFrame([(a,), (b,)], "sim long").select(F.array(*linededup.block_keys(F.col("sim"), linededup.DISTANCE, blocks)).alias("k")).collect()
        assert set(rows[0]["k"]) & set(rows[1]["k"])


def plain_lines(text):
    """The words of every line of a text: runs of letters in lower case."""
    return [regex.findall(r"\p{L}+", line.lower()) for line in (text or "").split("\n")]


def plain_edits(s, t):
    row = np.arange(len(t) + 1)
    codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    for i, c in enumerate(s, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.concatenate([[i], step])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def test_line_dedup_query_against_all_pairs(spark, sf, tmp_path):
    """Of all pairs of different lines that are near by the letters, nearly all are grouped, and nothing else is."""
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect()]
    norms = sorted({" ".join(w) for _, t in docs for w in plain_lines(t) if len(w) >= linededup.MIN_WORDS and len(w) <= 120})
    grams = {n: collections.Counter(n[i : i + 3] for i in range(len(n) - 2)) for n in norms}
    by_length, links = sorted(norms, key=len), []
    for i, s in enumerate(by_length):
        for t in by_length[i + 1 :]:
            most = int(len(t) * 0.15 + 1e-9)
            if len(t) - len(s) > most:
                break
            # an edit spoils three runs of three letters at most
            if sum((grams[s] & grams[t]).values()) >= len(t) - 2 - 3 * most and plain_edits(s, t) <= most:
                links.append((s, t))
    label = {n: n for n in norms}
    changed = True
    while changed:
        changed = False
        for s, t in links:
            low = min(label[s], label[t])
            changed |= label[s] != low or label[t] != low
            label[s] = label[t] = low
    got = {r["doc_id"]: [int(x) for x in r["removed_lines"].split(",") if x] for r in linededup.op5_line_dedup(spark, sf).collect()}
    seen, missed, removed = set(), 0, 0
    for doc, text in sorted(docs, key=lambda d: d[0]):
        for i, w in enumerate(plain_lines(text)):
            norm = " ".join(w)
            if norm in label:
                if i in got[doc]:
                    removed += 1
                    assert label[norm] in seen
                else:
                    missed += label[norm] in seen
                seen.add(label[norm])
            elif len(w) < linededup.MIN_WORDS:
                assert i not in got[doc]
    assert removed > 20 and missed <= 0.05 * removed


def test_places_hold_whatever_the_splits(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(20_000).repartition(3).write.parquet(path)
    rows = []
    for size in ("1m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows.append(placed(spark.read.parquet(path), stored=True).orderBy("id").collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows[0] == rows[1] and len({(r["file"], r["at"]) for r in rows[0]}) == 20_000


def test_line_dedup_leaves_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", 7, 8, 9), (2, "One, two three four five six!", 7, 8, 9), (2, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int, at int, Removed int")
    assert sorted(map(tuple, linededup.dedup_lines(docs).collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def spelled(rnd, length):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))


def kept_ids(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    return {r["doc_id"] for r in linededup.dedup_lines(spark.read.parquet(path)).collect()}


def test_lines_with_words_replaced_are_found_at_any_length(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for n, changed in ((6, 1), (10, 1), (10, 2), (20, 2), (50, 2), (50, 5), (100, 8)):
        for _ in range(20):
            words = [spelled(rnd, rnd.randint(4, 9)) for _ in range(n)]
            near = list(words)
            for i in sorted(range(n), key=lambda i: (len(words[i]) > 5, rnd.random()))[:changed]:
                near[i] = spelled(rnd, min(len(words[i]), 5))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(near))]
    kept = kept_ids(spark, tmp_path, rows)
    assert {i for i in range(0, len(rows), 2)} <= kept
    assert sum(i % 2 for i in kept) <= len(rows) // 2 * 0.03


@pytest.mark.parametrize("buckets", [10, 4096])
def test_heavy_keys_lose_no_near_lines(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(linededup, "SHOWN", 1)
    monkeypatch.setattr(linededup, "BUCKET_ROWS", buckets)
    rnd = random.Random(9)
    common = [spelled(rnd, 14) for _ in range(5)]
    rows = []
    for _ in range(12):
        words = common + [spelled(rnd, 8) for _ in range(20)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:12], "other", *words[13:]]))]
    assert kept_ids(spark, tmp_path, rows) == set(range(0, len(rows), 2))


def test_lines_of_one_hash_all_meet(spark, tmp_path):
    rnd = random.Random(10)
    rows = []
    for _ in range(6):
        words = ["often"] * 11 + [spelled(rnd, 16) for _ in range(10)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:15], spelled(rnd, 16), *words[16:]]))]
    assert len(set(sims_of(spark, [t for _, t in rows]))) == 1
    assert kept_ids(spark, tmp_path, rows) == set(range(0, len(rows), 2))


# --- near documents


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("short", [8, 2])
def test_components_against_all_pairs(spark, tmp_path, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    rnd = random.Random(short)
    words = [f"v{i}" for i in range(30)]
    texts, i = {}, 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 9, 11, 14, 40, 90]))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[], [rnd.choice(words)], [copy[at], rnd.choice(words)]])
            texts[i] = " ".join(copy)
            i += 1
    texts |= {i: None, i + 1: "", i + 2: LONG, i + 3: LONG + " more"}
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(path)
    rows = jaccard.jaccard_components(placed(spark.read.parquet(path), stored=True)).collect()
    label, sizes = plain_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in rows} == label
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes


def test_near_documents_on_awkward_rows(spark, awkward, empty):
    assert jaccard.jaccard_components(placed(empty, stored=True)).count() == 0
    kept = jaccard.keep_one_of_group(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 1


def test_boundary_weighs_sizes():
    assert jaccard.boundary({}) == 0 and 1 <= jaccard.boundary({s: 10 for s in range(1, 40)}) <= 12
    assert all(jaccard.subset_cost(s) >= 1 for s in range(1, 13))


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_hmm_sums_stay_with_their_texts(spark):
    """Texts of one batch, empty and null ones between them: each has its own sums and its own words without a count."""
    v = hmm.Vocabulary([b"a", b"b", b"c", b"d"], np.array([9, 5, 3, 0]), 2, 10, 4, 1, 1.0, 1)
    texts = ["a x b", "", "x c x", None, "d y", "a a c", "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "cast(text AS binary) text", "false held_out").coalesce(1)
    counts = {"a": 9, "b": 5, "c": 3, "d": 0}
    for r in hmm.code_texts(docs, v).collect():
        words = (texts[r["doc_id"]] or "").split()
        rare = collections.Counter(w for w in words if w not in counts)
        rest = [w for w in words if w not in ("a", "b")]
        logs = lambda some: sum(np.log10(counts.get(w, 0) + 1) for w in some)
        assert {bytes(w).decode(): n for w, n in zip(r["rare"], r["rare_n"], strict=True)} == rare
        assert (r["n_tokens"], r["n_known"], r["n_rest"]) == (len(words) + 1, sum(counts.get(w, 0) > 0 for w in words) + 1, len(rest))
        assert np.allclose([r["log_all"], r["log_rest"]], [logs(words) + np.log10(2), logs(rest)])
        assert len(r["codes"]) == 2 * len(words) + 2


def test_hmm_codes_of_known_and_rare_words(spark):
    """Every token has its symbol in order, and words beyond the broadcast table are counted in the order in which they come."""
    v = hmm.Vocabulary([b"a", b"b", b"c"], np.array([5, 3, 2]), 2, 10, 4, 1, 1.0, 1)
    docs = spark.createDataFrame([(1, False, bytearray(b"b zz A c yy zz")), (2, True, None)], "doc_id long, held_out boolean, text binary")
    one, none = hmm.code_texts(docs, v).orderBy("doc_id").collect()
    assert np.frombuffer(one["codes"], dtype="<u2").tolist() == [3, hmm.RARE, 2, hmm.RARE, hmm.RARE, hmm.RARE, hmm.END]
    assert [bytes(w) for w in one["rare"]] == [b"zz", b"yy"] and one["rare_n"] == [2, 1]
    assert (one["n_tokens"], one["n_known"], one["n_rest"]) == (7, 4, 4)
    assert np.frombuffer(none["codes"], dtype="<u2").tolist() == [hmm.END] and list(none["rare"]) == []
