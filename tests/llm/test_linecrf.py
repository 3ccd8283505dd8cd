"""The conditional random field against sums over all labellings; the base rule against a plain count; held-out rows."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import linecrf
from lotwise.llm.common import read_table

SHAPE = "doc_id long, text string, kept string, n_words int"


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(0)
    out = []
    for n in (1, 2, 4, 5, 5):
        lines = [np.sort(rng.choice(len(linecrf.FEATURES), 5, replace=False)) for _ in range(n)]
        out.append((np.concatenate(lines), np.repeat(np.arange(n), 5), rng.integers(0, 2, n)))
    return out


def plain_score(weights, text, labels):
    flat, line, _ = text
    step = weights[len(linecrf.FEATURES) : -2].reshape(2, 2)
    own = sum(weights[flat[line == t]].sum() for t, label in enumerate(labels) if label)
    return weights[-2:][labels[0]] + own + sum(step[a, b] for a, b in itertools.pairwise(labels))


def plain_loss(weights, sequences):
    total = 0.0
    for text in sequences:
        every = [plain_score(weights, text, labels) for labels in itertools.product((0, 1), repeat=len(text[2]))]
        total += np.log(np.exp(every).sum()) - plain_score(weights, text, list(text[2]))
    return total


@pytest.mark.parametrize("cells", [1, 12, 400_000])
def test_likelihood_and_gradient_are_sums_over_all_labellings(sequences, monkeypatch, cells):
    monkeypatch.setattr(linecrf, "CELLS_AT_ONCE", cells)
    weights = np.random.default_rng(1).normal(size=linecrf.PARAMETERS)
    loss, gradient = linecrf.likelihood(weights, sequences)
    assert loss == pytest.approx(plain_loss(weights, sequences))
    for i in range(0, linecrf.PARAMETERS, 3):
        step = np.zeros(linecrf.PARAMETERS)
        step[i] = 1e-5
        slope = (plain_loss(weights + step, sequences) - plain_loss(weights - step, sequences)) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=1e-6)


def test_decoding_finds_the_best_labelling(sequences):
    for seed in range(20):
        weights = np.random.default_rng(seed).normal(size=linecrf.PARAMETERS)
        for text in sequences:
            best = max(itertools.product((0, 1), repeat=len(text[2])), key=lambda labels: plain_score(weights, text, labels))  # noqa: B023
            assert linecrf.LineField(weights).label([text[0][text[1] == t].tolist() for t in range(len(text[2]))]) == list(best)


def test_lbfgs_reaches_the_least_value():
    rng = np.random.default_rng(2)
    half = rng.normal(size=(6, 6))
    matrix, target = half @ half.T + np.eye(6), rng.normal(size=6)
    value = lambda w: (0.5 * (w - target) @ matrix @ (w - target), matrix @ (w - target))
    assert np.allclose(linecrf.lbfgs(value, np.zeros(6), 200, 0.0), target, atol=1e-4)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_query_keeps_good_texts_and_counts_like_a_plain_rule(spark, sf):
    rows = linecrf.op13_line_crf(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = plain_base(texts[r["doc_id"]])
        failed = n < 10 or 100 * repeat > 20 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, repeat, failed)
        assert r["kept"] == (not failed and r["content_share"] >= linecrf.LEAST_SHARE)
    quality = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
    held = [r for r in rows if r["doc_id"] in quality and not r["base_failed"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["kept"] == bool(quality[r["doc_id"]]) for r in held)


@pytest.fixture(scope="module")
def field():
    weights = np.zeros(linecrf.PARAMETERS)
    weights[linecrf.AT["bias"]], weights[linecrf.START["symbols_a_word"] + 4] = 1.0, -4.0
    weights[len(linecrf.FEATURES) : -2] = [0.4, 0.0, 0.0, 0.4]
    return linecrf.LineField(weights)


def test_lines_of_one_text_get_labels_of_their_own(spark, field):
    good = "The and attion to thanedble the, anea. Eriner thanea and of the ounth."
    bad = " ".join(f"word{mark * 3}" for mark in "#*$%&#*$%&#*$%&")
    text = "\n".join([f"{good} One of {i}." for i in "ab"] + ["", bad, bad + " x***", bad + " y###", ""] + [good + " More of it, and the rest."] * 2)
    rows = [(1, text, "k", 3), (1, text, "k", 3), (2, None, None, None), (3, "", "k", 3), (4, " \n\t", "k", 3), (None, "w " * 50_000, "k", 3)]
    out = linecrf.label_lines(spark.createDataFrame(rows, SHAPE), field)
    assert out.columns[:4] == ["doc_id", "text", "kept", "_n_words"]
    got = out.orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert got[0]["line_labels"] == got[1]["line_labels"] == [True, True, None, False, False, False, None, True, True]
    assert bad not in got[0]["content_text"] and got[0]["content_text"].count(good) == 4
    assert (got[2]["line_labels"], got[2]["content_text"], got[3]["line_labels"], got[3]["content_text"]) == ([], None, [None], "")
    assert got[4]["line_labels"] == [None, None] and got[5]["n_words"] == 50_000
    assert linecrf.label_lines(spark.createDataFrame([], SHAPE), field).count() == 0


def test_one_quality_alone_labels_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "k", 3), (2, None, "k", 3)], SHAPE)
    for labels in ([(1, 1), (2, 0), (3, None)], [], [(1, 0), (1, 1)]):
        model = linecrf.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert model.weights is None and model.label([[0], [1]]) == [linecrf.CONTENT] * 2
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert linecrf.op13_line_crf(spark, str(tmp_path)).count() == 0
