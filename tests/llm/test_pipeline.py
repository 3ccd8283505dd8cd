"""The pipeline's stages over a small table, each against its own input."""

import collections

import corpus_pipeline
from lotwise.llm import decontaminate, linededup
from lotwise.llm.common import materialise, read_table
from test_operators import plain_components, plain_lines, plain_overlap


def test_stages_hold_what_they_promise(spark, sf):
    docs = read_table(spark, sf, "documents")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf), name)
        held[name] = docs
        if name != "bpe":
            assert docs.columns == before.columns
    ids = lambda name: {r["doc_id"] for r in held[name].select("doc_id").collect()}
    letters = {r["doc_id"] for r in read_table(spark, sf, "documents").collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert ids("language_id") == letters
    # no normalised line of five words or more is left twice
    lines = collections.Counter(tuple(w) for r in held["line_dedup"].collect() for w in plain_lines(r["text"]) if len(w) >= linededup.MIN_WORDS)
    assert max(lines.values()) == 1
    texts = {r["doc_id"]: r["text"] for r in held["line_dedup"].collect()}
    label, _ = plain_components(texts)
    assert ids("jaccard_join") == set(label.values())
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"].encode())) for r in read_table(spark, sf, "benchmark").collect()]
    for r in held["decontamination"].collect():
        assert not any(plain_overlap(decontaminate.words_of(r["text"].encode()), items, 10)[0])
    assert ids("bpe") == ids("decontamination") and len(ids("bpe")) > 0.7 * len(letters)
