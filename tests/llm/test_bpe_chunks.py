"""The table of chunks that an encoder keeps."""

from lotwise.llm import bpe


def test_a_full_table_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 6)
    merges = bpe.Merges(bpe.default_vocabulary())
    worker, learned = bpe.Encoder(merges, None), []
    learn = worker._learn
    worker._learn = lambda chunks: (learned.append(set(chunks)), learn(chunks))[1]
    texts = ["Often, met words", "often, Often, and İstanbul's", "Often, <|x|> a1 b2 c3 naïve"]
    got = [worker.encode([t])[0].tolist() for t in texts]
    assert got == [bpe.Encoder(merges, None).encode([t])[0].tolist() for t in texts]
    assert learned[2] == {"<|x|>", "a1", "b2", "c3", "naïve"}
    assert set(worker.chunks) == learned[2] | {"Often,"}
