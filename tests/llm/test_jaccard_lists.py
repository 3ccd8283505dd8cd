"""Inverted lists scanned in pieces, against all pairs of every list."""

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import jaccard


class Lists:
    """Stands for sorted lists in batches of a few rows."""

    def __init__(self, rows, batch):
        names = ["key", "n", "cid", "size"]
        types = [np.int64, np.int32, np.int64, np.int32]
        self.batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=t)) for c, t in zip(zip(*rows[i : i + batch], strict=True), types, strict=True)], names=names) for i in range(0, len(rows), batch)]

    def mapInArrow(self, scan, schema):  # noqa: N802
        assert schema == "a long, b long, size int, n int, long boolean"
        return [tuple(r.values()) for b in scan(iter(self.batches)) for r in b.to_pylist()]


@pytest.mark.parametrize(("held", "batch"), [(20, 3), (64, 7), (100_000, 500)])
def test_lists_scanned_in_pieces_give_all_their_pairs(monkeypatch, held, batch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", held)
    lists, cid = {}, 0
    for key, length in enumerate([1, 2, 1, 8, 9, 1, 1, 3, 40, 1, 8, 2, 1]):
        lists[key - 6] = [(key - 6, i % 2, cid := cid + 1, 20 + i % 3) for i in range(length)]
        if key % 3 == 1:
            lists[key - 6].append(lists[key - 6][0])
    rows = [r for k in sorted(lists) for r in lists[k]]
    found = jaccard.scan_lists(Lists(rows, batch))
    pairs, long = {f[:2] for f in found if not f[4]}, {f[:4] for f in found if f[4]}
    expected, in_long = set(), set()
    for key, members in lists.items():
        members = sorted(set(members), key=lambda r: r[2])
        # a list that fills the rows held counts as long, too
        if len(members) > jaccard.SHORT or any(x[1] == key for x in long):
            in_long |= {(c, key, size, n) for _, n, c, size in members}
        else:
            expected |= {(r[2], t[2]) for i, r in enumerate(members) for t in members[i + 1 :] if jaccard.fits(r[3], r[1], t[3], t[1])}
    assert (pairs, long) == (expected, in_long)
    assert expected and len(in_long) >= 49
