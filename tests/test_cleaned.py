"""Cleaned texts are worked off in runs, however many come in a batch."""

from __future__ import annotations

import pyarrow as pa

from oscilla.operators import documents


def test_slices_of_a_batch():
    most = documents.RUN
    texts = ["a" * (most // 2)] * 5 + ["b" * (3 * most), None, "", "c"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": texts})
    parts = list(documents._slices(batch, "t"))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2, 3], [4], [5], [6, 7, 8]]
    assert list(documents._slices(batch.slice(0, 0), "t")) == []


def test_no_batch_holds_more_than_a_run():
    """The arrays of 40 texts of 100,000 characters are handed on a few texts at a time."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(40)), "t": ["ab  \n" * 20000] * 40})
    made = list(documents._cleaned(iter([batch]), "k", "t"))
    assert [k for b in made for k in b.column("k").to_pylist()] == list(range(40))
    assert {len(t) for b in made for t in b.column("cleaned").to_pylist()} == {3 * 20000 - 1}
    assert max(len(b.column("starts").flatten()) for b in made) <= documents.RUN
