"""Slices of a text column, which bound what a Python worker holds."""

import pyarrow as pa

from probewise.llm import words


def test_slices_hold_little_text_and_lose_none():
    texts = ["word " * 50_000] * 60 + ["x" * (6 << 20), None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "doc_id"])
    parts = list(words.slices([batch]))
    sizes = [sum(map(len, p["text"].to_pylist())) for p in parts]
    assert all(size <= 4 << 20 or len(p) == 1 for p, size in zip(parts, sizes, strict=True))
    assert [t for p in parts for t in p["text"].to_pylist()] == [t or "" for t in texts]
