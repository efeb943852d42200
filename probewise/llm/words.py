"""Words of a whole column at once: split, number and expand without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most ``limit`` bytes of text; a longer text makes a run of its own.
    The column comes as large strings without nulls: a null is an empty text."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        batch = batch.set_column(at, column, texts)
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(total):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space, the word numbers of all texts one after another, and
    where each text's words end. A text without words has the empty word, which is among the words."""
    lists = pc.ascii_split_whitespace(pa.concat_arrays([texts]))
    found = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy().astype(np.int64)
    return spelt(found.dictionary), found.indices.to_numpy(), ends[1:] - ends[0]


def spelt(dictionary: pa.Array) -> list[str]:
    """The words of a dictionary as a list; as they hold no white space, one joined string gives all."""
    if not len(dictionary):
        return []
    ends = pa.array([0, len(dictionary)], pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, dictionary), pa.scalar("\n", dictionary.type))
    return joined[0].as_py().split("\n")


def expand(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where word w stands for ``sizes[w]`` values in a flat table: the table index of every value of
    all texts, and where each text's values end."""
    place = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    to = np.cumsum(counts)
    source = np.repeat(place[codes] - (to - counts), counts)
    source += np.arange(len(source))
    return source, np.concatenate([[0], to])[ends].astype(np.int64)
