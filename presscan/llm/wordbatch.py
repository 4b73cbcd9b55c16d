"""The words of Arrow text batches, each distinct word once.

Models that score a text as the sum over its words compute a word's score once a
slice of a batch, however often the word occurs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts a task looks at together: rows, and bytes unless a single text has more.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``most`` bytes of text, unless a single one has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


#: What operators keep in a process between their tasks, by name, as what forgets it.
CACHES: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """``run`` for a task whose process has done other work and goes on with other work.

    What other operators than ``owner`` have kept goes first; freed memory goes back to the machine at the end.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in CACHES.items():
            if name != owner:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
            if trim is not None:
                trim(0)

    return task


@dataclass
class Words:
    """``distinct`` words; ``index`` of each occurrence, in order; ``row`` each occurrence stands in."""

    distinct: list[bytes]
    index: np.ndarray
    row: np.ndarray
    rows: int


def letter_words(texts: pa.Array) -> Words:
    """Runs of letters, in lower case, as UTF-8; a null text has none."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(lowered, pattern=r"[^\pL]+")
    row = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    row = row[filled.to_numpy(zero_copy_only=False)]
    encoded = flat.filter(filled).dictionary_encode()
    distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
    return Words(distinct, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, len(texts))
