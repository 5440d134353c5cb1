"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are maximal runs of anything but ASCII white space ...
SPACED = r"[^\x20\x09-\x0D]+"
#: ... or of ASCII letters and digits and anything beyond ASCII.
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column, pattern: str) -> Column:
    """All words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"))


def share(c: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; null for a null id."""
    return F.crc32(c.cast("string").cast("binary")) % of


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of about ``most`` text bytes, one row at least, so that the
    working set of a task does not depend on how long its rows are."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.cumsum([len(x) if x is not None else 0 for x in (v.as_buffer() for v in column)])
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
