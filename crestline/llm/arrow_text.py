"""Access to the UTF-8 bytes of Arrow text columns, shared by the Arrow operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and the row borders in them; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, borders, data = column.buffers()
    ends = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def row_spans(column: pa.Array, most_bytes: int):
    """Ranges of rows that hold about most_bytes of text; a longer row is a range of its own."""
    _, ends = text_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, ends[start] + most_bytes, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop
