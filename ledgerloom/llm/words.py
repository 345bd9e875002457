"""Words of whole columns at once: runs of bytes of a given kind, cut in numpy and numbered in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerloom.llm.base import strings

_BYTES = np.arange(256)
#: Bytes with A-Z in lower case.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of ASCII letters and of all characters beyond ASCII; the same with digits.
LETTERS = (LOWER >= 97) & (LOWER <= 122) | (_BYTES >= 128)
ALPHANUMERIC = LETTERS | (_BYTES >= 48) & (_BYTES <= 57)


def word_runs(column: pa.Array, kind: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The longest runs of bytes of `kind` in each text, A-Z in lower case, one after the other; and how many each text
    has. Null texts have none. As all bytes of a character beyond ASCII are of one kind, runs are whole characters."""
    texts = strings(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    rows = offsets - offsets[0]
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = rows[:-1][rows[:-1] < rows[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    letters = LOWER[data[inside]]
    at = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(letters))
    runs = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return runs, np.diff(np.searchsorted(starts, rows))
