"""Arrow batches of text as flat byte arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task holds in numpy arrays at once; one longer text is its own slice.
SLICE_BYTES = 1 << 19
#: The same where words are looked up once for all their places in a slice.
SECTION_BYTES = 1 << 22


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches between rows so that each part holds about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_view(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            part = batch.slice(at, to - at)
            yield (part, *byte_view(part.column(part.schema.get_field_index(text))))
            at = to


def windows(batches: Iterator[pa.RecordBatch], overlap: int, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """slices(), but a text of more than twice ``limit`` bytes comes in windows; the last item is where in its text the slice begins.

    Each window but the last has ``overlap`` bytes more than the next one's distance, so each string of overlap + 1 bytes begins and ends in one.
    """
    for part, data, offsets in slices(batches, text, limit):
        if len(offsets) > 2 or len(data) <= 2 * limit:
            yield part, data, offsets, 0
            continue
        for at in range(0, max(1, len(data) - overlap), limit):
            x = data[at : at + limit + overlap]
            yield part, x, np.array([0, len(x)]), at


def sections(batches: Iterator[pa.RecordBatch], breaks: np.ndarray, text: str = "text", limit: int = SECTION_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """slices(), but a text of more than twice ``limit`` bytes comes in sections that end with a byte of ``breaks`` (256 booleans); the last item says that its text ends here.

    A text without such a byte stays whole.
    """
    for part, data, offsets in slices(batches, text, limit):
        if len(offsets) > 2 or len(data) <= 2 * limit:
            yield part, data, offsets, True
            continue
        at = 0
        while at < len(data):
            to = at + limit
            while to < len(data) and not breaks[data[to - 1]]:
                ahead = np.flatnonzero(breaks[data[to : to + limit]])
                to += int(ahead[0]) + 1 if len(ahead) else limit
            to = min(to, len(data))
            yield part, data[at:to], np.array([0, to - at]), to == len(data)
            at = to


def cut_words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray, np.ndarray]:
    """(number of each word in the list of different words, that list, begin of each word, its text); ``kinds`` is 0 for the bytes of words.

    ``begin`` marks bytes of words at which a new one begins though none has ended.
    """
    inside = kinds[data] == 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if begin is not None:
        begins |= begin & inside
        ends[:-1] |= begins[1:] & inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends[first[first > 0] - 1] = inside[first[first > 0] - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    ends_at = np.zeros(len(at) + 1, np.int64)
    np.cumsum(to - at, out=ends_at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends_at), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, at, np.searchsorted(offsets, at, "right") - 1
