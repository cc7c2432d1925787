"""Texts cut into segments, of which a chunk's distinct ones are found at once.

Operators that treat each distinct word once work on chunks: Arrow batches gathered up to some bytes of text. The
bytes of a chunk are cut by array operations, and Arrow's dictionary encoding numbers the distinct segments, exactly.
What is computed for a distinct segment comes back to the texts by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a chunk gathers; a longer text is a chunk of its own.
CHUNK = 32 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in record batches of about `size` bytes of text."""
    held, held_bytes = [], 0
    for batch in batches:
        own = batch.column(text).nbytes
        if held and held_bytes + own > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_bytes = [], 0
        held.append(batch)
        held_bytes += own
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts (and the last one ends)."""
    large = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The slices of data between neighbouring bounds."""
    bounds = np.ascontiguousarray(bounds, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of the slices of data between bounds: their numbers, and the distinct slices by number."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    coded = as_binary(data, bounds).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def expanded(lengths: np.ndarray, starts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places in a flat array of all items of the runs (starts, lengths) numbered by index, in order."""
    n = lengths[index]
    ends = np.cumsum(n)
    return np.repeat(starts[index] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


_SPACE, _LETTER, _SYMBOL = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
for _a, _b in ((65, 91), (97, 123)):
    _KIND[_a:_b] = _LETTER
for _a, _b in ((33, 39), (40, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_a:_b] = _SYMBOL
#: Last bytes of white space beyond ASCII (and of some other characters), with 0x1C to 0x1F; there no cut is made.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0x85, 0xA0, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B), *range(0x1C, 0x20)]] = True


def pattern_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of segments whose matches of public_tokenizers.PATTERN, one after the other, are those of the whole texts.

    No match of the pattern goes on from other text into white space, from a letter into a mark that is no apostrophe, or
    from such a mark into a letter; nor from a white character alone that is no blank into a letter. Matches depend
    on nothing before them, and on no more after them than that white space ends.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    if len(data) > 1:
        kind = _KIND[data]
        before, after = kind[:-1], kind[1:]
        inner = cut[1:-1]
        inner |= (after == _SPACE) & (before != _SPACE) & ~_UNSURE[data[:-1]]
        inner |= (before | after) == (_LETTER | _SYMBOL)
        if len(data) > 2:
            alone = (kind[1:-1] == _SPACE) & (data[1:-1] != 32) & (kind[:-2] != _SPACE) & ~_UNSURE[data[:-2]] & (kind[2:] == _LETTER)
            cut[2:-1] |= alone
    return np.flatnonzero(cut)


def blank_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of segments that start at a blank, at a line end and after a line end."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    line = data == 10
    cut[:-1] |= line | (data == 32)
    cut[1:] |= line
    return np.flatnonzero(cut)
