"""Sorted lists of numbers as bytes, and the closing of wedges in batches: what triangles need of numpy and Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of lists that are unpacked at once, and room for a row's place beside a number of a node (61 bits in all).
SLICE, ROOM = 2_000_000, 40
COUNTED = pa.schema([("rank", pa.int64()), ("t", pa.int64())])


def pack(sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bytes) of lists that follow each other in ``values``, each ascending: differences, seven bits a byte."""
    steps = values.astype(np.int64)
    steps[1:] -= values[:-1]
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    steps[starts[full]] = values[starts[full]]
    wide = np.ones(len(steps), np.int64)
    for bits in range(7, 63, 7):
        wide += steps >= (1 << bits)
    ends = np.cumsum(wide)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - wide, wide)
    out = (np.repeat(steps, wide) >> (7 * place)) & 127
    out[place < np.repeat(wide - 1, wide)] |= 128
    reach = np.concatenate([[0], ends])
    return reach[starts + sizes], out.astype(np.uint8)


def unpack(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of packed lists of ``sizes`` bytes that follow each other in ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    steps = np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)
    row = np.repeat(np.arange(len(sizes)), sizes)[last]
    total = np.cumsum(steps)
    opens = np.concatenate([[True], row[1:] != row[:-1]])
    base = (total - steps)[opens]
    return row, total - np.repeat(base, np.diff(np.append(np.flatnonzero(opens), len(row))))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, list of numbers) to (u, bytes)."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.asarray(lists.value_lengths(), np.int64)
        ends, data = pack(sizes, np.array(lists.flatten(), np.int64))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), blobs], names=["u", "near"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.diff(offsets).astype(np.int64), np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, w, near_x, near_u), a row for each side from u to x, to (rank, t): what the triangles on these sides count at
    each corner. A number w is 4 v + 2 go + back, for a side from u to v and its two directions."""
    for batch in batches:
        weights = np.cumsum(_bytes(batch.column(2))[0] + _bytes(batch.column(3))[0])
        start = 0
        while start < batch.num_rows:
            done = weights[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(weights, done + SLICE)))
            yield _closed(batch.slice(start, stop - start))
            start = stop


def _closed(batch: pa.RecordBatch) -> pa.RecordBatch:
    u, w = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
    opens = np.concatenate([[True], u[1:] != u[:-1]])  # rows of one u mostly follow each other, so its list is read once
    group = np.cumsum(opens) - 1
    row, far = unpack(*_bytes(batch.column(2)))
    own, near = unpack(*_bytes(batch.column(3).filter(pa.array(opens))))
    have = (own << ROOM) + (near >> 2)
    asked = (group[row] << ROOM) + (far >> 2)
    at = np.minimum(np.searchsorted(have, asked), max(0, len(have) - 1))
    hit = np.flatnonzero(have[at] == asked) if len(have) else np.zeros(0, np.int64)
    row, far, near = row[hit], far[hit], near[at[hit]]
    go, back = (lambda x: (x >> 1) & 1), (lambda x: x & 1)
    (ux, xu), (xy, yx), (uy, yu) = ((go(x), back(x)) for x in (w[row], far, near))
    ids = np.concatenate([u[row], w[row] >> 2, far >> 2])
    t = np.concatenate([ux * uy * (xy + yx), xu * xy * (uy + yu), yu * yx * (ux + xu)])
    rank, place = np.unique(ids, return_inverse=True)
    total = np.zeros(len(rank), np.int64)
    np.add.at(total, place, t)
    return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(total)], schema=COUNTED)
