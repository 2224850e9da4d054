"""Packed entries of chunks, dealt to buckets: one row for each bucket that a chunk has entries for.

There are never more rows than entries, so they grow with the input, whatever the number of buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .ragged import U64


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the high 32 bits of hashes, for up to 2**32 of them."""
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


class Deal:
    """Entries in the order of their buckets, cut where these change."""

    def __init__(self, bucket: np.ndarray):
        self.order = np.argsort(bucket, kind="stable")
        along = bucket[self.order]
        self.starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(along)), bool), along[1:] != along[:-1]]))
        self.ends = np.append(self.starts[1:], len(along))[: len(self.starts)]
        self.buckets = along[self.starts]

    def cells(self, values: np.ndarray) -> pa.Array:
        """The entries' values, a cell a bucket."""
        values = np.ascontiguousarray(values[self.order])
        return cut(values, self.ends)

    def back(self, buckets: list[int], cells: list[bytes], kind: type) -> np.ndarray:
        """Values that came back by bucket, in the order of the entries."""
        out = np.zeros(len(self.order), kind)
        at = np.searchsorted(self.buckets, buckets)
        for k, cell in zip(at.tolist(), cells, strict=True):
            out[self.order[self.starts[k] : self.ends[k]]] = np.frombuffer(cell, kind)
        return out


def cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the values up to each of ``ends``."""
    data = np.ascontiguousarray(values).view(np.uint8)
    offs = np.concatenate([[0], ends]).astype(np.int64) * values.dtype.itemsize
    if offs[-1] >= 1 << 31:
        return pa.array([data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])


def read(column: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]
