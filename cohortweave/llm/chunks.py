"""Token ids of whole texts from cached chunks, for tokenizers whose tokens never cross a chunk's end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa


class ChunkCache:
    """Encodes every distinct chunk once and puts texts together from the cached ids.

    `encode` maps new chunks to their ids: a list for each chunk, or all ids in one array and the number of each
    chunk's. At most `limit` chunks are held; a fuller cache starts anew.
    """

    def __init__(self, encode: Callable[[list], list[list[int]] | tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes | str, int] = {}
        self.n = self.used = 0
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)

    def learn(self, chunks: list) -> None:
        ids, n = self.encode(chunks), len(chunks)
        if isinstance(ids, tuple):
            flat, sizes = ids
        else:
            sizes = np.fromiter(map(len, ids), np.int64, n)
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.starts = grown(self.starts, self.n + n)
        self.sizes = grown(self.sizes, self.n + n)
        self.flat = grown(self.flat, self.used + len(flat))
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[self.n:self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n:self.n + n] = sizes
        self.at.update(zip(chunks, range(self.n, self.n + n)))
        self.n, self.used = self.n + n, self.used + len(flat)

    def texts(self, chunked: list[list]) -> Iterator[np.ndarray]:
        """The ids of each text, given its chunks."""
        new = set().union(*chunked) - self.at.keys()
        if len(self.at) + len(new) > self.limit:
            self.clear()
            new = set().union(*chunked)
        if new:
            self.learn(list(new))
        for chunks in chunked:
            idx = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
            sizes = self.sizes[idx]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.starts[idx] - (ends - sizes), sizes)
            yield self.flat[shift + np.arange(len(shift))]


def grown(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows of the batches in lists that end once they hold `most` characters of text."""
    for b in batches:
        held, size = [], 0
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append(row)
            size += len(row[text_at])
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
