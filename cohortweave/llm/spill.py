"""External counting of pairs that documents hold, in sorted zstd runs.

A run is what one task gathered up to a bound: its documents and, sorted by (bucket, side, other), the distinct
pairs with the documents that hold them. The bucket is a radix of the side id, so that a side's pairs meet in one
task. Counting reads the runs' heads alone (distinct pairs and their totals in the run): a pair that every document
holds is one number a run. Heads of a bucket are merged by a k-way heap, at most FAN_IN at a time; the merge goes
side by side, which gives each side's largest count as soon as the side ends. The heads then pass a second time and
get their pairs' counts back; answers meet their run's documents by run, so no task sees more than one run at a time.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_BITS = 24       # ids are below 2^24
BUCKET_BITS = 14   # and buckets below 2^14, so that bucket, side and other fit one signed long
FAN_IN = 64
RUN_RECORDS, RUN_DOCS = 1_000_000, 20_000
LEVEL = 3
OTHER = (1 << ID_BITS) - 1
TYPES = "<u1", "<u2", "<u4", "<i8"


def pair_codes(side: np.ndarray, other: np.ndarray) -> np.ndarray:
    return side.astype(np.int64) << ID_BITS | other.astype(np.int64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers in their narrowest types, compressed together."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        t = next(i for i, limit in enumerate((1 << 8, 1 << 16, 1 << 32, 1 << 63)) if a.max(initial=0) < limit)
        head.append(struct.pack("<BQ", t, len(a)))
        body.append(a.astype(TYPES[t]).tobytes())
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(head + body))


def expand(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at = data[0], 1 + 9 * data[0]
    out = []
    for i in range(n):
        t, size = struct.unpack_from("<BQ", data, 1 + 9 * i)
        a = np.frombuffer(data, TYPES[t], size, at)
        at += a.nbytes
        out.append(a.astype(np.int64))
    return out


def steps(sorted_codes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_codes, prepend=0)


class RunWriter:
    """Gathers documents' pairs and gives them out as the rows of a run: (run, bucket, head, records, docs).

    The row of bucket -1 has the records and the documents' own values; the other rows have the heads."""

    def __init__(self, buckets: int, columns: list[str]):
        if buckets >= 1 << BUCKET_BITS:
            raise ValueError("too many buckets")
        self.buckets, self.columns = buckets, columns
        self.clear()

    def clear(self) -> None:
        self.run, self.docs, self.pairs, self.times, self.sizes, self.n = None, [], [], [], [], 0

    def add(self, run: int, values: tuple, pairs: np.ndarray) -> None:
        """One document: its row number, its own values, and a code for each link."""
        self.run = run if self.run is None else self.run
        distinct, times = np.unique(pairs, return_counts=True)
        self.docs.append(values)
        self.pairs.append(distinct)
        self.times.append(times)
        self.sizes.append(len(distinct))
        self.n += len(distinct)

    def full(self) -> bool:
        return self.n >= RUN_RECORDS or len(self.docs) >= RUN_DOCS

    def rows(self) -> list[tuple]:
        if not self.docs:
            return []
        pairs, times = np.concatenate(self.pairs).astype(np.int64), np.concatenate(self.times)
        docs = np.repeat(np.arange(len(self.sizes)), self.sizes)
        coded = (pairs >> ID_BITS) % self.buckets << 2 * ID_BITS | pairs
        order = np.argsort(coded, kind="stable")
        coded, times, docs = coded[order], times[order], docs[order]
        distinct, starts, held = np.unique(coded, return_index=True, return_counts=True)
        totals = np.add.reduceat(times, starts) if len(starts) else times
        values = dict(zip(self.columns, map(list, zip(*self.docs))))
        out = [(self.run, -1, None, squeeze(held, docs, times), ipc(values))]
        bucket = distinct >> 2 * ID_BITS
        for b, start, size in zip(*np.unique(bucket, return_index=True, return_counts=True)):
            part = slice(start, start + size)
            codes = distinct[part] & ((1 << 2 * ID_BITS) - 1)
            out.append((self.run, int(b), squeeze(steps(codes), totals[part]), None, None))
        self.clear()
        return out


def ipc(values: dict[str, list]) -> bytes:
    batch = pa.RecordBatch.from_pydict(values)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


RUN_SCHEMA = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("head", pa.binary()), ("records", pa.binary()), ("docs", pa.binary())])
RUN_TYPES = "run long, bucket int, head binary, records binary, docs binary"


def by_side(head: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """side, others, totals of a head in ascending order of sides."""
    gaps, totals = expand(head)
    codes = np.cumsum(gaps)
    sides, starts = np.unique(codes >> ID_BITS, return_index=True)
    for side, start, end in zip(sides.tolist(), starts, [*starts[1:], len(codes)]):
        yield side, codes[start:end] & OTHER, totals[start:end]


def merge(heads: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sides of all heads in ascending order, each with its others (ascending) and their totals."""
    streams = [by_side(h) for h in heads]
    heap = [(*first, i) for i, s in enumerate(streams) if (first := next(s, None))]
    heap = [(side, i, others, totals) for side, others, totals, i in heap]
    heapq.heapify(heap)
    while heap:
        side, parts = heap[0][0], []
        while heap and heap[0][0] == side:
            _, i, others, totals = heap[0]
            parts.append((others, totals))
            following = next(streams[i], None)
            if following:
                heapq.heapreplace(heap, (following[0], i, *following[1:]))
            else:
                heapq.heappop(heap)
        if len(parts) == 1:
            yield side, *parts[0]
            continue
        others, place = np.unique(np.concatenate([o for o, _ in parts]), return_inverse=True)
        totals = np.zeros(len(others), np.int64)
        np.add.at(totals, place, np.concatenate([t for _, t in parts]))
        yield side, others, totals


class BucketCounts:
    """Counts of one bucket's pairs: heads go in, at most FAN_IN wait at a time."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []

    def add(self, head: bytes) -> None:
        self.waiting.append(head)
        if len(self.waiting) >= FAN_IN:
            codes, totals, _ = self.merged()
            self.waiting = [squeeze(steps(codes), totals)]

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes, counts and whether a pair's count is its side's largest."""
        codes, counts, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for side, others, totals in merge(self.waiting):
            codes.append(side << ID_BITS | others)
            counts.append(totals)
            best.append(totals == totals.max())
        return np.concatenate(codes), np.concatenate(counts), np.concatenate(best)


def count_and_answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads sorted by (bucket, pass): the first pass is counted, the second gets the counts of its pairs."""
    bucket, counts, known = None, None, None
    for batch in batches:
        out = []
        for b, again, run, head in zip(*(batch.column(n).to_pylist() for n in ("bucket", "again", "run", "head"))):
            if b != bucket:
                bucket, counts, known = b, BucketCounts(), None
            if not again:
                counts.add(head)
                continue
            if known is None:
                known, counts = counts.merged(), None
            codes, totals, best = known
            at = np.searchsorted(codes, np.cumsum(expand(head)[0]))
            out.append((run, b, squeeze(totals[at], best[at].astype(np.int64))))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
                                         names=["run", "bucket", "answer"])


def settle(records: bytes, answers: list[bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document of a run: links whose count is their side's largest, and the sum of the links' counts."""
    held, docs, times = expand(records)
    told = [expand(a) for a in answers]
    counts, best = (np.concatenate([t[i] for t in told] or [np.zeros(0, np.int64)]) for i in (0, 1))
    n_best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    np.add.at(n_best, docs, np.repeat(best, held) * times)
    np.add.at(total, docs, np.repeat(counts, held) * times)
    return n_best, total


def answered(runs: DataFrame) -> DataFrame:
    """run, bucket, answer for every head of the stored runs."""
    heads = runs.where("bucket >= 0").select("run", "bucket", "head")
    twice = heads.withColumn("again", F.explode(F.array(F.lit(False), F.lit(True))))
    return twice.repartition("bucket").sortWithinPartitions("bucket", "again", "run").mapInArrow(
        count_and_answer, "run long, bucket int, answer binary")


def streamed_back(runs: DataFrame, schema: pa.Schema, types: str) -> DataFrame:
    """The documents' own values with n_best and count_sum, one row a document.

    `schema` and `types` are those of the values with the two columns behind them."""
    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}

        def done() -> pa.RecordBatch:
            values = pa.ipc.open_stream(own["docs"]).read_all().combine_chunks()
            n_best, total = settle(own["records"], own["answers"], len(values))
            columns = [values.column(n).combine_chunks().cast(schema.field(n).type) for n in values.column_names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(total)], schema=schema)

        for batch in batches:
            for run, bucket, records, docs, answer in zip(
                    *(batch.column(n).to_pylist() for n in ("run", "bucket", "records", "docs", "answer"))):
                if bucket >= 0:
                    own["answers"].append(answer)
                    continue
                if own:
                    yield done()
                own = {"run": run, "records": records, "docs": docs, "answers": []}
        if own:
            yield done()

    docs = runs.where("bucket = -1").select("run", "bucket", "records", "docs", F.lit(None).cast("binary").alias("answer"))
    told = answered(runs).select("run", "bucket", F.lit(None).cast("binary").alias("records"), F.lit(None).cast("binary").alias("docs"), "answer")
    return docs.unionByName(told).repartition("run").sortWithinPartitions("run", "bucket").mapInArrow(run_rows, types)
