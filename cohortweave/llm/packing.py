"""Packing tokenised documents into as few sequences as possible.

Only the number of pieces of each length (at most `capacity` numbers, whatever the corpus) goes to the
driver. There the instance is reduced by Martello and Toth's dominance criterion and the rest is packed
best-fit decreasing, both on whole length classes. The plan is a table of slots, and every piece finds
its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.chunks import ChunkCache, batch_of, slices
from cohortweave.session import materialise

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _nth long"
Pattern = list[tuple[int, int]]  # (length, how many)


# Stops and commas behind an ASCII letter or digit, up to the word's end: pre-tokens of their own.
TAIL = re.compile(rb"(?<=[a-z0-9])[.,]+(?=[\t-\r ]|\Z)")
LATIN = [chr(c) for c in range(0x24F)]


def words_of(text: str) -> list[bytes]:
    """Words that are encoded each on its own: no token crosses ASCII white space or a TAIL's start.

    ASCII letters are lower-cased before the tokenizer does it, unless special tokens may be there.
    """
    data = text.encode()
    return data.split() if b"<|" in data else TAIL.sub(rb" \g<0>", data.lower()).split()


@lru_cache(maxsize=1)
def word_cache(path: str) -> ChunkCache:
    """Ids of a tokenizer that drops white space and lower-cases, by word; one a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # a word of these letters is one pre-token, so the model alone gives its ids; the tokenizer itself says
    # what it makes of each letter
    letters = {c: tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))
               for c in LATIN if c.isalpha() and tokenizer.normalizer.normalize_str(c) == c}
    table = str.maketrans({c: "".join(p for p, _ in parts) for c, parts in letters.items()})
    plain = re.compile(f"[{''.join(letters)}]+").fullmatch
    one = tokenizer.model.tokenize

    def encode(words: list[bytes]) -> list[list[int]]:
        texts = [w.decode() for w in words]
        ids = [[t.id for t in one(t.translate(table))] if plain(t) else None for t in texts]
        rest = [i for i, found in enumerate(ids) if found is None]
        for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        return ids

    return ChunkCache(encode)


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One stored row a piece: PIECES, _nth being its place among the task's pieces of that length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("_task", pa.int64()), ("_nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task, seen = word_cache(tokenizer), TaskContext.get().partitionId(), {}
        for rows in slices(batches, 1):
            out = []
            for (doc, _), ids in zip(rows, cache.texts([words_of(text) for _, text in rows])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    nth = seen.get(len(part), 0)
                    seen[len(part)] = nth + 1
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), task, nth))
            yield batch_of(out, schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(slim.mapInArrow(cut, PIECES))


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Fix sets that dominate every other set with the same longest piece; `counts` keeps the rest.

    A set dominates if each feasible set around piece j can be split into parts that fit into distinct
    pieces of it. Sets of up to three pieces are tried, for all copies of j at once.
    """
    fixed: list[tuple[int, Pattern]] = []

    def fix(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= n * k
        fixed.append((n, list(need.items())))

    def others(j: int, ascending: list[int], n: int, above: int = 0) -> list[int]:
        """The n smallest pieces longer than `above`, one copy of j aside."""
        out: list[int] = []
        for x in ascending[bisect.bisect_right(ascending, above):]:
            out += [x] * min(n - len(out), counts[x] - (x == j))
            if len(out) == n:
                break
        return out

    def largest(most: int, used: tuple[int, ...], ascending: list[int]) -> int:
        """The longest piece of at most `most` that is left beside the used ones, or 0."""
        for i in range(bisect.bisect_right(ascending, most) - 1, -1, -1):
            if counts[ascending[i]] > used.count(ascending[i]):
                return ascending[i]
        return 0

    def dominating(j: int, ascending: list[int]) -> tuple[int, ...] | None:
        room = capacity - j
        k = largest(room, (j,), ascending)
        if not k:
            return (j,)
        small = others(j, ascending, 3)
        if k == room or sum(small[:2]) > room or len(small) < 2:
            return (j, k)
        if len(small) == 3 and sum(small) <= room:
            return None
        b = largest(room - k, (j, k), ascending)  # at most two more pieces fit
        above = others(j, ascending, 2, b)
        if len(above) == 2 and sum(above) <= room:
            return None  # two pieces longer than b fit together
        return (j, k, b) if b else (j, k)

    changed = True
    while changed:
        changed = False
        ascending = sorted(x for x, n in counts.items() if n)
        for j in reversed(ascending):
            while counts[j]:
                found = dominating(j, ascending)
                if not found:
                    break
                fix(found)
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing on length classes: bins with the same content are one group."""
    open_bins: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, pattern: Pattern) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append((n, pattern))

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[x]
        while left:
            i = bisect.bisect_left(rooms, x)
            if i < len(rooms):
                room = rooms[i]
                n, pattern = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                room, n, pattern = capacity, left, []
            each = room // x
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            put(room - each * x, full, [*pattern, (x, each)])
            rest = min(rest, each - 1) if full < n else 0
            put(room - rest * x, 1 if rest else 0, [*pattern, (x, rest)])
            if pattern:
                put(room, n - full - (1 if rest else 0), pattern)
            left -= full * each + rest
    return [g for groups in open_bins.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """(how many sequences, their content) for the given number of pieces of each length."""
    rest = dict(counts)
    return reduce_dominated(rest, capacity) + best_fit(rest, capacity)


def slot_table(groups: list[tuple[int, Pattern]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many a sequence, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, pattern in groups:
        offset = 0
        for x, each in pattern:
            rows.append((x, used.get(x, 0), sequence, each, offset))
            used[x] = used.get(x, 0) + n * each
            offset += x * each
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def placed(pieces: DataFrame, slots: np.ndarray) -> DataFrame:
    """`pieces` (with rank) plus sequence_id and offset. A length class has few slots: the table is
    bounded by the capacity, not by the number of pieces."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        key = (s[:, 0] << 44) + s[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - s[at, 1]
            sequence, offset = s[at, 2] + nth // s[at, 3], s[at, 4] + nth % s[at, 3] * length
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names[:-1]], pa.array(sequence), pa.array(offset)],
                                             names=[*names[:-1], "sequence_id", "offset"])

    return pieces.select(*names).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID,
                   planner: Callable[[dict[int, int], int], list[tuple[int, Pattern]]] = plan) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end_id`; only longer ones than `capacity` are cut, into pieces of
    that size and a last one. `tokenizer` is the path of a word tokenizer's file on every machine.

    Null or empty text is the end id alone. Null ids and repeated rows are documents like others. An
    empty table gives no rows. Other columns are not read.
    """
    pieces = tokenised_pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    counts = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    ranked = pieces.join(bases, ["_task", "length"]).withColumn("rank", F.col("_base") + F.col("_nth"))
    return placed(ranked, slot_table(planner(histogram, capacity)))
