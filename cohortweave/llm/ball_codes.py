"""Product codes of vectors by Ball k-means on exact integers.

Every vector is cut into equal parts and each part position has its own codebook. An entry and the parts
assigned to it form a ball. Once entries have moved, only entries nearer than twice a ball's radius are its
neighbours; a part at distance d of its own entry is compared with the neighbours within 2 d alone (its ring),
and with none if there are none (the stable core). A ball skips all comparisons if neither its entry nor a
neighbour has moved. The bounds follow from the triangle inequality on integers, so codes are exactly those
of a full search.

Spark holds the vectors: every round is one pass over a stored table, and what reaches the driver is one
total a codebook number. Vectors are int64 inside a task where no square can overflow, Python integers otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.session import materialise, materialise_counted

SCALE_BITS = 8      # components are counted in steps of 1/256
LIMB = 30           # totals travel as digits of this many bits, so that sums of any size stay exact
CODED = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
LABELS_SENT = 100_000  # labels whose totals are broadcast; more of them are joined by shuffle


@dataclass
class Ring:
    """What a task needs to move on from one assignment: entries, and per entry its neighbours by distance."""
    entries: np.ndarray     # position, entry, component
    near: np.ndarray        # position, entry, rank -> neighbour
    gaps: np.ndarray        # position, entry, rank -> squared distance to it
    count: np.ndarray       # position, entry -> neighbours
    idle: np.ndarray        # position, entry -> nothing around it moved


def limit(width: int) -> float:
    """Components below it keep four times the squared distance of two parts of this width within int64."""
    return (1 << 29) / math.sqrt(width)


def integers(x: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 x) of every component as rows x parts x components; object dtype where int64 could overflow."""
    scaled = np.floor(np.ldexp(x.astype(np.float64), SCALE_BITS))  # exact: a power of two and a floor
    if np.abs(scaled).max(initial=0) < limit(x.shape[1] // parts):
        out = scaled.astype(np.int64)
    else:
        out = np.array([[math.floor(Fraction(v) * (1 << SCALE_BITS)) for v in row] for row in x.tolist()], dtype=object)
    return out.reshape(len(x), parts, -1)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows x components of a list column whose rows have one length and no nulls."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def fitting(entries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The entries in the type that suits x: int64 only if no difference can overflow."""
    if x.dtype == object or entries.dtype == object:
        return entries.astype(object)
    return entries


def full_search(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest entry of every part (rows x parts); ties go to the lower index."""
    codes = np.zeros(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        e = fitting(entries[p], x)
        best = squares(x[:, p], e[0])
        for j in range(1, len(e)):
            d = squares(x[:, p], e[j])
            nearer = d < best
            codes[nearer, p], best[nearer] = j, d[nearer]
    return codes


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def own_distances(x: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    e = fitting(entries, x)
    return np.stack([squares(x[:, p], e[p][codes[:, p]]) for p in range(x.shape[1])], axis=1)


def ring_search(x: np.ndarray, ring: Ring, codes: np.ndarray) -> np.ndarray:
    """Codes after the entries moved: each part meets the neighbours inside its ring, nearest first."""
    out = codes.copy()
    for p in range(x.shape[1]):
        e, own = fitting(ring.entries[p], x), codes[:, p]
        best = squares(x[:, p], e[own])
        reach, moving = 4 * best, ~ring.idle[p][own]
        live = np.flatnonzero(moving & (ring.count[p][own] > 0))
        rank = 0
        while len(live):
            live = live[ring.gaps[p][own[live], rank] <= reach[live]]  # the others' rings end here
            other = ring.near[p][own[live], rank]
            d = squares(x[live, p], e[other])
            wins = (d < best[live]) | ((d == best[live]) & (other < out[live, p]))
            best[live[wins]], out[live[wins], p] = d[wins], other[wins]
            rank += 1
            live = live[ring.count[p][own[live]] > rank]
    return out


def neighbours(entries: np.ndarray, radii: np.ndarray, moved: np.ndarray) -> Ring:
    """Balls around moved entries: `radii` bound each ball's squared radius, `moved` marks entries that changed."""
    parts, k, _ = entries.shape
    near, count = np.zeros((parts, k, max(k - 1, 1)), np.int64), np.zeros((parts, k), np.int64)
    gaps = np.zeros(near.shape, entries.dtype)
    idle = np.zeros((parts, k), bool)
    for p in range(parts):
        for i in range(k):
            gap = squares(entries[p], entries[p][i])
            found = [j for j in range(k) if j != i and gap[j] <= 4 * radii[p, i]]
            found.sort(key=lambda j: (gap[j], j))
            near[p, i, :len(found)], count[p, i] = found, len(found)
            gaps[p, i, :len(found)] = [gap[j] for j in found]
            idle[p, i] = not moved[p, i] and not any(moved[p, j] for j in found)
    return Ring(entries, near, gaps, count, idle)


def exact(values: list) -> np.ndarray:
    """int64 if all values are small enough for it, Python integers otherwise."""
    a = np.array(values, dtype=object)
    return a.astype(np.int64) if abs(a).max() < limit(a.shape[-1]) else a


def kept_vectors(df: DataFrame, parts: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                     F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0) & (F.size("vec") % parts == 0))


def assign(rows: DataFrame, search: Callable[[np.ndarray, np.ndarray | None], np.ndarray], parts: int) -> DataFrame:
    """rows with the codes that `search(x, old codes)` finds for each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = search(integers(matrix(b.column("vec")), parts), unpack(b.column("codes"), parts))
                yield b.set_column(b.schema.get_field_index("codes"), "codes", pa.array(packed(codes), pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def packed(codes: np.ndarray) -> list[bytes]:
    return [c.tobytes() for c in codes.astype("<u2")]


def unpack(codes: pa.Array, parts: int) -> np.ndarray | None:
    if codes.null_count:
        return None  # nothing is assigned yet
    return np.frombuffer(b"".join(codes.to_pylist()), "<u2").reshape(-1, parts).astype(np.int64)


def ball_totals(rows: DataFrame, entries: np.ndarray, parts: int) -> DataFrame:
    """part, entry, place, digit, total: sums of components by place (digits of LIMB bits), number of parts
    (place -1) and squared radius (place -2, the largest) of every ball. A task sends one row a number."""
    k, width = entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, width), object)
        counts = np.zeros((parts, k), np.int64)
        radii = np.zeros((parts, k), object)
        for b in batches:
            if not b.num_rows:
                continue
            x, codes = integers(matrix(b.column("vec")), parts), unpack(b.column("codes"), parts)
            far = own_distances(x, entries, codes)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                e, starts = np.unique(codes[order, p], return_index=True)
                sums[p, e] += np.add.reduceat(x[order, p], starts, axis=0).astype(object)
                counts[p, e] += np.diff([*starts, len(order)])
                radii[p, e] = np.maximum(radii[p, e], np.maximum.reduceat(far[order, p], starts))
        found = []
        for p, e in zip(*np.nonzero(counts)):
            found.append((p, e, -1, 0, int(counts[p, e])))
            found += [(p, e, -2, i, d) for i, d in digits(int(radii[p, e]))]
            for i in range(width):
                found += [(p, e, i, j, d) for j, d in digits(int(sums[p, e, i]))]
        columns = zip(*found) if found else [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], t) for c, t in zip(columns, types)],
                                         names=["part", "entry", "place", "digit", "total"])

    per_task = rows.select("vec", "codes").mapInArrow(run, "part int, entry int, place int, digit int, total long")
    # a radius is a maximum; the digits' own maxima make at least that
    sums = per_task.where("place <> -2").groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total"))
    radius = (per_task.where("place = -2").groupBy("part", "entry", "digit").agg(F.max("total").alias("total"))
              .select("part", "entry", F.lit(-2).alias("place"), "digit", "total"))
    return sums.unionByName(radius)


def digits(v: int) -> list[tuple[int, int]]:
    """Digits of LIMB bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) < v < (1 << LIMB):
        out.append((len(out), v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return [*out, (len(out), v)]


def update(entries: np.ndarray, totals: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries after one update, the squared radius of each ball around them (a bound), and which moved.

    A radius bound is (old radius + shift)^2 with both roots rounded up. Digit maxima of different tasks
    can only make the old radius larger, which keeps the bound."""
    parts, k, width = entries.shape
    value: dict[tuple[int, int, int], int] = {}
    for r in totals:
        at = (r["part"], r["entry"], r["place"])
        value[at] = value.get(at, 0) + (r["total"] << (LIMB * r["digit"]))
    new = entries.astype(object)
    radii, moved = np.zeros((parts, k), object), np.zeros((parts, k), bool)
    for p in range(parts):
        for e in range(k):
            n = value.get((p, e, -1), 0)
            if n:
                for i in range(width):
                    new[p, e, i] = value[p, e, i] // n
                shift = int(sum(int(a - b) ** 2 for a, b in zip(new[p, e], entries[p, e])))
                moved[p, e] = shift > 0
                radii[p, e] = (up(value[p, e, -2]) + up(shift)) ** 2
    return exact(new.tolist()), radii, moved


def up(square: int) -> int:
    root = math.isqrt(square)
    return root + (root * root < square)


@dataclass
class Fitted:
    entries: np.ndarray
    sha256: str


def encode(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id",
           vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Fitted | None]:
    """vec_id, label, code, error of every kept row, and the codebooks.

    A row is left out if its vector is null, empty, holds a null or non-finite component, cannot be cut into
    `parts` equal parts, or is not as long as the first kept one's. Codebooks start from the rows of the
    `entries` smallest ids (null ids last, equal ids by their components); fewer rows give fewer entries.
    Repeated rows and null ids count like others, labels of any type may be null, components may have any
    size. The error is a long; one beyond that is null. An empty table gives no rows and no codebooks. Other columns are not read.
    """
    kept = kept_vectors(df, parts, id_col, vec_col, label_col)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    if not first:
        return df.sparkSession.createDataFrame([], T.StructType([kept.schema["vec_id"], kept.schema["label"], *CODED])), None
    length = len(first[0]["vec"])
    start = integers(np.array([r["vec"] for r in first if len(r["vec"]) == length]), parts)
    books = exact(start.transpose(1, 0, 2).tolist())
    rows = kept.where(F.size("vec") == length)
    rows = rows.withColumn("codes", F.lit(None).cast("binary"))
    rows = materialise(assign(rows, lambda x, _, start=books: full_search(x, start), parts))
    for i in range(rounds):
        new, radii, moved = update(books, ball_totals(rows, books, parts).collect())  # one row a codebook number
        ring, books = neighbours(new, radii, moved), new
        rows = assign(rows, lambda x, codes, ring=ring: ring_search(x, ring, codes), parts)
        if i < rounds - 1:
            rows = materialise(rows)
    numbers = ",".join(str(int(v)) for v in books.reshape(-1))
    return materialise(final_codes(rows, books, parts)), Fitted(books, hashlib.sha256(numbers.encode()).hexdigest())


def final_codes(rows: DataFrame, books: np.ndarray, parts: int) -> DataFrame:
    """Code string (two hex digits a part, more above 256 entries) and summed squared distance of each row."""
    digits_each = max(2, len(f"{books.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = unpack(b.column("codes"), parts)
            error = own_distances(integers(matrix(b.column("vec")), parts), books, codes).sum(1).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"),
                 pa.array(["".join(f"{c:0{digits_each}x}" for c in row) for row in codes.tolist()]),
                 pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], rows.schema["label"], *CODED]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over rows of equal label (nulls together).

    Totals are pre-aggregated; they are broadcast if there are at most LABELS_SENT of them, else joined by
    shuffle, where adaptive execution splits a label that holds a large share of the rows."""
    totals, n = materialise_counted(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    totals = totals.withColumnRenamed("label", "_of")
    joined = coded.join(F.broadcast(totals) if n <= LABELS_SENT else totals, F.col("label").eqNullSafe(F.col("_of")), "left")
    return joined.drop("_of")
