"""Rows as packed vectors: what needs every marker of a row together is computed in one task, without pairs.

`pack` costs one shuffle on the row. Everything behind it is map-side: class scores against a matrix of prototypes,
and mergeable co-moments of marker pairs. A marker that a row does not measure is absent from its pack, never 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

# Prototypes travel to the tasks as one matrix up to this many numbers (32 MB); beyond it they are joined.
MATRIX_NUMBERS = 4_000_000
MOMENTS = ("n", "s1", "s2", "s11", "s22", "s12")


def pack(long: DataFrame, row: Sequence[str], value: str, vocabulary: Sequence[str]) -> DataFrame:
    """row, vec: one number per marker of the vocabulary, NULL where the row does not measure it.

    One hash aggregate with a column a marker, combined before the shuffle; of a marker given twice the larger value
    stays. Rows that measure nothing at all are left out.
    """
    columns = [F.max(F.when(F.col("marker") == m, F.col(value).cast("double"))).alias(f"_v{i}") for i, m in enumerate(vocabulary)]
    g = long.where(F.col(value).isNotNull() & F.col("marker").isin(list(vocabulary))).groupBy(*row).agg(*columns)
    return g.select(*row, F.array(*[f"_v{i}" for i in range(len(vocabulary))]).cast("array<double>").alias("vec"))


def dense(vec: pa.ListArray, width: int) -> np.ndarray:
    """Rows x vocabulary, NaN where a row does not measure a marker."""
    return vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def parted(columns: list[pa.Array]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each combination of the columns' values (nulls included) with the places of its rows."""
    code, values = np.zeros(len(columns[0]), np.int64), []
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        values.append(d.dictionary.to_pylist())
        code = code * len(values[-1]) + d.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    found, starts = np.unique(code[order], return_index=True)
    for f, at in zip(found.tolist(), np.split(order, starts[1:])):
        name = []
        for v in reversed(values):
            f, i = divmod(f, len(v))
            name.append(v[i])
        yield tuple(reversed(name)), at


# ------------------------------------------------------------------ class scores
class Prototypes:
    """Centroids as one matrix a fold, rows in class order; NaN where a class has no value of a marker."""

    def __init__(self, rows: list):
        self.markers = sorted({r["marker"] for r in rows})
        at = {m: i for i, m in enumerate(self.markers)}
        classes: dict = {}
        for r in rows:
            classes.setdefault(r["held"], {}).setdefault(r["cls"], np.full(len(at), np.nan))[at[r["marker"]]] = r["c"]
        self.folds = {h: (sorted(c), np.stack([c[k] for k in sorted(c)])) for h, c in classes.items()}


def cosine(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows x classes over the markers both sides have; NaN without any or without length."""
    mx, mc = ~np.isnan(x), ~np.isnan(c)
    x, c = np.where(mx, x, 0.0), np.where(mc, c, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x @ c.T) / np.sqrt(((x * x) @ mc.T.astype(float)) * (mx.astype(float) @ (c * c).T))


def rms_difference(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Root mean square difference over the markers both sides have."""
    out = np.full((len(x), len(c)), np.nan)
    for j, k in enumerate(c):
        d = (x - k) ** 2
        n = (~np.isnan(d)).sum(1)
        out[:, j] = np.sqrt(np.nansum(d, axis=1) / np.where(n > 0, n, np.nan))
    return out


MEASURES = {"cosine": cosine, "rms": rms_difference}


def fits(prototypes: DataFrame) -> bool:
    """Do the prototypes have at most MATRIX_NUMBERS numbers? They should be stored, they are read again."""
    return prototypes.count() <= MATRIX_NUMBERS


def class_scores(long: DataFrame, prototypes: DataFrame, row: Sequence[str], value: str, measure: str) -> DataFrame:
    """row, scores: array of (cls, score) in class order, of the classes that share a marker with the row.

    prototypes: cls, marker, c, and `held` if they are fold-specific (rows then need it too). The caller has
    checked that they fit. Scores are computed in the task that holds the packed row.
    """
    spark = long.sparkSession
    by_fold = "held" in prototypes.columns and "held" in long.columns
    keys = [*row, *(["held"] if by_fold and "held" not in row else [])]
    if by_fold:
        rows = prototypes.select("held", "cls", "marker", "c").collect()  # at most MATRIX_NUMBERS numbers
    else:
        rows = prototypes.select(F.lit("").alias("held"), "cls", "marker", "c").collect()
    known = Prototypes(rows)
    packed, shipped, kind = pack(long, keys, value, known.markers), spark.sparkContext.broadcast(known), prototypes.schema["cls"].dataType
    scores = T.StructField("scores", T.ArrayType(T.StructType([T.StructField("cls", kind), T.StructField("score", T.DoubleType())])))
    schema, told_type = T.StructType([*[packed.schema[k] for k in keys], scores]), to_arrow_type(scores.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for b in batches:
            x = dense(b.column("vec"), len(known.markers))
            told: list = [[] for _ in x]
            for (fold,), at in (parted([b.column("held")]) if by_fold else [(("",), np.arange(len(x)))]) if len(x) else ():
                names, c = known.folds.get(fold, ([], None))
                if names:
                    for i, s in zip(at.tolist(), MEASURES[measure](x[at], c).tolist()):
                        told[i] = [{"cls": k, "score": v} for k, v in zip(names, s) if v == v]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(told, told_type)], names=[*keys, "scores"])

    return packed.mapInArrow(run, schema)


def best_of(scored: DataFrame, row: Sequence[str], highest: bool = True, digits: int = 9) -> DataFrame:
    """row, y_pred, score: the best class of each row's scores, ties to the lowest class; no shuffle."""
    s = F.array_max(F.transform("scores", lambda p: F.struct(
        (F.round(p["score"], digits) * (1 if highest else -1)).alias("s"), (-p["cls"]).alias("k"), p["cls"].alias("cls"), p["score"].alias("score"))))
    return scored.where(F.size("scores") > 0).withColumn("_b", s).select(*row, F.col("_b.cls").alias("y_pred"), F.col("_b.score").alias("score"))


# ------------------------------------------------------------------ co-moments
def co_moments(packed: DataFrame, group: Sequence[str], vocabulary: Sequence[str], centre: float = 0.0) -> DataFrame:
    """group, m1, m2 (m1 < m2) and n, s1, s2, s11, s22, s12: rows that measure both, sums of their values less
    `centre`, of the squares and of the products. A task sends one row a group and pair."""
    group, names = list(group), list(vocabulary)
    types = [packed.schema[g] for g in group]
    out = T.StructType([*types, T.StructField("m1", T.StringType()), T.StructField("m2", T.StringType()),
                        *[T.StructField(m, T.DoubleType()) for m in MOMENTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = dense(b.column("vec"), len(names)) - centre
            for name, at in parted([b.column(g) for g in group]) if len(x) else ():
                there = ~np.isnan(x[at])
                v, m = np.where(there, x[at], 0.0), there.astype(float)
                new = np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])
                sums[name] = sums[name] + new if name in sums else new
        rows = [(*name, names[i], names[j], *s[:, i, j].tolist()) for name, s in sums.items()
                for i, j in zip(*np.nonzero(s[0])) if names[i] < names[j]]
        schema = to_arrow_schema(out)
        columns = zip(*rows) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)

    parts = packed.select(*group, "vec").mapInArrow(run, out)
    return parts.groupBy(*group, "m1", "m2").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def correlation_of(moments: DataFrame, keys: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """keys, m1, m2, r: Pearson correlation from co-moments; NULL where a side's variance is below `floor`."""
    n = F.col("n")
    v1, v2 = n * F.col("s11") - F.col("s1") * F.col("s1"), n * F.col("s22") - F.col("s2") * F.col("s2")
    cov = n * F.col("s12") - F.col("s1") * F.col("s2")
    return moments.select(*keys, "m1", "m2", F.when((v1 > floor * n * n) & (v2 > floor * n * n), cov / F.sqrt(v1) / F.sqrt(v2)).alias("r"))
