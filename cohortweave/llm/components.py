"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.session import materialise


def forest(edges: DataFrame) -> DataFrame:
    """The edges of each partition replaced by stars around the smallest node of its own components.

    Keeps components and shrinks dense parts before any shuffle; a task starts anew after a million nodes.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in parent]
            pairs = [p for p in pairs if p[0] != p[1]]
            arrow = pa.string() if kind == "string" else pa.int64()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], arrow) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select("a", "b").mapInArrow(contract, f"a {kind}, b {kind}")


def least_neighbour(pairs: DataFrame) -> DataFrame:
    """a, m: the smallest of a and its neighbours b."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edge table (a, b); the label is the component's smallest node.

    Every round is stored, which cuts the lineage. Rounds grow with the logarithm of the longest path,
    and end when a round changes nothing. Self-loops are ignored; an empty table gives no rows.
    """
    current = materialise(forest(edges.where("a <> b")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least_neighbour(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()  # a is the larger node
        small = down.join(least_neighbour(down), "a")
        star = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        current = materialise(star.where("a <> b").distinct())
        after = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    labels = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
