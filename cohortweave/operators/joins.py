"""Checked joins: cardinality and referential rules are part of the operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.session import sided


class RuleViolation(ValueError):
    """A declared data rule does not hold."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys carried by more than one row."""
    return df.groupBy(*keys).count().where("count > 1")


def assert_empty(df: DataFrame, message: str) -> None:
    """Raise with the first offending row; reads at most one row."""
    bad = df.take(1)
    if bad:
        raise RuleViolation(f"{message}: {bad[0]}")


def left_join_one(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                  right_on: Sequence[str] | None = None) -> DataFrame:
    """n:1 left join; a repeated right key is an error, so the row count cannot change."""
    left_on, right_on = list(left_on), list(right_on or left_on)
    assert_empty(duplicate_keys(right, right_on), f"join on {left_on} would duplicate rows")
    rows = right.count()
    if left_on == right_on:
        return left.join(sided(right, rows), left_on, "left")
    tmp = {r: f"_r_{i}" for i, r in enumerate(right_on)}
    for old, new in tmp.items():
        right = right.withColumnRenamed(old, new)
    cond = [left[a] == right[tmp[b]] for a, b in zip(left_on, right_on)]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return left.join(sided(right, rows), on, "left").drop(*tmp.values())


def unmatched_audit(joined: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows per key group whose joined columns are all NULL."""
    every = F.lit(True)
    for c in cols:
        every = every & F.col(c).isNull()
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                     F.count_if(every).alias("unmatched"))


def lookup_checked(df: DataFrame, dim: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Inner lookup that raises when any row has no match."""
    assert_empty(df.join(dim, list(keys), "left_anti").select(*keys), f"{what}: unknown key")
    return df.join(dim, list(keys))


def map_labels(cells: DataFrame, label_map: DataFrame) -> DataFrame:
    """Attach the shared class of (cohort, label); unmapped and NOVEL (-1) rows are dropped.

    The map is small, so AQE broadcasts it from its measured size.
    """
    m = label_map.where("cluster >= 0").select(
        "cohort", F.col("label").alias("native_label"), "cluster")
    return cells.join(m, ["cohort", "native_label"])


def default_filled(df: DataFrame, dim: DataFrame, keys: Sequence[str], column: str,
                   default: float) -> DataFrame:
    """Left join one column and fill what is missing with a default."""
    return (df.join(dim.select(*keys, column), list(keys), "left")
            .withColumn(column, F.coalesce(F.col(column), F.lit(default))))


def roster_pairs(df: DataFrame, unit: str, ordered: bool = False) -> DataFrame:
    """All pairs (a, b) of a roster-sized column: a < b, or a <> b when ordered.

    The distinct roster is gathered per row by a window over the roster itself.
    """
    roster = df.select(unit).distinct()
    others = F.collect_list(unit).over(Window.partitionBy(F.lit(0)))
    listed = roster.select(F.col(unit).alias("a"), others.alias("_others"))
    pairs = listed.select("a", F.explode("_others").alias("b"))
    return pairs.where("a <> b" if ordered else "a < b")


def constant_rows(values: Sequence) -> Column:
    """explode() of driver-side constants, used instead of a cross join with a tiny table."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                 suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Join two result tables on keys; shared value columns get suffixes."""
    keys = list(keys)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    for c in shared:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, keys, how)
