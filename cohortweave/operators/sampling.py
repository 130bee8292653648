"""Reproducible sampling: md5 orders replace random streams, and no draw sorts the rows it leaves out.

The lowest keys of a group are found by radix selection: a histogram of key prefixes gives the prefix that holds the
cut, and only the rows under that prefix are ranked. The draw itself is a filter against one cut a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import order_key
from cohortweave.operators.distribution import row_order, running_counts
from cohortweave.session import by_shuffle, checked, materialise, materialise_counted, sided

PREFIX = 4     # hex digits of the longest prefix: at most 65,536 bins a group
BIN_ROWS = 16  # a group's prefix is as long as gives bins of at most about this many rows
CHUNK = 10_000  # draws with replacement that one row unfolds to
FIRSTS = 16    # lowest rows of a group, in multiples of n, in which n strata are looked for


def lowest_cut(keyed: DataFrame, caps: DataFrame) -> DataFrame:
    """_g, _cut: the key of the `_cap`-th lowest row of every group in `caps`.

    keyed: stored _g (any type, null groups count), _k (hex text). caps: _g, _n (rows of the group), _cap (1 to _n).
    """
    size = F.ceil(F.log(F.col("_n") / BIN_ROWS) / F.log(F.lit(16.0)))
    caps = checked(caps.select("_g", "_cap", F.least(F.greatest(size, F.lit(0)), F.lit(PREFIX)).cast("int").alias("_d")))
    prefix = F.substr("_k", F.lit(1), F.col("_d"))
    bins = keyed.join(caps, "_g").groupBy("_g", prefix.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.first("_cap").alias("_cap"), F.first("_d").alias("_d"))
    before = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 bins
    bins = bins.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    edge = bins.where((F.col("_before") < F.col("_cap")) & (F.col("_before") + F.col("_c") >= F.col("_cap")))
    edge = checked(edge.select("_g", "_bin", "_d", (F.col("_cap") - F.col("_before")).alias("_need")))
    near = keyed.join(edge, "_g").where(prefix == F.col("_bin")).select("_g", "_k")
    ranked = running_counts(near, ["_g"], "_k").join(edge, "_g").where(F.col("n_upto") >= F.col("_need"))
    return ranked.groupBy("_g").agg(F.min("_k").alias("_cut"))


def tagged(df: DataFrame, keys: Sequence[str], purpose: str, row_id: str) -> DataFrame:
    return df.withColumn("_g", F.struct(*keys)).withColumn("_k", order_key(purpose, row_id))


def first_turn(d: DataFrame, n: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of groups still to be drawn, and the draws of the others, all of turn 0; None where there are none.

    d: stored rows with _o (group), _g (stratum), _k (hex text). The rows of a group under one key hold the lowest row
    of each stratum they meet; if they meet n strata, the n lowest of these are the whole draw. The key is set so that
    about FIRSTS * n rows lie under it, and the strata are counted.
    """
    sizes, n_groups = materialise_counted(d.groupBy("_o").agg(F.count(F.lit(1)).alias("_n")))
    share = F.lit(FIRSTS * n + 100.0) / F.col("_n")
    under = F.when(share < 1, F.lower(F.lpad(F.hex(F.floor(share * 2.0**32).cast("long")), 8, "0"))).otherwise("g")
    bounds, n_bounds = materialise_counted(sizes.where(F.col("_n") >= n).select("_o", under.alias("_under")))
    if not n_bounds:
        return d, None
    low = materialise(d.join(sided(bounds, n_bounds), "_o").where(F.col("_k") < F.col("_under")).drop("_under"))
    lowest = materialise(low.groupBy("_o", "_g").agg(F.min("_k").alias("_k")))
    met, n_met = materialise_counted(lowest.groupBy("_o").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n))
    if not n_met:
        return d, None
    cuts = lowest_cut(lowest.select(F.col("_o").alias("_g"), "_k"),
                      met.select(F.col("_o").alias("_g"), "_n", F.lit(n).cast("long").alias("_cap")))
    ends = checked(cuts.select(F.col("_g").alias("_o"), F.col("_cut").alias("_last")))
    taken = checked(lowest.join(ends, "_o").where(F.col("_k") <= F.col("_last")).select("_g", "_k"))
    first = low.join(taken, ["_g", "_k"]).dropDuplicates(["_g"]).withColumn("turn", F.lit(0).cast("long"))
    return (None if n_met == n_groups else d.join(sided(met.select("_o"), n_met), "_o", "left_anti")), first


def round_robin(df: DataFrame, group: Sequence[str], stratum: Sequence[str], row_id: str, n: int,
                purpose: str = "sample") -> DataFrame:
    """n rows per group taken in turns over its strata, so rare strata are kept whole; adds the 0-based `turn`.

    Stratum sizes alone tell how many full turns fit into n and how many strata give one row more; that row is
    the next lowest of its stratum, and the strata that give it are those with the lowest such keys. The rows are
    stored once; groups of n strata or more end in their first turn, mostly among a few lowest rows.
    """
    if n < 1:
        return df.limit(0).withColumn("turn", F.lit(0).cast("long"))
    d = tagged(materialise(df), [*group, *stratum], purpose, row_id).withColumn("_o", F.struct(*group))
    d, first = first_turn(d, n)
    if d is None:
        return first.select(*df.columns, "turn")
    keyed = d.select("_g", "_k", "_o")
    sizes = materialise(keyed.groupBy("_o", "_g").agg(F.count(F.lit(1)).alias("_n")))
    by_size = sizes.groupBy("_o", F.col("_n").alias("_s")).agg(F.count(F.lit(1)).alias("_m"))
    up = Window.partitionBy("_o").orderBy("_s")  # distinct stratum sizes of a group
    smaller = F.coalesce(F.sum(F.col("_s") * F.col("_m")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_m").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = by_size.select("_o", "_s", smaller.alias("_b"), left.alias("_l")).where(F.col("_b") + F.col("_s") * F.col("_l") > n)
    level = level.groupBy("_o").agg(F.min(F.struct("_s", "_b", "_l")).alias("_x")).select(
        "_o", F.floor((n - F.col("_x._b")) / F.col("_x._l")).alias("_turns"), F.col("_x._b").alias("_b"), F.col("_x._l").alias("_l"))
    level = checked(level.select("_o", "_turns", (n - F.col("_b") - F.col("_turns") * F.col("_l")).alias("_rest")))
    longer = sizes.join(level, "_o").where(F.col("_n") > F.col("_turns"))
    cuts = materialise(lowest_cut(keyed, longer.select("_g", "_n", (F.col("_turns") + 1).alias("_cap"))).join(longer, "_g").select("_g", "_o", "_cut", "_rest"))
    # the strata that give one row more: lowest keys first
    more = cuts.where("_rest > 0").join(cuts.groupBy("_o").agg(F.count(F.lit(1)).alias("_n")), "_o")
    last = lowest_cut(materialise(cuts.select(F.col("_o").alias("_g"), F.col("_cut").alias("_k"))),
                      more.groupBy(F.col("_o").alias("_g")).agg(F.first("_n").alias("_n"), F.first("_rest").alias("_cap")))
    ends = checked(cuts.join(last.select(F.col("_g").alias("_o"), F.col("_cut").alias("_last")), "_o", "left")
                   .select("_g", "_cut", (F.col("_cut") <= F.col("_last")).alias("_one")))
    kept = d.drop("_o").join(ends, "_g", "left").where(F.col("_cut").isNull() | (F.col("_k") < F.col("_cut")) | ((F.col("_k") == F.col("_cut")) & F.col("_one")))
    turns = row_order(kept, ["_g"], "_k", "turn").select(*df.columns, "turn")
    return turns if first is None else turns.unionByName(first.select(*df.columns, "turn"))


def uniform(df: DataFrame, group: Sequence[str], row_id: str, cap: int,
            purpose: str = "draw") -> DataFrame:
    """At most cap rows per group, without replacement."""
    if cap < 1:
        return df.limit(0)
    d = tagged(df, group, purpose, row_id)
    keyed = materialise(d.select("_g", "_k"))
    sizes = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    cuts = checked(lowest_cut(keyed, sizes.withColumn("_cap", F.lit(cap).cast("long"))))
    return d.join(cuts, "_g", "left").where(F.col("_cut").isNull() | (F.col("_k") <= F.col("_cut"))).select(*df.columns)


def class_balanced(df: DataFrame, group: Sequence[str], label: str, row_id: str,
                   purpose: str = "bal") -> DataFrame:
    """The same quota per class of a group: rows(group) / classes(group), at least 1.

    A class shorter than the quota is drawn with replacement (draw i takes a hashed position);
    longer classes give their first `quota` rows. Returns the rows with a `draw` number.
    """
    keys = [*group, label]
    d = tagged(df, keys, purpose, row_id)
    keyed = materialise(d.select("_g", "_k"))
    sizes = materialise(keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.struct(*[F.col(f"_g.{c}") for c in group])))
    totals = sizes.groupBy("_o").agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_c"))
    quota = F.greatest(F.lit(1), F.floor(F.col("_t") / F.col("_c"))).cast("long")
    plan = materialise(sizes.join(totals, "_o").select("_g", "_n", quota.alias("_q")))
    cuts = lowest_cut(keyed, plan.where("_n > _q").select("_g", "_n", F.col("_q").alias("_cap")))
    ends = checked(plan.join(cuts, "_g", "left").select("_g", "_n", "_q", "_cut"))
    taken = d.join(ends, "_g").where(F.col("_cut").isNull() | (F.col("_k") <= F.col("_cut")))
    placed = materialise(row_order(taken, ["_g"], "_k", "draw"))
    # short classes: one row per draw, in chunks that spread before they unfold
    short = plan.where("_n < _q")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_q") - 1) / CHUNK)))
    draws = short.withColumn("_part", parts).repartition("_g", "_part").withColumn("draw", F.explode(F.sequence(
        F.col("_part") * CHUNK, F.least((F.col("_part") + 1) * CHUNK, F.col("_q")) - 1)))
    pick = F.pmod(F.conv(F.substring(order_key(purpose, *[F.col(f"_g.{c}") for c in keys], "draw"), 1, 15), 16, 10).cast("long"), F.col("_n"))
    again = draws.select("_g", "draw", pick.alias("_pos")).join(
        by_shuffle(placed.where("_n < _q").drop("_cut", "_n", "_q").withColumnRenamed("draw", "_pos")), ["_g", "_pos"])
    cols = [*df.columns, "draw"]
    return placed.where("_n >= _q").select(*cols).unionByName(again.select(*cols))


def mask_markers(long: DataFrame, cell: Sequence[str], marker: str, fraction: float = 0.15,
                 purpose: str = "mask") -> DataFrame:
    """Hide a hashed fraction of each cell's eligible markers, at least one.

    A cell holds one vocabulary of markers, so the per-cell window is bounded.
    """
    w = Window.partitionBy(*cell)
    k = F.row_number().over(w.orderBy(order_key(purpose, *cell, marker), marker))
    n = F.count(F.lit(1)).over(w)
    return long.withColumn("hidden", k <= F.greatest(F.lit(1), F.bround(F.lit(fraction) * n, 0).cast("int")))


def derangement(df: DataFrame, group: Sequence[str], row_id: str, purpose: str = "shuffle") -> DataFrame:
    """Within-group cyclic shift by a hashed non-zero offset: group, row_id, donor.

    Every row of a group with two or more rows gets another row's id; singletons keep their own.
    """
    pos = running_counts(df.select(*group, row_id), group, row_id).select(
        *group, row_id, (F.col("n_upto") - 1).cast("long").alias("_i"), F.col("n_group").alias("_n"))
    h = F.conv(F.substring(order_key(purpose, *group), 1, 15), 16, 10).cast("long")
    shift = F.when(F.col("_n") >= 2, F.lit(1) + F.pmod(h, F.greatest(F.col("_n") - 1, F.lit(1)))).otherwise(F.lit(0))
    want = pos.withColumn("_j", F.pmod(F.col("_i") + shift, F.col("_n")))
    donors = pos.select(*group, F.col("_i").alias("_j"), F.col(row_id).alias("donor"))
    return want.join(by_shuffle(donors), [*group, "_j"]).select(*group, row_id, "donor")


def moved_fraction(shuffled: DataFrame, group: Sequence[str], row_id: str) -> DataFrame:
    return shuffled.groupBy(*group).agg(
        F.avg(F.when(F.col(row_id) != F.col("donor"), 1.0).otherwise(0.0)).alias("moved"),
        F.count(F.lit(1)).alias("n"))
