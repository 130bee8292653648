"""Exact ranks, quantiles and distribution distances that never put one group in one task.

Everything here is built on `running_counts`: distinct values are pre-aggregated with their
multiplicity, range-partitioned on (group, value), stored once, and prefix-summed in two levels
(inside a range chunk, and over the few chunk totals of a group). A group holding a third of all
rows is therefore spread over many chunks, and heavy ties collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import clean, mid_rank, safe_div
from cohortweave.session import checked, materialise, materialise_counted, sided

# A value carried by at least this many rows of its group gets its own salt when ranks are joined
# back to rows; rows / HOT_ROWS bounds how many such values can exist.
HOT_ROWS = 2_000_000
HOT_SENT = 100_000       # hot values up to this many are broadcast
GROUP_ROWS = 100_000     # rows of a group that one task may hold whole
MISSING_SALTS = 1 << 20  # rows without a value are dealt out over so many keys


def chunked_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Stored table of distinct values with multiplicity n_at, range-partitioned on (keys, value);
    `_chunk` is the range partition, so chunks of a group are ordered and balanced."""
    keys = list(keys)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n_at"))
    return materialise(
        counts.repartitionByRange(*keys, value).withColumn("_chunk", F.spark_partition_id()))


def prefix_sums(chunks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n_at, n_upto (inclusive running count), n_group from chunked counts."""
    keys = list(keys)
    offsets = chunk_offsets(chunks, keys, {"n_at": ("_off", "n_group")})
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = chunks.withColumn("_run", F.sum("n_at").over(inside))
    return local.join(offsets, [*keys, "_chunk"]).select(
        *keys, value, "n_at", (F.col("_run") + F.col("_off")).alias("n_upto"), "n_group")


def chunk_offsets(chunks: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Per (keys, _chunk): for each count column its total in earlier chunks and in the group.

    At most chunks + groups rows per key set.
    """
    keys = list(keys)
    totals = chunks.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for c, (off, total) in columns.items():
        out += [F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(off), F.sum(f"_t_{c}").over(group).alias(total)]
    return totals.select(*keys, "_chunk", *out)


def running_counts(df: DataFrame, keys: Sequence[str], value: str,
                   weight: str | None = None) -> DataFrame:
    """keys, value, n_at (rows at the value), n_upto (inclusive running count), n_group.

    NULL values are left out. `weight` is an optional multiplicity column.
    """
    return prefix_sums(chunked_counts(df, keys, value, weight), keys, value)


def midrank_table(df: DataFrame, keys: Sequence[str], value: str, out: str = "u",
                  weight: str | None = None) -> DataFrame:
    """Mid-rank ECDF of every distinct value: average rank of its ties / non-null count."""
    return running_counts(df, keys, value, weight).withColumn(
        out, mid_rank("n_upto", "n_at") / F.col("n_group"))


def attach_by_value(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str,
                    row_id: Sequence[str], counts: DataFrame, hot_rows: int = HOT_ROWS, sent: int = HOT_SENT) -> DataFrame:
    """Left-join a per-value table back to rows in one pass, salting values that are hot.

    The table is broadcast if it counts at most `sent` values, and shuffled beyond.

    counts: stored keys, value, n_at. There are at most rows / hot_rows hot values; without any, nothing is salted.
    Rows without a value match nothing and are dealt out by a hash, so that they do not meet in one task.
    """
    on = [*keys, value]
    spread = -1 - F.pmod(F.xxhash64(*row_id), F.lit(MISSING_SALTS))
    hot = counts.where(F.col("n_at") >= hot_rows).select(*on, F.ceil(F.col("n_at") / hot_rows).cast("int").alias("_salts"))
    n_hot, n_values = counts.agg(F.count_if(F.col("n_at") >= hot_rows), F.count(F.lit(1))).first()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= HOT_SENT else hot
        rows = rows.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*row_id), F.col("_salts")), F.lit(0))).drop("_salts")
        table = (table.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
    else:
        rows, table = rows.withColumn("_salt", F.lit(0)), table.withColumn("_salt", F.lit(0))
    rows = rows.withColumn("_salt", F.when(F.col(value).isNull(), spread).otherwise(F.col("_salt")).cast("long"))
    table = sided(table.withColumn("_salt", F.col("_salt").cast("long")), n_values, sent)
    return rows.join(table, [*on, "_salt"], "left").drop("_salt")


def ecdf(rows: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[str],
         out: str = "u", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row-level mid-rank ECDF; missing values stay missing."""
    rows = rows.withColumn(value, clean(value))
    counts = chunked_counts(rows, keys, value)
    u = mid_rank("n_upto", "n_at") / F.col("n_group")
    table = prefix_sums(counts, keys, value).select(*keys, value, u.alias(out))
    return attach_by_value(rows, table, keys, value, row_id, counts, hot_rows)


def row_ecdf(rows: DataFrame, keys: Sequence[str], value: str, out: str = "u") -> DataFrame:
    """ecdf() of rows whose values seldom repeat: the rows are dealt out by range once, ranked where they lie and stored,
    so nothing is joined back by value. The rows of a group that share a value meet in one task, which spills what it
    cannot hold; where one value of one group may be a large share of all rows, ecdf() is the way.
    """
    keys, rows = list(keys), rows.withColumn(value, clean(value))
    tied = Window.partitionBy(*keys, value)  # met by the ranges: no further shuffle, no further sort
    placed = (rows.where(F.col(value).isNotNull()).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select(*rows.columns, F.max("_at").over(tied).alias("_at"), F.count(F.lit(1)).over(tied).alias("_ties"))
    stored = materialise(placed).withColumn("_chunk", F.shiftright("_at", 33))
    parts = stored.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("_at") - F.col("_ties") + 1).alias("_first"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checked(parts.select(*keys, "_chunk", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"),
                                   F.sum("_n").over(group).alias("n_group")))
    u = mid_rank(F.col("_at") + F.col("_off"), "_ties") / F.col("n_group")
    ranked = stored.join(offsets, [*keys, "_chunk"]).select(*rows.columns, u.alias(out))
    return ranked.unionByName(rows.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def column_ecdf(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], row_id: Sequence[str],
                group_rows: int = GROUP_ROWS, hot_rows: int = HOT_ROWS, sent: int = HOT_SENT) -> DataFrame:
    """keys, row_id, columns: each column as its mid-rank ECDF inside the group; missing values stay missing.

    The wide rows travel, never one row a column. Groups of at most `group_rows` rows are dealt out whole, once, and
    ranked in their task. Larger groups get their ranks from value tables: those of columns with few distinct values
    are broadcast (`sent` values in all), each other column costs one shuffle of the wide rows.
    """
    keys, columns = list(keys), list(columns)
    kept = list(dict.fromkeys([*keys, *row_id]))
    rows, n_rows = materialise_counted(wide.select(*kept, *[clean(c).alias(c) for c in columns]))
    large, n_large = materialise_counted(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows).select(*keys))
    group = Window.partitionBy(*keys)

    def rank(c: str) -> Column:
        """One sort by (keys, c) serves all windows; missing values come first and are taken off the rank."""
        at, n = F.count(c).over(Window.partitionBy(*keys, c)), F.count(c).over(group)
        upto = F.rank().over(group.orderBy(c)) - 1 - (F.count(F.lit(1)).over(group) - n) + at
        return F.when(F.col(c).isNotNull(), mid_rank(upto, at) / n).alias(c)

    def ranked(df: DataFrame) -> DataFrame:
        return df.repartition(-(-n_rows // GROUP_ROWS) or 1, *keys).select(*kept, *[rank(c) for c in columns])

    if not n_large:
        return ranked(rows)
    large = sided(large, n_large)
    small = ranked(rows.join(large, keys, "left_anti"))
    big = rows.join(large, keys, "left_semi")
    long = big.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in columns])).alias("_e")).select(*keys, "_e.*")
    counts = chunked_counts(long, [*keys, "_c"], "_v")
    u = mid_rank("n_upto", "n_at") / F.col("n_group")
    table = materialise(prefix_sums(counts, [*keys, "_c"], "_v").select(*keys, "_c", "_v", u.alias("_u")))
    distinct = {r[0]: r[1] for r in counts.groupBy("_c").agg(F.count(F.lit(1))).collect()}  # one row a column
    left = sent
    for c in sorted(columns, key=lambda c: distinct.get(c, 0)):
        own = table.where(F.col("_c") == c).select(*keys, F.col("_v").alias(c), "_u")
        left -= distinct.get(c, 0)
        if left >= 0:
            big = big.join(F.broadcast(own), [*keys, c], "left")
        else:
            at = counts.where(F.col("_c") == c).select(*keys, F.col("_v").alias(c), "n_at")
            big = attach_by_value(big, own, keys, c, row_id, at, hot_rows, sent=0)
        big = big.withColumn(c, F.col("_u")).drop("_u")
    return small.unionByName(big.select(*kept, *columns))


def row_order(df: DataFrame, keys: Sequence[str], order: str, out: str = "turn") -> DataFrame:
    """0-based position of each row inside its group by a unique order column, without a single-task window.

    The rows are dealt out by range once, sorted, and stored with their place; a position is the place in the range
    plus the group's rows in earlier ranges, so nothing is joined back by value. Rows without an order are left out.
    """
    keys = list(keys)
    placed = (df.where(F.col(order).isNotNull()).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
              .withColumn("_at", F.monotonically_increasing_id()))
    rows = materialise(placed).withColumn("_chunk", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checked(parts.select(*keys, "_chunk", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_o")))
    return (rows.join(offsets, [*keys, "_chunk"]).withColumn(out, (F.col("_o") + F.col("_at")).cast("long"))
            .select(*keys, order, *[c for c in df.columns if c not in (*keys, order)], out))


def quantile_from_counts(counts: DataFrame, keys: Sequence[str], value: str,
                         levels: Sequence[float], out: str = "q",
                         extra: Sequence[Column] = ()) -> DataFrame:
    """Linear-interpolated quantiles from a running_counts table, as one array column.

    Order statistic j is min(value) where n_upto > j, so each level is two conditional minima and
    the aggregation stays partial/final with no per-group buffer.
    """
    aggs, parts = [], []
    n1 = F.col("n_group").cast("double") - 1.0
    for i, p in enumerate(levels):
        pos = F.lit(float(p)) * n1
        aggs += [
            F.min(F.when(F.col("n_upto") > F.floor(pos), F.col(value))).alias(f"_lo{i}"),
            F.min(F.when(F.col("n_upto") > F.ceil(pos), F.col(value))).alias(f"_hi{i}"),
        ]
        frac = F.lit(float(p)) * (F.col("_n").cast("double") - 1.0)
        frac = frac - F.floor(frac)
        parts.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac)
    g = counts.groupBy(*keys).agg(F.max("n_group").alias("_n"), *aggs, *extra)
    keep = [c for c in g.columns if not c.startswith(("_lo", "_hi")) and c != "_n"]
    return g.select(*keep, F.col("_n").cast("long").alias("n"), F.array(*parts).alias(out))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float],
              out: str = "q", weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group: keys, n, q ARRAY<DOUBLE>."""
    return quantile_from_counts(running_counts(df, keys, value, weight), keys, value, levels, out)


def median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median",
           weight: str | None = None) -> DataFrame:
    """Exact interpolated median per group."""
    q = quantiles(df, keys, value, [0.5], "_q", weight)
    return q.withColumn(out, F.col("_q")[0]).drop("_q")


def ks_distance(df: DataFrame, unit: str, marker: str, value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of every unordered unit pair per marker: marker, a, b, ks.

    One row per distinct (marker, value) carries the count of every unit (datasets: a roster), so
    one chunked prefix sum serves all pairs and no row is repeated per pair.
    """
    real = df.where(F.col(value).isNotNull())
    units = sorted(r[0] for r in real.select(unit).distinct().collect())  # one row per dataset
    cols = [f"_c{i}" for i in range(len(units))]
    counts = real.groupBy(marker, value).agg(*[
        F.count(F.when(F.col(unit) == u, 1)).alias(c) for u, c in zip(units, cols)])
    chunks = materialise(counts.repartitionByRange(marker, value).withColumn("_chunk", F.spark_partition_id()))
    offsets = chunk_offsets(chunks, [marker], {c: (f"_o{c}", f"_n{c}") for c in cols})
    inside = (Window.partitionBy(marker, "_chunk").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = chunks.select(marker, "_chunk", *[F.sum(c).over(inside).alias(c) for c in cols]).join(offsets, [marker, "_chunk"])
    cdf = {u: F.try_divide((F.col(c) + F.col(f"_o{c}")).cast("double"), F.col(f"_n{c}").cast("double")) for u, c in zip(units, cols)}
    pairs = [(a, b) for i, a in enumerate(units) for b in units[i + 1:]]
    g = runs.groupBy(marker).agg(*[F.max(F.abs(cdf[a] - cdf[b])).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_p{i}").alias("ks")) for i, (a, b) in enumerate(pairs)])
    return g.select(marker, F.explode(listed).alias("_p")).select(marker, "_p.*").where("ks IS NOT NULL")


def leave_one_out_quantile(df: DataFrame, unit: str, keys: Sequence[str], value: str, level: float = 0.5,
                           out: str = "median") -> DataFrame:
    """unit, keys, out: the interpolated quantile over the rows of all other units.

    One row per distinct (keys, value) carries the count of every unit (datasets: a roster). A fold's running count is
    the total's less the unit's own, so no row is repeated per fold. Units without other rows get NULL.
    """
    keys, real = list(keys), df.where(F.col(value).isNotNull())
    units = sorted(r[0] for r in real.select(unit).distinct().collect())  # one row per dataset
    if not units:
        return real.select(unit, *keys, F.col(value).cast("double").alias(out))
    cols = [f"_c{i}" for i in range(len(units))]
    counts = real.groupBy(*keys, value).agg(*[F.count(F.when(F.col(unit) == u, 1)).alias(c) for u, c in zip(units, cols)])
    chunks = materialise(counts.repartitionByRange(*keys, value).withColumn("_chunk", F.spark_partition_id()))
    offsets = chunk_offsets(chunks, keys, {c: (f"_o{c}", f"_n{c}") for c in cols})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = chunks.select(*keys, value, "_chunk", *[F.sum(c).over(inside).alias(c) for c in cols]).join(offsets, [*keys, "_chunk"])
    upto, total = sum(F.col(c) + F.col(f"_o{c}") for c in cols), sum(F.col(f"_n{c}") for c in cols)
    aggs = []
    for i, c in enumerate(cols):
        n, below = total - F.col(f"_n{c}"), upto - F.col(c) - F.col(f"_o{c}")
        pos = F.lit(level) * (n - 1).cast("double")
        aggs += [F.min(F.when((n > 0) & (below > F.floor(pos)), F.col(value))).alias(f"_lo{i}"),
                 F.min(F.when((n > 0) & (below > F.ceil(pos)), F.col(value))).alias(f"_hi{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    g = runs.groupBy(*keys).agg(*aggs)
    each = [F.struct(F.lit(u).alias(unit), (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(out)) for i, u in enumerate(units)]
    return g.select(*keys, F.explode(F.array(*each)).alias("_u")).select(f"_u.{unit}", *keys, f"_u.{out}")


def auroc(df: DataFrame, keys: Sequence[str], label: str, value: str,
          min_side: int = 20) -> DataFrame:
    """AUROC of each label against the rest of its group by mid-rank, both sides >= min_side.

    keys, label, n_pos, n_neg, auroc.
    """
    keys = list(keys)
    counts = materialise(
        df.where(F.col(value).isNotNull()).groupBy(*keys, label, value)
        .agg(F.count(F.lit(1)).alias("c")))
    ranks = running_counts(counts, keys, value, "c").select(
        *keys, value, mid_rank("n_upto", "n_at").alias("_r"), F.col("n_group").alias("_n"))
    g = counts.join(ranks, [*keys, value]).groupBy(*keys, label).agg(
        F.sum(F.col("_r") * F.col("c")).alias("_rs"), F.sum("c").alias("n_pos"),
        F.max("_n").alias("_n"))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return (g.withColumn("n_neg", F.col("_n") - F.col("n_pos"))
            .where((F.col("n_pos") >= min_side) & (F.col("n_neg") >= min_side))
            .select(*keys, label, "n_pos", "n_neg",
                    safe_div(F.col("_rs") - n1 * (n1 + 1.0) / 2.0, n1 * n0).alias("auroc")))
