"""Partition agreement: contingency tables, adjusted Rand, mutual information, fold stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.numeric import safe_div, share

OVERLAPS = 10_000  # terms of the expected mutual information that one row unfolds to

def contingency(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, a, b, n: (weighted) co-occurrence of two labelings."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight).cast("double")
    return df.groupBy(*keys, a, b).agg(n.alias("n"))


def _pairs(x: Column) -> Column:
    return x * (x - 1.0) / 2.0


def merge_by_key(keys: Sequence[str], *tables: DataFrame) -> DataFrame:
    """One-row-per-key tables side by side: union and one aggregate, no join (keys may be empty)."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    return u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in u.columns if c not in keys])


def _marginals(table: DataFrame, a: str, b: str, keys: Sequence[str], stat) -> DataFrame:
    """keys, tot and the summed statistic of cells, row totals and column totals."""
    keys = list(keys)
    cells = table.groupBy(*keys).agg(F.sum("n").alias("tot"), F.sum(stat(F.col("n"))).alias("s_cells"))

    def side(c: str, out: str) -> DataFrame:
        m = table.groupBy(*keys, c).agg(F.sum("n").alias("n"))
        return m.groupBy(*keys).agg(F.sum(stat(F.col("n"))).alias(out))

    return merge_by_key(keys, cells, side(a, "s_rows"), side(b, "s_cols"))


def ari(table: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index per key group from a contingency table; 0 where undefined."""
    m = _marginals(table, a, b, keys, _pairs)
    exp = safe_div(F.col("s_rows") * F.col("s_cols"), _pairs(F.col("tot")))
    mx = (F.col("s_rows") + F.col("s_cols")) / 2.0
    val = F.when(mx > exp, (F.col("s_cells") - exp) / (mx - exp)).otherwise(0.0)
    return m.select(*keys, F.col("tot").alias("n"), val.alias("ari"))


def entropies(table: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mutual information and both entropies (nats) per key group, from sums of n log n."""
    m = _marginals(table.where("n > 0"), a, b, keys, lambda n: n * F.log(n))
    tot = F.col("tot").cast("double")
    mi = (F.col("s_cells") - F.col("s_rows") - F.col("s_cols")) / tot + F.log(tot)
    return m.select(*keys, F.col("tot").alias("n"), mi.alias("mi"),
                    (F.log(tot) - F.col("s_rows") / tot).alias("hx"), (F.log(tot) - F.col("s_cols") / tot).alias("hy"))


def nmi(table: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Normalised mutual information, arithmetic mean of the entropies."""
    e = entropies(table, a, b, keys)
    return e.select(*keys, "n", (2.0 * F.col("mi") / F.greatest(F.col("hx") + F.col("hy"), F.lit(1e-12))).alias("nmi"))


def v_measure(table: DataFrame, truth: str, cluster: str, keys: Sequence[str] = ()) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean."""
    e = entropies(table, truth, cluster, keys)
    hom = F.when(F.col("hx") > 0, F.col("mi") / F.col("hx")).otherwise(1.0)
    com = F.when(F.col("hy") > 0, F.col("mi") / F.col("hy")).otherwise(1.0)
    return e.select(*keys, hom.alias("homogeneity"), com.alias("completeness"),
                    F.coalesce(safe_div(2.0 * hom * com, hom + com), F.lit(0.0)).alias("v_measure"))


def adjusted_mutual_information(table: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """AMI (arithmetic mean). Expected MI sums over marginal pairs and overlap counts, whose
    hypergeometric weights come from log-factorials accumulated by lgamma-free partial sums.

    Marginals are grouped by equal sizes and joined by key. The overlaps of a pair of sizes unfold in chunks of
    OVERLAPS, spread before they unfold, so a class of any number of rows is many bounded tasks.
    """
    keys = list(keys)
    t = table.where("n > 0").withColumn("n", F.round("n").cast("long")).withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    sizes = [t.groupBy("_key", c).agg(F.sum("n").alias(s)).groupBy("_key", s).agg(F.count(F.lit(1)).alias(m))
             for c, s, m in ((a, "ai", "ka"), (b, "bj", "kb"))]
    total = t.groupBy("_key").agg(F.sum("n").alias("N"))
    lo = F.greatest(F.lit(1).cast("long"), F.col("ai") + F.col("bj") - F.col("N"))
    pairs = sizes[0].join(sizes[1], "_key").join(total, "_key").withColumn("_lo", lo).withColumn("_hi", F.least("ai", "bj"))
    parts = pairs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / OVERLAPS))))
    start = F.col("_lo") + F.col("_part") * OVERLAPS
    terms = parts.repartition("_key", "ai", "bj", "_part").withColumn("k", F.explode(F.sequence(start, F.least(start + (OVERLAPS - 1), F.col("_hi")))))

    def lf(x: Column) -> Column:
        """log x! by Stirling's series (exact table below 10)."""
        z = x.cast("double")
        s = (z * F.log(F.greatest(z, F.lit(1.0))) - z + 0.5 * F.log(2.0 * F.lit(3.141592653589793) * F.greatest(z, F.lit(1.0)))
             + 1.0 / (12.0 * F.greatest(z, F.lit(1.0))) - 1.0 / (360.0 * F.pow(F.greatest(z, F.lit(1.0)), 3))
             + 1.0 / (1260.0 * F.pow(F.greatest(z, F.lit(1.0)), 5)))
        return F.when(x <= 20, F.log(F.factorial(F.least(F.greatest(x, F.lit(0)), F.lit(20)).cast("int")).cast("double"))).otherwise(s)

    A, B, N, K = F.col("ai"), F.col("bj"), F.col("N"), F.col("k")
    logw = (lf(A) + lf(B) + lf(N - A) + lf(N - B) - lf(N) - lf(K) - lf(A - K) - lf(B - K) - lf(N - A - B + K))
    term = (K / N) * F.log(N * K / (A * B)) * F.exp(logw) * F.col("ka") * F.col("kb")
    expected = terms.groupBy("_key").agg(F.sum(term).alias("emi")).select(*[F.col(f"_key.{k}").alias(k) for k in keys], "emi")
    e = merge_by_key(keys, entropies(table, a, b, keys), expected)
    den = (F.col("hx") + F.col("hy")) / 2.0 - F.col("emi")
    return e.select(*keys, "emi", F.coalesce(safe_div(F.col("mi") - F.col("emi"), den), F.lit(1.0)).alias("ami"))


def cohort_guards(label_map: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How much a label partition is the cohort partition, per key group.

    clusters, singletons, biggest, biggest_share, cohort_ari, cross_cohort_share (of cells).
    label_map: keys, cohort, label, cluster, n_cells.
    """
    keys = list(keys)
    per = label_map.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("labels"), F.countDistinct("cohort").alias("coh"), F.sum("n_cells").alias("cells"))
    s = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("labels") == 1).alias("singletons"),
        F.max("labels").alias("biggest"), (F.max("labels") / F.sum("labels")).alias("biggest_share"),
        (F.sum(F.when(F.col("coh") >= 2, F.col("cells")).otherwise(0)) / F.sum("cells")).alias("cross_cohort_share"))
    r = ari(contingency(label_map, "cluster", "cohort", keys), "cluster", "cohort", keys)
    return merge_by_key(keys, s, r.select(*keys, F.col("ari").alias("cohort_ari")))


def fold_pair_ari(maps: DataFrame, min_labels: int = 10) -> DataFrame:
    """ARI between every pair of fold partitions on labels trained in both.

    maps: fold, held, cohort, label, cluster. Returns a, b, n_labels, ari.
    """
    m = maps.where("cluster >= 0")
    x = m.select(F.col("fold").alias("a"), F.col("held").alias("ha"), "cohort", "label", F.col("cluster").alias("ca"))
    y = m.select(F.col("fold").alias("b"), F.col("held").alias("hb"), "cohort", "label", F.col("cluster").alias("cb"))
    j = x.join(y, ["cohort", "label"]).where("a < b AND cohort <> ha AND cohort <> hb")
    r = ari(contingency(j, "ca", "cb", ["a", "b"]), "ca", "cb", ["a", "b"])
    return r.where(F.col("n") >= min_labels).select("a", "b", F.col("n").cast("long").alias("n_labels"), "ari")


def merge_votes(maps: DataFrame, min_folds: int = 5) -> DataFrame:
    """Per label pair: folds that scored it, the share that merged it, consistency, unanimity."""
    m = maps.where("cluster >= 0 AND cohort <> held").select(
        "fold", F.concat_ws("|", "cohort", "label").alias("k"), "cluster")
    n_folds = maps.groupBy("cohort", "label").agg(F.countDistinct("fold").alias("nf"))
    every = n_folds.join(maps.agg(F.countDistinct("fold").alias("nf")), "nf").select(
        F.concat_ws("|", "cohort", "label").alias("k"))
    m = m.join(every, "k", "left_semi")
    a = m.select("fold", F.col("k").alias("x"), F.col("cluster").alias("cx"))
    b = m.select("fold", F.col("k").alias("y"), F.col("cluster").alias("cy"))
    same = share(F.col("cx") == F.col("cy"))
    v = a.join(b, "fold").where("x < y").groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("folds"), same.alias("merged_rate")).where(F.col("folds") >= min_folds)
    return (v.withColumn("consistency", F.greatest(F.col("merged_rate"), 1.0 - F.col("merged_rate")))
            .withColumn("unanimous", F.col("merged_rate").isin(0.0, 1.0)))


def merge_histogram(votes: DataFrame) -> DataFrame:
    """Pairs per merged-rate bin: [0,.01) [.01,.5) [.5,.99) [.99,1]."""
    b = (F.when(F.col("merged_rate") < 0.01, "never").when(F.col("merged_rate") < 0.5, "minority")
         .when(F.col("merged_rate") < 0.99, "majority").otherwise("always"))
    return votes.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))
