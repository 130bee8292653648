"""Declared but optional evaluations: selective prediction, calibration, intervals, controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import order_key, safe_div
from cohortweave.operators.distribution import row_order, running_counts
from cohortweave.session import by_shuffle, materialise


def step_counts(df: DataFrame, keys: Sequence[str], flag: str, score: str) -> DataFrame:
    """keys, s (minus the score), c, p (rows and flagged rows at it), n_upto, n_group, tp, np (running and
    total numbers of both), from the highest score down. Prefix sums of stored value counts, in chunks."""
    keys = list(keys)
    d = df.select(*keys, (-F.col(score)).alias("s"), F.col(flag).cast("int").alias("pos"))
    g = materialise(d.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("c"), F.sum("pos").cast("long").alias("p")))
    rows = running_counts(g, keys, "s", "c").select(*keys, "s", "n_at", "n_upto", "n_group")
    hits = running_counts(g.withColumn("p1", F.col("p")), keys, "s", "p1").select(
        *keys, "s", F.col("n_upto").alias("tp"), F.col("n_group").alias("np"))
    return rows.join(hits, [*keys, "s"]).join(g, [*keys, "s"])


def risk_coverage(preds: DataFrame, keys: Sequence[str], confidence: str) -> DataFrame:
    """keys, confidence, n, kept, coverage, accuracy and risk when only rows of at least that confidence
    are kept: one row a distinct confidence, exact. preds: keys, hit, confidence."""
    correct = F.col("tp") / F.col("n_upto")
    return step_counts(preds, keys, "hit", confidence).select(
        *keys, (-F.col("s")).alias(confidence), F.col("c").alias("n"), F.col("n_upto").alias("kept"),
        (F.col("n_upto") / F.col("n_group")).alias("coverage"), correct.alias("accuracy"), (1.0 - correct).alias("risk"))


def aurc(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the risk-coverage curve (row-weighted mean risk) and accuracy at 50 % / 80 % coverage."""
    def at(c: float):
        return F.min_by("accuracy", F.when(F.col("coverage") >= c, F.col("coverage")))
    return curve.groupBy(*keys).agg(
        (F.sum(F.col("risk") * F.col("n")) / F.sum("n")).alias("aurc"), at(0.5).alias("acc_at_50"), at(0.8).alias("acc_at_80"))


def calibration_error(preds: DataFrame, keys: Sequence[str], confidence: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    g = preds.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col("hit").cast("int")).alias("acc"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def reliability_diagram(preds: DataFrame, keys: Sequence[str], confidence: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return preds.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col("hit").cast("int")).alias("accuracy"))


def detection_scores(df: DataFrame, keys: Sequence[str], positive: str, score: str) -> DataFrame:
    """AUROC (mid-rank) and AUPRC (step-wise average precision) of a boolean target.

    Ties share one step. Works on value counts with chunked prefix sums of rows and of positives.
    """
    keys = list(keys)
    j = step_counts(df, keys, positive, score)
    mid = F.col("n_upto") - (F.col("n_at") - 1.0) / 2.0  # rank from the top
    a = j.groupBy(*keys).agg(
        F.sum(F.col("p") * mid).alias("_rs"), F.max("np").alias("n_pos"), F.max("n_group").alias("_n"),
        F.sum(F.col("p") * F.col("tp") / F.col("n_upto")).alias("_ap"))
    n1, n0 = F.col("n_pos").cast("double"), (F.col("_n") - F.col("n_pos")).cast("double")
    auc = 1.0 - safe_div(F.col("_rs") - n1 * (n1 + 1.0) / 2.0, n1 * n0)
    return a.select(*keys, "n_pos", (F.col("_n") - F.col("n_pos")).alias("n_neg"), auc.alias("auroc"), safe_div("_ap", n1).alias("auprc"))


def bootstrap_interval(deltas: DataFrame, keys: Sequence[str], unit: str, delta: str, replicates: int = 1000,
                       purpose: str = "boot") -> DataFrame:
    """95 % percentile bootstrap of a mean over fold-sized units, by hashed resampling.

    The units of one comparison are folds, so each replicate redraws from a fold-sized array.
    """
    keys = list(keys)
    g = deltas.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(unit), F.col(delta)))), lambda s: s[delta]).alias("_d"),
        F.count(F.lit(1)).cast("int").alias("n"), F.avg(delta).alias("mean"))
    r = g.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    r = r.withColumn("_i", F.explode(F.expr("sequence(1, n)")))
    h = F.conv(F.substring(order_key(purpose, *keys, "_b", "_i"), 1, 15), 16, 10).cast("long")
    m = r.withColumn("_x", F.expr("_d")[F.pmod(h, F.col("n")).cast("int")]).groupBy(*keys, "n", "mean", "_b").agg(F.avg("_x").alias("_m"))
    return m.groupBy(*keys, "n", "mean").agg(
        F.expr("percentile(_m, 0.025)").alias("lo"), F.expr("percentile(_m, 0.975)").alias("hi"))


def silhouette(df: DataFrame, features: str, cluster: str) -> float:
    """Mean squared-Euclidean silhouette (MLlib's distributed form)."""
    v = df.select(array_to_vector(F.col(features)).alias("features"), F.col(cluster).cast("int").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette").evaluate(v)


def best_reference_match(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Best Jaccard of each cluster's marker set against reference sets (ties: smallest name).

    found: cluster, marker; reference: name, marker.
    """
    f, r = found.select("cluster", "marker").distinct(), reference.select("name", "marker").distinct()
    nf = f.groupBy("cluster").agg(F.count(F.lit(1)).alias("nf"))
    nr = r.groupBy("name").agg(F.count(F.lit(1)).alias("nr"))
    both = f.join(r, "marker").groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("k")).join(nf, "cluster").join(nr, "name")
    j = both.withColumn("jaccard", safe_div("k", F.col("nf") + F.col("nr") - F.col("k")))
    best = j.groupBy("cluster").agg(F.min_by(F.struct("name", "jaccard"), F.struct(-F.round("jaccard", 12), F.col("name"))).alias("b"))
    return nf.join(best, "cluster", "left").select("cluster", F.col("b.name").alias("name"), F.coalesce("b.jaccard", F.lit(0.0)).alias("jaccard"))


def permute_labels(cells: DataFrame, row_id: str, label: str, purpose: str = "permute") -> DataFrame:
    """Negative control: labels of a cohort dealt to its rows in hashed order (counts unchanged)."""
    cells = materialise(cells)
    a = row_order(cells, ["cohort"], row_id, "_i")
    k = cells.select("cohort", F.struct(F.unhex(order_key(purpose, row_id)), F.col(row_id)).alias("_k"), F.col(label).alias("permuted"))
    b = row_order(k, ["cohort"], "_k", "_i").select("cohort", "_i", "permuted")
    return a.join(by_shuffle(b), ["cohort", "_i"]).drop("_i")


def permute_markers(long: DataFrame, marker: str = "marker", purpose: str = "permute") -> DataFrame:
    """Negative control: marker names of a cohort permuted by a hashed order; the map is panel-sized."""
    p = long.select("cohort", marker).distinct()
    w = Window.partitionBy("cohort")
    a = p.withColumn("_i", F.row_number().over(w.orderBy(marker)))
    b = p.withColumn("_i", F.row_number().over(w.orderBy(order_key(purpose, "cohort", marker)))).withColumnRenamed(marker, "_new")
    m = a.join(b, ["cohort", "_i"]).drop("_i")
    return long.join(m, ["cohort", marker]).drop(marker).withColumnRenamed("_new", marker)


def visible_fractions(long: DataFrame, cell: Sequence[str], fractions: Sequence[float], marker: str = "marker",
                      purpose: str = "visible") -> DataFrame:
    """Rows that stay visible at each fraction: the first ceil(f * n) measured markers of a hashed order."""
    w = Window.partitionBy(*cell)
    r = F.row_number().over(w.orderBy(order_key(purpose, *cell, marker), marker))
    d = long.withColumn("_r", r).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "fraction", F.explode(F.lit([float(f) for f in fractions])))
    return d.where(F.col("_r") <= F.ceil(F.col("fraction") * F.col("_n"))).drop("_r", "_n")


def generalisation_gap(loco: DataFrame, loto: DataFrame, key: str, value: str) -> DataFrame:
    """LOCO minus LOTO score per held cohort."""
    return loco.select(key, F.col(value).alias("loco")).join(loto.select(key, F.col(value).alias("loto")), key).withColumn(
        "gap", F.col("loco") - F.col("loto"))
