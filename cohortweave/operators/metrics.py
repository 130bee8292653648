"""One metric library over a predictions table.

Every score is derived from the confusion table of (keys, y_true, y_pred): the only pass over the
predictions is one map-side-combined count, and everything after it is class-sized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import half_even, order_key, safe_div
from cohortweave.session import materialise

# fixed values: support bins (lower bound inclusive, upper exclusive)
SUPPORT_BINS = (("rare (<50)", 0, 50), ("small (50-200)", 50, 200),
                ("medium (200-1000)", 200, 1000), ("large (>=1000)", 1000, None))


def confusion(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y_true, y_pred, n."""
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def scored_classes(conf: DataFrame, keys: Sequence[str], drop: DataFrame | None = None) -> DataFrame:
    """Classes present in the truth minus drop. drop: keys subset + cls."""
    c = conf.select(*keys, F.col("y_true").alias("cls")).distinct()
    return c if drop is None else c.join(drop, [x for x in drop.columns], "left_anti")


def confusion_matrix(conf: DataFrame, keys: Sequence[str], drop: DataFrame | None = None) -> DataFrame:
    """Confusion cells whose truth and prediction are both scored classes."""
    cls = scored_classes(conf, keys, drop)
    return (conf.join(cls.withColumnRenamed("cls", "y_true"), [*keys, "y_true"], "left_semi")
            .join(cls.withColumnRenamed("cls", "y_pred"), [*keys, "y_pred"], "left_semi")
            .select(*keys, "y_true", "y_pred", "n"))


def per_class(conf: DataFrame, keys: Sequence[str], drop: DataFrame | None = None) -> DataFrame:
    """Support, precision, recall, F1 per scored class; p, r, f1 also rounded half-even to 4 places.

    Rows of dropped truth classes still count against the precision of what they were called.
    """
    keys = list(keys)
    t = conf.groupBy(*keys, F.col("y_true").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = conf.groupBy(*keys, F.col("y_pred").alias("cls")).agg(F.sum("n").alias("called"))
    if drop is not None:
        t = t.join(drop, list(drop.columns), "left_anti")
    d = t.join(p, [*keys, "cls"], "left").withColumn("called", F.coalesce("called", F.lit(0)))
    zero = F.lit(0.0)
    d = (d.withColumn("precision", F.coalesce(safe_div("tp", "called"), zero))
         .withColumn("recall", F.coalesce(safe_div("tp", "support"), zero))
         .withColumn("f1", F.coalesce(safe_div(2.0 * F.col("precision") * F.col("recall"),
                                               F.col("precision") + F.col("recall")), zero)))
    return d.select(*keys, "cls", "support", "precision", "recall", "f1",
                    half_even("precision").alias("precision_r"), half_even("recall").alias("recall_r"),
                    half_even("f1").alias("f1_r"))


def macro(per_cls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro-F1 (of the rounded and of the exact per-class values), balanced accuracy, weighted F1."""
    w = F.col("support").cast("double")
    return per_cls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), F.avg("f1_r").alias("macro_f1"), F.avg("f1").alias("macro_f1_exact"),
        F.avg("recall_r").alias("balanced_accuracy"),
        safe_div(F.sum(F.col("f1_r") * w), F.sum(w)).alias("weighted_f1"))


def kappa(conf: DataFrame, keys: Sequence[str], drop: DataFrame | None = None) -> DataFrame:
    """Cohen's kappa on the scored-class matrix; NULL with < 2 classes or pe >= 1."""
    keys = list(keys)
    m = confusion_matrix(conf, keys, drop)
    k = scored_classes(conf, keys, drop).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    tot = m.groupBy(*keys).agg(F.sum("n").cast("double").alias("tot"),
                               F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("diag"))
    row = m.groupBy(*keys, F.col("y_true").alias("cls")).agg(F.sum("n").alias("r"))
    col = m.groupBy(*keys, F.col("y_pred").alias("cls")).agg(F.sum("n").alias("c"))
    pe = (row.join(col, [*keys, "cls"]).groupBy(*keys).agg(F.sum(F.col("r") * F.col("c").cast("double")).alias("rc")))
    j = k.join(tot, keys, "left").join(pe, keys, "left")
    po, e = F.col("diag") / F.col("tot"), F.coalesce("rc", F.lit(0.0)) / (F.col("tot") * F.col("tot"))
    ok = (F.col("k") >= 2) & (e < 1.0)
    return j.select(*keys, F.when(ok, (po - e) / (1.0 - e)).alias("cohen_kappa"))


def confused_pairs(conf: DataFrame, keys: Sequence[str], top_k: int = 10,
                   drop: DataFrame | None = None) -> DataFrame:
    """Top off-diagonal cells per key group (ties: smaller true, then predicted class)."""
    m = confusion_matrix(conf, keys, drop).where("y_true <> y_pred")
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "y_true", "y_pred")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def support_stratified(per_cls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classes and mean F1 per support bin; empty bins are kept with a NULL mean."""
    lo = F.lit(0)
    name = F.lit(None).cast("string")
    for label, low, high in SUPPORT_BINS:
        hit = F.col("support") >= low
        if high is not None:
            hit = hit & (F.col("support") < high)
        name = F.when(hit, F.lit(label)).otherwise(name)
    got = per_cls.groupBy(*keys, name.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_classes"), F.avg("f1_r").alias("mean_f1"))
    every = per_cls.select(*keys).distinct().withColumn("bin", F.explode(F.lit([b[0] for b in SUPPORT_BINS])))
    return (every.join(got, [*keys, "bin"], "left")
            .withColumn("n_classes", F.coalesce("n_classes", lo.cast("long"))))


def per_platform(preds: DataFrame, registry: DataFrame, keys: Sequence[str],
                 drop: DataFrame | None = None) -> DataFrame:
    """Macro-F1 and rows per platform of the cohort. Counts meet the registry, not rows: all rows of a cohort would meet in one task."""
    k = [*keys, "platform"]
    d = confusion(preds, [*keys, "cohort"]).join(registry.select("cohort", "platform"), "cohort")
    c = d.groupBy(*k, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    n = c.groupBy(*k).agg(F.sum("n").alias("n_cells"))
    return macro(per_class(c, k, drop), k).select(*k, "macro_f1").join(n, k)


def majority_class(train: DataFrame, keys: Sequence[str], label: str = "y_true") -> DataFrame:
    """Commonest training class per key group; ties go to the lowest class."""
    n = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("majority"))


def reference_predictors(test: DataFrame, majority: DataFrame, keys: Sequence[str], n_class: int,
                         purpose: str = "baseline") -> DataFrame:
    """The test rows called by the training majority and by a hashed uniform draw: adds method."""
    rnd = F.pmod(F.conv(F.substring(order_key(purpose, "cell_id"), 1, 15), 16, 10).cast("long"), F.lit(n_class))
    j = test.drop("y_pred", "method").join(majority, list(keys))
    calls = F.array(F.struct(F.lit("majority").alias("method"), F.col("majority").cast("long").alias("y_pred")),
                    F.struct(F.lit("random").alias("method"), rnd.alias("y_pred")))
    return j.withColumn("_c", F.explode(calls)).select("*", "_c.method", "_c.y_pred").drop("_c", "majority")


def score_report(preds: DataFrame, keys: Sequence[str] = ("method", "held"),
                 drop: DataFrame | None = None) -> DataFrame:
    """All scalar metrics per (method, held) from one confusion table."""
    keys = list(keys)
    c = materialise(confusion(preds, keys))  # class-sized, read by four branches
    core = macro(per_class(c, keys, drop), keys).withColumnRenamed("macro_f1", "macro_f1_reliable")
    full = macro(per_class(c, keys), keys).select(*keys, F.col("macro_f1").alias("macro_f1_all_classes"))
    return core.join(full, keys).join(kappa(c, keys, drop), keys)


def retained_information(probs: DataFrame, keys: Sequence[str], p_true: str, n_groups: str) -> DataFrame:
    """log2(N) minus the cross-entropy in bits of the probability given to the true group."""
    return probs.groupBy(*keys).agg(
        F.max(n_groups).alias("n_groups"), (-F.avg(F.log2(p_true))).alias("ce_bits")
    ).withColumn("retained_bits", F.log2("n_groups") - F.col("ce_bits"))


def vote_coverage(votes: DataFrame, row: Sequence[str], vote: str) -> DataFrame:
    """Share of sources behind the modal vote of each row (ties: lowest vote)."""
    n = votes.groupBy(*row, vote).agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy(*row).agg(
        F.max_by(vote, F.struct(F.col("c"), -F.col(vote))).alias("modal"),
        (F.max("c") / F.sum("c")).alias("coverage"))


def correlation_t(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r with its t statistic."""
    g = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")) if keys else df.agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("t", safe_div(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(1.0 - F.col("r") * F.col("r"))))


def covariate_correlations(df: DataFrame, y: str, covariates: Sequence[str]) -> DataFrame:
    """corr(y, covariate) for each covariate, as rows."""
    long = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot(
        ["_y"], list(covariates), "covariate", "_x")
    return correlation_t(long, ["covariate"], "_x", "_y")


def leave_one_out_correlation(df: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """r with each unit dropped (and with none), from sums minus the unit's own part.

    One aggregate and one roster-sized window; no unit x row product.
    """
    s = df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"))
    w = Window.partitionBy(F.lit(0))
    cols = ("n", "sx", "sy", "sxx", "syy", "sxy")
    tot = s.select(unit, *[F.sum(c).over(w).alias(f"t_{c}") for c in cols], *cols)
    one = tot.select(F.col(unit).alias("dropped"), *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in cols])
    none = s.agg(*[F.sum(c).alias(c) for c in cols]).select(F.lit("none").alias("dropped"), *cols)
    n = F.col("n").cast("double")
    num = n * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return none.unionByName(one).select("dropped", F.col("n").cast("long").alias("n"), safe_div(num, den).alias("r"))


def zero_f1_audit(per_cls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scored classes, how many sit at exactly 0 or below .10, medians of F1 and of support."""
    z = F.col("f1_r") == 0
    med = "percentile({}, 0.5)"
    return per_cls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), F.count_if(z).alias("zero"), F.count_if(F.col("f1_r") < 0.10).alias("below_10"),
        F.avg(F.when(z, 1.0).otherwise(0.0)).alias("zero_share"), F.expr(med.format("f1_r")).alias("median_f1"),
        F.expr(med.format("if(f1_r = 0, support, null)")).alias("median_support_zero"),
        F.expr(med.format("if(f1_r <> 0, support, null)")).alias("median_support_other"),
        F.avg(F.when(~z, F.col("f1_r"))).alias("mean_f1_nonzero"))


def gate(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """Declared checks against measured quantities.

    rules: check, quantity, relation (>, >=, <, <=, ==), threshold, required, waived.
    status: PASS | FAIL | WAIVED | NOT MEASURED; blocking marks required unwaived failures.
    """
    v, t, r = F.col("value"), F.col("threshold"), F.col("relation")
    ok = (F.when(r == ">", v > t).when(r == ">=", v >= t).when(r == "<", v < t).when(r == "<=", v <= t)
          .when(r == "==", v == t))
    d = rules.join(measured, "quantity", "left").withColumn("_ok", F.coalesce(ok, F.lit(False)))
    status = (F.when(v.isNull(), "NOT MEASURED").when(F.col("_ok"), "PASS")
              .when(F.col("waived") == 1, "WAIVED").otherwise("FAIL"))
    return d.select("check", "quantity", "value", "relation", "threshold", "required", "waived",
                    status.alias("status"),
                    ((F.col("required") == 1) & ~F.col("_ok") & (F.col("waived") == 0)).alias("blocking"))


def gate_verdict(gated: DataFrame) -> DataFrame:
    """PASS, SHIPPED UNDER WAIVER or FAIL."""
    req = F.col("required") == 1
    return gated.agg(
        F.count_if(req).alias("required"), F.count_if(req & (F.col("status") == "PASS")).alias("passed"),
        F.count_if(req & (F.col("status") == "WAIVED")).alias("waived"), F.count_if("blocking").alias("blocking"),
    ).withColumn("verdict", F.when(F.col("blocking") > 0, "FAIL").when(F.col("waived") > 0, "SHIPPED UNDER WAIVER")
                 .otherwise("PASS"))


def arm_table(scores: DataFrame, row: str, arm: str, arms: Sequence[str], value: str) -> DataFrame:
    """Fold x arm pivot of a score."""
    return scores.groupBy(row).pivot(arm, list(arms)).agg(F.first(value))


# ---------------------------------------------------------------- regression scores
def reconstruction_r2(rows: DataFrame, keys: Sequence[str], y: str, pred: str, base_mean: str,
                      base_median: str | None = None) -> DataFrame:
    """1 - mse / baseline mse per group, against the training mean (and median)."""
    aggs = [F.avg(F.pow(F.col(y) - F.col(pred), 2)).alias("mse"), F.avg(F.pow(F.col(y) - F.col(base_mean), 2)).alias("baseline_mse"),
            F.count(F.lit(1)).alias("cells")]
    if base_median:
        aggs.append(F.avg(F.pow(F.col(y) - F.col(base_median), 2)).alias("_dm"))
    g = rows.groupBy(*keys).agg(*aggs)
    g = g.withColumn("r2", F.when(F.col("baseline_mse") > 1e-12, 1.0 - F.col("mse") / F.col("baseline_mse")))
    if base_median:
        g = g.withColumn("r2_vs_median", F.when(F.col("_dm") > 1e-12, 1.0 - F.col("mse") / F.col("_dm"))).drop("_dm")
    return g.withColumn("split_spread", F.col("baseline_mse") * 12.0)


def split_floor(r2: DataFrame, floor: float = 0.20) -> DataFrame:
    """A pair is kept only if its denominator on the scored split clears the floor too."""
    kept = F.col("kept") if "kept" in r2.columns else F.lit(True)
    return r2.withColumn("kept_cohort_wide", kept).withColumn("kept", kept & (F.col("split_spread") >= floor))


def r2_summary(r2: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs, median, IQR, min, max of R2 per group (marker-sized groups)."""
    return r2.groupBy(*keys).agg(
        F.count("r2").alias("pairs"), F.avg("r2").alias("mean_r2"), F.expr("percentile(r2, 0.5)").alias("median_r2"),
        (F.expr("percentile(r2, 0.75)") - F.expr("percentile(r2, 0.25)")).alias("iqr_r2"),
        F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"))
