"""Standard-table operators: reshape, duplicate columns, vocabulary, panels, confidence, z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import clean, safe_div, share
from cohortweave.operators.distribution import running_counts
from cohortweave.operators.joins import constant_rows
from cohortweave.session import checked


def to_long(wide: DataFrame, ids: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """One row per (cell, marker); NaN and infinities become NULL. The rows stay in their tasks and partitioning."""
    each = [F.struct(F.lit(m).alias("marker"), clean(m).alias("value")) for m in markers]
    return wide.select(*ids, F.explode(F.array(*each)).alias("_e")).select(*ids, "_e.marker", "_e.value")


def to_wide(long: DataFrame, ids: Sequence[str], markers: Sequence[str], value: str = "value",
            prefix: str = "") -> DataFrame:
    """Back to one column per marker of a known vocabulary."""
    p = long.groupBy(*ids).pivot("marker", list(markers)).agg(F.first(value))
    return p.select(*ids, *[F.col(f"`{m}`").alias(prefix + m) for m in markers])


def mean_of_duplicates(long: DataFrame, registry: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Average the columns of one cohort that resolve to the same triple; missing ones are skipped."""
    m = registry.where("triple <> ''").select("cohort", F.col("raw_column").alias("marker"), "triple")
    return long.join(checked(m), ["cohort", "marker"]).groupBy(*ids, "triple").agg(F.avg("value").alias("value"))


def duplicate_columns(registry: DataFrame) -> DataFrame:
    """Triples carried by more than one raw column of a cohort."""
    return (registry.where("triple <> ''").groupBy("cohort", "triple")
            .agg(F.array_join(F.array_sort(F.collect_set("raw_column")), "|").alias("raw_columns"),
                 F.countDistinct("raw_column").alias("n"))
            .where("n > 1"))


def vocabulary(registry: DataFrame) -> DataFrame:
    """Frozen marker vocabulary: sorted distinct triple -> dense index, gene, cohort count.

    Vocabulary-sized (hundreds of rows), so one ordering window is fine.
    """
    v = (registry.where("triple <> '' AND kind <> 'non_protein'").groupBy("triple")
         .agg(F.min("gene").alias("gene"), F.countDistinct("cohort").alias("n_cohorts")))
    w = Window.partitionBy(F.lit(0)).orderBy("triple")
    return v.select("triple", (F.row_number().over(w) - 1).alias("idx"), "gene", "n_cohorts")


def panel(registry: DataFrame) -> DataFrame:
    """Which cohort measures which triple."""
    return registry.where("triple <> '' AND kind <> 'non_protein'").select("cohort", "triple").distinct()


def shared_panel(panel_df: DataFrame, key: str = "marker", cohorts: Sequence[str] | None = None) -> DataFrame:
    """Markers measured by every cohort (of a list, or of the panel)."""
    p = panel_df if cohorts is None else panel_df.where(F.col("cohort").isin(list(cohorts)))
    n_all = p.agg(F.countDistinct("cohort").alias("n_all"))
    per = p.groupBy(key).agg(F.countDistinct("cohort").alias("n_cohorts"))
    return per.join(n_all, per.n_cohorts == n_all.n_all).select(key, "n_cohorts")


def training_panels(panel_df: DataFrame, folds: DataFrame, key: str = "marker") -> DataFrame:
    """Per fold: markers shared by all its training cohorts, and whether the held cohort has them.

    folds has one row per (fold, held) cohort held out. Returns fold, marker, in_held.
    """
    cohorts = panel_df.select("cohort").distinct()
    held = folds.select("fold", F.col("held").alias("cohort"))
    names = folds.select("fold").distinct()
    # every (fold, marker, cohort) measurement, flagged held or training
    base = panel_df.select(key, "cohort").distinct()
    expanded = base.withColumn("fold", F.explode(F.array_distinct(
        F.lit([r[0] for r in names.collect()]))))  # folds are one row per dataset
    flagged = expanded.join(held.withColumn("_h", F.lit(True)), ["fold", "cohort"], "left")
    n_train = (cohorts.withColumn("fold", F.explode(F.lit([r[0] for r in names.collect()])))
               .join(held, ["fold", "cohort"], "left_anti").groupBy("fold")
               .agg(F.count(F.lit(1)).alias("n_train")))
    per = flagged.groupBy("fold", key).agg(
        F.count_if(F.col("_h").isNull()).alias("k"),
        F.coalesce(F.bool_or("_h"), F.lit(False)).alias("in_held"))
    return per.join(n_train, "fold").where("k = n_train").select("fold", key, "in_held")


def panel_vectors(long: DataFrame, vocab: DataFrame, ids: Sequence[str], value: str = "value",
                  fill: float | None = None) -> DataFrame:
    """Arrays over the vocabulary: u (NULL where unmeasured) and present.

    With `fill`, unmeasured slots hold that constant instead (the zero-fill contrast arm), but
    `present` still tells them apart. One row buffers one cell's markers, i.e. a vocabulary.
    """
    slots = vocab.agg(F.array_sort(F.collect_list("idx")).alias("_slots"))
    cell = (long.join(vocab.select("marker", "idx"), "marker").where(F.col(value).isNotNull())
            .select(*ids, "idx", value).repartition(*ids).groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("idx", value))).alias("_m")))
    n = slots.select(F.size("_slots")).first()[0]
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    absent = F.lit(fill).cast("double")
    return cell.select(
        *ids,
        F.transform(idx, lambda i: F.coalesce(F.try_element_at("_m", i), absent)).alias("u"),
        F.transform(idx, lambda i: F.map_contains_key("_m", i)).alias("present"))


def sanitise_confidence(df: DataFrame, column: str) -> DataFrame:
    """Numeric or 1, clipped to [0, 1]; only cohorts where it takes more than one value are kept."""
    v = F.expr(f"try_cast(`{column}` as double)")
    v = F.least(F.greatest(F.coalesce(F.when(~F.isnan(v), v), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    d = df.withColumn("conf", v)
    informative = d.groupBy("cohort").agg(F.min("conf").alias("lo"), F.max("conf").alias("hi")).where("lo < hi")
    return d.join(informative.select("cohort"), "cohort", "left_semi")


def confidence_summary(df: DataFrame, column: str) -> DataFrame:
    """Per cohort: rows, distinct values, range, informative."""
    v = F.expr(f"try_cast(`{column}` as double)")
    v = F.least(F.greatest(F.coalesce(F.when(~F.isnan(v), v), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("_c", v).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("_c").alias("distinct_values"),
        F.min("_c").alias("lo"), F.max("_c").alias("hi"),
    ).withColumn("informative", F.col("distinct_values") > 1)


def non_finite_audit(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows kept and dropped per group when every listed column must be finite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & clean(c).isNotNull()
    return df.groupBy(*keys).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def finite_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.where(clean(c).isNotNull())
    return df


# fixed values: id endings that mean "no patient recorded"
MISSING_PATIENT = r"\|(nan|unknown|<NA>|-1)$"


def missing_token_share(df: DataFrame, keys: Sequence[str], column: str,
                        pattern: str = MISSING_PATIENT) -> DataFrame:
    return df.groupBy(*keys).agg(share(F.col(column).rlike(pattern)).alias("missing_share"))


def zscore_by_train(long: DataFrame, keys: Sequence[str], value: str, is_train: str,
                    out: str = "z", floor: float = 1e-6) -> DataFrame:
    """Standardise by the training rows only; statistics are vocabulary-sized."""
    stats = long.where(F.col(is_train)).groupBy(*keys).agg(
        F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return (long.join(stats, list(keys))
            .withColumn(out, safe_div(F.col(value) - F.col("_mu"), F.greatest("_sd", F.lit(floor))))
            .drop("_mu", "_sd"))


def log_clip(c):
    """log1p of the value clipped at zero."""
    return F.log1p(F.greatest(c, F.lit(0.0)))


def dense_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Distinct values -> 0..n-1 in sorted order, joined back; rows without a value are left out.

    Values are numbered by prefix sums over range chunks, so no task holds the whole dictionary."""
    numbered = running_counts(df.select(column).distinct(), [], column)
    return df.join(numbered.select(column, (F.col("n_upto") - 1).cast("int").alias(out)), column)


def scale_coordinates(cells: DataFrame, registry: DataFrame, x: str = "x_px", y: str = "y_px",
                      factors: dict[str, float] | None = None) -> DataFrame:
    """Pixels to microns by the cohort's pixel size, with an optional what-if factor per cohort."""
    f = F.lit(1.0)
    for c, v in (factors or {}).items():
        f = F.when(F.col("cohort") == c, F.lit(float(v))).otherwise(f)
    return (cells.join(registry.select("cohort", "px_um"), "cohort")
            .withColumn("x_um", F.col(x) * F.col("px_um") * f)
            .withColumn("y_um", F.col(y) * F.col("px_um") * f).drop("px_um"))


def panel_pairs(panel_df: DataFrame, key: str = "marker") -> DataFrame:
    """Ordered cohort pairs with panel sizes, shared count and Jaccard (0 when nothing is shared)."""
    from cohortweave.operators.joins import roster_pairs
    sizes = panel_df.groupBy("cohort").agg(F.countDistinct(key).alias("n"))
    p = panel_df.select("cohort", key).distinct()
    shared = (p.select(key, F.col("cohort").alias("a")).join(p.select(key, F.col("cohort").alias("b")), key)
              .where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    return (roster_pairs(panel_df, "cohort", ordered=True)
            .join(shared, ["a", "b"], "left")
            .join(sizes.select(F.col("cohort").alias("a"), F.col("n").alias("n_a")), "a")
            .join(sizes.select(F.col("cohort").alias("b"), F.col("n").alias("n_b")), "b")
            .withColumn("shared", F.coalesce("shared", F.lit(0)))
            .withColumn("jaccard", safe_div("shared", F.col("n_a") + F.col("n_b") - F.col("shared"))))


def pair_covariates(panel_df: DataFrame, registry: DataFrame, classes: DataFrame,
                    key: str = "marker") -> DataFrame:
    """Source x target table: panel overlap, same tissue/platform, share of target classes covered."""
    base = panel_pairs(panel_df, key)
    c = classes.select("cohort", "label").distinct()
    n_cls = c.groupBy("cohort").agg(F.count(F.lit(1)).alias("k"))
    both = (c.select("label", F.col("cohort").alias("a")).join(c.select("label", F.col("cohort").alias("b")), "label")
            .where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")))
    ra = registry.select(F.col("cohort").alias("a"), F.col("tissue").alias("ta"), F.col("platform").alias("pa"))
    rb = registry.select(F.col("cohort").alias("b"), F.col("tissue").alias("tb"), F.col("platform").alias("pb"))
    return (base.join(ra, "a").join(rb, "b").join(both, ["a", "b"], "left")
            .join(n_cls.select(F.col("cohort").alias("a"), F.col("k").alias("src_classes")), "a")
            .join(n_cls.select(F.col("cohort").alias("b"), F.col("k").alias("tgt_classes")), "b")
            .select(F.col("a").alias("source"), F.col("b").alias("target"), "shared", "jaccard",
                    F.col("n_a").alias("n_src"), F.col("n_b").alias("n_tgt"),
                    F.expr("ta = tb").alias("same_tissue"), F.expr("pa = pb").alias("same_platform"),
                    "src_classes", "tgt_classes",
                    safe_div(F.coalesce("common", F.lit(0)), F.col("tgt_classes")).alias("class_cover")))


def newest_subset_artifact(catalog: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per fold: of the artifacts whose training set is inside the fold's allowed set, the one
    trained on most members (ties: greatest name). A fold with no qualifier is reported as NULL.

    catalog: artifact, seen ARRAY; allowed: fold, train ARRAY.
    """
    used = catalog.select("artifact", F.explode("seen").alias("m"), F.size("seen").alias("n"))
    ok = allowed.select("fold", F.explode("train").alias("m"))
    inside = (used.join(ok, "m").groupBy("fold", "artifact", "n").agg(F.count(F.lit(1)).alias("k"))
              .where("k = n"))
    best = inside.groupBy("fold").agg(F.max_by("artifact", F.struct("n", "artifact")).alias("artifact"),
                                      F.max("n").alias("n_seen"))
    return allowed.select("fold").join(best, "fold", "left")


__all__ = [n for n in dir() if not n.startswith("_") and n != "constant_rows"]
