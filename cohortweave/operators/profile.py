"""Value profiles: ECDF tables, dynamic range, label signatures, co-expression, composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import mid_rank, safe_div, share
from cohortweave.operators import packed
from cohortweave.operators.distribution import (
    chunk_offsets, median, quantile_from_counts, quantiles, running_counts,
)
from cohortweave.operators.tables import to_long
from cohortweave.session import checked, dealt, materialise, materialise_counted, sided

# --- fixed values --------------------------------------------------------------------
QUANTILE_LEVELS = (0.02, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98)
Q10, Q50, Q90 = 2, 4, 6
POSITIVE_CUTS = (0.50, 0.75, 0.90)
MIN_CELLS = 100
CHUNK_ROWS = 125_000  # distinct values of a range chunk
IMAGE_ROWS = 100_000  # rows of an image that one task may hold whole
UNIFORM_VARIANCE = 1.0 / 12.0
RANK_SPREAD_FLOOR = 0.20
SCALE_FLOOR = 0.05
MIN_INFORMATIVE = 0.10  # smaller between-label range of a marker says nothing about its labels
MIN_SPREAD = 1e-6
LINEAGE_FLOOR = 0.01
MIN_SIDE = 20
RANK_CENTRE = 0.5  # middle of the rank scale: sums are kept around it
NULL_LABELS = ("", "nan", "none", "null", "na")
# -------------------------------------------------------------------------------------


def label_runs(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, sizes) of the labels from one pass over the cells.

    runs: cohort, native_label, marker, u, n_at, n_upto, n_group, where u is the cohort mid-rank
    ECDF and the counts run inside the label. A label's values have the same order by value and by
    u, so one range partitioning on (cohort, marker, value) serves both prefix sums.
    sizes: cohort, native_label, n_cells (the best-covered marker, missing values included).
    """
    counts, n = materialise_counted(long.groupBy("cohort", "native_label", "marker", "value").agg(F.count(F.lit(1)).alias("c")))
    chunks = materialise(dealt(counts, n, "cohort", "marker", "value", most=CHUNK_ROWS, ranges=True).withColumn("_chunk", F.spark_partition_id()))
    sizes = chunks.groupBy("cohort", "native_label", "marker").agg(F.sum("c").alias("k")).groupBy(
        "cohort", "native_label").agg(F.max("k").alias("n_cells"))
    real = chunks.where(F.col("value").isNotNull())
    m, lab = ["cohort", "marker"], ["cohort", "marker", "native_label"]
    m_off = checked(chunk_offsets(real, m, {"c": ("_mo", "_mn")}))
    l_off = checked(chunk_offsets(real, lab, {"c": ("_lo", "n_group")}))
    real = dealt(real, n, "_chunk", most=2 * CHUNK_ROWS)  # every window below stays inside a chunk
    inside = Window.partitionBy(*m, "_chunk")
    upto = F.sum("c").over(inside.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.sum("c").over(Window.partitionBy(*m, "_chunk", "value"))
    own = F.sum("c").over(Window.partitionBy(*m, "_chunk", "native_label").orderBy("value")
                          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (real.withColumn("_mu", upto).withColumn("_at", at).withColumn("_lu", own)
            .join(m_off, [*m, "_chunk"]).join(l_off, [*lab, "_chunk"]))
    u = mid_rank(F.col("_mu") + F.col("_mo"), "_at") / F.col("_mn")
    return runs.select(*lab, u.alias("u"), F.col("c").alias("n_at"),
                       (F.col("_lu") + F.col("_lo")).alias("n_upto"), "n_group"), sizes


def label_filter(cells: DataFrame, bad_labels: DataFrame | None = None,
                 min_cells: int = MIN_CELLS) -> DataFrame:
    """One row per (cohort, native_label): cells, kept, reason. bad_labels: cohort, native_label, category."""
    n = cells.groupBy("cohort", F.trim("native_label").alias("native_label")).agg(
        F.count(F.lit(1)).alias("cells"))
    if bad_labels is not None:
        n = n.join(bad_labels.select("cohort", "native_label", "category"), ["cohort", "native_label"], "left")
    else:
        n = n.withColumn("category", F.lit(None).cast("string"))
    reason = (F.when(F.col("category").isNotNull(), F.concat(F.lit("label QC: "), F.col("category")))
              .when(F.lower("native_label").isin(*NULL_LABELS), "unlabelled")
              .when(F.col("cells") < min_cells, F.lit(f"below {min_cells} cells")).otherwise("kept"))
    return n.select("cohort", "native_label", "cells", (reason == "kept").alias("kept"), reason.alias("reason"))


def signatures(long: DataFrame, min_cells: int = MIN_CELLS,
               bad_labels: DataFrame | None = None) -> DataFrame:
    """Per (cohort, label, marker): nine quantiles of u, mean rank, positive fractions, prevalence, n.

    Ranks use every cell of the cohort; labels below min_cells or on the QC list are left out.
    """
    run, sizes = label_runs(long.withColumn("native_label", F.trim("native_label")))
    total = Window.partitionBy("cohort")
    sizes = sizes.withColumn("prev", F.col("n_cells") / F.sum("n_cells").over(total))
    good = sizes.where((F.col("n_cells") >= min_cells) & ~F.lower("native_label").isin(*NULL_LABELS))
    if bad_labels is not None:
        good = good.join(bad_labels.select("cohort", "native_label"), ["cohort", "native_label"], "left_anti")
    keys = ["cohort", "native_label", "marker"]
    n = F.max("n_group").cast("double")
    extra = [safe_div(F.sum(F.col("u") * F.col("n_at")), n).alias("mean_rank")]
    extra += [safe_div(F.coalesce(F.sum(F.when(F.col("u") > c, F.col("n_at"))), F.lit(0)), n).alias(f"_p{i}")
              for i, c in enumerate(POSITIVE_CUTS)]
    q = quantile_from_counts(run, keys, "u", QUANTILE_LEVELS, "q", extra)
    pos = F.array(*[F.col(f"_p{i}") for i in range(len(POSITIVE_CUTS))])
    return q.join(good, ["cohort", "native_label"]).select(
        "cohort", F.col("native_label").alias("label"), "marker", "q", "mean_rank",
        pos.alias("pos"), "prev", "n_cells")


def informativeness(sig: DataFrame) -> DataFrame:
    """Between-label range of the mean rank per (cohort, marker)."""
    return sig.groupBy("cohort", "marker").agg((F.max("mean_rank") - F.min("mean_rank")).alias("label_range"))


def rescale(sig: DataFrame, centre: str = "midrange", robust: bool = False) -> DataFrame:
    """Positions on the between-label scale of each (cohort, marker).

    p = (mean rank - centre) / max(spread, floor), z = the same map on the quantiles, w = spread.
    centre: midrange | median; robust uses the 90-10 percentile spread.
    """
    g = sig.groupBy("cohort", "marker").agg(
        F.max("mean_rank").alias("hi"), F.min("mean_rank").alias("lo"),
        F.expr("percentile(mean_rank, 0.5)").alias("med"),  # one value per label of a cohort
        F.expr("percentile(mean_rank, array(0.1, 0.9))").alias("tails"))
    ctr = (F.col("hi") + F.col("lo")) / 2.0 if centre == "midrange" else F.col("med")
    spread = (F.col("tails")[1] - F.col("tails")[0]) if robust else (F.col("hi") - F.col("lo"))
    g = g.select("cohort", "marker", ctr.alias("_ctr"), spread.alias("w"),
                 F.greatest(spread, F.lit(SCALE_FLOOR)).alias("_sc"))
    return (sig.join(g, ["cohort", "marker"])
            .withColumn("p", (F.col("mean_rank") - F.col("_ctr")) / F.col("_sc"))
            .withColumn("z", F.transform("q", lambda x: (x - F.col("_ctr")) / F.col("_sc")))
            .drop("_ctr", "_sc"))


def top_marker(rescaled: DataFrame) -> DataFrame:
    """The marker on which each label stands highest in its cohort (ties: smallest name)."""
    best = F.min_by(F.struct("marker", "p", "mean_rank", "w"), F.struct(-F.col("p"), F.col("marker")))
    return (rescaled.groupBy("cohort", "label").agg(best.alias("b"), F.max("n_cells").alias("n_cells"))
            .select("cohort", "label", "n_cells", "b.*"))


def lineage_score(sig: DataFrame, cut: int = 2) -> DataFrame:
    """How cleanly a marker gates: mean over cohorts of (max - median positive fraction), floored."""
    p = F.col("pos")[cut]
    per = sig.groupBy("cohort", "marker").agg(
        (F.max(p) - F.percentile(p, F.lit(0.5))).alias("gap"))
    return per.groupBy("marker").agg(F.greatest(F.avg("gap"), F.lit(LINEAGE_FLOOR)).alias("lineage"))


def dynamic_range(long: DataFrame) -> DataFrame:
    """Per (cohort, marker): tie mass incl. missing, IQR/(p99-p01), ECDF variance, spread, distinct."""
    keys = ["cohort", "marker"]
    run = running_counts(long, keys, "value")
    u = (F.col("n_upto") - (F.col("n_at") - 1.0) / 2.0) / F.col("n_group")
    n = F.col("n_group").cast("double")
    q = quantile_from_counts(run, keys, "value", (0.01, 0.25, 0.75, 0.99), "q", [
        F.max("n_at").alias("mode"), F.count(F.lit(1)).alias("d"),
        F.sum(F.col("n_at") * u * u).alias("s2"), F.sum(F.col("n_at") * u).alias("s1"),
        F.max(n).alias("m")])
    total = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("present"))
    missing = F.col("cells") - F.col("present")
    var = safe_div(F.col("s2") - F.col("s1") * F.col("s1") / F.col("m"), F.col("m") - 1.0)
    den = F.col("q")[3] - F.col("q")[0]
    return q.join(total, keys).select(
        *keys,
        (F.greatest("mode", missing) / F.col("cells")).alias("tie_mass"),
        F.when(den > 1e-12, (F.col("q")[2] - F.col("q")[1]) / den).otherwise(0.0).alias("robust_dispersion"),
        var.alias("var_ucoh"), (var / UNIFORM_VARIANCE).alias("rank_spread"),
        (F.col("d") + F.when(missing > 0, 1).otherwise(0)).cast("long").alias("distinct_values"), "cells")


def exclusion_sweep(ranges: DataFrame, thresholds: Sequence[float], column: str = "rank_spread",
                    below: bool = True) -> DataFrame:
    """(cohort, marker) pairs each threshold removes, per cohort."""
    hit = F.col(column) < F.col("threshold") if below else F.col(column) >= F.col("threshold")
    return (ranges.withColumn("threshold", F.explode(F.lit([float(t) for t in thresholds])))
            .groupBy("threshold", "cohort").agg(F.count_if(hit).alias("excluded"), F.count(F.lit(1)).alias("pairs")))


def excluded_pairs(ranges: DataFrame, floor: float = RANK_SPREAD_FLOOR) -> DataFrame:
    return ranges.where(F.col("rank_spread") < floor).select("cohort", "marker")


def image_statistics(wide_u: DataFrame, markers: Sequence[str], image_rows: int = IMAGE_ROWS) -> DataFrame:
    """Median and IQR of u per (image, marker), standardised over the images of a cohort; NULL -> 0.

    wide_u: cohort, image_id and a column of u a marker. Images up to `image_rows` rows are aggregated whole, after
    one shuffle of the wide rows; larger ones by prefix sums.
    """
    image, markers, levels = ["cohort", "image_id"], list(markers), (0.25, 0.5, 0.75)
    rows = materialise(wide_u.select(*image, *markers))
    large, n_large = materialise_counted(rows.groupBy(*image).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > image_rows).select(*image))
    large = sided(large, n_large)
    small = rows.join(large, image, "left_anti") if n_large else rows

    def level(v, p: float):
        at = (F.size(v) - 1) * F.lit(p)
        lo, hi = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return lo + (hi - lo) * (at - F.floor(at))

    g = small.groupBy(*image).agg(F.collect_list(F.struct(*markers)).alias("_l"))
    each = [F.struct(F.lit(m).alias("marker"), F.array_sort(F.array_compact(F.col(f"_l.{m}"))).alias("v")) for m in markers]
    q = g.select(*image, F.explode(F.array(*each)).alias("_e")).where(F.size("_e.v") > 0).select(
        *image, "_e.marker", F.array(*[level(F.col("_e.v"), p) for p in levels]).alias("q"))
    if n_large:
        long = to_long(rows.join(large, image, "left_semi"), image, markers)
        q = q.unionByName(quantiles(long, [*image, "marker"], "value", levels, "q").drop("n"))
    keys = ["cohort", "image_id", "marker"]
    s = materialise(q.select(*keys, F.col("q")[1].alias("med"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")))
    stats = s.groupBy("cohort", "marker").agg(
        F.avg("med").alias("mm"), F.stddev_samp("med").alias("ms"),
        F.avg("iqr").alias("im"), F.stddev_samp("iqr").alias("is"))

    def std(x: str, m: str, sd: str):
        d = F.when(F.coalesce(F.col(sd), F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(F.col(sd))
        return F.coalesce((F.col(x) - F.col(m)) / d, F.lit(0.0))

    return s.join(stats, ["cohort", "marker"]).select(
        *keys, std("med", "mm", "ms").alias("med_z"), std("iqr", "im", "is").alias("iqr_z"))


def coexpression(long_u: DataFrame, cell: Sequence[str], vocabulary: Sequence[str]) -> DataFrame:
    """Within-label Pearson r of every marker pair m1 < m2 over the cells that measure both: cohort, label, m1, m2, r.

    Cells are packed once; a task sends one sum a label and pair. r is NULL where a marker has no spread.
    """
    keys = list(dict.fromkeys([*cell, "cohort", "native_label"]))
    return coexpression_packed(packed.pack(long_u, keys, "u", vocabulary), vocabulary)


def coexpression_wide(wide_u: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The same where a row is a cell with a column of u a marker: nothing is packed, no row travels."""
    return coexpression_packed(wide_u.withColumn("vec", F.array(*vocabulary).cast("array<double>")), vocabulary)


def coexpression_packed(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    moments = packed.co_moments(rows, ["cohort", "native_label"], vocabulary, RANK_CENTRE)
    return packed.correlation_of(moments, ["cohort", "native_label"]).withColumnRenamed("native_label", "label")


def coexpression_agreement(coex: DataFrame, weights: DataFrame, min_weight: float = MIN_INFORMATIVE,
                           min_markers: int = 3) -> DataFrame:
    """Correlation of two labels' marker-pair r: (cohort_a, a, cohort_b, b, coex_r, n_pairs).

    Only markers informative for both labels (weights: cohort, label, marker, w; w at least `min_weight`)
    take part. Pairs of labels with fewer than `min_markers` such markers or finite pairs, or with no
    spread on a side, are left out.
    """
    told = weights.where(F.col("w") >= min_weight).select("cohort", "label", "marker").distinct()
    c = coex.where(F.col("r").isNotNull() & ~F.isnan("r"))
    for m in ("m1", "m2"):
        c = c.join(told.withColumnRenamed("marker", m), ["cohort", "label", m])
    own = told.select(F.col("cohort").alias("cohort_a"), F.col("label").alias("a"), "marker")
    other = told.select(F.col("cohort").alias("cohort_b"), F.col("label").alias("b"), "marker")
    pair = ["cohort_a", "a", "cohort_b", "b"]
    enough = (own.join(other, "marker").where("struct(cohort_a, a) < struct(cohort_b, b)").groupBy(*pair)
              .agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= min_markers).select(*pair))
    a = c.select(F.col("cohort").alias("cohort_a"), F.col("label").alias("a"), "m1", "m2", F.col("r").alias("ra"))
    b = c.select(F.col("cohort").alias("cohort_b"), F.col("label").alias("b"), "m1", "m2", F.col("r").alias("rb"))
    scored = (a.join(b, ["m1", "m2"]).where("struct(cohort_a, a) < struct(cohort_b, b)").groupBy(*pair)
              .agg(F.corr("ra", "rb").alias("coex_r"), F.count(F.lit(1)).alias("n_pairs"),
                   F.stddev_pop("ra").alias("_sa"), F.stddev_pop("rb").alias("_sb"))
              .where((F.col("n_pairs") >= 3) & (F.col("_sa") > MIN_SPREAD) & (F.col("_sb") > MIN_SPREAD)))
    return scored.join(enough, pair, "left_semi").drop("_sa", "_sb")


def composition(cells: DataFrame) -> DataFrame:
    """Per image: rows, label entropy, dominant label, and skewed / balanced flags in its cohort.

    The 10 % of images with the lowest entropy (at least one) are skewed, the upper half balanced.
    """
    n = cells.groupBy("cohort", "image_id", "native_label").agg(F.count(F.lit(1)).alias("c"))
    per_image = n.groupBy("cohort", "image_id").agg(
        F.sum("c").alias("cells"), F.max_by("native_label", F.struct("c", "native_label")).alias("dominant"))
    p = F.col("c") / F.col("cells")
    ent = (n.join(per_image, ["cohort", "image_id"]).groupBy("cohort", "image_id", "cells", "dominant")
           .agg((-F.sum(p * F.log(p + 1e-12))).alias("entropy")))
    # order images by (entropy, id) without one task per cohort; 12 decimals make ties stable
    ent = ent.withColumn("_o", F.struct(F.round("entropy", 9).alias("e"), F.col("image_id").alias("i")))
    pos = running_counts(ent, ["cohort"], "_o")
    j = ent.join(pos, ["cohort", "_o"])
    rank0 = F.col("n_upto") - 1
    return j.select(
        "cohort", "image_id", "cells", "dominant", "entropy",
        (rank0 < F.greatest(F.lit(1), F.floor(F.col("n_group") / 10))).alias("skewed"),
        (rank0 >= F.floor(F.col("n_group") / 2)).alias("balanced"))


def skew_contrast(long: DataFrame, comp: DataFrame, expected: DataFrame, value: str = "u",
                  min_rows: int = MIN_SIDE) -> DataFrame:
    """Per skewed image: median value of its dominant label there minus on balanced images.

    expected: cohort, native_label, marker. Both sides need min_rows rows.
    """
    d = long.join(expected, ["cohort", "native_label", "marker"]).join(
        comp.select("cohort", "image_id", "dominant", "skewed", "balanced"), ["cohort", "image_id"])
    here = d.where("skewed AND native_label = dominant")
    a = median(here, ["cohort", "image_id", "native_label", "marker"], value, "med_a").withColumnRenamed("n", "n_a")
    b = median(d.where("balanced"), ["cohort", "native_label", "marker"], value, "med_b").withColumnRenamed("n", "n_b")
    return (a.join(b, ["cohort", "native_label", "marker"])
            .where((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows))
            .select("cohort", "image_id", "native_label", "marker", "n_a", "n_b",
                    (F.col("med_a") - F.col("med_b")).alias("delta")))


def lineage_of_class(long_u: DataFrame, lineages: DataFrame, label: str, min_rows: int = 10,
                     floor: float = 0.55) -> DataFrame:
    """Lineage of each class: the lineage marker with the highest mean, 'unassigned' at or below
    the floor. lineages: lineage, marker."""
    m = long_u.join(lineages, "marker").groupBy("cohort", label, "lineage").agg(
        F.avg("u").alias("m"), F.count("u").alias("n")).where(F.col("n") >= min_rows)
    return m.groupBy("cohort", label).agg(
        F.max_by("lineage", F.struct("m", "lineage")).alias("_l"), F.max("m").alias("top_mean")
    ).select("cohort", label, F.when(F.col("top_mean") > floor, F.col("_l")).otherwise("unassigned").alias("lineage"),
             "top_mean")


def coarse_accuracy(preds: DataFrame, lineage: DataFrame) -> DataFrame:
    """Fine accuracy and accuracy at lineage level per held cohort. lineage: held, cls, lineage."""
    t = lineage.select("held", F.col("cls").alias("y_true"), F.col("lineage").alias("lt"))
    p = lineage.select("held", F.col("cls").alias("y_pred"), F.col("lineage").alias("lp"))
    j = preds.join(t, ["held", "y_true"], "left").join(p, ["held", "y_pred"], "left")
    return j.groupBy("held").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("y_true") == F.col("y_pred")).alias("fine_acc"),
        share(F.coalesce(F.col("lt") == F.col("lp"), F.lit(False))).alias("coarse_acc"))


def cohort_audit(cells: DataFrame, registry: DataFrame, x: str, y: str) -> DataFrame:
    """Cells, images, labels, median cells per image, mean image extent in microns, missing shares."""
    per_image = cells.groupBy("cohort", "image_id").agg(
        F.count(F.lit(1)).alias("cells"), (F.max(x) - F.min(x)).alias("ex"), (F.max(y) - F.min(y)).alias("ey"),
        F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("no_xy"))
    med = median(per_image, ["cohort"], "cells", "median_cells_per_image")
    labels = cells.select("cohort", "native_label").distinct().groupBy("cohort").agg(F.count(F.lit(1)).alias("labels"))
    g = per_image.groupBy("cohort").agg(
        F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("images"), F.avg("ex").alias("ex"),
        F.avg("ey").alias("ey"), F.sum("no_xy").alias("no_xy"))
    return (g.join(med.select("cohort", "median_cells_per_image"), "cohort").join(labels, "cohort")
            .join(registry.select("cohort", "px_um"), "cohort").select(
                "cohort", "cells", "images", "labels", "median_cells_per_image",
                (F.col("ex") * F.col("px_um")).alias("extent_um_x"), (F.col("ey") * F.col("px_um")).alias("extent_um_y"),
                (100.0 * F.col("no_xy") / F.col("cells")).alias("pct_xy_missing")))


def label_frequency(cells: DataFrame) -> DataFrame:
    """Rows and percentage of each label in its cohort."""
    n = cells.groupBy("cohort", "native_label").agg(F.count(F.lit(1)).alias("cells"))
    return n.withColumn("share_pct", 100.0 * F.col("cells") / F.sum("cells").over(Window.partitionBy("cohort")))


def representative_image(cells: DataFrame) -> DataFrame:
    """The median-sized image of each cohort: position n div 2 by (size, id)."""
    n = cells.groupBy("cohort", "image_id").agg(F.count(F.lit(1)).alias("cells"))
    n = n.withColumn("_o", F.struct("cells", "image_id"))
    pos = running_counts(n, ["cohort"], "_o").where(F.col("n_upto") - 1 == F.floor(F.col("n_group") / 2))
    return pos.select("cohort", F.col("_o.image_id").alias("image_id"), F.col("_o.cells").alias("cells"))
