"""Ranks, quantiles, signatures, dynamic range, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.numeric import r6
from cohortweave.operators import distribution as D
from cohortweave.operators import profile as P
from cohortweave.operators import tables as S
from cohortweave.plans.registry import query
from cohortweave.plans.tables import (
    IDS, MARKERS, SQL_CELLS, SQL_LONG, SQL_POINTS, SQL_RANKED, SQL_SEGMENTS, SQL_VECTOR_COHORTS, SQL_VRANKED,
    cell_values, cells, points, segment_registry, vector_registry, vectors,
)
from cohortweave.session import materialise

QL = "[0.02, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98]"
SQL_SIG = SQL_RANKED + f""",
sizes AS (SELECT cohort, native_label, count(*) AS n_cells,
                 count(*) / sum(count(*)) OVER (PARTITION BY cohort) AS prev FROM cells GROUP BY 1, 2),
sig AS (
  SELECT cohort, native_label AS label, marker, quantile_cont(u, {QL}) AS q, avg(u) AS mean_rank,
         avg(CASE WHEN u > 0.5 THEN 1.0 ELSE 0 END) AS p50, avg(CASE WHEN u > 0.75 THEN 1.0 ELSE 0 END) AS p75,
         avg(CASE WHEN u > 0.9 THEN 1.0 ELSE 0 END) AS p90
  FROM ranked GROUP BY 1, 2, 3),
ranges AS (SELECT cohort, marker, max(mean_rank) AS hi, min(mean_rank) AS lo FROM sig GROUP BY 1, 2),
rescaled AS (
  SELECT s.*, hi - lo AS w, (mean_rank - (hi + lo) / 2) / greatest(hi - lo, 0.05) AS p,
         list_transform(q, lambda x: (x - (hi + lo) / 2) / greatest(hi - lo, 0.05)) AS z
  FROM sig s JOIN ranges USING (cohort, marker))"""


def li_signatures(spark, d):
    return P.signatures(cell_values(spark, d), min_cells=1)


@query("defining_marker", f"""WITH {SQL_SIG}
SELECT cohort, label, n_cells, marker, round(p, 6) + 0.0 AS p, round(mean_rank, 6) AS mean_rank, round(w, 6) AS w
FROM (SELECT *, row_number() OVER (PARTITION BY cohort, label ORDER BY round(p, 9) DESC, marker) AS rn FROM rescaled) r
JOIN (SELECT cohort, native_label AS label, CAST(n_cells AS BIGINT) AS n_cells FROM sizes) s USING (cohort, label)
WHERE rn = 1""")
def defining_marker(spark, d):
    r = P.rescale(li_signatures(spark, d)).withColumn("p", F.round("p", 9))
    return P.top_marker(r).select("cohort", "label", F.col("n_cells").cast("long").alias("n_cells"), "marker",
                                  r6("p").alias("p"), r6("mean_rank").alias("mean_rank"), r6("w").alias("w"))


@query("cohort_ecdf", f"""WITH {SQL_RANKED}
SELECT cohort, cell_id, marker, round(u, 6) AS u FROM ranked""")
def cohort_ecdf(spark, d):
    u = D.column_ecdf(cells(spark, d), ["cohort"], MARKERS, ["cell_id"])
    return S.to_long(u, ["cohort", "cell_id"], MARKERS).select("cohort", "cell_id", "marker", r6("value").alias("u"))


@query("image_ecdf", f"""WITH {SQL_LONG}
SELECT image_id, cell_id, marker,
       round((rank() OVER (PARTITION BY image_id, marker ORDER BY value)
              + (count(*) OVER (PARTITION BY image_id, marker, value) - 1) / 2.0)
             / count(value) OVER (PARTITION BY image_id, marker), 6) AS u FROM long""")
def image_ecdf(spark, d):
    u = D.column_ecdf(cells(spark, d), ["image_id"], MARKERS, ["cell_id"])
    return S.to_long(u, ["image_id", "cell_id"], MARKERS).select("image_id", "cell_id", "marker", r6("value").alias("u"))


LEVEL_NAMES = tuple(f"q{round(100 * p):02d}" for p in P.QUANTILE_LEVELS)


def sql_levels(array, prefix=""):
    return ", ".join(f"round({array}[{i + 1}], 6) + 0.0 AS {prefix}{n}" for i, n in enumerate(LEVEL_NAMES))


@query("label_signatures", f"""WITH {SQL_SIG}
SELECT cohort, label, marker, {sql_levels('q')}, round(mean_rank, 6) AS mean_rank, round(p50, 6) AS p50, round(p75, 6) AS p75,
       round(p90, 6) AS p90, round(prev, 6) AS prev, CAST(n_cells AS BIGINT) AS n_cells
FROM sig JOIN (SELECT cohort, native_label AS label, n_cells, prev FROM sizes) USING (cohort, label)""")
def label_signatures(spark, d):
    pos = F.col("pos")
    return li_signatures(spark, d).select(
        "cohort", "label", "marker", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(LEVEL_NAMES)], r6("mean_rank").alias("mean_rank"),
        r6(pos[0]).alias("p50"), r6(pos[1]).alias("p75"), r6(pos[2]).alias("p90"), r6("prev").alias("prev"), F.col("n_cells").cast("long").alias("n_cells"))


@query("between_label_range", f"""WITH {SQL_SIG}
SELECT cohort, marker, round(hi - lo, 6) AS label_range FROM ranges""")
def between_label_range(spark, d):
    return P.informativeness(li_signatures(spark, d)).select("cohort", "marker", r6("label_range").alias("label_range"))


@query("midrange_rescale", f"""WITH {SQL_SIG}
SELECT cohort, label, marker, round(p, 6) + 0.0 AS p, {sql_levels('z', 'z_')}, round(w, 6) AS w FROM rescaled""")
def midrange_rescale(spark, d):
    return P.rescale(li_signatures(spark, d)).select(
        "cohort", "label", "marker", r6("p").alias("p"), *[r6(F.col("z")[i]).alias(f"z_{n}") for i, n in enumerate(LEVEL_NAMES)], r6("w").alias("w"))


@query("robust_rescale", f"""WITH {SQL_SIG},
rob AS (SELECT cohort, marker, quantile_cont(mean_rank, 0.5) AS med,
               quantile_cont(mean_rank, 0.9) - quantile_cont(mean_rank, 0.1) AS w FROM sig GROUP BY 1, 2)
SELECT cohort, label, marker, round((mean_rank - med) / greatest(rob.w, 0.05), 6) + 0.0 AS p, round(rob.w, 6) AS w
FROM sig JOIN rob USING (cohort, marker)""")
def robust_rescale(spark, d):
    return P.rescale(li_signatures(spark, d), "median", robust=True).select(
        "cohort", "label", "marker", r6("p").alias("p"), r6("w").alias("w"))


@query("lineage_score", f"""WITH {SQL_SIG}
SELECT marker, round(greatest(avg(gap), 0.01), 6) AS lineage
FROM (SELECT cohort, marker, max(p90) - quantile_cont(p90, 0.5) AS gap FROM sig GROUP BY 1, 2) GROUP BY 1""")
def lineage_score(spark, d):
    return P.lineage_score(li_signatures(spark, d)).select("marker", r6("lineage").alias("lineage"))


SQL_DYN = SQL_RANKED + """,
modes AS (SELECT cohort, marker, max(c) AS mode, count(*) AS dv FROM
          (SELECT cohort, marker, value, count(*) AS c FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2),
dyn AS (
  SELECT cohort, marker, max(mode) / CAST(count(*) AS DOUBLE) AS tie_mass,
         CASE WHEN quantile_cont(value, 0.99) - quantile_cont(value, 0.01) > 1e-12
              THEN (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
                   / (quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) ELSE 0 END AS robust_dispersion,
         var_samp(u) AS var_ucoh, var_samp(u) * 12 AS rank_spread, max(dv) AS distinct_values, count(*) AS cells
  FROM ranked JOIN modes USING (cohort, marker) GROUP BY 1, 2)"""


@query("dynamic_range", f"""WITH {SQL_DYN}
SELECT cohort, marker, round(tie_mass, 6) AS tie_mass, round(robust_dispersion, 6) AS robust_dispersion,
       round(var_ucoh, 6) AS var_ucoh, round(rank_spread, 6) AS rank_spread,
       CAST(distinct_values AS BIGINT) AS distinct_values, CAST(cells AS BIGINT) AS cells FROM dyn""")
def dynamic_range(spark, d):
    return P.dynamic_range(cell_values(spark, d)).select(
        "cohort", "marker", *[r6(c).alias(c) for c in ("tie_mass", "robust_dispersion", "var_ucoh", "rank_spread")],
        "distinct_values", "cells")


@query("exclusion_sweep", f"""WITH {SQL_DYN}
SELECT CAST(threshold AS DOUBLE) AS threshold, cohort, count(*) FILTER (round(rank_spread, 6) < threshold) AS excluded, count(*) AS pairs
FROM dyn CROSS JOIN (VALUES (0.2), (0.5), (0.98), (0.995), (0.9999)) t(threshold) GROUP BY 1, 2""")
def exclusion_sweep(spark, d):
    r = P.dynamic_range(cell_values(spark, d)).withColumn("rank_spread", r6("rank_spread"))
    return P.exclusion_sweep(r, (0.2, 0.5, 0.98, 0.995, 0.9999))


@query("image_statistics", f"""WITH {SQL_RANKED},
s AS (SELECT cohort, image_id, marker, quantile_cont(u, 0.5) AS med,
             quantile_cont(u, 0.75) - quantile_cont(u, 0.25) AS iqr FROM ranked GROUP BY 1, 2, 3),
m AS (SELECT cohort, marker, avg(med) AS mm, stddev_samp(med) AS ms, avg(iqr) AS im, stddev_samp(iqr) AS si FROM s GROUP BY 1, 2)
SELECT cohort, image_id, marker,
       round(coalesce((med - mm) / CASE WHEN coalesce(ms, 0) = 0 THEN 1 ELSE ms END, 0), 6) + 0.0 AS med_z,
       round(coalesce((iqr - im) / CASE WHEN coalesce(si, 0) = 0 THEN 1 ELSE si END, 0), 6) + 0.0 AS iqr_z
FROM s JOIN m USING (cohort, marker)""")
def image_statistics(spark, d):
    u = D.column_ecdf(cells(spark, d), ["cohort"], MARKERS, ["image_id"])
    return P.image_statistics(u, MARKERS).select(
        "cohort", "image_id", "marker", r6("med_z").alias("med_z"), r6("iqr_z").alias("iqr_z"))


@query("ks_distance", f"""WITH {SQL_LONG},
pts AS (SELECT DISTINCT marker, value FROM long),
co AS (SELECT DISTINCT cohort FROM long),
f AS (SELECT p.marker, p.value, co.cohort, coalesce(sum(c.c) OVER (PARTITION BY p.marker, co.cohort ORDER BY p.value), 0)
             / CAST(sum(c.c) OVER (PARTITION BY p.marker, co.cohort) AS DOUBLE) AS fx
      FROM pts p CROSS JOIN co LEFT JOIN (SELECT marker, cohort, value, count(*) AS c FROM long GROUP BY 1, 2, 3) c
      ON c.marker = p.marker AND c.value = p.value AND c.cohort = co.cohort)
SELECT a.marker, a.cohort AS a, b.cohort AS b, round(max(abs(a.fx - b.fx)), 6) AS ks
FROM f a JOIN f b ON a.marker = b.marker AND a.value = b.value AND a.cohort < b.cohort GROUP BY 1, 2, 3""")
def ks_distance(spark, d):
    return D.ks_distance(cell_values(spark, d), "cohort", "marker", "value").select("marker", "a", "b", r6("ks").alias("ks"))


@query("ks_mean", f"""WITH {SQL_LONG},
pts AS (SELECT DISTINCT marker, value FROM long),
co AS (SELECT DISTINCT cohort FROM long),
f AS (SELECT p.marker, p.value, co.cohort, coalesce(sum(c.c) OVER (PARTITION BY p.marker, co.cohort ORDER BY p.value), 0)
             / CAST(sum(c.c) OVER (PARTITION BY p.marker, co.cohort) AS DOUBLE) AS fx
      FROM pts p CROSS JOIN co LEFT JOIN (SELECT marker, cohort, value, count(*) AS c FROM long GROUP BY 1, 2, 3) c
      ON c.marker = p.marker AND c.value = p.value AND c.cohort = co.cohort)
SELECT marker, round(avg(ks), 6) AS mean_ks, count(*) AS pairs FROM (
SELECT a.marker, a.cohort AS a, b.cohort AS b, max(abs(a.fx - b.fx)) AS ks
FROM f a JOIN f b ON a.marker = b.marker AND a.value = b.value AND a.cohort < b.cohort GROUP BY 1, 2, 3) GROUP BY 1""")
def ks_mean(spark, d):
    k = D.ks_distance(cell_values(spark, d), "cohort", "marker", "value")
    return k.groupBy("marker").agg(r6(F.avg("ks")).alias("mean_ks"), F.count(F.lit(1)).alias("pairs"))


@query("label_auroc", f"""WITH {SQL_LONG},
r AS (SELECT *, rank() OVER (PARTITION BY cohort, marker ORDER BY value)
             + (count(*) OVER (PARTITION BY cohort, marker, value) - 1) / 2.0 AS rk,
             count(*) OVER (PARTITION BY cohort, marker) AS n FROM long)
SELECT cohort, marker, native_label, count(*) AS n_pos, max(n) - count(*) AS n_neg,
       round((sum(rk) - count(*) * (count(*) + 1.0) / 2) / (CAST(count(*) AS DOUBLE) * (max(n) - count(*))), 6) AS auroc
FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND max(n) - count(*) >= 20""")
def label_auroc(spark, d):
    return D.auroc(cell_values(spark, d), ["cohort", "marker"], "native_label", "value").select(
        "cohort", "marker", "native_label", "n_pos", "n_neg", r6("auroc").alias("auroc"))


# Declared assertions: the label should read higher on the marker than the rest of its cohort.
ASSERTED = (("ECONOMY", "quantity"), ("PROMO", "extendedprice"), ("SMALL", "size"), ("LARGE", "retailprice"))


@query("auroc_assertions", f"""WITH {SQL_LONG},
r AS (SELECT *, rank() OVER (PARTITION BY cohort, marker ORDER BY value)
             + (count(*) OVER (PARTITION BY cohort, marker, value) - 1) / 2.0 AS rk,
             count(*) OVER (PARTITION BY cohort, marker) AS n FROM long),
a AS (SELECT cohort, marker, native_label, count(*) AS cells,
       round((sum(rk) - count(*) * (count(*) + 1.0) / 2) / (CAST(count(*) AS DOUBLE) * (max(n) - count(*))), 6) AS auroc
FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND max(n) - count(*) >= 20)
SELECT a.*, auroc >= 0.75 AS passes FROM a JOIN (VALUES ('ECONOMY', 'quantity'), ('PROMO', 'extendedprice'),
 ('SMALL', 'size'), ('LARGE', 'retailprice')) e(native_label, marker) USING (native_label, marker)""")
def auroc_assertions(spark, d):
    e = spark.createDataFrame(ASSERTED, "native_label string, marker string")
    a = D.auroc(cell_values(spark, d).join(F.broadcast(e.select("marker").distinct()), "marker", "left_semi"),
                ["cohort", "marker"], "native_label", "value")
    return a.join(e, ["native_label", "marker"]).select(
        "cohort", "marker", "native_label", F.col("n_pos").alias("cells"), r6("auroc").alias("auroc"),
        (r6("auroc") >= 0.75).alias("passes"))


SQL_COMP = SQL_CELLS + """,
lc AS (SELECT cohort, image_id, native_label, count(*) AS c FROM cells GROUP BY 1, 2, 3),
im AS (SELECT cohort, image_id, sum(c) AS cells, arg_max(native_label, (c, native_label)) AS dominant FROM lc GROUP BY 1, 2),
en AS (SELECT im.cohort, im.image_id, im.cells, dominant,
              -sum(c / CAST(cells AS DOUBLE) * ln(c / CAST(cells AS DOUBLE) + 1e-12)) AS entropy
       FROM lc JOIN im USING (cohort, image_id) GROUP BY 1, 2, 3, 4),
comp AS (SELECT *, row_number() OVER w - 1 < greatest(1, count(*) OVER (PARTITION BY cohort) // 10) AS skewed,
                row_number() OVER w - 1 >= count(*) OVER (PARTITION BY cohort) // 2 AS balanced
         FROM en WINDOW w AS (PARTITION BY cohort ORDER BY round(entropy, 9), image_id))"""


@query("slide_composition", f"""WITH {SQL_COMP}
SELECT cohort, image_id, CAST(cells AS BIGINT) AS cells, dominant, round(entropy, 6) + 0.0 AS entropy, skewed, balanced FROM comp""")
def slide_composition(spark, d):
    return P.composition(cells(spark, d)).select(
        "cohort", "image_id", "cells", "dominant", r6("entropy").alias("entropy"), "skewed", "balanced")


# Users are images of events; each image holds dozens of rows, so the >= 20 rule has something to pass.
SQL_EVCOMP = SQL_POINTS + """,
lc AS (SELECT cohort, image_id, native_label, count(*) AS c FROM points GROUP BY 1, 2, 3),
im AS (SELECT cohort, image_id, sum(c) AS cells, arg_max(native_label, (c, native_label)) AS dominant FROM lc GROUP BY 1, 2),
en AS (SELECT im.cohort, im.image_id, im.cells, dominant,
              -sum(c / CAST(cells AS DOUBLE) * ln(c / CAST(cells AS DOUBLE) + 1e-12)) AS entropy
       FROM lc JOIN im USING (cohort, image_id) GROUP BY 1, 2, 3, 4),
comp AS (SELECT *, row_number() OVER w - 1 < greatest(1, count(*) OVER (PARTITION BY cohort) // 10) AS skewed,
                row_number() OVER w - 1 >= count(*) OVER (PARTITION BY cohort) // 2 AS balanced
         FROM en WINDOW w AS (PARTITION BY cohort ORDER BY round(entropy, 9), image_id))"""


@query("skew_contrast", f"""WITH {SQL_EVCOMP},
a AS (SELECT p.cohort, p.image_id, p.native_label, median(p.x_px) AS m, count(*) AS n FROM points p JOIN comp USING (cohort, image_id)
      WHERE skewed AND native_label = dominant GROUP BY 1, 2, 3),
b AS (SELECT p.cohort, p.native_label, median(p.x_px) AS m, count(*) AS n FROM points p JOIN comp USING (cohort, image_id)
      WHERE balanced GROUP BY 1, 2)
SELECT cohort, a.image_id, native_label, 'x_px' AS marker, a.n AS n_a, b.n AS n_b, round(a.m - b.m, 6) + 0.0 AS delta
FROM a JOIN b USING (cohort, native_label) WHERE a.n >= 15 AND b.n >= 15""")
def skew_contrast(spark, d):
    p = points(spark, d)
    long = S.to_long(p, ["cohort", "image_id", "cell_id", "native_label"], ["x_px"])
    expected = p.select("cohort", "native_label").distinct().withColumn("marker", F.lit("x_px"))
    return P.skew_contrast(long, materialise(P.composition(p)), expected, "value", 15).select(
        "cohort", "image_id", "native_label", "marker", "n_a", "n_b", r6("delta").alias("delta"))


@query("cohort_audit", f"""WITH {SQL_POINTS}, {SQL_VECTOR_COHORTS},
im AS (SELECT cohort, image_id, count(*) AS cells, max(x_px) - min(x_px) AS ex, max(y_px) - min(y_px) AS ey FROM points GROUP BY 1, 2)
SELECT cohort, CAST(sum(cells) AS BIGINT) AS cells, count(*) AS images,
       (SELECT count(DISTINCT native_label) FROM points p WHERE p.cohort = im.cohort) AS labels,
       CAST(median(cells) AS DOUBLE) AS median_cells_per_image, round(avg(ex) * max(px_um), 6) AS extent_um_x,
       round(avg(ey) * max(px_um), 6) AS extent_um_y, CAST(0 AS DOUBLE) AS pct_xy_missing
FROM im JOIN registry USING (cohort) GROUP BY 1""")
def cohort_audit(spark, d):
    return P.cohort_audit(points(spark, d), vector_registry(spark), "x_px", "y_px").select(
        "cohort", "cells", "images", "labels", F.col("median_cells_per_image").cast("double").alias("median_cells_per_image"),
        r6("extent_um_x").alias("extent_um_x"), r6("extent_um_y").alias("extent_um_y"), r6("pct_xy_missing").alias("pct_xy_missing"))


@query("label_frequency", f"""WITH {SQL_CELLS}
SELECT cohort, native_label, count(*) AS cells, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cohort), 6) AS share_pct
FROM cells GROUP BY 1, 2""")
def label_frequency(spark, d):
    return P.label_frequency(cells(spark, d)).select("cohort", "native_label", "cells", r6("share_pct").alias("share_pct"))


@query("representative_image", f"""WITH {SQL_CELLS},
n AS (SELECT cohort, image_id, count(*) AS cells FROM cells GROUP BY 1, 2)
SELECT cohort, image_id, cells FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY cells, image_id) - 1 AS rn,
  count(*) OVER (PARTITION BY cohort) AS k FROM n) WHERE rn = k // 2""")
def representative_image(spark, d):
    return P.representative_image(cells(spark, d))


@query("label_qc", f"""WITH {SQL_CELLS},
n AS (SELECT cohort, native_label, count(*) AS cells FROM cells GROUP BY 1, 2)
SELECT cohort, native_label, cells, NOT (native_label = 'PROMO' AND cohort = 'BUILDING') AND cells >= 2000 AS kept,
  CASE WHEN native_label = 'PROMO' AND cohort = 'BUILDING' THEN 'label QC: ambiguous'
       WHEN cells < 2000 THEN 'below 2000 cells' ELSE 'kept' END AS reason FROM n""")
def label_qc(spark, d):
    bad = spark.createDataFrame([("BUILDING", "PROMO", "ambiguous")], "cohort string, native_label string, category string")
    return P.label_filter(cells(spark, d), bad, 2000)


def wide_ranks(c):
    return D.column_ecdf(c, ["cohort"], MARKERS, ["native_label"])


@query("coexpression", f"""WITH {SQL_RANKED}
SELECT a.cohort, a.native_label AS label, a.marker AS m1, b.marker AS m2, round(corr(a.u, b.u), 6) + 0.0 AS r
FROM ranked a JOIN ranked b ON a.cell_id = b.cell_id AND a.cohort = b.cohort AND a.marker < b.marker GROUP BY 1, 2, 3, 4""")
def coexpression(spark, d):
    return P.coexpression_wide(wide_ranks(cells(spark, d)), MARKERS).select("cohort", "label", "m1", "m2", r6("r").alias("r"))


@query("coexpression_agreement", f"""WITH {SQL_SIG},
told AS (SELECT cohort, label, marker FROM rescaled WHERE w >= 0.10),
enough AS (SELECT a.cohort AS cohort_a, a.label AS a, b.cohort AS cohort_b, b.label AS b FROM told a JOIN told b USING (marker)
           WHERE (a.cohort, a.label) < (b.cohort, b.label) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
cx AS (SELECT a.cohort, a.native_label AS label, a.marker AS m1, b.marker AS m2, round(corr(a.u, b.u), 9) AS r
FROM ranked a JOIN ranked b ON a.cell_id = b.cell_id AND a.cohort = b.cohort AND a.marker < b.marker GROUP BY 1, 2, 3, 4),
cy AS (SELECT cx.* FROM cx JOIN told t ON t.cohort = cx.cohort AND t.label = cx.label AND t.marker = m1
       JOIN told v ON v.cohort = cx.cohort AND v.label = cx.label AND v.marker = m2 WHERE r IS NOT NULL AND isfinite(r)),
scored AS (SELECT a.cohort AS cohort_a, a.label AS a, b.cohort AS cohort_b, b.label AS b, round(corr(a.r, b.r), 5) + 0.0 AS coex_r, count(*) AS n_pairs
FROM cy a JOIN cy b USING (m1, m2) WHERE (a.cohort, a.label) < (b.cohort, b.label) GROUP BY 1, 2, 3, 4
HAVING count(*) >= 3 AND stddev_pop(a.r) > 1e-6 AND stddev_pop(b.r) > 1e-6)
SELECT scored.* FROM scored JOIN enough USING (cohort_a, a, cohort_b, b)""")
def coexpression_agreement(spark, d):
    c = materialise(cells(spark, d).select("cohort", "cell_id", "native_label", *MARKERS))
    cx = materialise(P.coexpression_wide(wide_ranks(c), MARKERS)).withColumn("r", F.round("r", 9))
    sig = P.signatures(S.to_long(c, ["cohort", "native_label"], MARKERS), min_cells=1)
    weights = P.rescale(sig).select("cohort", "label", "marker", "w")
    return P.coexpression_agreement(cx, weights).withColumn("coex_r", F.round("coex_r", 5) + F.lit(0.0))


@query("lineage_assignment", f"""WITH {SQL_VRANKED},
m AS (SELECT cohort, native_label, marker, avg(u) AS m, count(u) AS n FROM vranked
      WHERE marker IN ('m00', 'm01', 'm02', 'm03') GROUP BY 1, 2, 3 HAVING count(u) >= 5)
SELECT cohort, native_label, CASE WHEN max(m) > 0.55 THEN arg_max('lineage_' || marker, m) ELSE 'unassigned' END AS lineage,
       round(max(m), 6) AS top_mean FROM m GROUP BY 1, 2""")
def lineage_assignment(spark, d):
    lin = spark.createDataFrame([(f"lineage_m0{i}", f"m0{i}") for i in range(4)], "lineage string, marker string")
    u = D.ecdf(vectors(spark, d), ["cohort", "marker"], "value", ["cell_id"])
    return P.lineage_of_class(u, lin, "native_label", 5).select("cohort", "native_label", "lineage", r6("top_mean").alias("top_mean"))


__all__ = ["SQL_SIG", "SQL_DYN", "li_signatures", "IDS", "MARKERS", "SQL_SEGMENTS", "segment_registry"]
