"""Neighbourhood queries over located events (user = image)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.numeric import r6
from cohortweave.operators import sampling as SM
from cohortweave.operators import spatial as N
from cohortweave.operators.distribution import column_ecdf
from cohortweave.plans.registry import query
from cohortweave.plans.tables import SQL_POINTS, points
from cohortweave.session import materialise

G = ["cohort", "image_id"]
SQL_KNN = SQL_POINTS + """,
pr AS (SELECT a.cohort, a.image_id, a.cell_id AS src, b.cell_id AS dst, (a.x_px - b.x_px) ** 2 + (a.y_px - b.y_px) ** 2 AS d2,
         b.x_px - a.x_px AS dx, b.y_px - a.y_px AS dy, a.native_label = b.native_label AS same
       FROM points a JOIN points b ON a.image_id = b.image_id AND a.cell_id <> b.cell_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, src ORDER BY d2, dst) AS rank FROM pr),
edges AS (SELECT *, greatest(sqrt(d2), 1e-3) AS d FROM rk WHERE rank <= 15),
sc AS (SELECT image_id, CASE WHEN median(d) > 1e-3 THEN median(d) ELSE 1 END AS s FROM edges WHERE rank = 1 GROUP BY 1),
rel AS (SELECT e.*, d / s AS d_rel FROM edges e JOIN sc USING (image_id))"""
SQL_VAL = """
v AS (SELECT cohort, image_id, cell_id, marker, value FROM points UNPIVOT (value FOR marker IN (x_px, k))),
vu AS (SELECT *, (rank() OVER (PARTITION BY cohort, marker ORDER BY value) + (count(*) OVER (PARTITION BY cohort, marker, value) - 1) / 2.0)
        / count(value) OVER (PARTITION BY cohort, marker) AS u FROM v),
prof AS (SELECT e.cohort, e.image_id, src, marker, avg(u) AS mean, stddev_pop(u) AS sd, count(u) AS n
         FROM edges e JOIN (SELECT image_id, cell_id AS dst, marker, u FROM vu) x USING (image_id, dst) GROUP BY 1, 2, 3, 4)"""


def graph(spark, d):
    p = points(spark, d)
    return p, materialise(N.knn(p, G, "cell_id", "x_px", "y_px"))


def values_near(spark, d):
    """Profiles of the neighbours' x and k on the mid-rank scale."""
    p = points(spark, d).select(*G, "cell_id", F.col("x_px").alias("x"), F.col("y_px").alias("y"), "x_px", "k")
    u = column_ecdf(p, ["cohort"], ["x_px", "k"], ["image_id", "cell_id", "x", "y"])
    return N.profiles(N.neighbourhoods(u, G, "cell_id", "x", "y", ["x_px", "k"]), G, ["x_px", "k"])


@query("knn_edges", f"WITH {SQL_KNN} SELECT cohort, image_id, src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6) AS d FROM edges")
def knn_edges(spark, d):
    return N.knn(points(spark, d), G, "cell_id", "x_px", "y_px").withColumn("d", r6("d"))


@query("relative_edges", f"WITH {SQL_KNN} SELECT image_id, src, dst, round(d_rel, 6) AS d_rel FROM rel")
def relative_edges(spark, d):
    return N.relative_distance(graph(spark, d)[1], G).select("image_id", "src", "dst", r6("d_rel").alias("d_rel"))


@query("pooled_profile", f"WITH {SQL_KNN}, {SQL_VAL} SELECT image_id, src, marker, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM prof")
def pooled_profile(spark, d):
    return N.pooled_profile(values_near(spark, d), G).select("image_id", "src", "marker", r6("mean").alias("mean"), r6("sd").alias("sd"), "n")


@query("heterogeneity", f"WITH {SQL_KNN}, {SQL_VAL} SELECT image_id, src, round(avg(sd), 6) AS het FROM prof GROUP BY 1, 2")
def heterogeneity(spark, d):
    return N.heterogeneity(values_near(spark, d), G).select("image_id", "src", r6("het").alias("het"))


@query("neighbour_geometry", f"""WITH {SQL_KNN} SELECT image_id, src, round(ln(greatest(median(d), 1e-3)), 6) + 0.0 AS log_edge, round(median(d_rel), 6) AS rel_edge,
 round(count(*) / 15.0, 6) AS filled FROM rel GROUP BY 1, 2""")
def neighbour_geometry(spark, d):
    g = N.geometry(N.relative_distance(graph(spark, d)[1], G), G)
    return g.select("image_id", "src", r6("log_edge").alias("log_edge"), r6("rel_edge").alias("rel_edge"), r6("filled").alias("filled"))


@query("px_sensitivity", f"""WITH {SQL_KNN} SELECT cohort, round(avg(ln(greatest(m, 1e-3))), 6) + 0.0 AS base, round(avg(ln(greatest(m * 1.3, 1e-3))), 6) + 0.0 AS scaled
 FROM (SELECT cohort, image_id, src, median(d) AS m FROM edges GROUP BY 1, 2, 3) GROUP BY 1""")
def px_sensitivity(spark, d):
    e = materialise(N.relative_distance(graph(spark, d)[1], G))
    a = N.geometry(e, G).groupBy("cohort").agg(r6(F.avg("log_edge")).alias("base"))
    b = N.geometry(e, G, px_scale=1.3).groupBy("cohort").agg(r6(F.avg("log_edge")).alias("scaled"))
    return a.join(b, "cohort")


@query("anisotropy", f"""WITH {SQL_KNN}, m AS (SELECT image_id, src, avg(dx * dx) AS xx, avg(dy * dy) AS yy, avg(dx * dy) AS xy, count(*) AS n FROM edges GROUP BY 1, 2),
l AS (SELECT *, (xx + yy) / 2 AS h, sqrt(greatest((xx + yy) ** 2 / 4 - (xx * yy - xy * xy), 0)) AS q FROM m)
SELECT image_id, src, n, round(CASE WHEN n >= 3 THEN 1 - (h - q) / greatest(h + q, 1e-12) END, 6) AS aniso FROM l""")
def anisotropy(spark, d):
    near = N.neighbourhoods(points(spark, d), G, "cell_id", "x_px", "y_px", ["x_px", "y_px"])
    return N.anisotropy(near, G, "x_px", "y_px").select("image_id", "src", "n", r6("aniso").alias("aniso"))


@query("homotypic_fraction", f"WITH {SQL_KNN} SELECT image_id, src, round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 6) AS homotypic FROM edges GROUP BY 1, 2")
def homotypic_fraction(spark, d):
    p, e = graph(spark, d)
    return N.homotypic(e, p, G, "cell_id", "native_label").select("image_id", "src", r6("homotypic").alias("homotypic"))


@query("boundary_score", f"""WITH {SQL_KNN}, {SQL_VAL} SELECT p.image_id, src, round(avg(abs(mean - u)), 6) AS d_self FROM prof p
 JOIN (SELECT image_id, cell_id AS src, marker, u FROM vu) x USING (image_id, src, marker) GROUP BY 1, 2""")
def boundary_score(spark, d):
    return N.boundary_score(values_near(spark, d), G).select("image_id", "src", r6("d_self").alias("d_self"))


@query("graph_audit", f"""WITH {SQL_KNN} SELECT cohort, (SELECT count(*) FROM points p WHERE p.cohort = e.cohort) AS cells, CAST(0 AS BIGINT) AS dropped,
 (SELECT count(*) FROM points p WHERE p.cohort = e.cohort) - count(DISTINCT (image_id, src)) AS isolated, round(median(d), 6) AS median_edge,
 median(d) BETWEEN 10 AND 30 AS in_range FROM edges e GROUP BY 1""")
def graph_audit(spark, d):
    p, e = graph(spark, d)
    N.assert_in_image(e, p, "image_id", "cell_id")
    return N.graph_audit(e, p, "cohort", "image_id", "cell_id", "x_px", "y_px").withColumn("median_edge", r6("median_edge"))


@query("shuffled_neighbourhood", f"""WITH {SQL_KNN},
o AS (SELECT cohort, image_id, cell_id, row_number() OVER (PARTITION BY cohort, image_id ORDER BY cell_id) - 1 AS i, count(*) OVER (PARTITION BY cohort, image_id) AS n,
      CAST(('0x' || substr(md5('shuffle|' || cohort || '|' || image_id), 1, 15)) AS BIGINT) AS h FROM points),
sh AS (SELECT a.image_id, a.cell_id AS src, b.cell_id AS donor FROM o a JOIN o b ON a.image_id = b.image_id AND b.i = (a.i + CASE WHEN a.n >= 2 THEN 1 + a.h % greatest(a.n - 1, 1) ELSE 0 END) % a.n),
hm AS (SELECT image_id, src AS donor, avg(CASE WHEN same THEN 1.0 ELSE 0 END) AS homotypic FROM edges GROUP BY 1, 2)
SELECT image_id, src, round(homotypic, 6) AS homotypic FROM sh JOIN hm USING (image_id, donor)""")
def shuffled_neighbourhood(spark, d):
    p, e = graph(spark, d)
    h = N.homotypic(e, p, G, "cell_id", "native_label")
    s = SM.derangement(p, G, "cell_id").withColumnRenamed("cell_id", "src")
    return N.shuffled_features(h, s, G).select("image_id", "src", r6("homotypic").alias("homotypic"))
