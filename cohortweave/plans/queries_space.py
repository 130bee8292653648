"""Label-space queries over the vector cohorts (5 cohorts x 10 labels, 64 markers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.numeric import r6
from cohortweave.operators import agreement as A
from cohortweave.operators import clustering as C
from cohortweave.operators import labelspace as L
from cohortweave.operators import nesting as N
from cohortweave.operators import profile as P
from cohortweave.operators import tables as S
from cohortweave.plans.registry import query
from cohortweave.plans.tables import (
    SQL_VECTOR_COHORTS, SQL_VECTORS, SQL_VRANKED, table, vector_registry, vectors,
)
from cohortweave.session import materialise

FLOOR = L.EVIDENCE_FLOOR
QL = "[0.02, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98]"
# panels: C1 lacks m00-m09, C2 lacks m10-m15, C3 lacks everything from m20 on (thin panel)
UNMEASURED = "(cohort = 'C1' AND marker < 'm10') OR (cohort = 'C2' AND marker BETWEEN 'm10' AND 'm15') OR (cohort = 'C3' AND marker >= 'm20')"
SQL_VSIG = SQL_VRANKED + f""",
vsig AS (
  SELECT cohort, native_label AS label, marker, quantile_cont(u, {QL}) AS q, avg(u) AS mean_rank,
         avg(CASE WHEN u > 0.5 THEN 1.0 ELSE 0 END) AS p50, avg(CASE WHEN u > 0.75 THEN 1.0 ELSE 0 END) AS p75,
         avg(CASE WHEN u > 0.9 THEN 1.0 ELSE 0 END) AS p90, count(*) AS n_cells
  FROM vranked WHERE NOT ({UNMEASURED}) GROUP BY 1, 2, 3),
vr AS (SELECT cohort, marker, max(mean_rank) AS hi, min(mean_rank) AS lo FROM vsig GROUP BY 1, 2),
ids AS (SELECT cohort, label, CAST(row_number() OVER (ORDER BY cohort, label) - 1 AS INTEGER) AS lid FROM (SELECT DISTINCT cohort, label FROM vsig)),
res AS (SELECT s.*, lid, hi - lo AS w, (mean_rank - (hi + lo) / 2) / greatest(hi - lo, 0.05) AS p,
          (q[3] - (hi + lo) / 2) / greatest(hi - lo, 0.05) AS z10, (q[5] - (hi + lo) / 2) / greatest(hi - lo, 0.05) AS z50,
          (q[7] - (hi + lo) / 2) / greatest(hi - lo, 0.05) AS z90
        FROM vsig s JOIN vr USING (cohort, marker) JOIN ids USING (cohort, label)),
pj AS (SELECT a.lid AS lid_a, b.lid AS lid_b, a.cohort AS cohort_a, b.cohort AS cohort_b, marker, a.p AS pa, b.p AS pb,
         a.p50 AS a50, b.p50 AS b50, a.p75 AS a75, b.p75 AS b75, a.p90 AS a90, b.p90 AS b90,
         CASE WHEN least(a.w, b.w) >= 0.10 THEN least(a.w, b.w) ELSE 0 END AS w,
         CASE WHEN a.z90 - a.z10 > 1e-6 THEN least(1.0, greatest(least(a.z90, b.z90) - greatest(a.z10, b.z10), 0) / (a.z90 - a.z10))
              WHEN a.z10 >= b.z10 - 1e-6 AND a.z10 <= b.z90 + 1e-6 THEN 1.0 ELSE 0.0 END AS o
       FROM res a JOIN res b USING (marker) WHERE a.lid <> b.lid),
pairs0 AS (SELECT lid_a, lid_b, cohort_a, cohort_b, CASE WHEN sum(w) > 0 THEN sqrt(sum(w * (pa - pb) ** 2) / sum(w)) END AS dist,
         CASE WHEN sum(w) > 0 THEN exp(sum(w * ln(greatest(o, 0.05))) / sum(w)) END AS contain, count(*) FILTER (w > 0) AS evidence FROM pj GROUP BY 1, 2, 3, 4),
blk AS (SELECT cohort_a, cohort_b, median(dist) AS m FROM pairs0 WHERE dist > 0 GROUP BY 1, 2),
pairs AS (SELECT p.*, coalesce(dist / m, dist) AS d, exp(-coalesce(dist / m, dist)) AS sim FROM pairs0 p LEFT JOIN blk USING (cohort_a, cohort_b))"""


def rescaled(spark, d):
    v = vectors(spark, d)
    sig = P.signatures(v, min_cells=1).where(f"NOT ({UNMEASURED})")  # ranks are per marker, so masking after is the same
    return materialise(L.with_label_ids(P.rescale(sig)))


def pairs(r):
    return materialise(L.block_normalise(L.pair_relations(r)))


def nodes_of(r):
    return materialise(r.groupBy(F.col("lid").alias("node"), "cohort", "label").agg(F.max("n_cells").alias("n_cells")))


def _pair_cols(p):
    return p.select("lid_a", "lid_b", r6("dist").alias("dist"), r6("contain").alias("contain"), F.col("evidence").cast("long").alias("evidence"),
                    r6("d").alias("d"), r6("sim").alias("sim"))


@query("label_pair_relations", f"""WITH {SQL_VSIG} SELECT lid_a, lid_b, round(dist, 6) AS dist, round(contain, 6) AS contain, evidence, round(d, 6) AS d, round(sim, 6) AS sim FROM pairs""")
def label_pair_relations(spark, d):
    return _pair_cols(pairs(rescaled(spark, d)))


@query("agreement_distance", f"""WITH {SQL_VSIG}, ag AS (SELECT *, least(greatest(-abs(pa - pb) + (ln(greatest(1 - abs(a50 - b50), 1e-300)) + ln(greatest(1 - abs(a75 - b75), 1e-300)) + ln(greatest(1 - abs(a90 - b90), 1e-300))) / 3, ln(0.05)), 0) AS la FROM pj)
SELECT lid_a, lid_b, round(-sum(w * la) / sum(w), 6) + 0.0 AS dist FROM ag GROUP BY 1, 2""")
def agreement_distance(spark, d):
    return L.pair_relations(rescaled(spark, d), "both").select("lid_a", "lid_b", r6("dist").alias("dist"))


@query("lineage_weighted_distance", f"""WITH {SQL_VSIG}, lin AS (SELECT marker, greatest(avg(gap), 0.01) AS lineage FROM (SELECT cohort, marker, max(p90) - median(p90) AS gap FROM vsig GROUP BY 1, 2) GROUP BY 1)
SELECT lid_a, lid_b, round(sqrt(sum(w * lineage * (pa - pb) ** 2) / sum(w * lineage)), 6) AS dist FROM pj JOIN lin USING (marker) GROUP BY 1, 2""")
def lineage_weighted_distance(spark, d):
    r = rescaled(spark, d)
    return L.pair_relations(r, lineage=P.lineage_score(r)).select("lid_a", "lid_b", r6("dist").alias("dist"))


@query("evidence_floor_distance", f"""WITH {SQL_VSIG} SELECT lid_a, lid_b, round(CASE WHEN evidence >= 12 THEN -ln(least(greatest(sim, 1e-6), 1)) ELSE 5.0 END, 6) AS d FROM pairs""")
def evidence_floor_distance(spark, d):
    return L.far_filled(pairs(rescaled(spark, d)), 12).select("lid_a", "lid_b", r6("d").alias("d"))


@query("evidence_coverage", f"""WITH {SQL_VSIG}, n AS (SELECT count(*) * (count(*) - 1) // 2 AS t FROM ids)
SELECT CAST(floor AS INTEGER) AS floor, count(*) FILTER (evidence >= floor) AS direct, round(count(*) FILTER (evidence >= floor) / CAST(max(t) AS DOUBLE), 6) AS share_direct,
  max(t) - count(*) FILTER (evidence > 0) AS never FROM pairs, n, (VALUES (4), (6), (8), (12), (16)) f(floor) WHERE lid_a < lid_b GROUP BY 1""")
def evidence_coverage(spark, d):
    r = rescaled(spark, d)
    n = r.select("lid").distinct().count()
    c = L.evidence_coverage(pairs(r), n, (4, 6, 8, 12, 16))
    return c.select("floor", "direct", r6("share_direct").alias("share_direct"), F.col("never").cast("long").alias("never"))


@query("evidence_by_cohort_pair", f"""WITH {SQL_VSIG}, u AS (SELECT cohort_a, cohort_b, evidence FROM pairs UNION ALL SELECT cohort, cohort, 0 FROM ids)
SELECT cohort_a, cohort_b, CAST(floor(median(evidence)) AS INTEGER) AS median_evidence FROM u GROUP BY 1, 2""")
def evidence_by_cohort_pair(spark, d):
    return L.evidence_by_cohort_pair(pairs(rescaled(spark, d)))


def base_space(spark, d, cut=0.85):
    r = rescaled(spark, d)
    p, n = pairs(r), nodes_of(r)
    m = C.cluster_at(L.linkage_distance(p), n.select("node"), [], cut)
    return r, p, n, materialise(n.join(m, "node"))


@query("average_linkage")
def average_linkage(spark, d):
    return base_space(spark, d)[3].select("node", "cohort", "label", "cluster")


@query("cut_sweep")
def cut_sweep(spark, d):
    r = rescaled(spark, d)
    s = C.cut_sweep(L.linkage_distance(pairs(r)), nodes_of(r))
    return s.select("cut", "clusters", "singletons", "biggest", *[r6(c).alias(c) for c in (
        "biggest_share", "stability", "cohort_ari", "cross_cohort_share", "violation")], "seed_ok", "usable")


@query("cut_choice")
def cut_choice(spark, d):
    r = rescaled(spark, d)
    s = materialise(C.cut_sweep(L.linkage_distance(pairs(r)), nodes_of(r)))
    rules = [("stable", "usable"), ("nearest", "usable"), ("stable", "seed")]
    out = None
    for f, rule in rules:
        c = C.choose_cut(s, fallback=f, rule=rule).withColumn("rule", F.lit(f"{rule}/{f}"))
        out = c if out is None else out.unionByName(c)
    return out.select("rule", "tau", "usable_cut", r6("stability").alias("stability"), r6("violation").alias("violation"), "clusters")


@query("refined_clusters")
def refined_clusters(spark, d):
    _, p, _, m = base_space(spark, d, 1.05)
    out, _ = C.refine(L.linkage_distance(p), m)
    return out.select("node", "cohort", "n_cells", "cluster")


@query("refinement_log")
def refinement_log(spark, d):
    _, p, _, m = base_space(spark, d, 1.05)
    return C.refine(L.linkage_distance(p), m)[1].withColumn("stability", r6("stability"))


# The label itself as a fixed partition makes the rules below testable in SQL.
SQL_MAP = SQL_VSIG + """,
lm AS (SELECT i.*, CAST(substr(label, 2) AS INTEGER) // 2 AS cluster, n_cells FROM ids i JOIN (SELECT cohort, label, max(n_cells) AS n_cells FROM vsig GROUP BY 1, 2) USING (cohort, label))"""


def fixed_map(r):
    n = nodes_of(r)
    return n.withColumn("cluster", F.floor(F.substring("label", 2, 9).cast("int") / 2).cast("int"))


@query("nesting_edges", f"""WITH {SQL_VSIG}
SELECT x.lid_a AS child, x.lid_b AS parent, round(x.contain, 6) AS contain, CAST(1 AS BIGINT) AS pairs FROM pairs x JOIN pairs y ON x.lid_a = y.lid_b AND x.lid_b = y.lid_a
WHERE x.evidence >= 8 AND x.contain >= 0.75 AND (y.evidence < 8 OR x.contain - y.contain >= 0.10) AND -ln(greatest(x.sim, 1e-9)) <= 1.5 * 0.8""")
def nesting_edges(spark, d):
    """Every label as its own cluster: which label's spread sits inside which."""
    r = rescaled(spark, d)
    cp = N.cluster_pairs(pairs(r), nodes_of(r).select("node", F.col("node").alias("cluster")))
    return N.nesting_edges(cp, 0.8).select("child", "parent", r6("contain").alias("contain"), "pairs")


SQL_GRAPH = SQL_VSIG + """,
e AS (SELECT lid_a AS child, lid_b AS parent FROM pairs WHERE contain >= 0.89 AND evidence >= 8)"""


def containment_graph(r):
    return pairs(r).where("contain >= 0.89 AND evidence >= 8").select(F.col("lid_a").alias("child"), F.col("lid_b").alias("parent"))


@query("containment_reachability", f"""WITH RECURSIVE {SQL_GRAPH}, reach(child, parent) AS (SELECT child, parent FROM e UNION SELECT r.child, e.parent FROM reach r JOIN e ON r.parent = e.child)
SELECT child, parent FROM reach""")
def containment_reachability(spark, d):
    return N.reachability(containment_graph(rescaled(spark, d)))


@query("cycle_contraction", f"""WITH RECURSIVE {SQL_GRAPH}, reach(child, parent) AS (SELECT child, parent FROM e UNION SELECT r.child, e.parent FROM reach r JOIN e ON r.parent = e.child),
mut AS (SELECT a.child, min(a.parent) AS m FROM reach a JOIN reach b ON a.child = b.parent AND a.parent = b.child WHERE a.child <> a.parent GROUP BY 1)
SELECT lid AS node, coalesce(least(lid, m), lid) AS cluster FROM ids LEFT JOIN mut ON mut.child = lid""")
def cycle_contraction(spark, d):
    r = rescaled(spark, d)
    n = nodes_of(r).select("node", F.col("node").alias("cluster"))
    return N.contract_cycles(containment_graph(r), n).select("node", "cluster")


@query("evidence_closure", f"""WITH RECURSIVE {SQL_VSIG},
e AS (SELECT lid_a AS child, lid_b AS parent FROM pairs WHERE contain >= 0.86 AND evidence >= 20 AND lid_a < lid_b),
reach(child, parent) AS (SELECT child, parent FROM e UNION SELECT r.child, e.parent FROM reach r JOIN e ON r.parent = e.child),
im AS (SELECT * FROM reach EXCEPT SELECT * FROM e)
SELECT im.child, im.parent, round(contain, 6) AS contain, coalesce(evidence, 0) AS pairs, CASE WHEN coalesce(evidence, 0) < 20 THEN 'bridged' ELSE 'violation' END AS kind
FROM im LEFT JOIN pairs ON lid_a = child AND lid_b = parent WHERE coalesce(evidence, 0) < 20 OR contain < 0.86""")
def evidence_closure(spark, d):
    p = pairs(rescaled(spark, d)).select(F.col("lid_a").alias("child"), F.col("lid_b").alias("parent"), "contain", F.col("evidence").alias("pairs"))
    e = p.where("contain >= 0.86 AND pairs >= 20 AND child < parent")
    return N.closure(e, p, 20, 0.86).withColumn("contain", r6("contain"))


@query("acyclic_nesting")
def acyclic_nesting(spark, d):
    _, p, _, m = base_space(spark, d)
    _, edges, _ = N.acyclic_nesting(p, m.select("node", "cluster"), 0.85)
    return edges.withColumn("contain", r6("contain"))


@query("fold_enumeration", f"""WITH {SQL_VECTORS}, {SQL_VECTOR_COHORTS}, r AS (SELECT * FROM registry WHERE cohort IN (SELECT cohort FROM vectors))
SELECT 'loco_' || cohort AS fold, cohort AS held FROM r UNION ALL SELECT 'loto_' || tissue, cohort FROM r WHERE tissue IN (SELECT tissue FROM r GROUP BY 1 HAVING count(*) >= 2)""")
def fold_enumeration(spark, d):
    present = vectors(spark, d).select("cohort").distinct()
    return L.enumerate_folds(vector_registry(spark).join(present, "cohort", "left_semi"))


SQL_ADMIT = SQL_MAP + """,
fd AS (SELECT 'loco_' || cohort AS fold, cohort AS held FROM (SELECT DISTINCT cohort FROM ids)),
av AS (SELECT fold, h.lid, m.cluster, avg(CASE WHEN evidence >= 8 THEN -ln(least(greatest(sim, 1e-6), 1)) ELSE 5.0 END) AS dist
  FROM fd JOIN lm h ON h.cohort = held JOIN lm m ON m.cohort <> held LEFT JOIN pairs ON lid_a = h.lid AND lid_b = m.lid GROUP BY 1, 2, 3),
bst AS (SELECT fold, lid, arg_min(cluster, (round(dist, 9), cluster)) AS nearest, min(dist) AS distance FROM av GROUP BY 1, 2),
placed AS (SELECT fold, lid, CASE WHEN distance <= 0.97 AND distance < 5 THEN nearest ELSE -1 END AS cluster, distance, distance <= 0.97 AND distance < 5 AS admitted FROM bst)"""


def _placed(spark, d):
    r = rescaled(spark, d)
    p = L.far_filled(pairs(r))
    m = materialise(fixed_map(r))
    folds = m.select(F.concat(F.lit("loco_"), "cohort").alias("fold"), F.col("cohort").alias("held")).distinct()
    cohorts = [x[0] for x in m.select("cohort").distinct().collect()]
    tagged = m.withColumn("held", F.explode(F.lit(cohorts))).join(folds, "held")
    members = tagged.where("cohort <> held").select("fold", F.col("node").alias("lid"), "cluster")
    held = tagged.where("cohort = held").select("fold", F.col("node").alias("lid"))
    tau = folds.select("fold", F.lit(0.97).alias("tau"))
    return L.admit(p, members, held, tau), m


@query("label_admission", f"WITH {SQL_ADMIT} SELECT fold, lid, cluster, round(distance, 6) AS distance, admitted FROM placed")
def label_admission(spark, d):
    return _placed(spark, d)[0].withColumn("distance", r6("distance"))


@query("novel_shares", f"""WITH {SQL_ADMIT} SELECT fold, count(*) AS held_labels, count(*) FILTER (p.cluster < 0) AS novel, round(avg(CASE WHEN p.cluster < 0 THEN 1.0 ELSE 0 END), 6) AS novel_labels,
 round(coalesce(sum(n_cells) FILTER (p.cluster < 0), 0) / CAST(sum(n_cells) AS DOUBLE), 6) AS novel_cells FROM placed p JOIN lm USING (lid) GROUP BY 1""")
def novel_shares(spark, d):
    pl, m = _placed(spark, d)
    s = L.novel_shares(pl, m.select(F.col("node").alias("lid"), "n_cells"))
    return s.withColumn("novel_labels", r6("novel_labels")).withColumn("novel_cells", r6("novel_cells"))


def fold_spaces(spark, d):
    """Every LOCO/LOTO fold's own label space in one keyed run: fold, held set, node, cluster."""
    r = rescaled(spark, d)
    p, n = pairs(r), nodes_of(r)
    folds = materialise(L.enumerate_folds(vector_registry(spark)))
    tags = materialise(n.withColumn("fold", F.explode(F.lit([x[0] for x in folds.select("fold").distinct().collect()])))
                       .join(folds.select("fold", F.col("held").alias("cohort")), ["fold", "cohort"], "left_anti"))
    dist = L.linkage_distance(p)
    fp = (dist.join(tags.select("fold", F.col("node").alias("a")), "a").join(tags.select("fold", F.col("node").alias("b")), ["fold", "b"]))
    sweep = materialise(C.cut_sweep(fp, tags.select("fold", "node", "cohort", "n_cells"), ["fold"]))
    tau = materialise(C.choose_cut(sweep, ["fold"], "nearest"))
    tree = C.merge_tree(fp, ["fold"], stop=max(C.CUTS))
    m = C.cut_tree(tree, tags.select("fold", "node"), ["fold"], tau.select("fold", F.col("tau").alias("cut")))
    return r, p, n, folds, tags, tau, materialise(m.join(tags, ["fold", "node"]))


@query("fold_label_spaces")
def fold_label_spaces(spark, d):
    """Each fold's map: training labels clustered without the held-out cohorts, held labels admitted or NOVEL."""
    _, p, n, folds, _, tau, m = fold_spaces(spark, d)
    held = folds.join(n.select(F.col("cohort").alias("held"), F.col("node").alias("lid")), "held").select("fold", "lid")
    placed = L.admit(L.far_filled(p), m.select("fold", F.col("node").alias("lid"), "cluster"), held, tau.select("fold", "tau"))
    train = m.select("fold", F.col("node").alias("lid"), "cluster", F.lit("train").alias("role"))
    return train.unionByName(placed.select("fold", "lid", "cluster", F.lit("held").alias("role"))).join(
        n.select(F.col("node").alias("lid"), "cohort", "label", "n_cells"), "lid")


@query("fold_space_agreement")
def fold_space_agreement(spark, d):
    """Cell-weighted ARI of every fold's training partition with the whole-roster partition at the fold's cut."""
    _, p, n, _, _, tau, m = fold_spaces(spark, d)
    tree = C.merge_tree(L.linkage_distance(p), [], stop=max(C.CUTS))
    cuts = [float(x[0]) for x in tau.select("tau").distinct().collect()]
    whole = C.cut_tree(tree, n.select("node"), [], cuts=cuts).select(F.col("cut").alias("tau"), "node", F.col("cluster").alias("whole"))
    j = m.drop("cut").join(tau.select("fold", "tau"), "fold").join(whole, ["tau", "node"])
    a = A.ari(A.contingency(j, "cluster", "whole", ["fold"], "n_cells"), "cluster", "whole", ["fold"])
    return a.select("fold", r6("ari").alias("ari"))


@query("fold_training_geometry", "SELECT 'loco_C' || i AS fold, CAST(0 AS BIGINT) AS moved FROM range(5) t(i)")
def fold_training_geometry(spark, d):
    """Pairs whose distance changes when a fold is built on its training cohorts alone (must be none)."""
    r = rescaled(spark, d)
    full = pairs(r)
    tagged = r.withColumn("held", F.explode(F.lit([x[0] for x in r.select("cohort").distinct().collect()]))).where("cohort <> held")
    alone = L.block_normalise(L.pair_relations(tagged, keys=["held"]), ["held"])
    j = alone.join(full.select("lid_a", "lid_b", F.col("sim").alias("s0"), F.col("evidence").alias("e0")), ["lid_a", "lid_b"])
    return j.groupBy(F.concat(F.lit("loco_"), "held").alias("fold")).agg(
        F.count_if((F.abs(F.col("sim") - F.col("s0")) > 1e-12) | (F.col("evidence") != F.col("e0"))).alias("moved"))


@query("cluster_summary", f"""WITH {SQL_MAP} SELECT cluster, count(*) AS labels, count(DISTINCT cohort) AS cohorts, CAST(sum(n_cells) AS BIGINT) AS cells, string_agg(cohort || '|' || label, '; ' ORDER BY cohort || '|' || label) AS members FROM lm GROUP BY 1""")
def cluster_summary(spark, d):
    return L.cluster_summary(fixed_map(rescaled(spark, d)))


@query("cohort_cluster_cells", f"""WITH {SQL_MAP}, k AS (SELECT unnest(range(5)) AS cluster), co AS (SELECT DISTINCT cohort FROM lm)
SELECT co.cohort, k.cluster::VARCHAR AS cluster, CAST(coalesce(sum(n_cells), 0) AS BIGINT) AS cells
FROM co CROSS JOIN k LEFT JOIN lm ON lm.cohort = co.cohort AND lm.cluster = k.cluster GROUP BY 1, 2""")
def cohort_cluster_cells(spark, d):
    wide = L.cohort_cluster_cells(fixed_map(rescaled(spark, d)), range(5))
    return wide.unpivot(["cohort"], [F.col(f"`{k}`") for k in range(5)], "cluster", "cells")


@query("cohort_guards", f"""WITH {SQL_MAP}, g AS (SELECT cluster, count(*) AS labels, count(DISTINCT cohort) AS coh, sum(n_cells) AS cells FROM lm GROUP BY 1),
t AS (SELECT cluster AS a, cohort AS b, CAST(count(*) AS DOUBLE) AS n FROM lm GROUP BY 1, 2),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS i, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM t GROUP BY a)) AS ai, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM t GROUP BY b)) AS bi, (SELECT sum(n) FROM t) AS nn)
SELECT count(*) AS clusters, count(*) FILTER (labels = 1) AS singletons, max(labels) AS biggest, round(max(labels) / CAST(sum(labels) AS DOUBLE), 6) AS biggest_share,
 round(coalesce(sum(cells) FILTER (coh >= 2), 0) / CAST(sum(cells) AS DOUBLE), 6) AS cross_cohort_share, (SELECT round((i - ai * bi / (nn * (nn - 1) / 2)) / ((ai + bi) / 2 - ai * bi / (nn * (nn - 1) / 2)), 6) + 0.0 FROM x) AS cohort_ari FROM g""")
def cohort_guards(spark, d):
    g = A.cohort_guards(fixed_map(rescaled(spark, d)))
    return g.select("clusters", "singletons", "biggest", *[r6(c).alias(c) for c in ("biggest_share", "cross_cohort_share", "cohort_ari")])


@query("cluster_coherence", f"""WITH {SQL_MAP}, m AS (SELECT cluster, cohort, label, marker, z50 AS x FROM res JOIN lm USING (cohort, label) WHERE marker IN (SELECT marker FROM res GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM ids))),
c AS (SELECT cluster, marker, avg(x) AS c FROM m GROUP BY 1, 2), g AS (SELECT marker, avg(c) AS g FROM c GROUP BY 1),
b AS (SELECT avg(b) AS between_ FROM (SELECT cluster, sum((c - g) ** 2) AS b FROM c JOIN g USING (marker) GROUP BY 1)),
w AS (SELECT cluster, avg(s) AS within, count(*) AS labels FROM (SELECT cluster, cohort, label, sum((x - c) ** 2) AS s FROM m JOIN c USING (cluster, marker) GROUP BY 1, 2, 3) GROUP BY 1)
SELECT cluster, labels, round(within, 6) AS within, round(between_, 6) AS between, within < between_ AS coherent FROM w, b""")
def cluster_coherence(spark, d):
    r = rescaled(spark, d)
    return L.cluster_coherence(r, fixed_map(r)).withColumn("within", r6("within")).withColumn("between", r6("between"))


EXCLUSIONS = (("a_vs_b", "m16", "m17"), ("c_vs_d", "m18", "m19"))


@query("exclusion_violations", f"""WITH {SQL_MAP}, e(pair, ma, mb) AS (VALUES ('a_vs_b', 'm16', 'm17'), ('c_vs_d', 'm18', 'm19')),
j AS (SELECT pair, cluster, cohort, label, max(p50) FILTER (marker = ma) AS pa, max(p50) FILTER (marker = mb) AS pb FROM vsig JOIN lm USING (cohort, label) JOIN e ON marker IN (ma, mb) GROUP BY 1, 2, 3, 4)
SELECT pair, cluster, count(*) FILTER (pa >= 0.6 AND pb < 0.6) AS only_a, count(*) FILTER (pb >= 0.6 AND pa < 0.6) AS only_b FROM j GROUP BY 1, 2
HAVING count(*) FILTER (pa >= 0.6 AND pb < 0.6) > 0 AND count(*) FILTER (pb >= 0.6 AND pa < 0.6) > 0""")
def exclusion_violations(spark, d):
    r = rescaled(spark, d)
    rules = spark.createDataFrame(EXCLUSIONS, "pair string, marker_a string, marker_b string")
    return L.exclusion_violations(r, fixed_map(r), rules)


@query("shared_informative_markers", f"""WITH {SQL_MAP} SELECT cluster AS set_id, marker FROM res JOIN lm USING (cohort, label) WHERE w >= 0.10 GROUP BY 1, 2
 HAVING count(*) = (SELECT count(*) FROM lm l WHERE l.cluster = lm.cluster)""".replace("l.cluster = lm.cluster", "l.cluster = any_value(lm.cluster)"))
def shared_informative_markers(spark, d):
    r = rescaled(spark, d)
    return L.shared_informative(r, fixed_map(r).select(F.col("cluster").alias("set_id"), "cohort", "label"))


SQL_NAMES = SQL_MAP + """,
cen AS (SELECT cluster, marker, avg(p) AS c, count(p) AS k FROM res JOIN lm USING (cohort, label) GROUP BY 1, 2),
zz AS (SELECT cluster, marker, round(CASE WHEN k / CAST((SELECT count(*) FROM lm l WHERE l.cluster = cen.cluster) AS DOUBLE) >= 0.5
   AND (SELECT count(DISTINCT cohort) FROM res r WHERE r.marker = cen.marker) >= 3 THEN
   coalesce(CASE WHEN stddev_pop(c) OVER (PARTITION BY marker) > 1e-6 THEN (c - avg(c) OVER (PARTITION BY marker)) / stddev_pop(c) OVER (PARTITION BY marker) END, 0) ELSE 0 END, 9) AS z FROM cen),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, marker) AS up, row_number() OVER (PARTITION BY cluster ORDER BY z, marker) AS dn FROM zz),
prt AS (SELECT cluster, up AS o, marker || '+' AS t FROM rk WHERE up <= 3 AND z > 0.8 UNION ALL SELECT cluster, 10 + dn, marker || '-' FROM rk WHERE dn <= 1 AND z < -1.2),
nm AS (SELECT c.cluster, coalesce(string_agg(t, ' ' ORDER BY o), 'no discriminative shared marker') AS cluster_name FROM (SELECT DISTINCT cluster FROM lm) c LEFT JOIN prt USING (cluster) GROUP BY 1)"""


@query("cluster_names", f"WITH {SQL_NAMES} SELECT cluster, cluster_name FROM nm")
def cluster_names(spark, d):
    r = rescaled(spark, d)
    return L.name_clusters(r, fixed_map(r))


@query("merge_fidelity", f"""WITH {SQL_MAP}, g AS (SELECT a.cohort, a.label AS la, b.label AS lb, max(abs(a.mean_rank - b.mean_rank)) AS gap FROM vsig a JOIN vsig b ON a.cohort = b.cohort AND a.marker = b.marker AND a.label < b.label GROUP BY 1, 2, 3),
j AS (SELECT gap, x.cluster = y.cluster AS same FROM g JOIN lm x ON x.cohort = g.cohort AND x.label = la JOIN lm y ON y.cohort = g.cohort AND y.label = lb)
SELECT count(*) AS pairs, count(*) FILTER (gap > 0.5) AS separable, count(*) FILTER (gap > 0.5 AND same) AS bad_merges, round(count(*) FILTER (gap > 0.5 AND same) / CAST(nullif(count(*) FILTER (gap > 0.5), 0) AS DOUBLE), 6) AS bad_rate FROM j""")
def merge_fidelity(spark, d):
    r = rescaled(spark, d)
    return L.merge_fidelity(r.select("cohort", "label", "marker", "mean_rank"), fixed_map(r)).withColumn("bad_rate", r6("bad_rate"))


CASES = (("same_ok", "same", "C0|L0;C1|L1;C4|L0", 1, 0), ("same_blob", "same", "C0|L2;C1|L3", 1, 1), ("same_bad", "same", "C0|L0;C1|L2;C3|L3", 1, 1),
         ("diff_ok", "different", "C0|L0;C0|L2;C0|L9", 1, 0), ("diff_bad", "different", "C0|L0;C1|L1", 0, 0),
         ("nested", "nested", "C0|L0;C1|L4", 0, 0), ("merged", "nested", "C0|L0;C1|L1", 0, 0), ("absent", "same", "C0|L0;C9|L1", 1, 0))
CASE_SCHEMA = "case string, relation string, members string, required int, waived int"
SQL_CASES = SQL_NAMES + """,
cs("case", relation, members, required, waived) AS (VALUES """ + ", ".join("('%s', '%s', '%s', %d, %d)" % c for c in CASES) + """),
mm AS (SELECT "case", relation, required, waived, pos, split_part(m, '|', 1) AS cohort, split_part(m, '|', 2) AS label FROM
   (SELECT *, unnest(string_split(members, ';')) AS m, generate_subscripts(string_split(members, ';'), 1) AS pos FROM cs)),
mc AS (SELECT mm.*, lm.cluster FROM mm LEFT JOIN lm USING (cohort, label)),
big AS (SELECT arg_max(cluster, (k, -cluster)) AS cluster FROM (SELECT cluster, count(*) AS k FROM lm GROUP BY 1)),
blob AS (SELECT cluster FROM big UNION SELECT cluster FROM nm WHERE cluster_name NOT LIKE '%+%'),
ag AS (SELECT "case", relation, required, waived, count(*) AS n, count(*) FILTER (cluster IS NULL) AS missing, count(DISTINCT cluster) AS k,
   bool_or(cluster IN (SELECT cluster FROM blob)) AS blob, arg_min(cluster, pos) AS child, arg_max(cluster, pos) AS parent FROM mc GROUP BY 1, 2, 3, 4),
edge(child, parent) AS (VALUES (0, 2)),
sc AS (SELECT "case", relation, required, waived, n AS members, k AS clusters, CASE WHEN n < 2 OR missing > 0 THEN 'n/a'
  WHEN relation = 'same' THEN CASE WHEN k = 1 AND NOT coalesce(blob, false) THEN 'PASS' ELSE 'FAIL' END
  WHEN relation = 'different' THEN CASE WHEN k = n THEN 'PASS' ELSE 'FAIL' END
  WHEN child = parent THEN 'merged' WHEN (child, parent) IN (SELECT (child, parent) FROM edge) THEN 'PASS' ELSE 'FAIL' END AS result FROM ag)"""


def _cases(spark, d):
    r = rescaled(spark, d)
    m = materialise(fixed_map(r))
    names = materialise(L.name_clusters(r, m))
    cases = spark.createDataFrame(CASES, CASE_SCHEMA)
    edges = spark.createDataFrame([(0, 2)], "child int, parent int")
    return cases, m, names, L.score_cases(cases, m, names, edges)


@query("declared_cases", f'WITH {SQL_CASES} SELECT "case", relation, required, waived, members, clusters, result FROM sc')
def declared_cases(spark, d):
    return _cases(spark, d)[3]


@query("unreliable_clusters", f"""WITH {SQL_CASES}, {SQL_VECTOR_COHORTS},
bad AS (SELECT "case" FROM sc WHERE required = 1 AND waived = 1 AND result = 'FAIL'),
bm AS (SELECT "case", cluster, count(*) AS k FROM mc WHERE "case" IN (SELECT "case" FROM bad) AND cluster IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT DISTINCT cluster FROM bm b WHERE k = (SELECT max(k) FROM bm x WHERE x."case" = b."case"))
SELECT c.cluster, NOT ex AS flagged, ex AS exempt FROM (SELECT cluster, (SELECT count(DISTINCT tissue) FROM lm JOIN registry USING (cohort) WHERE lm.cluster = b.cluster) >= 3
  AND (SELECT cluster_name FROM nm WHERE nm.cluster = b.cluster) LIKE '%+%' AND cluster IN (SELECT cluster FROM pl) AND cluster NOT IN (SELECT cluster FROM big) AS ex FROM (SELECT DISTINCT cluster FROM bm) b) c""")
def unreliable_clusters(spark, d):
    cases, m, names, scored = _cases(spark, d)
    return L.unreliable_clusters(scored, cases, m, names, vector_registry(spark))


# ------------------------------------------------------------------ fold stability over a fixed family of maps
SQL_MAPS = SQL_MAP + """,
maps AS (SELECT 'loco_' || h.cohort AS fold, h.cohort AS held, lm.cohort, lm.label,
   CASE WHEN lm.cohort = h.cohort AND lm.cluster = 1 THEN -1 ELSE (lm.cluster + CASE WHEN h.cohort = 'C1' AND lm.cluster = 2 THEN 1 ELSE 0 END) END AS cluster
 FROM lm CROSS JOIN (SELECT DISTINCT cohort FROM ids) h)"""


def fixed_maps(spark, d):
    m = materialise(fixed_map(rescaled(spark, d)))
    x = m.withColumn("held", F.explode(F.lit([r[0] for r in m.select("cohort").distinct().collect()])))
    nov = (F.col("cohort") == F.col("held")) & (F.col("cluster") == 1)
    bump = F.when((F.col("held") == "C1") & (F.col("cluster") == 2), 1).otherwise(0)
    return x.select(F.concat(F.lit("loco_"), "held").alias("fold"), "held", "cohort", "label",
                    F.when(nov, -1).otherwise(F.col("cluster") + bump).alias("cluster"))


@query("fold_pair_ari", f"""WITH {SQL_MAPS}, j AS (SELECT a.fold AS fa, b.fold AS fb, a.cluster AS ca, b.cluster AS cb FROM maps a JOIN maps b USING (cohort, label)
 WHERE a.fold < b.fold AND cohort <> a.held AND cohort <> b.held AND a.cluster >= 0 AND b.cluster >= 0),
t AS (SELECT fa, fb, ca, cb, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY 1, 2, 3, 4),
i AS (SELECT fa, fb, sum(n * (n - 1) / 2) AS i, sum(n) AS nn FROM t GROUP BY 1, 2),
x AS (SELECT fa, fb, sum(n * (n - 1) / 2) AS ai FROM (SELECT fa, fb, ca, sum(n) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2),
y AS (SELECT fa, fb, sum(n * (n - 1) / 2) AS bi FROM (SELECT fa, fb, cb, sum(n) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT fa AS a, fb AS b, CAST(nn AS BIGINT) AS n_labels, round((i - ai * bi / (nn * (nn - 1) / 2)) / ((ai + bi) / 2 - ai * bi / (nn * (nn - 1) / 2)), 6) AS ari
FROM i JOIN x USING (fa, fb) JOIN y USING (fa, fb) WHERE nn >= 10""")
def fold_pair_ari(spark, d):
    return A.fold_pair_ari(fixed_maps(spark, d)).withColumn("ari", r6("ari"))


SQL_VOTE = SQL_MAPS + """,
k AS (SELECT fold, cohort || '|' || label AS k, cluster FROM maps WHERE cluster >= 0 AND cohort <> held),
v AS (SELECT a.k AS x, b.k AS y, count(*) AS folds, avg(CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0 END) AS mr FROM k a JOIN k b USING (fold) WHERE a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("merge_votes", f"WITH {SQL_VOTE} SELECT x, y, folds, round(mr, 6) AS merged_rate, round(greatest(mr, 1 - mr), 6) AS consistency, mr IN (0, 1) AS unanimous FROM v")
def merge_votes(spark, d):
    return A.merge_votes(fixed_maps(spark, d), 3).withColumn("merged_rate", r6("merged_rate")).withColumn("consistency", r6("consistency"))


@query("merge_histogram", f"WITH {SQL_VOTE} SELECT CASE WHEN mr < .01 THEN 'never' WHEN mr < .5 THEN 'minority' WHEN mr < .99 THEN 'majority' ELSE 'always' END AS bin, count(*) AS pairs FROM v GROUP BY 1")
def merge_histogram(spark, d):
    return A.merge_histogram(A.merge_votes(fixed_maps(spark, d), 3))


# ------------------------------------------------------------------ name baselines on part names
def part_names(spark, d):
    """One node per distinct part name; the noun decides its cohort for the baseline."""
    return S.dense_codes(table(spark, d, "part").select(F.col("p_name").alias("label")).distinct(), "label", "lid")


SQL_PN = "pn AS (SELECT p_name AS label, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT p_name FROM part))"


@query("name_token_jaccard", f"""WITH {SQL_PN}, g AS (SELECT DISTINCT id, unnest(string_split(label, ' ')) AS g FROM pn), k AS (SELECT id, count(*) AS k FROM g GROUP BY 1)
SELECT x.id AS a, y.id AS b, round(count(*) / CAST(any_value(kx.k) + any_value(ky.k) - count(*) AS DOUBLE), 6) AS sim FROM g x JOIN g y USING (g) JOIN k kx ON kx.id = x.id JOIN k ky ON ky.id = y.id WHERE x.id < y.id GROUP BY 1, 2""")
def name_token_jaccard(spark, d):
    return L.name_similarity(part_names(spark, d), "token").withColumn("sim", r6("sim"))


@query("name_char3_jaccard", f"""WITH {SQL_PN}, g AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(length(label) - 2, 1) + 1), lambda i: substr(label, i, 3))) AS g FROM pn), k AS (SELECT id, count(*) AS k FROM g GROUP BY 1)
SELECT x.id AS a, y.id AS b, round(count(*) / CAST(any_value(kx.k) + any_value(ky.k) - count(*) AS DOUBLE), 6) AS sim FROM g x JOIN g y USING (g) JOIN k kx ON kx.id = x.id JOIN k ky ON ky.id = y.id WHERE x.id < y.id GROUP BY 1, 2""")
def name_char3_jaccard(spark, d):
    return L.name_similarity(part_names(spark, d), "char3").withColumn("sim", r6("sim"))


@query("name_exact", f"""WITH pn AS (SELECT n_nationkey AS id, 'NATION ' || n_regionkey AS label FROM nation) SELECT x.id AS a, y.id AS b, CAST(1 AS DOUBLE) AS sim FROM pn x JOIN pn y USING (label) WHERE x.id < y.id""")
def name_exact(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("lid"), F.concat(F.lit("Nation_"), F.col("n_regionkey").cast("string")).alias("label"))
    return L.name_similarity(n, "exact")


@query("name_tfidf_cosine", f"""WITH {SQL_PN}, w AS (SELECT id, ' ' || unnest(string_split(label, ' ')) || ' ' AS w FROM pn),
g AS (SELECT id, unnest(list_transform(range(1, greatest(length(w) - len + 1, 1) + 1), lambda i: substr(w, i, len))) AS g FROM w, (VALUES (2), (3), (4)) l(len) WHERE length(w) >= len),
tf AS (SELECT id, g, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT g, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT id, g, tf * (ln((1.0 + (SELECT count(*) FROM pn)) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (g)),
n AS (SELECT id, g, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM x)
SELECT a.id AS a, b.id AS b, round(sum(a.v * b.v), 6) AS sim FROM n a JOIN n b USING (g) WHERE a.id < b.id GROUP BY 1, 2""")
def name_tfidf_cosine(spark, d):
    return L.name_similarity(part_names(spark, d), "tfidf").withColumn("sim", r6("sim"))


@query("name_clusters")
def name_clusters(spark, d):
    """Character-gram name clusters, average linkage to eight groups."""
    n = part_names(spark, d)
    sim = L.name_similarity(n, "char3")
    p = sim.select("a", "b", (1.0 - F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0))).alias("d"))
    return C.cluster_to_k(p, n.select(F.col("lid").alias("node")), 8).join(n.select(F.col("lid").alias("node"), "label"), "node")


__all__ = ["SQL_VECTORS", "SQL_VSIG", "SQL_MAP", "rescaled", "pairs", "fixed_map", "base_space"]
