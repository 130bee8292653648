"""Label-pair relations and the rules that read a finished label space.

All tables here are label-sized: the number of distinct annotation names, not of cells. Pairs are
produced by an equi-join on the marker and reduced at once to one row per label pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import safe_div, share
from cohortweave.functions.text import name_key
from cohortweave.operators.profile import Q10, Q50, Q90

# --- fixed values --------------------------------------------------------------------
INFORMATIVE = 0.10      # smaller between-label range carries no evidence
OVERLAP_FLOOR = 0.05    # floor inside the geometric mean
EVIDENCE_FLOOR = 8      # informative shared markers needed for a direct comparison
FAR = 5.0               # distance of a pair below the evidence floor
SIM_FLOOR = 1e-6
EXCLUSIVE_HIGH = 0.60
GAP_SEPARABLE = 0.5
NAME_UP, NAME_DOWN, NAME_TOP, NAME_MIN_COHORTS, NAME_COVERAGE = 0.8, -1.2, 3, 3, 0.5
NOVEL = -1
# -------------------------------------------------------------------------------------


def with_label_ids(sig: DataFrame) -> DataFrame:
    """Dense label id over sorted (cohort, label); label-sized window."""
    ids = sig.select("cohort", "label").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("cohort", "label")
    return sig.join(ids.withColumn("lid", (F.row_number().over(w) - 1).cast("int")), ["cohort", "label"])


def pair_relations(rescaled: DataFrame, distance: str = "rms", keys: Sequence[str] = (),
                   lineage: DataFrame | None = None) -> DataFrame:
    """Ordered label pairs (a, b): dist, contain (a inside b), evidence.

    rescaled: keys, cohort, label, lid, marker, p, z, w, pos. distance: rms (weighted position
    RMS), position, posfrac or both (agreement form: minus the weighted mean log agreement).
    """
    keys = list(keys)
    side = rescaled.select(*keys, "marker", "lid", "cohort", "w", "p", F.col("z")[Q10].alias("lo"),
                           F.col("z")[Q90].alias("hi"), "pos")
    a = side.select(*keys, "marker", *[F.col(c).alias(c + "_a") for c in ("lid", "cohort", "w", "p", "lo", "hi", "pos")])
    b = side.select(*keys, "marker", *[F.col(c).alias(c + "_b") for c in ("lid", "cohort", "w", "p", "lo", "hi", "pos")])
    j = a.join(b, [*keys, "marker"]).where("lid_a <> lid_b")
    w = F.least("w_a", "w_b")
    j = j.withColumn("_w", F.when(w >= INFORMATIVE, w).otherwise(0.0))
    if lineage is not None:
        j = j.join(lineage, "marker").withColumn("_u", F.col("_w") * F.col("lineage"))
    else:
        j = j.withColumn("_u", F.col("_w"))
    inter = F.greatest(F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b"), F.lit(0.0))
    wid = F.col("hi_a") - F.col("lo_a")
    point = F.when((F.col("lo_a") >= F.col("lo_b") - 1e-6) & (F.col("lo_a") <= F.col("hi_b") + 1e-6), 1.0).otherwise(0.0)
    o = F.least(F.when(wid > 1e-6, safe_div(inter, wid)).otherwise(point), F.lit(1.0))
    u = F.col("_u")
    sw = F.sum(u)
    if distance == "rms":
        dist = F.sqrt(safe_div(F.sum(u * F.pow(F.col("p_a") - F.col("p_b"), 2)), sw))
    else:
        agree = F.lit(0.0)
        if distance in ("position", "both"):
            agree = agree - F.abs(F.col("p_a") - F.col("p_b"))
        if distance in ("posfrac", "both"):
            for i in range(3):
                gap = 1.0 - F.abs(F.col("pos_a")[i] - F.col("pos_b")[i])
                agree = agree + F.log(F.greatest(gap, F.lit(1e-300))) / 3.0
        agree = F.least(F.greatest(agree, F.log(F.lit(OVERLAP_FLOOR))), F.lit(0.0))
        dist = -safe_div(F.sum(u * agree), sw)
    return j.groupBy(*keys, "lid_a", "lid_b", "cohort_a", "cohort_b").agg(
        dist.alias("dist"),
        F.exp(safe_div(F.sum(u * F.log(F.greatest(o, F.lit(OVERLAP_FLOOR)))), sw)).alias("contain"),
        F.count_if(F.col("_w") > 0).alias("evidence"))


def block_normalise(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Divide distances by the median positive distance of their cohort pair; adds d and sim."""
    g = [*keys, "cohort_a", "cohort_b"]
    med = pairs.where("dist > 0").groupBy(*g).agg(F.percentile("dist", F.lit(0.5)).alias("_m"))
    d = F.coalesce(safe_div("dist", "_m"), F.col("dist"))
    return pairs.join(med, g, "left").withColumn("d", d).withColumn("sim", F.exp(-d)).drop("_m")


def linkage_distance(pairs: DataFrame, floor: int = EVIDENCE_FLOOR, keys: Sequence[str] = ()) -> DataFrame:
    """Undirected comparable pairs a < b with their symmetric distance; absent pairs mean FAR."""
    d = -F.log(F.least(F.greatest("sim", F.lit(SIM_FLOOR)), F.lit(1.0)))
    return (pairs.where(F.col("evidence") >= floor)
            .groupBy(*keys, F.least("lid_a", "lid_b").alias("a"), F.greatest("lid_a", "lid_b").alias("b"))
            .agg(F.avg(d).alias("d")))


def far_filled(pairs: DataFrame, floor: int = EVIDENCE_FLOOR) -> DataFrame:
    """Ordered pairs with FAR where evidence is short (the dense reading of linkage_distance)."""
    d = -F.log(F.least(F.greatest("sim", F.lit(SIM_FLOOR)), F.lit(1.0)))
    return pairs.withColumn("d", F.when(F.col("evidence") >= floor, d).otherwise(F.lit(FAR)))


# ---------------------------------------------------------------------------- fold logic
def enumerate_folds(registry: DataFrame) -> DataFrame:
    """One row per held-out cohort of each fold: LOCO for every cohort, LOTO per tissue with >= 2."""
    loco = registry.select(F.concat(F.lit("loco_"), "cohort").alias("fold"), F.col("cohort").alias("held"))
    many = registry.groupBy("tissue").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    loto = registry.join(many, "tissue").select(
        F.concat(F.lit("loto_"), F.regexp_replace("tissue", " ", "_")).alias("fold"), F.col("cohort").alias("held"))
    return loco.unionByName(loto)


def admit(pairs: DataFrame, members: DataFrame, held: DataFrame, tau: DataFrame,
          keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Place held-out labels: nearest cluster by mean distance, admitted if <= tau and < FAR.

    pairs: ordered lid_a, lid_b, d (FAR filled; absent pairs count as FAR); members: keys, lid,
    cluster; held: keys, lid; tau: keys, tau. Returns keys, lid, cluster (-1 = NOVEL), distance,
    admitted. Ties go to the lowest cluster.
    """
    keys = list(keys)
    size = members.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("m"))
    got = (held.join(members.select(*keys, F.col("lid").alias("lid_b"), "cluster"), keys)
           .join(pairs.select(F.col("lid_a").alias("lid"), "lid_b", "d"), ["lid", "lid_b"], "left")
           .groupBy(*keys, "lid", "cluster").agg(F.sum(F.coalesce("d", F.lit(FAR))).alias("s")))
    avg = got.join(size, [*keys, "cluster"]).withColumn("dist", F.col("s") / F.col("m"))
    best = avg.groupBy(*keys, "lid").agg(
        F.min_by("cluster", F.struct("dist", "cluster")).alias("nearest"), F.min("dist").alias("distance"))
    ok = (F.col("distance") <= F.col("tau")) & (F.col("distance") < FAR)
    return best.join(tau, keys).select(*keys, "lid", F.when(ok, F.col("nearest")).otherwise(NOVEL).alias("cluster"),
                                       "distance", ok.alias("admitted"))


def novel_shares(placed: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Share of held-out labels and of their cells that no cluster admits."""
    nov = F.col("cluster") < 0
    return placed.join(sizes.select("lid", "n_cells"), "lid").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("held_labels"), F.count_if(nov).alias("novel"), share(nov).alias("novel_labels"),
        (F.sum(F.when(nov, F.col("n_cells")).otherwise(0)) / F.sum("n_cells")).alias("novel_cells"))


# ---------------------------------------------------------------------------- reading a space
def cluster_summary(label_map: DataFrame) -> DataFrame:
    """Labels, cohorts, cells and member list of each cluster."""
    return label_map.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("labels"), F.countDistinct("cohort").alias("cohorts"), F.sum("n_cells").alias("cells"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "cohort", "label"))), "; ").alias("members"))


def cohort_cluster_cells(label_map: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """Cells per cohort x cluster, 0 where none."""
    return (label_map.groupBy("cohort").pivot("cluster", list(clusters)).agg(F.sum("n_cells")).na.fill(0))


def cluster_coherence(rescaled: DataFrame, label_map: DataFrame) -> DataFrame:
    """Within-cluster spread against the spread of centroids, on markers every label has."""
    m = rescaled.join(label_map.select("cohort", "label", "cluster"), ["cohort", "label"]).withColumn("x", F.col("z")[Q50])
    n_labels = label_map.agg(F.count(F.lit(1)).alias("k"))
    full = m.groupBy("marker").agg(F.count("x").alias("k")).join(n_labels, "k").select("marker")
    m = m.join(full, "marker", "left_semi")
    cen = m.groupBy("cluster", "marker").agg(F.avg("x").alias("c"))
    grand = cen.groupBy("marker").agg(F.avg("c").alias("g"))
    spread = cen.join(grand, "marker").groupBy("cluster").agg(F.sum(F.pow(F.col("c") - F.col("g"), 2)).alias("b"))
    within = (m.join(cen, ["cluster", "marker"]).groupBy("cluster", "cohort", "label")
              .agg(F.sum(F.pow(F.col("x") - F.col("c"), 2)).alias("s")).groupBy("cluster")
              .agg(F.avg("s").alias("within"), F.count(F.lit(1)).alias("labels")))
    between = F.avg("b").over(Window.partitionBy(F.lit(0)))  # cluster-sized
    w = F.when(F.col("labels") > 1, F.col("within")).otherwise(0.0)
    return within.join(spread, "cluster").withColumn("between", between).select(
        "cluster", "labels", w.alias("within"), "between", (w < F.col("between")).alias("coherent"))


def exclusion_violations(sig: DataFrame, label_map: DataFrame, rules: DataFrame) -> DataFrame:
    """Clusters holding one label high only on marker A and one high only on marker B.

    rules: pair, marker_a, marker_b. High = at least 60 % of cells above the cohort median; a
    marker that was not measured is not evidence of absence.
    """
    p = sig.join(label_map.select("cohort", "label", "cluster"), ["cohort", "label"]).select(
        "cluster", "cohort", "label", "marker", F.col("pos")[0].alias("p"))
    sides = rules.select("pair", F.explode(F.array(
        F.struct(F.col("marker_a").alias("marker"), F.lit("a").alias("side")),
        F.struct(F.col("marker_b").alias("marker"), F.lit("b").alias("side")))).alias("_s")).select("pair", "_s.*")
    j = p.join(sides, "marker").groupBy("pair", "cluster", "cohort", "label").agg(
        F.max(F.when(F.col("side") == "a", F.col("p"))).alias("pa"),
        F.max(F.when(F.col("side") == "b", F.col("p"))).alias("pb"))
    ah, bh = F.col("pa") >= EXCLUSIVE_HIGH, F.col("pb") >= EXCLUSIVE_HIGH
    only_a = F.coalesce(ah & ~bh, F.lit(False))
    only_b = F.coalesce(bh & ~ah, F.lit(False))
    return j.groupBy("pair", "cluster").agg(
        F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b")).where("only_a > 0 AND only_b > 0")


def evidence_coverage(pairs: DataFrame, n_labels: int, floors: Sequence[int]) -> DataFrame:
    """Unordered label pairs at or above each evidence floor, and never comparable ones."""
    total = n_labels * (n_labels - 1) // 2
    und = pairs.where("lid_a < lid_b")
    g = und.withColumn("floor", F.explode(F.lit(list(floors)))).groupBy("floor").agg(
        F.count_if(F.col("evidence") >= F.col("floor")).alias("direct"), F.count_if(F.col("evidence") > 0).alias("_any"))
    return g.select("floor", "direct", (F.col("direct") / total).alias("share_direct"),
                    (F.lit(total) - F.col("_any")).alias("never"))


def evidence_by_cohort_pair(pairs: DataFrame) -> DataFrame:
    """Median evidence per cohort pair (the diagonal pairs of a label with itself count as 0)."""
    self_pairs = (pairs.select(F.col("lid_a").alias("lid_b"), F.col("lid_a"), F.col("cohort_a"), F.col("cohort_a").alias("cohort_b"))
                  .distinct().withColumn("evidence", F.lit(0).cast("long")))
    u = pairs.select("lid_b", "lid_a", "cohort_a", "cohort_b", "evidence").unionByName(self_pairs)
    return u.groupBy("cohort_a", "cohort_b").agg(F.percentile("evidence", F.lit(0.5)).cast("int").alias("median_evidence"))


def shared_informative(rescaled: DataFrame, label_set: DataFrame) -> DataFrame:
    """Markers that are informative for every label of a set. label_set: set_id, cohort, label."""
    n = label_set.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    k = (rescaled.where(F.col("w") >= INFORMATIVE).join(label_set, ["cohort", "label"])
         .groupBy("set_id", "marker").agg(F.count(F.lit(1)).alias("n")))
    return k.join(n, ["set_id", "n"]).select("set_id", "marker")


def name_clusters(rescaled: DataFrame, label_map: DataFrame) -> DataFrame:
    """Top discriminative markers of each cluster: up to three '+', at most one '-'.

    A marker may name a cluster only if half its labels measure it and at least three cohorts do.
    """
    m = rescaled.join(label_map.select("cohort", "label", "cluster"), ["cohort", "label"])
    n = label_map.groupBy("cluster").agg(F.count(F.lit(1)).alias("labels"))
    ncoh = rescaled.groupBy("marker").agg(F.countDistinct("cohort").alias("ncoh"))
    cen = m.groupBy("cluster", "marker").agg(F.avg("p").alias("c"), F.count("p").alias("k")).join(n, "cluster").join(ncoh, "marker")
    w = Window.partitionBy("marker")
    sd = F.stddev_pop("c").over(w)
    z = F.when(sd > 1e-6, (F.col("c") - F.avg("c").over(w)) / sd)
    ok = (F.col("k") / F.col("labels") >= NAME_COVERAGE) & (F.col("ncoh") >= NAME_MIN_COHORTS)
    z = cen.withColumn("z", F.round(F.when(ok, F.coalesce(z, F.lit(0.0))).otherwise(0.0), 9))
    by = Window.partitionBy("cluster")
    up = F.row_number().over(by.orderBy(F.col("z").desc(), "marker"))
    dn = F.row_number().over(by.orderBy(F.col("z"), "marker"))
    r = z.withColumn("up", up).withColumn("dn", dn)
    plus = F.when((F.col("up") <= NAME_TOP) & (F.col("z") > NAME_UP), F.struct(F.col("up").alias("o"), F.concat("marker", F.lit("+")).alias("t")))
    minus = F.when((F.col("dn") <= 1) & (F.col("z") < NAME_DOWN), F.struct((F.col("dn") + 10).alias("o"), F.concat("marker", F.lit("-")).alias("t")))
    parts = r.groupBy("cluster").agg(F.array_sort(F.concat(F.collect_list(plus), F.collect_list(minus))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda s: s["t"]), " ")
    return parts.select("cluster", F.when(text != "", text).otherwise("no discriminative shared marker").alias("cluster_name"))


def merge_fidelity(mean_rank: DataFrame, label_map: DataFrame, gap: float = GAP_SEPARABLE) -> DataFrame:
    """Within-cohort label pairs that differ by more than `gap` on some marker yet share a cluster.

    mean_rank: cohort, label, marker, mean_rank. Returns pairs, separable, bad_merges, bad_rate.
    """
    a = mean_rank.select("cohort", "marker", F.col("label").alias("la"), F.col("mean_rank").alias("ra"))
    b = mean_rank.select("cohort", "marker", F.col("label").alias("lb"), F.col("mean_rank").alias("rb"))
    g = (a.join(b, ["cohort", "marker"]).where("la < lb").groupBy("cohort", "la", "lb")
         .agg(F.max(F.abs(F.col("ra") - F.col("rb"))).alias("gap")))
    m = label_map.select("cohort", "label", "cluster")
    g = (g.join(m.select("cohort", F.col("label").alias("la"), F.col("cluster").alias("ca")), ["cohort", "la"])
         .join(m.select("cohort", F.col("label").alias("lb"), F.col("cluster").alias("cb")), ["cohort", "lb"]))
    sep, bad = F.col("gap") > gap, (F.col("gap") > gap) & (F.col("ca") == F.col("cb"))
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(sep).alias("separable"), F.count_if(bad).alias("bad_merges"),
                 safe_div(F.count_if(bad), F.count_if(sep)).alias("bad_rate"))


# ---------------------------------------------------------------------------- declared cases
def score_cases(cases: DataFrame, label_map: DataFrame, names: DataFrame, edges: DataFrame,
                cohorts: DataFrame | None = None) -> DataFrame:
    """same / different / nested cases on a partition, blob-proof.

    cases: case, relation, members (';' of cohort|label), required, waived. A `same` case merged
    only in the largest cluster, or in one without a positive marker in its name, fails.
    `cohorts` keeps only members of training cohorts; fewer than two left is n/a.
    """
    m = cases.select("case", "relation", "required", "waived", F.posexplode(F.split("members", ";")).alias("pos", "m"))
    m = m.withColumn("cohort", F.substring_index("m", "|", 1)).withColumn("label", F.expr("substring(m, instr(m, '|') + 1)"))
    if cohorts is not None:
        m = m.join(cohorts.select("cohort"), "cohort", "left_semi")
    m = m.join(label_map.select("cohort", "label", "cluster"), ["cohort", "label"], "left")
    sizes = label_map.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.agg(F.max_by("cluster", F.struct(F.col("k"), -F.col("cluster"))).alias("cluster"))
    blobs = largest.unionByName(names.where(~F.col("cluster_name").contains("+")).select("cluster")).distinct().withColumn("_blob", F.lit(True))
    m = m.join(blobs, "cluster", "left")
    g = m.groupBy("case", "relation", "required", "waived").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster").isNull()).alias("missing"),
        F.countDistinct("cluster").alias("k"), F.coalesce(F.bool_or("_blob"), F.lit(False)).alias("blob"),
        F.min_by("cluster", "pos").alias("child"), F.max_by("cluster", "pos").alias("parent"))
    e = edges.select("child", "parent", F.lit(True).alias("_e"))
    g = g.join(e, ["child", "parent"], "left")
    names_of = F.col("relation")
    result = (
        F.when((F.col("n") < 2) | (F.col("missing") > 0), "n/a")
        .when(names_of == "same", F.when((F.col("k") == 1) & ~F.col("blob"), "PASS").otherwise("FAIL"))
        .when(names_of == "different", F.when(F.col("k") == F.col("n"), "PASS").otherwise("FAIL"))
        .when(F.col("child") == F.col("parent"), "merged")
        .when(F.coalesce("_e", F.lit(False)), "PASS").otherwise("FAIL"))
    listed = cases.select("case", "relation", "required", "waived")
    return listed.join(g.select("case", "n", "k", result.alias("result")), "case", "left").select(
        "case", "relation", "required", "waived", F.coalesce("n", F.lit(0)).alias("members"),
        F.coalesce("k", F.lit(0)).alias("clusters"), F.coalesce("result", F.lit("n/a")).alias("result"))


def unreliable_clusters(scored: DataFrame, cases: DataFrame, label_map: DataFrame, names: DataFrame,
                        registry: DataFrame) -> DataFrame:
    """Clusters of waived failed required cases: cluster, flagged, exempt.

    Exempt: at least three tissues, a positive name, the plurality of a case's members, and not
    the largest cluster.
    """
    bad = scored.where("required = 1 AND waived = 1 AND result = 'FAIL'").select("case")
    m = cases.join(bad, "case", "left_semi").select("case", F.explode(F.split("members", ";")).alias("m"))
    m = m.select("case", F.substring_index("m", "|", 1).alias("cohort"), F.expr("substring(m, instr(m, '|') + 1)").alias("label"))
    m = m.join(label_map.select("cohort", "label", "cluster"), ["cohort", "label"])
    per = m.groupBy("case", "cluster").agg(F.count(F.lit(1)).alias("k"))
    top = per.groupBy("case").agg(F.max("k").alias("k"))
    plural = per.join(top, ["case", "k"]).select("cluster").distinct().withColumn("_pl", F.lit(True))
    tissues = label_map.join(registry.select("cohort", "tissue"), "cohort").groupBy("cluster").agg(
        F.countDistinct("tissue").alias("tissues"), F.count(F.lit(1)).alias("labels"))
    largest = tissues.agg(F.max_by("cluster", F.struct(F.col("labels"), -F.col("cluster"))).alias("cluster")).withColumn("_lg", F.lit(True))
    f = (m.select("cluster").distinct().join(plural, "cluster", "left").join(tissues, "cluster")
         .join(names, "cluster").join(largest, "cluster", "left"))
    exempt = ((F.col("tissues") >= 3) & F.col("cluster_name").contains("+") & F.coalesce("_pl", F.lit(False))
              & F.col("_lg").isNull())
    return f.select("cluster", (~exempt).alias("flagged"), exempt.alias("exempt"))


# ---------------------------------------------------------------------------- name baselines
def name_similarity(labels: DataFrame, method: str, id_col: str = "lid", name_col: str = "label") -> DataFrame:
    """Similarity of label names, a < b, zero pairs left out.

    exact: equal cleaned names; token, char3: Jaccard; tfidf: cosine of 2-4-character word-bounded
    n-grams. All through an inverted-index equi-join on the shared gram.
    """
    n = labels.select(F.col(id_col).alias("id"), name_key(name_col).alias("n"))
    if method == "exact":
        a = n.select(F.col("id").alias("a"), "n")
        return a.join(n.select(F.col("id").alias("b"), "n"), "n").where("a < b").select("a", "b", F.lit(1.0).alias("sim"))
    if method == "tfidf":
        words = n.select("id", F.explode(F.split("n", " ")).alias("w")).where("w <> ''")
        words = words.withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
        grams = words.withColumn("len", F.explode(F.sequence(F.lit(2), F.lit(4)))).where("length(w) >= len OR len = 2")
        grams = grams.select("id", F.explode(F.expr(
            "transform(sequence(1, greatest(length(w) - len + 1, 1)), i -> substring(w, i, len))")).alias("g"))
        tf = grams.groupBy("id", "g").agg(F.count(F.lit(1)).alias("tf"))
        total = float(n.select("id").distinct().count())  # a vocabulary of names
        df = tf.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        x = tf.join(df, "g").withColumn("v", F.col("tf") * (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0))
        x = x.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))).select("id", "g", "v")
        a = x.select(F.col("id").alias("a"), "g", F.col("v").alias("va"))
        b = x.select(F.col("id").alias("b"), "g", F.col("v").alias("vb"))
        return a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("sim"))
    if method == "token":
        grams = n.select("id", F.explode(F.array_distinct(F.split("n", " "))).alias("g"))
    elif method == "char3":
        grams = n.select("id", F.explode(F.expr(
            "array_distinct(transform(sequence(1, greatest(length(n) - 2, 1)), i -> substring(n, i, 3)))")).alias("g"))
    else:
        raise ValueError(f"unknown name similarity {method}")
    size = grams.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    g = grams.join(size, "id")
    a = g.select(F.col("id").alias("a"), "g", F.col("k").alias("ka"))
    b = g.select(F.col("id").alias("b"), "g", F.col("k").alias("kb"))
    inter = F.count(F.lit(1))
    return a.join(b, "g").where("a < b").groupBy("a", "b", "ka", "kb").agg(inter.alias("i")).select(
        "a", "b", safe_div("i", F.col("ka") + F.col("kb") - F.col("i")).alias("sim"))
