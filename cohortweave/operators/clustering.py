"""Average-linkage clustering as rounds of reciprocal-nearest-neighbour merges on a pair table.

Average linkage is reducible, so every mutual nearest pair may merge in the same round. Any number
of independent problems (folds, held-out sets, branches) run in the same rounds under key columns.
Only comparable pairs are stored: a missing pair has distance FAR. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.agreement import ari, cohort_guards, contingency
from cohortweave.operators.labelspace import FAR
from cohortweave.session import materialise, materialise_counted

# --- fixed values --------------------------------------------------------------------
CUTS = tuple(round(0.30 + 0.025 * i, 4) for i in range(35))
MAX_CLUSTER_SHARE = 0.25
MIN_CROSS_SHARE = 0.95
COHORT_ARI_MAX = 0.20
MIN_SPLIT_LABELS = 2
MIN_SPLIT_COHORTS = 2
MIN_STRADDLE = 2
SPLIT_SUPPORT = 0.5
LOG_COLUMNS = "labels long, min_side long, min_cohorts long, straddle long, stability double, reason string, kept boolean"
# -------------------------------------------------------------------------------------


def merge_tree(pairs: DataFrame, keys: Sequence[str], far: float = FAR,
               stop: float | None = None) -> DataFrame:
    """Merge forest of every keyed problem: keys, child, parent, height, round.

    pairs: keys, a < b, d. Heights stay below `far`; clusters that are only FAR apart never merge.
    `stop` is the highest cut anyone will ask for, to save rounds.
    """
    keys = list(keys)
    state, n = materialise_counted(pairs.select(
        *keys, "a", "b", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"),
        F.col("d").cast("double").alias("s"), F.lit(1).cast("long").alias("n")))
    rounds: list[DataFrame] = []
    while n > 0:
        merges = _mutual_nearest(state, keys, far, stop)
        rounds.append(merges.withColumn("round", F.lit(len(rounds))))
        before = n
        state, n = materialise_counted(_apply_merges(state, merges, keys))
        if n == before:  # every merge removes its own pair row
            break
    tree = [r.select(*keys, "child", "parent", "height", "round") for r in rounds]
    if not tree:
        tree = [_mutual_nearest(state, keys, far, stop).withColumn("round", F.lit(0)).select(*keys, "child", "parent", "height", "round")]
    # each round's merges are re-read from that round's stored state, all in one job
    return materialise(reduce(DataFrame.unionByName, tree))


def _mutual_nearest(state: DataFrame, keys: list[str], far: float, stop: float | None) -> DataFrame:
    """Pairs that are each other's nearest cluster, below far. Ties: smaller ids."""
    slots = F.col("na") * F.col("nb")
    dist = (F.col("s") + F.lit(far) * (slots - F.col("n"))) / slots
    seen = state.withColumn("h", dist).where(F.col("h") < far)
    near = (seen.select(*keys, F.struct("h", "a", "b", "na", "nb").alias("m"), F.explode(F.array("a", "b")).alias("c"))
            .groupBy(*keys, "c").agg(F.min("m").alias("m")))
    mutual = near.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("votes")).where("votes = 2")
    if stop is not None:
        mutual = mutual.where(F.col("m.h") <= stop + 1e-12)
    return mutual.select(
        *keys, F.col("m.b").alias("child"), F.col("m.a").alias("parent"), F.col("m.h").alias("height"),
        (F.col("m.na") + F.col("m.nb")).alias("size"))


def _apply_merges(state: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Relabel both ends of every pair and sum the pair statistics of merged clusters."""
    move = merges.select(*keys, F.explode(F.array("child", "parent")).alias("old"), F.col("parent").alias("new"), "size")
    x = state
    for side, n in (("a", "na"), ("b", "nb")):
        t = move.select(*keys, F.col("old").alias(side), F.col("new").alias("_new"), F.col("size").alias("_size"))
        x = x.join(t, [*keys, side], "left").withColumn(side, F.coalesce("_new", side)).withColumn(
            n, F.coalesce("_size", n)).drop("_new", "_size")
    swap = F.col("a") > F.col("b")
    x = x.where("a <> b").select(
        *keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), "s", "n")
    return x.groupBy(*keys, "a", "b", "na", "nb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def cut_tree(tree: DataFrame, nodes: DataFrame, keys: Sequence[str], limit: DataFrame | None = None,
             cuts: Sequence[float] = ()) -> DataFrame:
    """Membership at one or more heights: keys, cut, node, cluster (= smallest node id).

    nodes: keys, node. Either `cuts` for every problem, or `limit`: keys plus a `cut` column.
    Heights rise along every path, so dropping edges above the cut leaves exactly its clusters;
    pointers are then doubled until they cover the number of rounds.
    """
    keys = list(keys)
    depth = tree.agg(F.coalesce(F.max("round"), F.lit(0)).alias("r")).first()["r"] + 1
    if limit is None:
        n = nodes.select(*keys, "node").withColumn("cut", F.explode(F.lit([float(c) for c in cuts])))
    else:
        n = nodes.select(*keys, "node").join(limit, [k for k in keys if k in limit.columns])
    g = [*keys, "cut"]
    p = n.join(tree.select(*keys, F.col("child").alias("node"), "parent", "height"), [*keys, "node"], "left").select(
        *g, "node", F.when(F.col("height") <= F.col("cut") + 1e-12, F.col("parent")).otherwise(F.col("node")).alias("p"))
    reach = 1
    while reach < depth:
        p = materialise(p)
        q = p.select(*g, F.col("node").alias("p"), F.col("p").alias("pp"))
        p = p.join(q, [*g, "p"]).select(*g, "node", F.col("pp").alias("p"))
        reach *= 2
    return p.withColumnRenamed("p", "cluster")


def cluster_at(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], cut: float) -> DataFrame:
    """Average linkage cut at one height."""
    return cut_tree(merge_tree(pairs, keys, stop=cut), nodes, keys, cuts=[cut]).drop("cut")


def cluster_to_k(pairs: DataFrame, nodes: DataFrame, k: int, far: float = 1.0) -> DataFrame:
    """Average linkage down to k clusters (distances in [0, far], absent pairs at far).

    If the comparable part stops above k, the leftover clusters are all exactly `far` apart and are
    joined in id order, as any tie rule must pick an order.
    """
    keys = ["_one"]
    n = nodes.withColumn("_one", F.lit(0))
    tree = merge_tree(pairs.withColumn("_one", F.lit(0)), keys, far)
    total = n.count()
    merges = tree.count()
    need = total - k
    if merges >= need:
        # exactly the first `need` merges, so merges tied with the last of them do not slip in
        first = tree.orderBy("height", "round", "child").limit(max(need, 0))
        return cut_tree(materialise(first), n, keys, cuts=[far]).select("node", "cluster")
    m = cut_tree(tree, n, keys, cuts=[far]).select("node", "cluster")
    from pyspark.sql.window import Window
    ids = m.select("cluster").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster")))
    first = ids.agg(F.min("cluster").alias("_f")).first()["_f"]
    extra = (total - merges) - k
    return m.join(ids, "cluster").select("node", F.when(F.col("_r") <= extra + 1, F.lit(first)).otherwise(F.col("cluster")).alias("cluster"))


def held_out_problems(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The full problem (held = '') and one copy per held-out cohort with its labels removed.

    pairs: keys, a, b, d; nodes: keys, node, cohort, n_cells.
    """
    keys = list(keys)
    side = nodes.select(*keys, "node", "cohort")
    p = (pairs.join(side.select(*keys, F.col("node").alias("a"), F.col("cohort").alias("_ca")), [*keys, "a"])
         .join(side.select(*keys, F.col("node").alias("b"), F.col("cohort").alias("_cb")), [*keys, "b"]))
    if keys:
        roster = nodes.select(*keys, F.explode(F.array(F.col("cohort"), F.lit(""))).alias("held")).distinct()
        n, p = nodes.join(roster, keys), p.join(roster, keys)
    else:
        held = F.explode(F.lit([r[0] for r in nodes.select("cohort").distinct().collect()] + [""]))  # one row per dataset
        n, p = nodes.withColumn("held", held), p.withColumn("held", held)
    return p.where("_ca <> held AND _cb <> held").drop("_ca", "_cb"), n.where("cohort <> held")


def cut_sweep(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str] = (), cuts: Sequence[float] = CUTS) -> DataFrame:
    """Every cut scored: clusters, biggest, guards, leave-one-cohort-out stability, violation.

    One merge tree per held-out set, all built in the same rounds, then read at every cut.
    """
    keys = list(keys)
    p, n = held_out_problems(pairs, nodes, keys)
    n = materialise(n)
    hk = [*keys, "held"]
    tree = merge_tree(p, hk, stop=max(cuts))
    m = materialise(cut_tree(tree, n.select(*hk, "node"), hk, cuts=cuts).join(n, [*hk, "node"]))
    full = m.where("held = ''").drop("held")
    g = cohort_guards(full, [*keys, "cut"])
    sub = m.where("held <> ''").select(*keys, "cut", "held", "node", F.col("cluster").alias("cs"), "n_cells")
    j = sub.join(full.select(*keys, "cut", "node", "cluster"), [*keys, "cut", "node"])
    r = ari(contingency(j, "cluster", "cs", [*keys, "cut", "held"], "n_cells"), "cluster", "cs", [*keys, "cut", "held"])
    s = r.groupBy(*keys, "cut").agg(F.avg("ari").alias("stability"))
    out = g.join(s, [*keys, "cut"])
    seed = (F.col("cross_cohort_share") >= MIN_CROSS_SHARE) & (F.col("cohort_ari") <= COHORT_ARI_MAX)
    zero = F.lit(0.0)
    viol = F.greatest(
        F.greatest((MIN_CROSS_SHARE - F.col("cross_cohort_share")) / MIN_CROSS_SHARE, zero),
        F.greatest((F.col("biggest_share") - MAX_CLUSTER_SHARE) / MAX_CLUSTER_SHARE, zero),
        F.greatest((F.col("cohort_ari") - COHORT_ARI_MAX) / COHORT_ARI_MAX, zero))
    return out.withColumn("seed_ok", seed).withColumn(
        "usable", seed & (F.col("biggest_share") <= MAX_CLUSTER_SHARE)).withColumn("violation", viol)


def choose_cut(sweep: DataFrame, keys: Sequence[str] = (), fallback: str = "stable", rule: str = "usable") -> DataFrame:
    """Most stable usable cut (ties: smallest cut); keys, tau, usable_cut, stability, violation.

    With no usable cut: 'stable' takes the most stable of all, 'nearest' the most stable among the
    least guard violation. rule='seed' takes the finest cut whose preserved guards hold.
    """
    keys = list(keys)
    s = sweep.withColumn("_g", F.lit(0)).withColumn("_st", F.round("stability", 9))
    g = [*keys, "_g"]
    ok = "usable" if rule == "usable" else "seed_ok"
    any_ok = s.groupBy(*g).agg(F.bool_or(ok).alias("_any"), F.min(F.round("violation", 9)).alias("_mv"))
    j = s.join(any_ok, g)
    pool = F.when(F.col("_any"), F.col(ok)).otherwise(
        (F.round("violation", 9) == F.col("_mv")) if fallback == "nearest" else F.lit(True))
    order = F.struct(F.col("_st"), -F.col("cut")) if rule == "usable" else F.struct(-F.col("cut"))
    pick = j.where(pool).groupBy(*g).agg(F.max_by(F.struct("cut", "_any", "stability", "violation", "clusters"), order).alias("b"))
    return pick.select(*keys, F.col("b.cut").alias("tau"), F.col("b._any").alias("usable_cut"), F.col("b.stability").alias("stability"),
                       F.col("b.violation").alias("violation"), F.col("b.clusters").alias("clusters"))


def bisect(tree: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The two clusters under the top merge of each problem: keys, node, side (0/1).

    Problems that fall into exactly two FAR-apart parts split there; three or more such parts, or a
    tie at the top, have no two-cluster cut and give no rows.
    """
    keys = list(keys)
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    t = tree.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.max("height").alias("top"))
    tied = tree.join(t, keys).where("height >= top - 1e-12").groupBy(*keys).agg(F.count(F.lit(1)).alias("ties"))
    s = n.join(t, keys, "left").join(tied, keys, "left").na.fill({"m": 0, "ties": 0})
    parts = F.col("n") - F.col("m")
    cut = F.when(parts == 2, F.lit(FAR)).when((parts == 1) & (F.col("ties") == 1), F.col("top") - 1e-9)
    limit = s.select(*keys, cut.alias("cut")).where("cut IS NOT NULL")
    mem = cut_tree(tree, nodes.join(limit.select(*keys), keys, "left_semi"), keys, limit)
    low = mem.groupBy(*keys).agg(F.min("cluster").alias("_lo"))
    return mem.join(low, keys).select(*keys, "node", F.when(F.col("cluster") == F.col("_lo"), 0).otherwise(1).alias("side"))


def refine(pairs: DataFrame, nodes: DataFrame, straddle: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split clusters in two wherever the split reproduces when a cohort is held out.

    nodes: node, cohort, n_cells, cluster. All branches of a level, with all their held-out copies,
    run in one set of rounds. Returns (node, cohort, n_cells, cluster) and the split log. The loop
    ends when no branch splits; every kept split makes strictly smaller branches.
    """
    done: list[DataFrame] = []
    logs: list[DataFrame] = []
    active = materialise(nodes.select("node", "cohort", "n_cells", F.col("cluster").alias("branch")))
    for level in count():
        size = active.groupBy("branch").agg(F.count(F.lit(1)).alias("labels"))
        big = size.where(F.col("labels") >= 2 * MIN_SPLIT_LABELS)
        work = materialise(active.join(big, "branch"))
        done.append(active.join(big, "branch", "left_anti"))
        if work.isEmpty():
            break
        side = work.select("node", "branch")
        p = (pairs.join(side.select(F.col("node").alias("a"), "branch"), "a")
             .join(side.select(F.col("node").alias("b"), F.col("branch").alias("_bb")), "b").where("branch = _bb").drop("_bb"))
        hp, hn = held_out_problems(p, work.select("branch", "node", "cohort", "n_cells"), ["branch"])
        hn = materialise(hn)
        two = materialise(bisect(merge_tree(hp, ["branch", "held"]), hn, ["branch", "held"]))
        full = two.where("held = ''").select("branch", "node", "side").join(work.select("node", "cohort"), "node")
        per = full.groupBy("branch", "side").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("cohort").alias("c"))
        shape = per.groupBy("branch").agg(F.min("k").alias("min_side"), F.min("c").alias("min_cohorts"), F.count(F.lit(1)).alias("sides"))
        both = full.groupBy("branch", "cohort").agg(F.countDistinct("side").alias("s")).groupBy("branch").agg(
            F.count_if(F.col("s") == 2).alias("straddle"))
        sub = (two.where("held <> ''").select("branch", "held", "node", F.col("side").alias("ss"))
               .join(full.select("branch", "node", "side"), ["branch", "node"]))
        # every hold-out that leaves four labels and both sides counts; one without a two-way split agrees by 0
        left = hn.where("held <> ''").select("branch", "held", "node").join(full.select("branch", "node", "side"), ["branch", "node"])
        fit = left.groupBy("branch", "held").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("side").alias("s")).where("k >= 4 AND s = 2")
        agreed = ari(contingency(sub, "ss", "side", ["branch", "held"]), "ss", "side", ["branch", "held"])
        loco = fit.select("branch", "held").join(agreed, ["branch", "held"], "left").groupBy("branch").agg(
            F.avg(F.coalesce("ari", F.lit(0.0))).alias("stability"))
        rec = big.join(shape, "branch", "left").join(both, "branch", "left").join(loco, "branch", "left")
        reason = (
            F.when(F.col("sides").isNull() | (F.col("sides") < 2) | (F.col("min_side") < MIN_SPLIT_LABELS), "a side is too small")
            .when(F.col("min_cohorts") < MIN_SPLIT_COHORTS, "a side is one cohort only")
            .when(F.lit(straddle) & (F.col("straddle") < MIN_STRADDLE), "a boundary between cohort groups")
            .when(F.col("stability").isNull(), "no cohort can be held out")
            .when(F.col("stability") < SPLIT_SUPPORT, "does not reproduce").otherwise("kept"))
        rec = materialise(rec.select(F.lit(level).alias("level"), "branch", "labels", "min_side", "min_cohorts", "straddle",
                                     "stability", reason.alias("reason"), (reason == "kept").alias("kept")))
        logs.append(rec)
        kept = rec.where("kept").select("branch")
        done.append(work.join(kept, "branch", "left_anti").drop("labels"))
        grown = full.join(kept, "branch", "left_semi").groupBy("branch", "side").agg(F.min("node").alias("_new"))
        active = materialise(full.join(grown, ["branch", "side"]).join(work.select("node", "n_cells"), "node").select(
            "node", "cohort", "n_cells", F.col("_new").alias("branch")))
        if active.isEmpty():
            break
    cols = ["node", "cohort", "n_cells", "branch"]
    out = reduce(DataFrame.unionByName, [x.select(*cols) for x in done]).withColumnRenamed("branch", "cluster")
    log = reduce(DataFrame.unionByName, logs) if logs else nodes.sparkSession.createDataFrame(
        [], f"level int, branch {nodes.schema['cluster'].dataType.simpleString()}, {LOG_COLUMNS}")
    return out, log
