"""Directed nesting between clusters: edges, strongly connected contraction, evidence-aware closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.labelspace import EVIDENCE_FLOOR
from cohortweave.session import materialise, materialise_counted

# fixed values
NEST_MIN, NEST_MARGIN, NEST_RELATED = 0.75, 0.10, 1.5


def cluster_pairs(pairs: DataFrame, members: DataFrame, floor: int = EVIDENCE_FLOOR) -> DataFrame:
    """Ordered cluster pairs: mean containment over comparable label pairs, their count, mean sim.

    pairs: lid_a, lid_b, contain, evidence, sim; members: node, cluster.
    """
    ok = (F.col("evidence") >= floor) & F.col("contain").isNotNull()
    return (pairs.join(members.select(F.col("node").alias("lid_a"), F.col("cluster").alias("child")), "lid_a")
            .join(members.select(F.col("node").alias("lid_b"), F.col("cluster").alias("parent")), "lid_b")
            .where("child <> parent").groupBy("child", "parent").agg(
                F.avg(F.when(ok, F.col("contain"))).alias("contain"), F.count_if(ok).alias("pairs"),
                F.avg("sim").alias("mean_sim")))


def nesting_edges(cp: DataFrame, cut: float, tau: float = NEST_MIN) -> DataFrame:
    """child, parent, contain, pairs where the child sits in the parent, not the reverse, and the
    two are within 1.5 cuts of each other."""
    back = cp.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("contain").alias("_back"))
    related = -F.log(F.greatest("mean_sim", F.lit(1e-9))) <= NEST_RELATED * cut
    return cp.join(back, ["child", "parent"], "left").where(
        (F.col("contain") >= tau) & F.coalesce(related, F.lit(False))
        & (F.col("_back").isNull() | (F.col("contain") - F.col("_back") >= NEST_MARGIN))
    ).select("child", "parent", "contain", "pairs")


def reachability(edges: DataFrame) -> DataFrame:
    """Transitive closure (child, parent) by path doubling to a fixpoint; cluster-sized."""
    reach, n = materialise_counted(edges.select("child", "parent").distinct())
    while True:
        step = reach.join(reach.select(F.col("child").alias("parent"), F.col("parent").alias("_p")), "parent").select(
            "child", F.col("_p").alias("parent"))
        reach, m = materialise_counted(reach.unionByName(step).distinct())
        if m == n:
            return reach
        n = m


def contract_cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Members with every strongly connected set of clusters merged into its smallest id."""
    r = reachability(edges)
    mutual = r.join(r.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"]).where("child <> parent")
    target = mutual.groupBy("child").agg(F.min("parent").alias("_m")).select(
        F.col("child").alias("cluster"), F.least("child", "_m").alias("_to"))
    return members.join(target, "cluster", "left").withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to")


def has_cycle(edges: DataFrame) -> bool:
    return not reachability(edges).where("child = parent").isEmpty()


def acyclic_nesting(pairs: DataFrame, members: DataFrame, cut: float, floor: int = EVIDENCE_FLOOR,
                    tau: float = NEST_MIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, edges, cluster pairs) with cycles contracted until the graph is a DAG.

    Each pass with a cycle removes at least one cluster, so the loop ends.
    """
    while True:
        cp = materialise(cluster_pairs(pairs, members, floor))
        edges = materialise(nesting_edges(cp, cut, tau))
        if not has_cycle(edges):
            return members, edges, cp
        members = materialise(contract_cycles(edges, members))


def closure(edges: DataFrame, cp: DataFrame, floor: int = EVIDENCE_FLOOR, tau: float = NEST_MIN) -> DataFrame:
    """Implied edges: bridged where too little was measured, violation where it was measured < tau.

    Implied pairs measured at or above tau but not drawn (related or margin rule) are left out.
    """
    implied = reachability(edges).join(edges.select("child", "parent"), ["child", "parent"], "left_anti")
    j = implied.join(cp.select("child", "parent", "contain", "pairs"), ["child", "parent"], "left").withColumn(
        "pairs", F.coalesce("pairs", F.lit(0)))
    kind = F.when(F.col("pairs") < floor, "bridged").when(F.col("contain") < tau, "violation")
    return j.withColumn("kind", kind).where("kind IS NOT NULL").select("child", "parent", "contain", "pairs", "kind")
