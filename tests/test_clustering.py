import itertools

import numpy as np
import pytest

from cohortweave.operators import agreement as A
from cohortweave.operators import clustering as C
from cohortweave.operators import nesting as N

FAR = 5.0


def brute(d, cut):
    """Sequential average linkage on a dense matrix, smallest (height, ids) first."""
    groups = {i: [i] for i in range(len(d))}
    while len(groups) > 1:
        best = min((np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        if best[0] > cut or best[0] >= FAR:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(d), int)
    for k, m in groups.items():
        out[m] = k
    return out


def case(seed, n, far=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * 0.4
    gap = np.triu(rng.random((n, n)) < far, 1)
    d[gap | gap.T] = FAR
    np.fill_diagonal(d, 0)
    return d


def frame(spark, mats):
    rows = [(k, i, j, float(d[i, j])) for k, d in mats.items() for i, j in itertools.combinations(range(len(d)), 2) if d[i, j] < FAR]
    nodes = [(k, i) for k, d in mats.items() for i in range(len(d))]
    return (spark.createDataFrame(rows, "fold string, a int, b int, d double"),
            spark.createDataFrame(nodes, "fold string, node int"))


def test_linkage_equals_sequential_merging(spark):
    mats = {"p": case(1, 14), "q": case(2, 11, 0.3), "r": case(3, 9, 0.0)}
    pairs, nodes = frame(spark, mats)
    tree = C.merge_tree(pairs, ["fold"])
    cuts = (0.3, 0.6, 0.9, 2.0)
    got = {}
    for r in C.cut_tree(tree, nodes, ["fold"], cuts=cuts).collect():
        got.setdefault((r["fold"], r["cut"]), {})[r["node"]] = r["cluster"]
    for k, d in mats.items():
        for c in cuts:
            assert [got[k, c][i] for i in range(len(d))] == brute(d, c).tolist(), (k, c)


def test_permuting_ids_keeps_the_partition(spark):
    d = case(7, 10)
    perm = np.random.default_rng(0).permutation(10)
    p, n = frame(spark, {"x": d, "y": d[np.ix_(perm, perm)]})
    m = {(r["fold"], r["node"]): r["cluster"] for r in C.cluster_at(p, n, ["fold"], 0.7).collect()}
    a = [m["x", perm[i]] for i in range(10)]
    b = [m["y", i] for i in range(10)]
    for i, j in itertools.combinations(range(10), 2):
        assert (a[i] == a[j]) == (b[i] == b[j])


def test_bisect_rules(spark):
    two_blobs = case(4, 6, 0.0)
    two_blobs[:3, 3:] = two_blobs[3:, :3] = FAR  # exactly two far parts
    three = np.full((3, 3), FAR)
    np.fill_diagonal(three, 0)
    pairs, nodes = frame(spark, {"two": two_blobs, "three": three})
    b = {(r["fold"], r["node"]): r["side"] for r in C.bisect(C.merge_tree(pairs, ["fold"]), nodes, ["fold"]).collect()}
    assert [b["two", i] for i in range(6)] == [0, 0, 0, 1, 1, 1]
    assert not any(k == "three" for k, _ in b)


@pytest.fixture(scope="module")
def planted(spark):
    """Three cohorts that each annotate the same two tight types inside one broad cluster."""
    rng = np.random.default_rng(11)
    nodes, pos = [], []
    for c in ("A", "B", "C"):
        for t in range(2):
            for _ in range(2):
                nodes.append((len(nodes), c, 10 + len(nodes), 0))
                pos.append(t * 1.0 + rng.normal() * 0.02)
    pairs = [(i, j, float(abs(pos[i] - pos[j]) + 0.01)) for i, j in itertools.combinations(range(len(pos)), 2)]
    return (spark.createDataFrame(pairs, "a int, b int, d double"),
            spark.createDataFrame(nodes, "node int, cohort string, n_cells int, cluster int"))


def test_refine_finds_the_planted_split(planted):
    pairs, nodes = planted
    out, log = C.refine(pairs, nodes)
    got = {r["node"]: r["cluster"] for r in out.collect()}
    assert len(got) == 12
    for c in set(got.values()):  # later levels may split a type further, never mix two
        assert len({(n // 2) % 2 for n in got if got[n] == c}) == 1
    top = log.where("level = 0").first()
    assert top["kept"] and top["min_side"] == 6 and top["straddle"] == 3 and top["stability"] == 1.0


def test_refine_without_a_branch_to_split_logs_nothing(spark):
    nodes = spark.createDataFrame([(i, "C0", 5, i) for i in range(4)], "node int, cohort string, n_cells long, cluster int")
    pairs = spark.createDataFrame([], "a int, b int, d double")
    out, log = C.refine(pairs, nodes)
    assert {r["cluster"] for r in out.collect()} == {0, 1, 2, 3}
    assert log.collect() == [] and log.columns[:3] == ["level", "branch", "labels"] and "stability" in log.columns


def test_sweep_stability_and_choice(planted, spark):
    pairs, nodes = planted
    d = np.zeros((12, 12))
    for r in pairs.collect():
        d[r["a"], r["b"]] = d[r["b"], r["a"]] = r["d"]
    info = nodes.orderBy("node").toPandas()
    sweep = {r["cut"]: r for r in C.cut_sweep(pairs, nodes.drop("cluster"), cuts=(0.02, 0.3, 2.0)).collect()}
    for cut, row in sweep.items():
        full, aris = brute(d, cut), []
        assert row["clusters"] == len(set(full))
        for c in "ABC":
            keep = np.flatnonzero(info.cohort != c)
            sub = brute(d[np.ix_(keep, keep)], cut)
            rows = spark.createDataFrame([(int(full[k]), int(s), float(info.n_cells[k])) for k, s in zip(keep, sub)], "x int, y int, w double")
            aris.append(A.ari(A.contingency(rows, "x", "y", weight="w"), "x", "y").first()["ari"])
        assert abs(row["stability"] - np.mean(aris)) < 1e-9
    import pyspark.sql.functions as F
    table = spark.createDataFrame(list(sweep.values()))
    pick = C.choose_cut(table, fallback="nearest").first()
    least = min(r["violation"] for r in sweep.values())
    assert not pick["usable_cut"] and abs(pick["violation"] - least) < 1e-9
    assert C.choose_cut(table.withColumn("usable", F.col("cut") == 0.3)).first()["tau"] == 0.3


def test_cluster_to_k(spark):
    d = case(9, 12, 0.0)
    d = d / d.max()
    pairs, nodes = frame(spark, {"x": d})
    m = C.cluster_to_k(pairs.drop("fold"), nodes.drop("fold"), 4).toPandas()
    assert m["cluster"].nunique() == 4 and len(m) == 12


def test_ari_identity_and_cycles(spark):
    t = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert A.ari(A.contingency(t, "a", "b"), "a", "b").first()["ari"] == 1.0
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4)], "child int, parent int")
    n = spark.createDataFrame([(i, i) for i in range(1, 7)], "node int, cluster int")
    got = {r["node"]: r["cluster"] for r in N.contract_cycles(e, n).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert N.has_cycle(e) and not N.has_cycle(e.where("child <> 3"))
