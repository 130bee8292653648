import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortweave.operators import sampling as SM
from cohortweave.operators import spatial as S


def brute(p, k):
    out = []
    for img, g in p.groupby("image"):
        xy, ids = g[["x", "y"]].to_numpy(), g["id"].to_numpy()
        for i in range(len(g)):
            d2 = ((xy - xy[i]) ** 2).sum(1)
            order = [j for j in np.lexsort((ids, d2)) if j != i][:k]
            out += [(img, ids[i], ids[j], r + 1, max(np.sqrt(d2[j]), 1e-3)) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["image", "src", "dst", "rank", "d"])


def points():
    """A crowded image with a stack of copies, a dense clump and far outliers; a line; tiny images."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(60, 4.0), rng.normal(50, 0.01, 150), rng.uniform(0, 1000, 120), [9000.0, -5000.0]])
    y = np.concatenate([np.full(60, 4.0), rng.normal(50, 0.01, 150), rng.uniform(0, 1000, 120), [9000.0, 20.0]])
    big = pd.DataFrame({"image": "big", "x": x, "y": y})
    line = pd.DataFrame({"image": "line", "x": np.arange(40.0), "y": 0.0})
    small = pd.DataFrame({"image": "small", "x": [0.0, 1.0, 5.0], "y": [0.0, 0.0, 0.0]})
    one = pd.DataFrame({"image": "one", "x": [2.0], "y": [2.0]})
    p = pd.concat([big, line, small, one], ignore_index=True)
    p["id"] = np.random.default_rng(2).permutation(len(p)).astype("int64")
    return p


def test_knn_is_exact(spark, many_chunks):
    p = points()
    for k in (3, 15):
        got = S.knn(spark.createDataFrame(p), ["image"], "id", "x", "y", k).toPandas()
        want = brute(p, k)
        key = ["image", "src", "rank"]
        j = want.merge(got, on=key, suffixes=("", "_g"), how="outer")
        assert len(got) == len(want) == len(j)
        assert (j["dst"] == j["dst_g"]).all()
        assert np.allclose(j["d"], j["d_g"])


def test_row_sized_sides_are_never_broadcast(spark):
    """Spark judges a stored side by its compressed file; only counted per-image tables may go through the driver."""
    p = spark.createDataFrame(points())
    e = S.knn(p, ["image"], "id", "x", "y", 3)
    h = S.homotypic(e, p.withColumn("label", p["id"] % 3), ["image"], "id", "label")
    for df, joins in ((e, 2), (h, 4)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("SortMergeJoin") == joins


def test_non_finite_points_are_left_out(spark):
    p = points()
    p.loc[p.index[:5], "x"] = np.nan
    df = spark.createDataFrame(p)
    e = S.knn(df, ["image"], "id", "x", "y", 3)
    bad = set(p["id"][:5])
    assert not bad & {r["src"] for r in e.collect()} and not bad & {r["dst"] for r in e.collect()}
    a = {r["image"]: r for r in S.graph_audit(e, df, "image", "image", "id", "x", "y").collect()}
    assert a["big"]["dropped"] == 5 and a["one"]["isolated"] == 1


def test_derangement_moves_every_row(spark, many_chunks):
    df = spark.createDataFrame(points())
    s = SM.derangement(df, ["image"], "id")
    moved = {r["image"]: r["moved"] for r in SM.moved_fraction(s, ["image"], "id").collect()}
    assert moved["big"] == moved["line"] == 1.0 and moved["one"] == 0.0
    assert s.select("donor").distinct().count() == df.count()


@pytest.mark.parametrize("whole,pairs", [(8192, 1 << 20), (100, 900), (2, 1)])
def test_neighbourhoods_carry_the_values_of_the_edges(spark, many_chunks, monkeypatch, whole, pairs):
    """Whole images in a task and images over cells give the same neighbours, in order, ties by id."""
    monkeypatch.setattr(S, "WHOLE_IMAGE", whole)
    monkeypatch.setattr(S, "PAIRS", pairs)
    p = points()
    df = spark.createDataFrame(p.assign(v=p["id"].astype(float))).withColumn("w", F.when(F.col("id") % 3 > 0, F.col("v")))
    got = {(r["image"], r["src"]): r for r in S.neighbourhoods(df, ["image"], "id", "x", "y", ["v", "w"], 5).collect()}
    want = {k: [float(i) for i in g["dst"]] for k, g in brute(p, 5).groupby(["image", "src"])}
    assert {k: r["near_v"] for k, r in got.items()} == want and all(r["v"] == r["src"] for r in got.values())
    assert all(r["near_w"] == [v if v % 3 else None for v in r["near_v"]] for r in got.values())


@pytest.mark.parametrize("name", ["pooled_profile", "heterogeneity", "boundary_score", "anisotropy"])
def test_edges_are_not_shuffled_for_values(spark, name):
    """k rows a point must not travel again for what the search had in hand."""
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange") == 1 and df.count() > 0
