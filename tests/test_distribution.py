import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortweave.functions.numeric import clean
from cohortweave.operators import distribution as D
from cohortweave.operators import profile
from cohortweave.operators.tables import to_long


def skewed(spark):
    """One group holds most rows, half of them tied; a NaN, a NULL, an all-tied group, a singleton."""
    rng = np.random.default_rng(3)
    big = np.where(rng.random(4000) < 0.5, 7.0, np.round(rng.normal(size=4000), 2))
    rows = [("big", i, float(v)) for i, v in enumerate(big)]
    rows += [("tied", 10_000 + i, 1.0) for i in range(50)] + [("one", 20_000, 3.0)]
    rows += [("big", 30_000, float("nan")), ("big", 30_001, None)]
    return spark.createDataFrame(rows, "g string, id long, v double")


def pandas_u(df):
    p = df.toPandas()
    p["u"] = p.groupby("g")["v"].rank(pct=True, method="average")
    return p.set_index("id")["u"]


def test_ecdf_over_many_chunks_and_salts(spark, many_chunks):
    df = skewed(spark)
    want = pandas_u(df)
    for hot in (10**9, 100):
        got = D.ecdf(df, ["g"], "v", ["id"], hot_rows=hot).toPandas().set_index("id")["u"]
        pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    mean = D.ecdf(df, ["g"], "v", ["id"]).groupBy("g").agg(F.avg("u").alias("m"), F.count("u").alias("n")).toPandas()
    assert np.allclose(mean["m"], (mean["n"] + 1) / (2 * mean["n"]))


def test_chunks_are_really_several(spark, many_chunks):
    df = skewed(spark).withColumn("v", clean("v"))
    parts = df.groupBy("g", "v").count().repartitionByRange("g", "v").select(F.spark_partition_id().alias("p")).distinct()
    assert parts.count() > 1


def test_quantiles_match_numpy(spark, many_chunks):
    df = skewed(spark).withColumn("v", clean("v"))
    levels = (0.0, 0.02, 0.1, 0.5, 0.75, 0.98, 1.0)
    got = {r["g"]: r["q"] for r in D.quantiles(df, ["g"], "v", levels).collect()}
    for g, p in df.toPandas().dropna().groupby("g"):
        assert np.allclose(got[g], np.quantile(p["v"], levels))


def test_row_order_is_dense(spark, many_chunks):
    df = skewed(spark).select("g", F.md5(F.col("id").cast("string")).alias("k"))
    r = D.row_order(df, ["g"], "k").groupBy("g").agg(
        F.max("turn").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("turn").alias("d")).collect()
    assert all(x["hi"] + 1 == x["n"] == x["d"] for x in r)


def test_auroc_and_ks_against_brute_force(spark, many_chunks):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"cohort": rng.choice(["a", "b", "c"], 900, p=[0.7, 0.2, 0.1]), "marker": "m",
                      "label": rng.choice(["x", "y"], 900), "v": np.round(rng.normal(size=900), 1)})
    df = spark.createDataFrame(p)
    for r in D.auroc(df, ["cohort", "marker"], "label", "v", 5).collect():
        g = p[p.cohort == r["cohort"]]
        a, b = g[g.label == r["label"]].v.to_numpy(), g[g.label != r["label"]].v.to_numpy()
        want = ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())
        assert abs(r["auroc"] - want) < 1e-9
    for r in D.ks_distance(df, "cohort", "marker", "v").collect():
        a, b = np.sort(p[p.cohort == r["a"]].v), np.sort(p[p.cohort == r["b"]].v)
        grid = np.concatenate([a, b])
        want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
        assert abs(r["ks"] - want) < 1e-12


def test_column_ecdf_small_large_and_hot_groups(spark, many_chunks):
    rows = [("a", i, float(i % 3), None if i % 4 == 0 else float(i)) for i in range(12)]
    rows += [("b", 100, 2.0, float("nan")), ("b", 101, 1.0, 5.0), ("c", 200, None, None)]
    want = {}
    for g, i, *vs in rows:
        for c, v in zip("xy", vs):
            have = [r["xy".index(c) + 2] for r in rows if r[0] == g]
            have = [h for h in have if h is not None and h == h]
            at, below = sum(h == v for h in have), sum(h < v for h in have if v is not None)
            want[i, c] = (below + (at + 1) / 2) / len(have) if at else None
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    for group_rows, hot_rows, sent in ((100, 2_000_000, 100), (5, 2_000_000, 100), (5, 3, 0), (0, 2, 3)):
        got = D.column_ecdf(df, ["g"], ["x", "y"], ["id"], group_rows, hot_rows, sent).collect()
        assert len(got) == len(rows)
        for r in got:
            for c in "xy":
                w = want[r["id"], c]
                assert r[c] == w if w is None else abs(r[c] - w) < 1e-12


def test_image_statistics_of_small_and_large_images_agree(spark):
    rows = [("a", f"i{i % 3}", None if i % 7 == 0 else float(i * i % 11), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "cohort string, image_id string, x double, y double")
    whole, cut = [sorted(map(tuple, profile.image_statistics(df, ["x", "y"], n).collect())) for n in (100, 0)]
    assert len(whole) == 6 and [r[:3] for r in whole] == [r[:3] for r in cut]
    assert np.allclose([r[3:] for r in whole], [r[3:] for r in cut])
    med = {i: np.median([r[2] for r in rows if r[1] == i and r[2] is not None]) for i in ("i0", "i1", "i2")}
    z = {i: (m - np.mean(list(med.values()))) / np.std(list(med.values()), ddof=1) for i, m in med.items()}
    assert all(abs(r[3] - z[r[1]]) < 1e-9 for r in whole if r[2] == "x")


def test_row_order_needs_no_value_table(spark, many_chunks):
    df = spark.createDataFrame([("ab"[i % 2], (i * 37) % 101, i) for i in range(100)] + [("a", None, 7)], "g string, k long, x long")
    pos = D.row_order(df, ["g"], "k", "at")
    rows = pos.collect()
    for g in "ab":
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: r["k"])
        assert [r["at"] for r in own] == list(range(50)) and all(r["k"] == (r["x"] * 37) % 101 for r in own)
    joins = [line for line in pos._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "_chunk" in joins[0]  # the offsets of ranges, not one row a value


def test_unfolded_rows_stay_with_their_cell(spark):
    wide = spark.createDataFrame([("a", i, float(i), None) for i in range(50)], "cohort string, cell_id long, x double, y double")
    long = to_long(wide.repartition(7, "cohort", "cell_id"), ["cohort", "cell_id"], ["x", "y"])
    counts = long.groupBy("cohort", "cell_id", "marker").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v"))
    assert {tuple(r) for r in counts.select("marker", "n", "v").collect()} == {("x", 1, 1), ("y", 1, 0)} and counts.count() == 100
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1


def test_row_ecdf_ranks_rows_where_they_lie(spark, many_chunks, monkeypatch):
    rows = [(f"g{i % 3}", "m", i, [None, float("nan"), 7.0, float(i % 50), i / 7][i % 5]) for i in range(900)]
    df = spark.createDataFrame(rows, "cohort string, marker string, id long, value double").repartition(5)
    keys = ["cohort", "marker"]
    want = sorted(map(repr, D.ecdf(df, keys, "value", ["id"]).select("cohort", "id", "u").collect()))
    monkeypatch.delattr(D, "attach_by_value")  # nothing is joined back by value
    got = D.row_ecdf(df, keys, "value")
    assert got.columns == [*df.columns, "u"]
    assert sorted(map(repr, got.select("cohort", "id", "u").collect())) == want
