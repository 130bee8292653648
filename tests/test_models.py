"""Probe inputs and arms."""

import math
from statistics import fmean, pstdev

import __spark_entry__ as entry
from cohortweave.operators import models, tables


def test_standardise_is_fitted_on_training_rows(spark):
    rows = [(1, [1.0, 5.0, -3.0], False), (2, [7.0, 5.0, 4.0], False), (3, [0.0, 5.0, 2.0], False), (4, [1e6, 9.0, -1e6], True)]
    x = spark.createDataFrame(rows, "id int, raw array<double>, is_test boolean")
    got = {r["id"]: r["raw"] for r in models.standardise(x, "raw", x.where("NOT is_test")).collect()}
    log = lambda v: math.log1p(max(v, 0.0))
    for i in (0, 2):
        train = [log(r[1][i]) for r in rows if not r[2]]
        for n, v, _ in rows:
            assert abs(got[n][i] - (log(v[i]) - fmean(train)) / pstdev(train)) < 1e-9
    assert all(v[1] == 0.0 for v in got.values())


def test_standardise_keeps_groups_apart(spark):
    rows = [("a", [1.0, 2.0], False), ("a", [3.0, 8.0], False), ("b", [10.0, 0.0], False), ("b", [30.0, 0.0], True)]
    x = spark.createDataFrame(rows, "cohort string, raw array<double>, is_test boolean")
    got = sorted((r["cohort"], *[round(v, 6) for v in r["raw"]]) for r in models.standardise(x, "raw", x.where("NOT is_test"), ["cohort"]).collect())
    assert got == [("a", -1.0, -1.0), ("a", 1.0, 1.0), ("b", 0.0, 0.0), ("b", 0.0, 0.0)]


def test_transfer_has_covariates_and_a_pooled_source(spark):
    got = entry.queries()["transfer_matrix"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({(r["source"], r["target"]) for r in got}) == 20
    assert all(len({r["pooled"] for r in got if r["target"] == t}) == 1 for t in {r["target"] for r in got})
    c12 = next(r for r in got if (r["source"], r["target"]) == ("C1", "C2"))
    assert (c12["n_src"], c12["n_tgt"], c12["shared"]) == (54, 58, 48) and c12["class_cover"] == 1.0


def test_feature_comparison_reads_standardised_values(spark, monkeypatch):
    seen = []
    real = models.standardise
    monkeypatch.setattr(models, "standardise", lambda *a: seen.append(a[1]) or real(*a))
    got = entry.queries()["feature_comparison"](spark, "/root/testdata/sf0.001").collect()
    assert seen == ["raw"] and {r["cohort"] for r in got} == {f"C{i}" for i in range(5)}


def test_fixed_panels_are_cut_from_one_pack(spark, monkeypatch):
    seen, packs, real = {}, [], tables.panel_vectors
    monkeypatch.setattr(tables, "panel_vectors", lambda *a, **k: (packs.append(1), real(*a, **k))[1])

    def fit(train, test, features, label, n_class, width):
        seen[width] = [sorted((r["cls"], *r["u"]) for r in t.collect()) for t in (train, test)]
        return test.withColumn("y_pred", test["cls"])
    monkeypatch.setattr(models, "panel_mlp", fit)
    got = entry.queries()["fixed_panel_mlp"](spark, "/root/testdata/sf0.001").collect()
    assert len(packs) == 1 and sorted(seen) == [48, 58, 64] and {r["arm"] for r in got} == {"core", "shared", "zero_fill"}
    assert all(len(train) == 400 and len(test) == 100 for train, test in seen.values())
    assert all(set(r[1:11]) == {0.0} and 0.0 not in r[11:] for r in seen[64][1])  # C1 does not measure m00 to m09


def test_every_cohort_is_held_out_in_every_arm(spark, monkeypatch):
    seen = []

    def fit(train, test, features, label, n_class, width):
        seen.append((width, *[tuple(sorted({r[0] for r in t.select("cohort").distinct().collect()})) for t in (train, test)]))
        return test.withColumn("y_pred", test["cls"])
    monkeypatch.setattr(models, "panel_mlp", fit)
    monkeypatch.setattr(models, "fold_mlp", fit)
    got = entry.queries()["fixed_panel_mlp"](spark, "/root/testdata/sf0.001").collect()
    cohorts = [f"C{i}" for i in range(5)]
    assert sorted((r["arm"], r["held"]) for r in got) == [(a, h) for a in ("core", "shared", "zero_fill") for h in cohorts]
    assert all(r["macro_f1"] == 1.0 for r in got)
    shared = {"C0": 48, "C1": 58, "C2": 54, "C3": 48, "C4": 48}  # C1 lacks ten markers, C2 six others
    want = {(w, tuple(c for c in cohorts if c != h), (h,)) for h in cohorts for w in (48, 64, shared[h])}
    assert sorted(seen) == sorted(want)  # a panel that serves two arms is fitted once
