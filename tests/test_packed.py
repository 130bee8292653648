"""Packed rows against the joined form and numpy."""

import random

import numpy as np

from cohortweave.operators import models, packed, profile


def measured(spark, seed=3, cells=120, markers=9, classes=4):
    """Long rows with missing values and unmeasured markers, and fold prototypes that lack some markers."""
    rng = random.Random(seed)
    long = [(f"C{i % 3}", i, i % classes, f"m{j}", None if rng.random() < .1 else rng.random())
            for i in range(cells) for j in range(markers) if rng.random() < .8]
    long += [("C0", 500, 1, "m0", None), ("C1", 501, 1, "other", .5)]
    protos = [(f"C{h}", k, f"m{j}", rng.random()) for h in range(3) for k in range(classes) for j in range(markers) if rng.random() < .8]
    return (spark.createDataFrame(long, "held string, cell long, y long, marker string, u double"),
            spark.createDataFrame(protos, "held string, cls long, marker string, c double"))


def table(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_packed_scores_equal_joined_ones(spark, monkeypatch):
    long, protos = measured(spark)
    row = ["held", "cell", "y"]
    for predict in (models.prototype_predict, models.masked_profile_predict):
        got = table(predict(long, protos, row, "u"))
        monkeypatch.setattr(packed, "MATRIX_NUMBERS", 0)
        want = table(predict(long, protos, row, "u"))
        monkeypatch.undo()
        assert got == want and len(got) == 120
    for fold in ("C1", None):
        p = protos if fold is None else protos.where(f"held = '{fold}'").drop("held")
        got = table(models.cosine_scores(long, p, row, "u"))
        assert got == table(models.joined_scores(long, p, row, "u", "cosine")) and got


def test_scores_are_not_shuffled_by_class(spark):
    long, protos = measured(spark)
    df = models.prototype_predict(long, protos, ["held", "cell", "y"], "u")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_shares_sum_to_one(spark):
    long, protos = measured(spark)
    s = packed.class_scores(long, protos, ["held", "cell"], "u", "cosine").withColumn("p", models.softmax_shares("scores"))
    for r in s.collect():
        e = np.exp(np.array([x["score"] for x in r["scores"]]) / .1)
        assert np.allclose([x["p"] for x in r["p"]], e / e.sum()) and [x["cls"] for x in r["p"]] == [x["cls"] for x in r["scores"]]


def test_coexpression_over_cells_that_measure_both(spark, many_chunks):
    long, _ = measured(spark, cells=400)
    rows = [(r["held"], r["cell"], f"L{r['y']}", r["marker"], r["u"]) for r in long.collect()]
    rows += [("C9", i, "flat", m, 0.25 if m == "m0" else i / 7) for i in range(6) for m in ("m0", "m1")]
    df = spark.createDataFrame(rows, "cohort string, cell_id long, native_label string, marker string, u double").repartition(7)
    names = sorted({r[3] for r in rows})
    got = {(r["cohort"], r["label"], r["m1"], r["m2"]): r["r"] for r in profile.coexpression(df, ["cohort", "cell_id"], names).collect()}
    values = {}
    for c, i, lab, m, u in rows:
        if u is not None:
            values.setdefault((c, lab), {}).setdefault(m, {})[i] = u
    want = {}
    for (c, lab), by in values.items():
        for a in by:
            for b in by:
                both = sorted(by[a].keys() & by[b].keys())
                if a < b and both:
                    x, y = np.array([by[a][i] for i in both]), np.array([by[b][i] for i in both])
                    flat = x.std() < 1e-7 or y.std() < 1e-7
                    want[c, lab, a, b] = None if flat else np.corrcoef(x, y)[0, 1]
    assert got.keys() == want.keys() and None in want.values()
    for k, r in want.items():
        assert got[k] is None if r is None else abs(got[k] - r) < 1e-9
    df2 = profile.coexpression(df, ["cohort", "cell_id"], names)
    df2.collect()
    assert "Join" not in df2._jdf.queryExecution().executedPlan().toString()
