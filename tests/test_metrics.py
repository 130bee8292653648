import numpy as np
from pyspark.sql import functions as F

from cohortweave.operators import metrics as M
from cohortweave.operators import protocol as P

KEYS = ["held"]


def preds(spark, n=3000):
    rng = np.random.default_rng(20)
    t = rng.integers(0, 6, n)
    p = np.where(rng.random(n) < 0.7, t, rng.integers(0, 7, n))  # class 6 is called but never true
    return spark.createDataFrame([(int(i), "c", "c", "m", "LOCO", int(a), int(b)) for i, (a, b) in enumerate(zip(t, p))],
                                 "cell_id long, cohort string, held string, method string, protocol string, y_true long, y_pred long"), t, p


def test_scores_by_hand(spark):
    df, t, p = preds(spark)
    c = M.confusion(df, KEYS)
    rows = {r["cls"]: r for r in M.per_class(c, KEYS).collect()}
    assert set(rows) == set(range(6)) and sum(r["support"] for r in rows.values()) == len(t)
    for k, r in rows.items():
        tp = ((t == k) & (p == k)).sum()
        prec, rec = tp / (p == k).sum(), tp / (t == k).sum()
        assert abs(r["precision"] - prec) < 1e-12 and abs(r["recall"] - rec) < 1e-12
        assert r["f1_r"] == round(2 * prec * rec / (prec + rec), 4)
    m = M.confusion_matrix(c, KEYS)
    assert m.agg(F.max("y_pred").alias("x")).first()["x"] == 5
    keep = p < 6
    po = (t[keep] == p[keep]).mean()
    pe = sum((t[keep] == k).mean() * (p[keep] == k).mean() for k in range(6))
    assert abs(M.kappa(c, KEYS).first()["cohen_kappa"] - (po - pe) / (1 - pe)) < 1e-12


def test_drop_is_consistent(spark):
    df, t, _ = preds(spark)
    drop = spark.createDataFrame([(0,)], "cls long")
    c = M.confusion(df, KEYS)
    assert 0 not in {r["cls"] for r in M.per_class(c, KEYS, drop).collect()}
    assert M.kappa(c, KEYS, drop).first()["cohen_kappa"] != M.kappa(c, KEYS).first()["cohen_kappa"]
    s = M.support_stratified(M.per_class(c, KEYS, drop), KEYS).collect()
    assert len(s) == 4 and sum(r["n_classes"] for r in s) == 5


def test_one_class_has_no_kappa(spark):
    df = spark.createDataFrame([("h", 1, 1), ("h", 1, 2)], "held string, y_true long, y_pred long")
    assert M.kappa(M.confusion(df, KEYS), KEYS).first()["cohen_kappa"] is None


def test_gate_states(spark):
    rules = spark.createDataFrame([("1", "a", ">", 0.0, 1, 0), ("2", "b", ">", 1.0, 1, 1), ("3", "z", ">", 0.0, 0, 0)],
                                  "check string, quantity string, relation string, threshold double, required int, waived int")
    measured = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "quantity string, value double")
    g = M.gate(measured, rules)
    assert [r["status"] for r in g.orderBy("check").collect()] == ["PASS", "WAIVED", "NOT MEASURED"]
    assert M.gate_verdict(g).first()["verdict"] == "SHIPPED UNDER WAIVER"


def test_detection_scores(spark):
    rng = np.random.default_rng(4)
    s, y = np.round(rng.random(400), 2), rng.random(400) < 0.2
    r = P.detection_scores(spark.createDataFrame([("k", bool(a), float(b)) for a, b in zip(y, s)], "k string, pos boolean, s double"), ["k"], "pos", "s").first()
    a, b = s[y], s[~y]
    assert abs(r["auroc"] - ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())) < 1e-9
    ap = sum(((s >= v) & y).sum() / (s >= v).sum() * ((s == v) & y).sum() for v in np.unique(s)) / y.sum()
    assert abs(r["auprc"] - ap) < 1e-9


def test_permuted_labels_keep_counts(spark):
    df = spark.createDataFrame([("A", i, "x" if i % 3 else "y") for i in range(90)], "cohort string, id long, label string")
    p = P.permute_labels(df, "id", "label")
    assert p.where("permuted = 'y'").count() == 30 and p.where("permuted <> label").count() > 0
