"""Keyed fits: the optimum itself, MLlib as a second opinion, and the few-shot grid recomputed in numpy."""

import hashlib
import random
from statistics import fmean, pstdev

import numpy as np
import pytest

from cohortweave.operators import fits, models


def blobs(rng, n, k, width, spread=1.0):
    centres = rng.normal(size=(k, width))
    y = rng.integers(0, k, n)
    return centres[y] + spread * rng.normal(size=(n, width)), y


@pytest.mark.parametrize("k,penalty", [(2, 1.0), (3, 1.0), (6, .01)])
def test_a_fit_is_the_optimum(k, penalty):
    rng = np.random.default_rng(k)
    x, y = blobs(rng, 80, k, 5)
    y[:k] = range(k)
    weight = rng.uniform(.5, 2, 80)
    w = fits.softmax_fit(x, y, k, weight, penalty)

    def loss(v):
        z = fits.logits(x, v)
        return weight @ (np.log(np.exp(z).sum(1)) - z[np.arange(80), y]) + penalty / 2 * (v[:, :-1] ** 2).sum()
    at = loss(w)
    for _ in range(200):
        assert loss(w + rng.normal(size=w.shape) * 10 ** rng.uniform(-4, 0)) >= at - 1e-7


def test_a_fit_agrees_with_mllib(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    x, y = blobs(rng, 200, 4, 3)
    df = spark.createDataFrame([("a", int(c), v.tolist()) for v, c in zip(x, y)], "key string, label int, vec array<double>")
    m = fits.fit_each(df, ["key"], "label", "vec").first()
    ours = np.array(m["weights"]).reshape(4, -1)
    theirs = LogisticRegression(family="multinomial", regParam=1 / 200, standardization=False, tol=1e-12, maxIter=1000).fit(
        df.select(array_to_vector("vec").alias("features"), df.label.cast("double").alias("label")))
    assert m["classes"] == [0, 1, 2, 3] and m["n_rows"] == 200
    assert np.allclose(ours[:, :-1], theirs.coefficientMatrix.toArray(), atol=1e-3)


def grid(seed=1):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    x, y = blobs(rng, 360, 4, 3, .8)
    return [(f"C{i % 2}", i, int(y[i]) if not (i % 2 and y[i] == 3 and i > 40) else 0, x[i].tolist(), pick.random() < .4) for i in range(360)]


@pytest.mark.parametrize("numbers", [4_000_000, 1])
def test_few_shot_grid(spark, many_chunks, monkeypatch, numbers):
    monkeypatch.setattr(fits, "MODEL_NUMBERS", numbers)  # 1: every model travels alone
    rows, shots, seeds = grid(), (1, 3, 500), (0, 1) if numbers > 1 else (4,)
    df = spark.createDataFrame(rows, "cohort string, id long, cls long, vec array<double>, is_test boolean")
    scores = models.few_shot(df, "vec", "cls", "id", shots, seeds)
    got = {(r["cohort"], r["shots"], r["seed"]): r["macro_f1"] for r in scores.collect()}
    for c in ("C0", "C1"):
        for n in shots:
            per = []
            for s in seeds:
                train = []
                for k in range(4):
                    own = [r for r in rows if r[0] == c and r[2] == k and not r[4]]
                    train += sorted(own, key=lambda r: hashlib.md5(f"shot|{s}|{r[1]}".encode()).hexdigest())[:n]
                classes, y = np.unique([r[2] for r in train], return_inverse=True)
                w = fits.softmax_fit(np.array([r[3] for r in train]), y, len(classes), np.ones(len(y)))
                test = [r for r in rows if r[0] == c and r[4] and r[2] in classes]
                called = classes[fits.logits(np.array([r[3] for r in test]), w).argmax(1)]
                truth = np.array([r[2] for r in test])
                f1 = []
                for k in set(truth) | set(called):
                    tp, p, t = ((truth == k) & (called == k)).sum(), (called == k).sum(), (truth == k).sum()
                    f1.append(2 * tp / (p + t))
                per.append(fmean(f1))
                assert abs(got[c, n, s] - per[-1]) < 1e-9, (c, n, s)
            curve = models.few_shot_curve(scores).where(f"cohort = '{c}' AND shots = {n}").first()
            assert abs(curve["f1"] - fmean(per)) < 1e-9 and abs(curve["sd"] - pstdev(per)) < 1e-9


def test_transfer_scores_every_pair_and_the_pool(spark):
    rows = [(f"C{i % 3}", i, i // 3 % 4, v, t) for i, (_, _, _, v, t) in enumerate(grid(3))]
    df = spark.createDataFrame(rows, "cohort string, id long, cls long, vec array<double>, is_test boolean")
    conf = models.transfer(df, "vec", "cls", "id", 50).collect()
    pairs = {}
    for r in conf:
        pairs[r["source"], r["target"]] = pairs.get((r["source"], r["target"]), 0) + r["n"]
    tests = {c: sum(r[0] == c and r[4] for r in rows) for c in ("C0", "C1", "C2")}
    assert pairs == {(s, t): tests[t] for t in tests for s in (*tests, "pooled") if s != t}


def test_keys_of_one_class_have_no_model(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 1, [2.0]), ("b", 1, [1.0]), ("b", 2, [5.0])], "key string, label int, vec array<double>")
    m = fits.fit_each(df, ["key"], "label", "vec", balanced=True)
    assert [r["key"] for r in m.collect()] == ["b"]
    assert fits.score_each(m.where("false"), df, ["key"], ["key"], [], "label", "vec").count() == 0
    got = fits.score_each(m, df, ["key"], ["key"], [], "label", "vec")
    assert {(r["y_true"], r["y_pred"], r["n"]) for r in got.collect()} == {(1, 1, 1), (2, 2, 1)}
