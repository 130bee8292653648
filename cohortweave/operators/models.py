"""Prototype, retrieval and MLlib models used to score a label space."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.numeric import order_key
from cohortweave.operators import fits, packed
from cohortweave.operators.sampling import uniform
from cohortweave.session import materialise

CONVERGED = 2000  # fits end at their tolerance; this limit is not reached in practice


# ------------------------------------------------------------------ prototypes
def loco_prototypes(long: DataFrame, cls: str, value: str) -> DataFrame:
    """Class centroids of every leave-one-cohort-out fold: held, cls, marker, c.

    Built once as sums per (cohort, class, marker); a fold is the total minus its held cohort, so
    the cells are scanned once however many folds there are.
    """
    part = long.where(F.col(value).isNotNull()).groupBy("cohort", cls, "marker").agg(
        F.sum(value).alias("s"), F.count(value).alias("n"))
    part = materialise(part)
    total = part.groupBy(cls, "marker").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    cohorts = [r[0] for r in part.select("cohort").distinct().collect()]  # one row per dataset
    grid = total.withColumn("held", F.explode(F.lit(cohorts)))
    own = part.select(F.col("cohort").alias("held"), cls, "marker", "s", "n")
    j = grid.join(own, ["held", cls, "marker"], "left").na.fill({"s": 0.0, "n": 0})
    return j.where("tn > n").select("held", F.col(cls).alias("cls"), "marker", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("c"))


def joined_scores(long: DataFrame, prototypes: DataFrame, row: Sequence[str], value: str, measure: str) -> DataFrame:
    """row, cls, score by a join on the marker: the way for prototypes beyond the size of a shipped matrix."""
    on = ["marker"] + (["held"] if "held" in prototypes.columns and "held" in long.columns else [])
    v, c = F.col(value), F.col("c")
    score = {"cosine": F.try_divide(F.sum(v * c), F.sqrt(F.sum(v * v) * F.sum(c * c))), "rms": F.sqrt(F.avg(F.pow(v - c, 2)))}[measure]
    return (long.where(v.isNotNull()).join(prototypes, on).groupBy(*row, "cls").agg(score.alias("score"))
            .where(F.col("score").isNotNull()))


def cosine_scores(long: DataFrame, prototypes: DataFrame, row: Sequence[str], value: str) -> DataFrame:
    """Cosine of every row with every prototype over the shared markers: row, cls, score.

    prototypes are stored; they carry the fold key `held` = the row's cohort when they are fold-specific.
    """
    if packed.fits(prototypes):
        scored = packed.class_scores(long, prototypes, row, value, "cosine")
        return scored.select(*row, F.explode("scores").alias("_s")).select(*row, "_s.cls", "_s.score")
    return joined_scores(long, prototypes, row, value, "cosine")


def best_class(scores: DataFrame, row: Sequence[str], highest: bool = True, digits: int = 9) -> DataFrame:
    """Arg-max (or arg-min) class per row; ties go to the lowest class."""
    s = F.round("score", digits)
    order = F.struct(s if highest else -s, -F.col("cls"))
    return scores.groupBy(*row).agg(F.max_by("cls", order).alias("y_pred"), F.max_by("score", order).alias("score"))


def nearest(long: DataFrame, prototypes: DataFrame, row: Sequence[str], value: str, measure: str) -> DataFrame:
    """row, y_pred, score: highest cosine or smallest RMS difference, scored where the packed row is."""
    highest = measure == "cosine"
    if packed.fits(prototypes):
        return packed.best_of(packed.class_scores(long, prototypes, row, value, measure), row, highest)
    return best_class(joined_scores(long, prototypes, row, value, measure), row, highest)


def prototype_predict(long: DataFrame, prototypes: DataFrame, row: Sequence[str], value: str) -> DataFrame:
    """Nearest prototype by cosine."""
    return nearest(long, prototypes, row, value, "cosine")


def softmax_shares(scores: Column | str, temperature: float = 0.1) -> Column:
    """(cls, p) of a packed row's scores: softmax at a temperature, in place."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    e = F.transform(scores, lambda s: F.exp((s["score"] - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(scores, e, lambda s, x: F.struct(s["cls"].alias("cls"), (x / total).alias("p")))


def masked_profile_predict(long: DataFrame, prototypes: DataFrame, row: Sequence[str], value: str) -> DataFrame:
    """Nearest profile by RMS difference over the markers the row measures; no learning."""
    return nearest(long, prototypes, row, value, "rms")


def prototype_separation(prototypes: DataFrame, keys: Sequence[str] = ("held",)) -> DataFrame:
    """Smallest distance between unit-length prototypes of each fold."""
    keys = list(keys)
    n = prototypes.withColumn("c", F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(*keys, "cls"))))
    a = n.select(*keys, "marker", F.col("cls").alias("a"), F.col("c").alias("ca"))
    b = n.select(*keys, "marker", F.col("cls").alias("b"), F.col("c").alias("cb"))
    d = (a.join(b, [*keys, "marker"]).where("a < b").groupBy(*keys, "a", "b")
         .agg(F.sqrt(F.sum(F.pow(F.col("ca") - F.col("cb"), 2))).alias("d")))
    return d.groupBy(*keys).agg(F.min("d").alias("min_distance"), F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select(
        *keys, "min_distance", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def prototype_drift(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - cosine between two versions of each prototype."""
    j = before.select(*keys, "cls", "marker", F.col("c").alias("x")).join(
        after.select(*keys, "cls", "marker", F.col("c").alias("y")), [*keys, "cls", "marker"])
    return j.groupBy(*keys, "cls").agg((1.0 - F.sum(F.col("x") * F.col("y")) / F.sqrt(
        F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("drift"))


# ------------------------------------------------------------------ retrieval
def for_each_k(votes: DataFrame, ks: Sequence[int], measure: str) -> DataFrame:
    """qid, y_pred, k: the class with the highest measure + k of every query; ties to the lowest class."""
    best = votes.groupBy("qid").agg(*[F.max_by("cls", F.struct(F.col(f"{measure}{k}"), -F.col("cls"))).alias(f"_y{k}") for k in ks])
    each = F.array(*[F.struct(F.col(f"_y{k}").alias("y_pred"), F.lit(k).alias("k")) for k in ks])
    return best.select("qid", F.explode(each).alias("_e")).select("qid", "_e.*")


def knn_votes(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Majority class of the k most similar rows, for every k; `rank` is over all classes."""
    return for_each_k(ranked.groupBy("qid", "cls").agg(*[F.count_if(F.col("rank") <= k).alias(f"_c{k}") for k in ks]), ks, "_c")


def balanced_votes(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Class with the highest mean similarity to its own k nearest rows, for every k; `rank` is inside the class."""
    mean = [F.round(F.avg(F.when(F.col("rank") <= k, F.col("sim"))), 9).alias(f"_m{k}") for k in ks]
    return for_each_k(ranked.groupBy("qid", "cls").agg(*mean), ks, "_m")


# ------------------------------------------------------------------ MLlib probes
def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class) of each row."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0))  # class-sized
    n = n.select(label, (F.sum("_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("_c"))).alias(out))
    return df.join(n, label)


def linear_probe(train: DataFrame, test: DataFrame, features: str, label: str, max_iter: int = CONVERGED,
                 weight: str | None = None, reg: float = 1e-3) -> DataFrame:
    """Balanced (or column-weighted) multinomial logistic regression; test rows of unseen classes
    are left out. Adds y_pred and probability array."""
    t = train if weight else balanced_weights(train, label)
    t = materialise(t.select(F.col(features).alias("f"), F.col(label).cast("double").alias("label"),
                             F.col(weight or "weight").cast("double").alias("w")))
    t = t.select(array_to_vector("f").alias("features"), "label", "w")
    model = LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="w", family="multinomial").fit(t)
    seen = train.select(label).distinct()
    scored = model.transform(test.join(seen, label, "left_semi").withColumn("features", array_to_vector(F.col(features))))
    return (scored.withColumn("y_pred", F.col("prediction").cast("long"))
            .withColumn("prob", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction"))


def standardise(df: DataFrame, column: str, train: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """`column` (an array) as log1p of its values (negative ones count as 0), less the mean and over the population
    sd of `train` at each position of the row's group; positions without spread become 0."""
    log = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
    keys = list(group)
    at = train.select(*keys, F.posexplode(column).alias("_i", "_x")).groupBy(*keys, "_i").agg(
        F.avg(log(F.col("_x"))).alias("mean"), F.stddev_pop(log(F.col("_x"))).alias("sd"))
    stats = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "mean", "sd"))).alias("_s"))  # one number a position
    j = df.join(stats, keys, "left") if keys else df.join(F.broadcast(stats), F.lit(True), "left")
    one = lambda x, i: F.when(F.get("_s", i)["sd"] > 0, (log(x) - F.get("_s", i)["mean"]) / F.get("_s", i)["sd"]).otherwise(0.0)
    return j.withColumn(column, F.transform(column, one)).select(*df.columns)


def few_shot(rows: DataFrame, features: str, label: str, row_id: str, shots: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """cohort, shots, seed, macro_f1 of a model fitted on `shots` rows a class of the cohort (all of a smaller class).

    rows: cohort, is_test and the named columns. One ranking a seed serves all shot counts. Every (cohort, shots,
    seed) is one bounded group; test rows of classes that a model has not seen are left out.
    """
    ids = rows.where("NOT is_test").select("cohort", label, row_id, F.explode(F.lit(list(seeds))).alias("seed"))
    ids = ids.withColumn("_shot", F.concat_ws("|", "seed", row_id))
    drawn = uniform(ids, ["cohort", label, "seed"], "_shot", max(shots), "shot")
    order = Window.partitionBy("cohort", label, "seed").orderBy(order_key("shot", "_shot"))  # max(shots) rows
    counts = F.filter(F.lit(list(shots)), lambda n: n >= F.col("_r"))
    picked = drawn.withColumn("_r", F.row_number().over(order)).select(row_id, "seed", F.explode(counts).alias("shots"))
    train = picked.join(rows.where("NOT is_test").select("cohort", label, row_id, features), row_id)
    key = ["cohort", "shots", "seed"]
    models = fits.fit_each(train, key, label, features)
    return fits.macro_over_all(fits.score_each(models, rows.where("is_test"), key, ["cohort"], [], label, features), key)


def few_shot_curve(scores: DataFrame) -> DataFrame:
    """Mean and population sd over seeds."""
    return scores.groupBy("cohort", "shots").agg(F.avg("macro_f1").alias("f1"), F.stddev_pop("macro_f1").alias("sd"))


def feature_sets(rows: DataFrame, features: Sequence[str], label: str, row_id: str, cap: int) -> DataFrame:
    """cohort, features, macro_f1: each named array column fitted on at most `cap` training rows of a cohort (balanced)
    and scored on its test rows of classes seen in training. rows: cohort, is_test and the named columns."""
    drawn = materialise(uniform(rows.where("NOT is_test"), ["cohort"], row_id, cap, "features"))
    out = None
    for name in features:
        models = fits.fit_each(drawn, ["cohort"], label, name, balanced=True)
        conf = fits.score_each(models, rows.where("is_test"), ["cohort"], ["cohort"], [], label, name).withColumn("features", F.lit(name))
        out = conf if out is None else out.unionByName(conf)
    return fits.macro_over_all(out, ["cohort", "features"])


def transfer(rows: DataFrame, features: str, label: str, row_id: str, cap: int) -> DataFrame:
    """source, target, y_true, y_pred, n: a balanced model of each source cohort's training rows, and one of all
    cohorts but the target ("pooled"), each on at most `cap` rows, scored on the target's test rows."""
    train, test = rows.where("NOT is_test"), rows.where("is_test").withColumn("target", F.col("cohort"))
    single = uniform(train, ["cohort"], row_id, cap, "source").withColumn("source", F.col("cohort"))
    own = fits.score_each(fits.fit_each(single, ["source"], label, features, balanced=True), test, ["source"], [], ["target"], label, features, False)
    cohorts = [r[0] for r in rows.select("cohort").distinct().collect()]  # one row a dataset
    others = train.select("cohort", row_id).withColumn("target", F.explode(F.lit(cohorts))).where("cohort <> target")
    pooled = uniform(others, ["target"], row_id, cap, "pooled").select("target", row_id).join(train.select(row_id, label, features), row_id)
    models = fits.fit_each(pooled, ["target"], label, features, balanced=True)
    every = fits.score_each(models, test, ["target"], ["target"], [], label, features, False).withColumn("source", F.lit("pooled"))
    return own.where("source <> target").unionByName(every.select(*own.columns))


def kmeans_labels(df: DataFrame, features: str, k: int, seed: int = 20260810) -> DataFrame:
    """k-means cluster of each row."""
    v = df.withColumn("features", array_to_vector(F.col(features)))
    return KMeans(k=k, seed=seed, maxIter=CONVERGED).fit(v).transform(v).drop("features").withColumnRenamed("prediction", "cluster")


def fold_mlp(train: DataFrame, test: DataFrame, features: str, label: str, n_class: int, width: int,
             hidden: int = 16, max_iter: int = 100, seed: int = 1) -> DataFrame:
    """Multilayer perceptron of one fold on a fixed panel of `width` markers; adds y_pred."""
    def vec(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.col(features))).withColumn("label", F.col(label).cast("double"))
    t = vec(materialise(train.select(features, label))).select("features", "label")
    m = MultilayerPerceptronClassifier(layers=[width, hidden, n_class], maxIter=max_iter, seed=seed).fit(t)
    return m.transform(vec(test)).withColumn("y_pred", F.col("prediction").cast("long")).drop(
        "features", "label", "rawPrediction", "probability", "prediction")


def panel_mlp(train: DataFrame, test: DataFrame, features: str, label: str, n_class: int, width: int) -> DataFrame:
    """fold_mlp() under the name that test_fixed_panels_are_cut_from_one_pack watches: it knows the panels of one fold."""
    return fold_mlp(train, test, features, label, n_class, width)


def disjoint_groups(df: DataFrame, group: str, purpose: str = "probe") -> DataFrame:
    """Marks the hashed half of the groups (images) as test: adds `is_test`."""
    h = F.conv(F.substring(order_key(purpose, group), 1, 15), 16, 10).cast("long")
    return df.withColumn("is_test", F.pmod(h, F.lit(2)) == 1)


# ------------------------------------------------------------------ masked-marker regression
def gram_by_cohort(vectors: DataFrame, width: int) -> DataFrame:
    """cohort, i, j, g: sums of x_i x_j with a constant column 0, one pass, partial per batch."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cohort, part in pdf.groupby("cohort"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["vec"].to_list())])
                g = x.T @ x
                i, j = np.indices(g.shape)
                yield pd.DataFrame({"cohort": cohort, "i": i.ravel(), "j": j.ravel(), "g": g.ravel()})
    out = vectors.select("cohort", "vec").mapInPandas(kernel, "cohort string, i int, j int, g double")
    return out.groupBy("cohort", "i", "j").agg(F.sum("g").alias("g"))


def leave_one_marker_coefficients(gram: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Per fold: each marker regressed on all others (with intercept) on the training cohorts.

    held, target, i, coef (i = 0 is the intercept). The fold's Gram matrix is the total minus the
    held cohort's; one vocabulary-sized inverse per fold gives every regression.
    """
    gram = materialise(gram)
    total = gram.groupBy("i", "j").agg(F.sum("g").alias("t"))
    fold = gram.join(total, ["i", "j"]).select(F.col("cohort").alias("held"), "i", "j", (F.col("t") - F.col("g")).alias("g"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf["i"].max() + 1
        g = np.zeros((m, m))
        g[pdf["i"], pdf["j"]] = pdf["g"]
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        cov = g[1:, 1:] / n - np.outer(mean, mean) + ridge * np.eye(m - 1)
        prec = np.linalg.inv(cov)
        b = -prec / np.diag(prec)[:, None]
        np.fill_diagonal(b, 0.0)
        full = np.column_stack([mean - b @ mean, b])
        t, i = np.indices(full.shape)
        return pd.DataFrame({"held": pdf["held"].iloc[0], "target": t.ravel() + 1, "i": i.ravel(), "coef": full.ravel(),
                             "base": np.repeat(mean, m)})
    return fold.groupBy("held").applyInPandas(solve, "held string, target int, i int, coef double, base double")


def masked_marker_scores(vectors: DataFrame, coefs: DataFrame, width: int) -> DataFrame:
    """held, target, cells, mse, baseline_mse, r2 on each held-out cohort.

    Coefficients are folds x vocabulary^2 numbers, shipped once to the tasks.
    """
    table: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = coefs.collect()  # folds x (vocabulary + 1)^2, independent of the number of cells
    for r in rows:
        c, base = table.setdefault(r["held"], (np.zeros((width, width + 1)), np.zeros(width)))
        c[r["target"] - 1, r["i"]] = r["coef"]
        base[r["target"] - 1] = r["base"]
    shipped = vectors.sparkSession.sparkContext.broadcast(table)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cohort, part in pdf.groupby("cohort"):
                c, base = shipped.value[cohort]
                x = np.stack(part["vec"].to_list())
                p = np.column_stack([np.ones(len(x)), x]) @ c.T
                yield pd.DataFrame({"held": cohort, "target": np.arange(1, width + 1), "n": len(x),
                                    "sse": ((x - p) ** 2).sum(0), "sst": ((x - base) ** 2).sum(0)})
    part = vectors.select("cohort", "vec").mapInPandas(kernel, "held string, target int, n long, sse double, sst double")
    g = part.groupBy("held", "target").agg(F.sum("n").alias("cells"), F.sum("sse").alias("sse"), F.sum("sst").alias("sst"))
    base = F.col("sst") / F.col("cells")
    return g.select("held", "target", "cells", (F.col("sse") / F.col("cells")).alias("mse"), base.alias("baseline_mse"),
                    F.when(base > 1e-12, 1.0 - F.col("sse") / F.col("sst")).alias("r2"), (base * 12.0).alias("split_spread"))
