"""Many small models at once: every key's rows are one bounded group, fitted in its own task and scored together.

Softmax regression with an L2 penalty on everything but the intercept, minimised by limited-memory BFGS. Callers
bound a group by drawing (`sampling.uniform`); what is scored has no bound. Coefficients travel to the scoring tasks
in batches of a checked size, and scoring sends confusion counts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.session import materialise

MODEL_NUMBERS = 4_000_000  # coefficients (32 MB) that travel at once; more are scored in several passes


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, tolerance: float = 1e-7,
             rounds: int = 2000, memory: int = 12) -> np.ndarray:
    """Limited-memory BFGS with halving steps for a smooth convex f that gives (value, gradient)."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance * max(1.0, abs(value)):
            break
        d, marks = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d = d - a * y
            marks.append(a)
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(marks)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = g @ d
        if slope >= 0:
            d, slope, past = -g, -(g @ g), []
        step = 1.0 if past else 1.0 / max(1.0, np.sqrt(g @ g))
        while True:
            new, new_g = f(x + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-14:
                break
            step /= 2
        s, y = step * d, new_g - g
        if step < 1e-14:
            break
        x, value, g = x + s, new, new_g
        if s @ y > 1e-14 * (y @ y):
            past = [*past[-memory + 1:], (s, y)]
    return x


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows x classes; two classes share one row of weights, that of the second."""
    z = x @ w[:, :-1].T + w[:, -1]
    return np.column_stack([np.zeros(len(x)), z]) if len(w) == 1 else z


def softmax_fit(x: np.ndarray, y: np.ndarray, n_class: int, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (classes, or 1 for two classes, x features + intercept) for class numbers y."""
    free, width = (1 if n_class == 2 else n_class), x.shape[1] + 1
    truth = np.zeros((len(x), n_class))
    truth[np.arange(len(x)), y] = 1.0

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(free, width)
        z = logits(x, w)
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1, keepdims=True)
        off = weight[:, None] * (p / total - truth)
        off = off[:, 1:] if free == 1 else off
        g = np.column_stack([off.T @ x + penalty * w[:, :-1], off.sum(0)])
        value = weight @ (np.log(total[:, 0]) - (z * truth).sum(1)) + penalty / 2 * (w[:, :-1] ** 2).sum()
        return float(value), g.ravel()

    return minimise(loss, np.zeros(free * width)).reshape(free, width)


def fit_each(rows: DataFrame, key: Sequence[str], label: str, features: str, balanced: bool = False, penalty: float = 1.0) -> DataFrame:
    """Stored: key, classes, weights (flat), n_rows of the model of every key; keys with one class are left out.

    rows of a key must be bounded: they are one group. `balanced` weighs a row by rows / (classes x rows of its class).
    Rows are sorted before the fit, so a model does not depend on their order.
    """
    key = list(key)
    schema = T.StructType([*[rows.schema[k] for k in key], T.StructField("classes", T.ArrayType(rows.schema[label].dataType)),
                           T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("n_rows", T.LongType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        classes, y = np.unique(pdf[label].to_numpy(), return_inverse=True)
        x = np.array(pdf[features].to_list(), dtype=np.float64)
        order = np.lexsort((*x.T[::-1], y))
        x, y = x[order], y[order]
        if len(classes) < 2:
            return pd.DataFrame(columns=schema.names)
        weight = (len(y) / (len(classes) * np.bincount(y)))[y] if balanced else np.ones(len(y))
        w = softmax_fit(x, y, len(classes), weight, penalty)
        return pd.DataFrame([[*pdf[key].iloc[0], classes.tolist(), w.ravel().tolist(), len(y)]], columns=schema.names)

    return materialise(rows.select(*key, label, features).groupBy(*key).applyInPandas(fit, schema))


def batches_of(models: DataFrame, key: Sequence[str]) -> list[list]:
    """Models in lists of at most MODEL_NUMBERS coefficients, one larger model alone."""
    sizes = models.select(*key, F.size("weights").alias("_s")).orderBy(*key).collect()  # one row a model
    out, room = [], -1
    for r in sizes:
        if r["_s"] > room:
            out.append([])
            room = MODEL_NUMBERS
        out[-1].append(tuple(r[k] for k in key))
        room -= r["_s"]
    return out


def score_each(models: DataFrame, rows: DataFrame, key: Sequence[str], on: Sequence[str], carry: Sequence[str], label: str,
               features: str, seen_only: bool = True) -> DataFrame:
    """key, carry, y_true, y_pred, n: every row under each model whose `on` columns (part of the key) equal the row's.

    `seen_only` leaves out rows of classes that the model has not seen. A task sends counts, not rows.
    """
    key, on, carry, spark = list(key), list(on), list(carry), rows.sparkSession
    kind = rows.schema[label].dataType
    out_schema = T.StructType([*[models.schema[k] for k in key], *[rows.schema[c] for c in carry], T.StructField("y_true", kind),
                               T.StructField("y_pred", kind), T.StructField("n", T.LongType())])
    named = F.struct(*key)
    counts = None
    for names in batches_of(models, key):
        wanted = spark.createDataFrame(names, T.StructType([models.schema[k] for k in key])).select(F.struct(*key).alias("_wanted"))
        held = models.join(F.broadcast(wanted), named.eqNullSafe(F.col("_wanted")), "left_semi").collect()  # MODEL_NUMBERS at most
        by: dict[tuple, list] = {}
        for m in held:
            w = np.array(m["weights"])
            free = 1 if len(m["classes"]) == 2 else len(m["classes"])
            by.setdefault(tuple(m[c] for c in on), []).append((tuple(m[k] for k in key), np.array(m["classes"]), w.reshape(free, -1)))
        shipped = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            seen: dict[tuple, int] = {}
            for pdf in batches:
                for group, part in (pdf.groupby(on, dropna=False) if on else [((), pdf)]):
                    x, y = np.array(part[features].to_list(), dtype=np.float64), part[label].to_numpy()
                    told = list(zip(*(part[c] for c in carry))) if carry else [()] * len(part)
                    for name, classes, w in shipped.value.get(tuple(group), []):
                        called = classes[logits(x, w).argmax(1)]
                        for i in (np.flatnonzero(np.isin(y, classes)) if seen_only else range(len(y))):
                            at = (*name, *told[i], y[i], called[i])
                            seen[at] = seen.get(at, 0) + 1
            yield pd.DataFrame([[*at, n] for at, n in seen.items()], columns=out_schema.names)

        part = rows.select(*dict.fromkeys([*on, *carry, label, features])).mapInPandas(run, out_schema)
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return spark.createDataFrame([], out_schema)
    return counts.groupBy(*key, *carry, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def macro_over_all(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, macro_f1: mean F1 over the classes that occur in the truth or in the predictions."""
    from cohortweave.operators.metrics import per_class

    keys = list(keys)
    every = conf.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("cls")).groupBy(*keys).agg(F.count_distinct("cls").alias("_k"))
    f1 = per_class(conf, keys).groupBy(*keys).agg(F.sum("f1").alias("_s"))
    return f1.join(every, keys).select(*keys, (F.col("_s") / F.col("_k")).alias("macro_f1"))
