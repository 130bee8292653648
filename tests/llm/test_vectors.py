"""Vector codes against a full search in plain Python."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from cohortweave.llm import ball_codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.StringType()), T.StructField("codes", T.StringType()),
                       T.StructField("vec", T.LongType()), T.StructField("error", T.LongType())])


def brute(rows, parts, entries, rounds):
    """Rows, their codes and errors, and the final entries, by comparing every part with every entry."""
    ok = [(i, v, lab) for i, v, lab, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    ints = [[math.floor(Fraction(x) * 256) for x in v] for _, v, _ in ok]
    w = len(ints[0]) // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def search():
        return [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = search()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes) if k[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    codes = search()
    errors = [sum(dist(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    return ok, codes, errors, books


def sample(seed, n, width, spread):
    rng = random.Random(seed)
    rows = [(rng.randrange(2 * n), [rng.gauss(rng.choice([-1, 0, 2]), spread) for _ in range(width)], rng.choice(["a", "b", None]), "x", 1, 2)
            for _ in range(n)]
    rows += [rows[0], rows[1], rows[1], (None, rows[2][1], "a", None, None, None), (5, None, "a", "x", 1, 2), (6, [], "a", "x", 1, 2),
             (7, [1.0] * (width - 1) + [None], None, "x", 1, 2), (8, [1.0] * (width - 1) + [float("nan")], None, "x", 1, 2),
             (9, [float("-inf")] + [0.0] * (width - 1), None, "x", 1, 2), (10 ** 9, [0.5] * (width + 1), "a", "x", 1, 2),
             (10 ** 9, [0.25] * (2 * width), "a", "x", 1, 2), (11, [0.0] * width, "a", "x", 1, 2), (12, [-0.001] * width, "a", "x", 1, 2)]
    return rows


@pytest.mark.parametrize("seed,n,width,parts,entries,rounds,spread", [
    (1, 300, 8, 4, 16, 2, .3), (2, 120, 12, 2, 9, 3, .05), (3, 40, 4, 4, 64, 2, 1.0), (4, 60, 8, 2, 8, 2, 1e12)])
def test_codes_equal_a_full_search(spark, many_chunks, seed, n, width, parts, entries, rounds, spread):
    rows = sample(seed, n, width, spread)
    coded, fitted = ball_codes.encode(spark.createDataFrame(rows, SCHEMA), parts, entries, rounds)
    ok, codes, errors, books = brute(rows, parts, entries, rounds)
    want = sorted(((i, lab, "".join(f"{c:02x}" for c in k), e if e < 2 ** 63 else None)
                   for (i, _, lab), k, e in zip(ok, codes, errors)), key=str)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    assert fitted.sha256 == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    if spread < 1e6:
        sums = {}
        for (_, _, lab), e in zip(ok, errors):
            sums[lab] = sums.get(lab, 0) + e
        got = ball_codes.with_label_error(coded).collect()
        assert len(got) == len(ok) and all(r["label_error"] == sums[r["label"]] for r in got)


def test_label_totals_without_broadcast(spark, monkeypatch):
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, "00", i) for i in range(50)], "vec_id long, label int, code string, error long")
    want = sorted(map(tuple, ball_codes.with_label_error(coded).collect()), key=str)
    monkeypatch.setattr(ball_codes, "LABELS_SENT", 0)
    assert sorted(map(tuple, ball_codes.with_label_error(coded).collect()), key=str) == want and len(want) == 50


def test_no_vectors(spark):
    for rows in ([], [(1, None, "a", "x", 1, 2)]):
        coded, fitted = ball_codes.encode(spark.createDataFrame(rows, SCHEMA))
        assert coded.count() == 0 and fitted is None and coded.columns == ["vec_id", "label", "code", "error"]


def test_rings_leave_out_most_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (1, 32, 4))
    x = (centres[0][rng.integers(0, 32, 4000)] + rng.integers(-60, 60, (4000, 4)))[:, None, :]
    codes = ball_codes.full_search(x, centres)
    far = ball_codes.own_distances(x, centres, codes)
    radii = np.array([[int(far[codes[:, 0] == e, 0].max(initial=0)) for e in range(32)]], dtype=object)
    ring = ball_codes.neighbours(centres, radii, np.ones((1, 32), bool))
    assert ring.count.mean() < 4  # of 31 other entries
    assert (ball_codes.ring_search(x, ring, codes) == codes).all()
    idle = ball_codes.neighbours(centres, radii, np.zeros((1, 32), bool))
    assert idle.idle.all()
