"""Distributions by convolution against enumeration, and aggregates that no longer unfold whole classes or folds."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from cohortweave.operators import agreement, distribution, exact_null
from cohortweave.sources import loaders


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12])
def test_sign_flips_equal_enumeration(n):
    rng = random.Random(n)
    for x in ([rng.uniform(-1, 1) for _ in range(n)], [rng.choice([-.25, .5, .75, 0]) for _ in range(n)], [0.0] * n):
        x = [round(v, 6) for v in x]
        seen = abs(sum(x))
        p = sum(abs(sum(s * v for s, v in zip(signs, x))) >= seen - 1e-9 for signs in itertools.product((1, -1), repeat=n)) / 2 ** n
        assert abs(exact_null.sign_flip_p(x) - p) < 1e-9


@pytest.mark.parametrize("n", [1, 3, 8, 12])
def test_signed_ranks_equal_enumeration(n):
    rng = random.Random(n)
    x = [rng.choice([-3, -2, -1, 0, 1, 2, 5]) / 10 for _ in range(n)] + [.4]
    d = [v for v in x if v]
    order = sorted(abs(v) for v in d)
    ranks = [sum(i + 1 for i, v in enumerate(order) if v == abs(w)) / order.count(abs(w)) for w in d]
    w = sum(r for r, v in zip(ranks, d) if v > 0)
    half = sum(ranks) / 2
    p = np.mean([abs(sum(itertools.compress(ranks, keep)) - half) >= abs(w - half) - 1e-9 for keep in itertools.product((0, 1), repeat=len(d))])
    assert exact_null.signed_rank(x)[:2] == (len(d), w) and abs(exact_null.signed_rank(x)[2] - p) < 1e-9


def test_sixty_folds(spark):
    rng = random.Random(6)
    x = [rng.gauss(.02, .1) for _ in range(60)]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", .1), ("c", None)], "k string, d double")
    r = {row["k"]: row for row in exact_null.paired(df, ["k"], "d").collect()}
    z = abs(sum(x)) / math.sqrt(sum(v * v for v in x))
    assert r["a"]["n"] == 60 and abs(r["a"]["p"] - math.erfc(z / math.sqrt(2))) < .02
    half = 2.000995378 * np.std(x, ddof=1) / math.sqrt(60)  # t of 59 degrees of freedom
    assert abs(r["a"]["hi"] - r["a"]["mean"] - half) < 1e-8
    assert r["b"]["lo"] is None and r["b"]["p"] == 1.0 and "c" not in r
    w = exact_null.wilcoxon(df, ["k"], "d").where("k = 'a'").first()
    mean, sd = 60 * 61 / 4, math.sqrt(60 * 61 * 121 / 24)
    assert abs(w["p"] - math.erfc(abs(w["w_plus"] - mean) / sd / math.sqrt(2))) < .02


def test_t_quantiles():
    for df, t in ((1, 12.706204736), (2, 4.302652730), (4, 2.776445105), (30, 2.042272456), (31, 2.039513446), (120, 1.979930405)):
        assert abs(exact_null.t_quantile(df) - t) < 1e-8


def test_leave_one_out_medians(spark, many_chunks):
    rng = random.Random(3)
    rows = [(rng.choice("abcc"), rng.choice("xy"), None if rng.random() < .1 else round(rng.random(), 2)) for _ in range(700)] + [("d", "z", 1.0)]
    got = {(r["u"], r["m"]): r["q"] for r in distribution.leave_one_out_quantile(
        spark.createDataFrame(rows, "u string, m string, v double"), "u", ["m"], "v", .25, "q").collect()}
    for unit in "abcd":
        for m in "xyz":
            rest = [v for u, k, v in rows if k == m and u != unit and v is not None]
            assert (got[unit, m] is None) if not rest else abs(got[unit, m] - np.quantile(rest, .25)) < 1e-12


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_expected_information_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(agreement, "OVERLAPS", chunk)
    rng = random.Random(8)
    rows = [(k, a, (a + rng.randrange(2)) % 4) for k in "pq" for a in [rng.randrange(3) for _ in range(40)]]
    t = Counter(rows)
    df = spark.createDataFrame([(*r, n) for r, n in t.items()], "k string, a int, b int, n long")
    got = {r["k"]: r["emi"] for r in agreement.adjusted_mutual_information(df, "a", "b", ["k"]).collect()}
    for k in "pq":
        n, ra, rb = 40, Counter(r[1] for r in rows if r[0] == k), Counter(r[2] for r in rows if r[0] == k)
        emi = 0.0
        for ai in ra.values():
            for bj in rb.values():
                for m in range(max(1, ai + bj - n), min(ai, bj) + 1):
                    emi += m / n * math.log(n * m / (ai * bj)) * math.comb(bj, m) * math.comb(n - bj, ai - m) / math.comb(n, ai)
        assert abs(got[k] - emi) < 1e-7


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_row_numbers_follow_the_files_and_store_nothing(spark, tmp_path, fmt):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # text files are cut into many parts
    try:
        df = spark.range(0, 2000, 1, 5).selectExpr("cast(id as string) AS i", "concat('w', id) AS w")
        (df.write.option("header", True) if fmt == "csv" else df.write).format(fmt).save(f"{tmp_path}/t")
        before = set(tmp_path.iterdir())
        read = lambda: loaders.number_rows(loaders.read_table(spark, f"{tmp_path}/t", fmt, ["i"], placed=True), "n")
        got, again = ({r["n"]: int(r["i"]) for r in read().collect()} for _ in range(2))
        assert sorted(got) == list(range(2000)) and got == again and set(got.values()) == set(range(2000))
        runs = sum(got[n + 1] == got[n] + 1 for n in range(1999))
        assert runs >= 1999 - 5  # rows of a file stay in order
        assert read().columns == ["i", "n"] and set(tmp_path.iterdir()) == before
        plan = read()._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
