"""Draws against sorting every group in plain Python; one group holds most rows."""

import hashlib
import random

import pytest

from cohortweave.operators import sampling


def key(purpose, i):
    return hashlib.md5(f"{purpose}|{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice("abcde") if rng.random() < .5 else f"p{rng.randrange(400)}", i) for i in range(20_000)]
    rows += [(f"g{i % 40}", "a", 30_000 + i) for i in range(800)] + [(None, "a", 40_000 + i) for i in range(90)]
    rows += [("hot", None, 50_000 + i) for i in range(50)] + [("tiny", "x", 60_000)]
    return rows, spark.createDataFrame(rows, "g string, s string, i long").repartition(6)


@pytest.fixture
def ranked(monkeypatch):
    """Rows that are ranked to find the cuts, one number a selection."""
    seen, real = [], sampling.running_counts
    monkeypatch.setattr(sampling, "running_counts", lambda df, *a: (seen.append(df.count()), real(df, *a))[1])
    return seen


@pytest.mark.parametrize("cap", [1, 7, 300, 19_999, 50_000])
def test_uniform_takes_the_lowest_keys_of_each_group(crowd, many_chunks, ranked, cap):
    rows, df = crowd
    got = sorted((tuple(r) for r in sampling.uniform(df, ["g"], "i", cap).collect()), key=str)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    want = [r for rs in groups.values() for r in sorted(rs, key=lambda r: key("draw", r[2]))[:cap]]
    assert got == sorted(want, key=str)
    assert max(ranked, default=0) < 2_500  # of 20,941 rows


def test_uniform_of_nothing(spark, crowd):
    assert sampling.uniform(crowd[1], ["g"], "i", 0).count() == 0
    assert sampling.uniform(spark.createDataFrame([], "g string, i long"), ["g"], "i", 5).count() == 0


@pytest.mark.parametrize("n", [1, 10, 405, 3_000, 100_000])
def test_round_robin_takes_turns(crowd, many_chunks, ranked, n):
    rows, df = crowd
    got = sorted((tuple(r) for r in sampling.round_robin(df, ["g"], ["s"], "i", n).select("g", "s", "i", "turn").collect()), key=str)
    strata, groups = {}, {}
    for g, s, i in rows:
        strata.setdefault((g, s), []).append((key("sample", i), i))
    for (g, s), rs in strata.items():
        groups.setdefault(g, []).extend((t, k, s, i) for t, (k, i) in enumerate(sorted(rs)))
    want = [(g, s, i, t) for g, rs in groups.items() for t, _, s, i in sorted(rs, key=lambda r: r[:2])[:n]]
    assert got == sorted(want, key=str)
    assert max(ranked, default=0) < 6_000


@pytest.mark.parametrize("n", [50, 2_000])
def test_round_robin_over_many_strata_looks_at_few_rows(spark, many_chunks, monkeypatch, n):
    rows = [("wide", f"s{i % 6_000}", i) for i in range(24_000)] + [("thin", f"s{i % 3}", 30_000 + i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, s string, i long").repartition(6)
    seen, real = [], sampling.lowest_cut
    monkeypatch.setattr(sampling, "lowest_cut", lambda keyed, caps: (seen.append(keyed.count()), real(keyed, caps))[1])
    got = sorted((r["turn"], r["i"]) for r in sampling.round_robin(df, ["g"], ["s"], "i", n).collect())
    want = []
    for g in ("wide", "thin"):
        strata = {}
        for h, s, i in rows:
            if h == g:
                strata.setdefault(s, []).append((key("sample", i), i))
        want += [(t, i) for t, _, i in sorted((t, k, i) for rs in strata.values() for t, (k, i) in enumerate(sorted(rs)))[:n]]
    assert got == sorted(want)
    assert max(seen) <= 6_000  # of 24,900 rows: the lowest of each stratum, or the thin group


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_balanced_draws_unfold_in_chunks(crowd, many_chunks, monkeypatch, chunk):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    rows, df = crowd
    got = sampling.class_balanced(df.where("s IS NOT NULL"), ["g"], "s", "i").collect()
    by = {}
    for r in got:
        by.setdefault((r["g"], r["s"]), []).append((r["draw"], r["i"]))
    sizes = {}
    for g, s, _ in rows:
        if s is not None:
            sizes[g, s] = sizes.get((g, s), 0) + 1
    for (g, s), draws in by.items():
        of = [n for (h, _), n in sizes.items() if h == g]
        quota = max(1, sum(of) // len(of))
        assert sorted(d for d, _ in draws) == list(range(quota))
        if sizes[g, s] >= quota:
            own = sorted((i for h, t, i in rows if (h, t) == (g, s)), key=lambda i: key("bal", i))[:quota]
            assert [i for _, i in sorted(draws)] == own
    assert by.keys() == sizes.keys()


def test_unfolded_draws_are_not_broadcast(spark):
    """Spark sizes the draws by the stored plan of a few rows, before they unfold to a row each."""
    rows = [(i, "C0", "a" if i < 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, cohort string, label string")
    got = sampling.class_balanced(df, ["cohort"], "label", "id")
    assert got.groupBy("label").count().where("count = 30").count() == 2
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
