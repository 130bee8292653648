"""Rules that must raise or hold exactly."""

import pytest

from cohortweave.operators import clustering, splits
from cohortweave.operators.joins import RuleViolation, left_join_one
from cohortweave.operators.spatial import knn
from cohortweave.sources import sinks

CELLS = "cohort string, image_id string, patient_id string, cell_id string"


def test_a_split_refuses_images_of_two_patients_and_too_few_units(spark):
    rows = [("C", f"i{k}", f"C|p{k}", str(k)) for k in range(6)]
    assert splits.split_plan(spark.createDataFrame(rows, CELLS)).count() == 6
    with pytest.raises(RuleViolation):
        splits.split_plan(spark.createDataFrame([*rows, ("C", "i0", "C|p1", "x")], CELLS))
    with pytest.raises(RuleViolation):
        splits.split_plan(spark.createDataFrame(rows[:2], CELLS))


def test_saving_predictions_again_replaces_them(spark, tmp_path):
    schema = "cell_id long, cohort string, held string, method string, protocol string, y_true long, y_pred long"
    first = spark.createDataFrame([(1, "a", "1", "m", "p", 0, 1), (2, "a", "1", "m", "p", 0, 1), (3, "a", "2", "m", "p", 0, 1)], schema)
    sinks.save_predictions(first, str(tmp_path / "p"))
    sinks.save_predictions(first.where("held = '1'"), str(tmp_path / "p"))
    got = sinks.load_predictions(spark, str(tmp_path / "p"))
    assert sorted((r.cell_id, r.held) for r in got.collect()) == [(1, "1"), (2, "1"), (3, "2")]


def test_differently_named_keys_are_compared_typed(spark):
    left = spark.createDataFrame([(1,), (2,)], "a int")
    right = spark.createDataFrame([(1.0, "x")], "b double, v string")
    assert {(r.a, r.v) for r in left_join_one(left, right, ["a"], ["b"]).collect()} == {(1, "x"), (2, None)}


def test_tied_merges_give_exactly_k_clusters(spark):
    pairs = spark.createDataFrame([(0, 1, 0.5), (2, 3, 0.5), (4, 5, 0.5)], "a long, b long, d double")
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    for k in range(1, 7):
        assert clustering.cluster_to_k(pairs, nodes, k).select("cluster").distinct().count() == k


def test_neighbours_of_a_clump_beside_an_outlier(spark):
    points = [(0, i, 0.5 + i * 1e-7, 0.5) for i in range(300)] + [(0, 999, 1e9, 1e9)]
    got = knn(spark.createDataFrame(points, "g int, id long, x double, y double"), ["g"], "id", "x", "y", 3).collect()
    near = {}
    for r in got:
        near.setdefault(r.src, []).append((r.rank, r.dst))
    for q in (0, 1, 150, 299, 999):
        _, _, x, y = next(p for p in points if p[1] == q)
        want = [i for _, i in sorted(((a - x) ** 2 + (b - y) ** 2, i) for _, i, a, b in points if i != q)[:3]]
        assert [d for _, d in sorted(near[q])] == want
