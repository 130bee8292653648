"""Row-sized work is dealt out by rows: no task holds a dataset, a file or a share that grows with the input."""

from __future__ import annotations

import pytest

from cohortweave import session
from cohortweave.operators import distribution, metrics, profile, splits
from cohortweave.sources import loaders


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_of_a_file_are_not_dealt_out_by_file(spark, tmp_path, no_broadcast):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = loaders.number_rows(loaders.read_table(spark, f"{tmp_path}/t", "parquet", placed=True))
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["cell_id"] for r in df.collect()) == list(range(1000))


def test_platforms_join_counts_not_rows(spark):
    preds = spark.createDataFrame([("m", "A", 0, 0), ("m", "A", 0, 1), ("m", "B", 1, 1)], "method string, cohort string, y_true long, y_pred long")
    registry = spark.createDataFrame([("A", "x"), ("B", "x")], "cohort string, platform string")
    got = metrics.per_platform(preds, registry, ["method"])
    lines = plan_of(got).split("\n")
    last = max(i for i, x in enumerate(lines) if "Join Inner, (cohort" in x)
    assert any("Aggregate" in x for x in lines[last:])
    assert got.first()["n_cells"] == 3


def test_split_plan_and_draw_read_the_cells_once(spark):
    rows = [("C", f"i{i // 4}", f"C|p{i // 8}", str(i // 2)) for i in range(80)]  # every cell id twice
    cells = spark.createDataFrame(rows, "cohort string, image_id string, patient_id string, cell_id string")
    plan = splits.split_plan(cells)
    assert "LogicalRDD" not in plan_of(plan)
    drawn = splits.draw(splits.attach_split(cells, plan), "cell_id", {"train": 5})
    assert "LogicalRDD" not in plan_of(drawn)
    assert drawn.where("part = 'train'").count() == 5
    assert drawn.where("part <> 'train'").count() == splits.attach_split(cells, plan).where("part <> 'train'").count()


def test_label_signatures_in_many_chunks(spark, monkeypatch):
    long = spark.range(600).selectExpr("concat('C', id % 2) cohort", "concat('L', id % 3) native_label", "'m' marker", "cast(hash(id) % 97 as double) value")
    want = {tuple(r)[:3]: r for r in profile.signatures(long, min_cells=1).collect()}
    monkeypatch.setattr(profile, "CHUNK_ROWS", 10)
    sig = profile.signatures(long, min_cells=1)
    assert "RepartitionByExpression [_chunk" in plan_of(sig)
    for r in sig.collect():
        assert r["q"] == pytest.approx(want[tuple(r)[:3]]["q"]) and r["mean_rank"] == pytest.approx(want[tuple(r)[:3]]["mean_rank"])


def test_value_tables_beyond_the_limit_are_not_broadcast(spark, monkeypatch):
    df = spark.range(200).selectExpr("'g' g", "id", "cast(id as double) v")
    table, at = df.selectExpr("g", "v", "v u"), df.selectExpr("g", "v", "1L n_at")
    far = distribution.attach_by_value(df, table, ["g"], "v", ["id"], at, sent=100)
    assert "BroadcastHashJoin" not in far._jdf.queryExecution().executedPlan().toString() and far.where("u = v").count() == 200


def test_dealt_tasks_are_bounded_by_rows(spark):
    df = spark.range(1000)
    assert session.dealt(df, 1000, "id", most=10).rdd.getNumPartitions() == 100
    assert session.dealt(df, 1000, "id", most=10, ranges=True).rdd.getNumPartitions() == 100
    assert session.dealt(df, 1000, "id").rdd.getNumPartitions() == df.rdd.getNumPartitions()
