"""Leak-free train/val/test splits by patient, and the assertions around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.numeric import order_key
from cohortweave.operators.distribution import row_order
from cohortweave.operators.joins import RuleViolation, assert_empty
from cohortweave.operators.sampling import lowest_cut
from cohortweave.session import by_shuffle, checked, materialise

# fixed values: shares of split units
TEST_FRACTION, VAL_FRACTION = 0.20, 0.12
# fixed values: patient tails that mean "not recorded"
NO_PATIENT = ("", "unknown", "nan", "None")


def nesting_violations(cells: DataFrame) -> DataFrame:
    """Images that carry more than one patient."""
    return (cells.select("cohort", "image_id", "patient_id").distinct()
            .groupBy("cohort", "image_id").agg(F.count(F.lit(1)).alias("patients")).where("patients > 1"))


def split_units(cells: DataFrame) -> DataFrame:
    """cohort, image_id, unit, unit_kind: the patient, or the image where the patient is missing
    for any row of the cohort or constant over it."""
    return _units(image_sizes(cells))


def image_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cohort", "image_id", "patient_id").agg(F.count(F.lit(1)).alias("cells"))


def _units(imgs: DataFrame) -> DataFrame:
    tail = F.substring_index("patient_id", "|", -1)
    # min/max instead of a distinct count: only "constant or not" matters
    kind = imgs.groupBy("cohort").agg(
        F.bool_or(F.col("patient_id").isNull() | tail.isin(*NO_PATIENT)).alias("_missing"),
        (F.min("patient_id") == F.max("patient_id")).alias("_const"))
    by_image = F.col("_missing") | F.col("_const")
    return imgs.join(kind, "cohort").select(
        "cohort", "image_id", "cells",
        F.when(by_image, F.col("image_id")).otherwise(F.col("patient_id")).alias("unit"),
        F.when(by_image, F.lit("image")).otherwise(F.lit("patient")).alias("unit_kind"))


def split_plan(cells: DataFrame, purpose: str = "split") -> DataFrame:
    """cohort, image_id, unit, unit_kind, part. Units go to test, val, train by hashed order.

    Raises if an image carries two patients, or if a cohort has fewer than three units.
    """
    sizes = materialise(image_sizes(cells))  # the cells are read once
    assert_empty(nesting_violations(sizes), "an image must have one patient")
    imgs = materialise(_units(sizes))
    units = imgs.select("cohort", "unit").distinct().withColumn("_k", order_key(purpose, "cohort", "unit"))
    n = units.groupBy("cohort").agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_order(units, ["cohort"], "_k", "_pos").join(n, "cohort")

    def count_of(f: float):
        return F.greatest(F.lit(1), F.bround(F.lit(f) * F.col("_n"), 0).cast("long"))

    nt, nv = count_of(TEST_FRACTION), count_of(VAL_FRACTION)
    part = (F.when(F.col("_pos") < nt, "test").when(F.col("_pos") < nt + nv, "val").otherwise("train"))
    check_split_units(n.withColumnRenamed("_n", "units"))
    return materialise(imgs.join(by_shuffle(ranked.select("cohort", "unit", part.alias("part"), F.col("_n").alias("units"))), ["cohort", "unit"]))


def check_split_units(plan: DataFrame) -> None:
    """Three parts need at least three units."""
    short = plan.groupBy("cohort").agg(F.min("units").alias("units")).where("units < 3")
    assert_empty(short, "train, val and test need 3 split units")


def attach_split(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Part of every cell; an image the plan does not know raises."""
    p = plan.select("cohort", "image_id", "part")
    assert_empty(cells.select("cohort", "image_id").distinct().join(p, ["cohort", "image_id"], "left_anti"),
                 "cells carry image ids the split plan does not know")
    return cells.join(by_shuffle(p), ["cohort", "image_id"])


def split_summary(plan: DataFrame) -> DataFrame:
    """Per cohort: unit kind, images, units and cell share of each part."""
    parts = ("train", "val", "test")
    return plan.groupBy("cohort").agg(
        F.first("unit_kind").alias("unit_kind"), F.count(F.lit(1)).alias("images"),
        F.max("units").alias("units"),
        *[F.countDistinct(F.when(F.col("part") == p, F.col("unit"))).alias(f"units_{p}") for p in parts],
        *[(F.sum(F.when(F.col("part") == p, F.col("cells")).otherwise(0)) / F.sum("cells")).alias(f"cells_{p}")
          for p in parts])


def multi_image_patients(cells: DataFrame) -> DataFrame:
    """Images whose patient has another image: the domain where image identity is technical."""
    imgs = cells.select("cohort", "image_id", "patient_id").distinct()
    many = (imgs.groupBy("cohort", "patient_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2"))
    return imgs.join(many, ["cohort", "patient_id"], "left_semi")


def probe_holdout(train_cells: DataFrame, row_id: str, hold: int, purpose: str = "trainpool") -> DataFrame:
    """Reserve up to min(hold, n/5) training rows per cohort; keep only those whose image still has
    a row left for training. Adds role = probe | train; probe rows of exhausted images are dropped."""
    n = train_cells.groupBy("cohort").agg(F.count(F.lit(1)).alias("_n"))
    d = row_order(train_cells.withColumn("_k", order_key(purpose, row_id)), ["cohort"], "_k", "_pos")
    d = d.join(n, "cohort").withColumn(
        "role", F.when(F.col("_pos") < F.least(F.lit(hold), F.floor(F.col("_n") / 5)), "probe").otherwise("train"))
    left = d.where("role = 'train'").select("cohort", "image_id").distinct()
    kept = d.where("role = 'probe'").join(left, ["cohort", "image_id"], "left_semi")
    return d.where("role = 'train'").unionByName(kept).drop("_k", "_pos", "_n")


def draw(cells: DataFrame, row_id: str, caps: dict[str, int]) -> DataFrame:
    """Capped draw per (cohort, part); a part without a cap is kept whole. Rows above a group's cut are never sorted."""
    cells = materialise(cells)
    capped = cells.where(F.col("part").isin(list(caps)))
    d = capped.withColumn("_g", F.struct("cohort", "part")).withColumn("_k", order_key("draw", "part", row_id))
    keyed = d.select("_g", "_k")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("part"))
    sizes = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("part", F.col("_g.part")).withColumn("_cap", cap.cast("long"))
    cuts = checked(lowest_cut(keyed, sizes.where("_n > _cap AND _cap > 0").select("_g", "_n", "_cap")))
    near = d.join(cuts, "_g", "left").where(F.col("_cut").isNull() | (F.col("_k") <= F.col("_cut"))).drop("_g", "_cut")
    d = row_order(near, ["cohort", "part"], "_k", "_pos")  # exact where row ids repeat
    return d.where(F.col("_pos") < cap).drop("_k", "_pos").unionByName(cells.where(~F.col("part").isin(list(caps))))


def comparability(a: DataFrame, b: DataFrame, fold: str, checks: Sequence[str]) -> DataFrame:
    """Folds where two result sets differ on label space, class count or split fingerprint.

    A fold present on one side only is reported as missing.
    """
    x = a.select(fold, F.lit(True).alias("_ina"), *[F.col(c).alias(f"_a_{c}") for c in checks])
    y = b.select(fold, F.lit(True).alias("_inb"), *[F.col(c).alias(f"_b_{c}") for c in checks])
    j = x.join(y, fold, "full")
    both = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    bad = F.array_compact(F.array(
        F.when(F.col("_ina").isNull(), "missing_a"), F.when(F.col("_inb").isNull(), "missing_b"),
        *[F.when(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in checks]))
    return j.select(fold, F.array_join(bad, ",").alias("mismatch"), (F.size(bad) == 0).alias("comparable"))


__all__ = [n for n in dir() if not n.startswith("_") and n != "RuleViolation"]
