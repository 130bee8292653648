"""Standard-table sink, metadata, predictions contract, fingerprints, table diff, region table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PREDICTION_COLUMNS = ("cell_id", "cohort", "held", "method", "protocol", "y_true", "y_pred")


def write_standard(df: DataFrame, path: str) -> None:
    """One Parquet folder per cohort, spread by image so that a large cohort makes many files."""
    df.repartition("cohort", "image_id").write.mode("overwrite").partitionBy("cohort").parquet(path)


def metadata(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Per cohort: cells, images, patients and the markers that hold any value."""
    measured = [F.when(F.count(F.col(m)) > 0, F.lit(m)) for m in markers]
    return df.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("image_id").alias("n_images"),
        F.countDistinct("patient_id").alias("n_patients"),
        F.array_sort(F.array_compact(F.array(*measured))).alias("markers"),
    ).withColumn("n_markers", F.size("markers"))


def write_metadata(df: DataFrame, markers: Sequence[str], path: str) -> None:
    """JSON sidecar, one row per cohort."""
    metadata(df, markers).write.mode("overwrite").json(path)


def predictions(df: DataFrame, cohort: str | Column, held: str | Column, method: str,
                protocol: str = "LOCO") -> DataFrame:
    """The predictions contract; a plain string for cohort or held is broadcast to every row."""
    def const(x):
        return F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.col("cell_id"), const(cohort).alias("cohort"), const(held).alias("held"),
        F.lit(method).alias("method"), F.lit(protocol).alias("protocol"),
        F.col("y_true").cast("long").alias("y_true"), F.col("y_pred").cast("long").alias("y_pred"))


def save_predictions(df: DataFrame, path: str) -> None:
    missing = [c for c in PREDICTION_COLUMNS if c not in df.columns]
    if missing:
        raise KeyError(f"predictions lack {missing}")
    # saving a (method, held) again replaces it
    df.select(*PREDICTION_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "method", "held").parquet(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Method and held are text even where every name looks like a number."""
    stored = spark.read.parquet(path).schema
    for name in ("method", "held"):
        stored[name].dataType = StringType()
    return spark.read.schema(stored).parquet(path).select(*PREDICTION_COLUMNS)


def fingerprint(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                tag: str = "v1") -> DataFrame:
    """Order-free content fingerprint per key: tag:rows:digest.

    Rows are hashed where they lie and folded by two commutative sums, so no group is gathered
    into one sorted string.
    """
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols]))
    hi = F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)")
    lo = F.conv(F.substring(h, 13, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hi).alias("_a"), F.sum(lo).alias("_b"),
    ).select(*keys, F.concat_ws(":", F.lit(tag), F.col("n").cast("string"), F.sha2(
        F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string")), 256)).alias("fingerprint"))


def stale(current: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Artifacts whose recorded fingerprint is missing or differs."""
    old = manifest.select(*keys, F.col("fingerprint").alias("recorded"))
    return (current.join(old, list(keys), "left")
            .withColumn("stale", ~F.col("fingerprint").eqNullSafe(F.col("recorded"))))


def table_diff(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row: same schema?, rows only in a, rows only in b, status. Timing columns are ignored."""
    ca, cb = [c for c in a.columns if c not in ignore], [c for c in b.columns if c not in ignore]
    if sorted(ca) != sorted(cb):
        return a.sparkSession.range(1).select(
            F.lit(False).alias("same_columns"), F.lit(None).cast("long").alias("only_a"),
            F.lit(None).cast("long").alias("only_b"), F.lit("different").alias("status"))
    cols = sorted(ca)
    # exceptAll in both directions as one signed count per distinct row
    signed = (a.select(*cols).withColumn("_s", F.lit(1))
              .unionByName(b.select(*cols).withColumn("_s", F.lit(-1))))
    d = signed.groupBy(*cols).agg(F.sum("_s").alias("_d"))
    return d.agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).cast("long").alias("only_a"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("long").alias("only_b"),
    ).select(
        F.lit(True).alias("same_columns"), "only_a", "only_b",
        F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "same content")
        .otherwise("different").alias("status"))


def region_properties(pixels: DataFrame, image: str, region: str, x: str, y: str,
                      channels: Sequence[str]) -> DataFrame:
    """Centroid, pixel area and channel means of every labelled region (0 is background)."""
    return pixels.where(F.col(region) > 0).groupBy(image, region).agg(
        F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("area"),
        *[F.avg(c).alias(f"mean_{c}") for c in channels])


def patient_from_image(image: str | Column) -> Column:
    """Patient id: the image id without its trailing A/B core suffix."""
    c = F.col(image) if isinstance(image, str) else image
    return F.regexp_replace(c, "[AB]$", "")
