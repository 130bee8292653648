"""Session settings and the durable hand-off used by iterative and multi-pass operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TASK_ROWS = 500_000  # rows of a large join that one task should hold
SENT = 100_000  # stored tables up to this many rows are broadcast; larger ones are joined by shuffle


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cohortweave",
                  **extra: str) -> SparkSession:
    """Local session for tests and the benchmark; clusters pass their own session in."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for durable intermediates: the cluster's checkpoint folder.

    A private folder is used only in local mode with nothing configured (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = os.path.join(tempfile.gettempdir(), f"cohortweave-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage, survives lost executors, and keeps columnar pruning for every reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A row-sized side of a join: always shuffled. Spark would broadcast it by the size of its compressed file or
    shuffle blocks, which says little about the rows that the driver then has to hold."""
    return df.hint("merge")


def sided(df: DataFrame, rows: int, most: int = SENT) -> DataFrame:
    """A side of a join that counts `rows` rows: broadcast up to `most`, shuffled beyond, whatever its files weigh."""
    return F.broadcast(df) if rows <= most else by_shuffle(df)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A side of a join, dealt by `keys` to tasks of about TASK_ROWS rows where Spark would make larger ones: it goes by
    compressed bytes and, up to its target size, makes no more tasks than cores. Joins get the session's number of
    partitions at least, so smaller tables are left to Spark."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if 8 * n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dealt(df: DataFrame, rows: int, *keys: str, most: int | None = None, ranges: bool = False) -> DataFrame:
    """Dealt by `keys` (or by their ranges) to tasks of about `most` rows (TASK_ROWS), once that gives every core one."""
    n = -(-rows // (most or TASK_ROWS))
    few = n <= df.sparkSession.sparkContext.defaultParallelism
    if ranges:
        return df.repartitionByRange(*keys) if few else df.repartitionByRange(n, *keys)
    return df if few else df.repartition(n, *keys)


def checked(df: DataFrame, most: int = SENT) -> DataFrame:
    """A stored table, broadcast if it counts at most `most` rows and shuffled beyond."""
    return sided(*materialise_counted(df), most)


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """materialise() plus the row count, observed while writing (no second job)."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]
