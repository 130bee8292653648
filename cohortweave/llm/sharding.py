"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.session import materialise


def size_prefixes(sized: DataFrame, order: list[str]) -> DataFrame:
    """`sized` (with a positive `size`) plus `before` (bytes of all earlier rows), `row` (rows before)
    and `total` (bytes of all rows), in the order of `order` (nulls first, full ties in scan order).

    The rows are range-partitioned once and stored. Each partition gives one row of totals, whose
    prefix sums are the partitions' offsets; inside a partition a window continues from its offset.
    The tie column spreads a hot key over many partitions.
    """
    ranged = materialise(
        sized.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    everything = Window.partitionBy()
    offsets = (ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
                       F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
                       F.sum("_bytes").over(everything).alias("total")))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (ranged.withColumn("_run", F.sum("size").over(upto) - F.col("size"))
             .withColumn("_nth", F.row_number().over(inside) - 1))
    return local.join(offsets, "_part").select(
        *sized.columns, (F.col("_run") + F.col("_bytes_before")).alias("before"),
        (F.col("_nth") + F.col("_rows_before")).cast("long").alias("row"), "total")


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of `shards` contiguous shards (by id) of near-equal bytes.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (place in the shard from 0). The
    shard of a row is where its middle byte falls among equal cuts of all bytes, so a shard differs
    from its target by at most one row's size.

    Null or empty text: size 1, crc32 0. Null ids come first. Repeated rows each take a place of their
    own. An empty table gives no rows. With fewer rows than shards some shards stay empty. Other
    columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = size_prefixes(sized, ["doc_id", "text_crc32", "size"]).withColumn(
        "shard", F.expr(f"{shards} * (2 * before + size) div (2 * total)").cast("int"))
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    return placed.join(first, "shard").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("_first")).alias("slot"))
