"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space is kept.

A sketch grows with its text, so two sketches are samples of the same part of the hash space: overlap
of sketches estimates overlap of the texts however unequal their lengths, and the sketch of a union is
the union of the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.words import shingle_hashes, words_of
from cohortweave.session import materialise

SHINGLE_WORDS = 5
FRACTION = 0.25


def add_sketch(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """`df` plus the sorted distinct hashes below the fraction of lower-cased `words`-word shingles.

    A text whose shingles all lie above the threshold keeps its smallest hash, so only texts without
    words have an empty sketch. Null text counts as empty.
    """
    limit = -(1 << 63) + int(fraction * (1 << 64))
    w, h, k = f"_{out}_words", f"_{out}_hashes", f"_{out}_kept"
    df = df.withColumn(w, words_of(F.lower(F.coalesce(F.col(text), F.lit("")))))
    df = df.withColumn(h, shingle_hashes(w, words))
    df = df.withColumn(k, F.filter(h, lambda x: x < F.lit(limit)))
    sketch = (F.when(F.size(k) > 0, F.sort_array(F.array_distinct(k)))
              .when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.col(k)))
    return df.withColumn(out, sketch).drop(w, h, k)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two texts' shingles taken together."""
    limit = -(1 << 63) + int(fraction * (1 << 64))
    both = F.sort_array(F.array_union(a, b))
    below = F.filter(both, lambda x: x < F.lit(limit))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike, one empty sketch is not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained in everything."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """16 hex digits a hash, in ascending order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """(_id, _th) rows, each with the row that follows in order; the last is followed by the first.

    The rows are range-partitioned and stored; what follows the last row of a partition comes from a
    table of one row a partition.
    """
    key = F.struct("_id", "_th")
    ranged = materialise(keys.repartitionByRange("_id", "_th").withColumn("_part", F.spark_partition_id()))
    parts = Window.orderBy("_part")  # one row a partition
    edges = (ranged.groupBy("_part").agg(F.min(key).alias("_first"))
             .select("_part", F.coalesce(F.lead("_first").over(parts), F.min("_first").over(Window.partitionBy()))
                     .alias("_after")))
    inside = ranged.withColumn("_lead", F.lead(key).over(Window.partitionBy("_part").orderBy("_id", "_th")))
    return inside.join(edges, "_part").select(*keys.columns, F.coalesce("_lead", "_after").alias("_next"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                 fraction: float = FRACTION) -> DataFrame:
    """Fingerprint every text and its edited text, and compare both, and the next document's.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many
    of the next document by id. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Null text counts as empty; its fingerprint is "". Null ids come first (-2^63 is read as null). Rows with one id follow
    each other by a hash of their text; a repeated row is followed by its own copy and only the last
    copy by the next document. A lone row follows itself. An empty table gives no rows. Other columns
    are not read.
    """
    # both sides of the last join need the same three columns, so they share one exchange of the texts
    null_id = -(1 << 63)
    base = docs.select(F.coalesce(F.col(id_col), F.lit(null_id)).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_th", F.xxhash64("_text"))
    keys = base.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("_copies"),
                                          F.first(F.length("_text")).alias("_chars"))
    order = next_keys(keys)
    before = order.select(F.col("_next._id").alias("_id"), F.col("_next._th").alias("_th"),
                          F.col("_id").alias("_before_id"), F.col("_th").alias("_before_th"),
                          F.expr("_chars div 4").alias("_take"))
    pointed = base.join(before.join(keys.select("_id", "_th", "_copies"), ["_id", "_th"]), ["_id", "_th"])
    pointed = pointed.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id")))
    pointed = add_sketch(pointed, "_text", "_sketch", words, fraction)
    following = pointed.where("_nth = 1").select(
        F.col("_before_id").alias("_id"), F.col("_before_th").alias("_th"),
        F.expr("substring(_text, 1, cast(_take as int))").alias("_head"), F.col("_sketch").alias("_after"))
    full = pointed.join(following, ["_id", "_th"])
    copy = F.col("_nth") < F.col("_copies")
    n = F.length("_text")
    full = full.select(
        F.nullif(F.col("_id"), F.lit(null_id)).alias(id_col), n.cast("long").alias("n_chars"), "_sketch",
        F.when(copy, F.col("_sketch")).otherwise(F.col("_after")).alias("_after"),
        F.concat(F.expr("substring(_text, 1, length(_text) - length(_text) div 4)"),
                 F.when(copy, F.expr("substring(_text, 1, cast(length(_text) div 4 as int))"))
                 .otherwise(F.col("_head"))).alias("_edited"))
    full = add_sketch(full, "_edited", "_edited_sketch", words, fraction)
    return full.select(
        id_col, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_after")).alias("near_next"))
