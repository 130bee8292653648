"""Views that give the shared tables the roles of the cell tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators.tables import to_long
from cohortweave.session import sided, spread

MARKERS = ("quantity", "extendedprice", "discount", "tax", "size", "retailprice", "totalprice")
IDS = ("cohort", "image_id", "patient_id", "cell_id", "native_label")
# fixed values: dataset facts of the five market segments and of the five vector cohorts
SEGMENTS = (("AUTOMOBILE", "imaging", "north", 0.5), ("BUILDING", "imaging", "south", 0.5),
            ("FURNITURE", "cytometry", "north", 0.4), ("HOUSEHOLD", "cytometry", "east", 0.4),
            ("MACHINERY", "imaging", "east", 1.0))
VECTOR_COHORTS = (("C0", "imaging", "north", 0.5), ("C1", "imaging", "south", 0.5),
                  ("C2", "cytometry", "north", 0.4), ("C3", "cytometry", "east", 0.4),
                  ("C4", "imaging", "east", 1.0))
REGISTRY_SCHEMA = "cohort string, platform string, tissue string, px_um double"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as cells: segment = cohort, order = image, customer = patient, part type = label.

    Orders meet their customers before the lines, so that lines are dealt out twice, by order and by part. Sides are
    broadcast by their counted rows (file footers), not by what their files weigh.
    """
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice", "p_brand")
    rows, o_rows = li.count(), o.count()
    o = spread(o, o_rows, "o_custkey").join(sided(c, c.count()), o.o_custkey == c.c_custkey)
    j = spread(li, rows, "l_orderkey").join(sided(o, o_rows), li.l_orderkey == o.o_orderkey)
    j = spread(j, rows, "l_partkey").join(sided(p, p.count()), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.col("c_mktsegment").alias("cohort"),
        F.concat_ws("|", "c_mktsegment", F.col("l_orderkey").cast("string")).alias("image_id"),
        F.concat_ws("|", "c_mktsegment", F.col("o_custkey").cast("string")).alias("patient_id"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cell_id"),
        F.col("p_type").alias("native_label"), "p_brand",
        F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("extendedprice"),
        F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("retailprice"),
        F.col("o_totalprice").cast("double").alias("totalprice"))


def cell_values(spark: SparkSession, d: str) -> DataFrame:
    return to_long(cells(spark, d), IDS, MARKERS)


def values_by_cell(spark: SparkSession, d: str) -> DataFrame:
    """cell_values with the rows of a cell in one task: dealt out as wide rows, unfolded there."""
    wide = cells(spark, d).select("cohort", "cell_id", *MARKERS).repartition("cohort", "cell_id")
    return to_long(wide, ("cohort", "cell_id"), MARKERS)


SQL_CELLS = """
cells AS (
  SELECT c_mktsegment AS cohort, c_mktsegment || '|' || l_orderkey AS image_id,
         c_mktsegment || '|' || o_custkey AS patient_id,
         l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-'
           || CAST(round(l_extendedprice * 100) AS BIGINT) AS cell_id,
         p_type AS native_label, p_brand,
         CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS extendedprice,
         CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, CAST(p_size AS DOUBLE) AS size,
         CAST(p_retailprice AS DOUBLE) AS retailprice, CAST(o_totalprice AS DOUBLE) AS totalprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey)"""
SQL_LONG = SQL_CELLS + """,
long AS (
  SELECT cohort, image_id, patient_id, cell_id, native_label, marker, value FROM cells
  UNPIVOT (value FOR marker IN (quantity, extendedprice, discount, tax, size, retailprice, totalprice)))"""
SQL_RANKED = SQL_LONG + """,
ranked AS (
  SELECT *, (rank() OVER (PARTITION BY cohort, marker ORDER BY value)
             + (count(*) OVER (PARTITION BY cohort, marker, value) - 1) / 2.0)
            / count(value) OVER (PARTITION BY cohort, marker) AS u FROM long)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embedding rows as cells with one marker per dimension."""
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("C"), (F.col("vec_id") % 5).cast("string")).alias("cohort"),
        F.concat(F.lit("C"), (F.col("vec_id") % 5).cast("string"), F.lit("|"), (F.col("vec_id") % 25).cast("string")).alias("image_id"),
        F.col("vec_id").alias("cell_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("native_label"),
        F.col("label").cast("long").alias("cls"),
        F.posexplode("embedding").alias("dim", "_v")).select(
        "cohort", "image_id", "cell_id", "native_label", "cls",
        F.concat(F.lit("m"), F.lpad(F.col("dim").cast("string"), 2, "0")).alias("marker"),
        F.col("_v").cast("double").alias("value"))


SQL_VECTORS = """
vectors AS (
  SELECT 'C' || (vec_id % 5) AS cohort, 'C' || (vec_id % 5) || '|' || (vec_id % 25) AS image_id,
         vec_id AS cell_id, 'L' || label AS native_label, CAST(label AS BIGINT) AS cls,
         'm' || lpad(CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR), 2, '0') AS marker,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings)"""
SQL_VRANKED = SQL_VECTORS + """,
vranked AS (
  SELECT *, (rank() OVER (PARTITION BY cohort, marker ORDER BY value)
             + (count(*) OVER (PARTITION BY cohort, marker, value) - 1) / 2.0)
            / count(value) OVER (PARTITION BY cohort, marker) AS u FROM vectors)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Events as located cells: user = image, value = x, fractional hour of day = y."""
    return table(spark, d, "events").select(
        F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string")).alias("cohort"),
        F.col("user_id").cast("string").alias("image_id"), F.col("event_id").alias("cell_id"),
        F.col("event_type").alias("native_label"), F.col("value").cast("double").alias("x_px"),
        (F.hour("ts") + F.minute("ts") / 60.0).cast("double").alias("y_px"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


SQL_POINTS = """
points AS (
  SELECT 'C' || (user_id % 5) AS cohort, CAST(user_id AS VARCHAR) AS image_id, event_id AS cell_id,
         event_type AS native_label, CAST(value AS DOUBLE) AS x_px,
         CAST(hour(ts) + minute(ts) / 60.0 AS DOUBLE) AS y_px,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""


def segment_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, REGISTRY_SCHEMA)


def vector_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VECTOR_COHORTS, REGISTRY_SCHEMA)


def _values(rows) -> str:
    return ", ".join("('%s', '%s', '%s', CAST(%s AS DOUBLE))" % r for r in rows)


SQL_SEGMENTS = f"registry(cohort, platform, tissue, px_um) AS (VALUES {_values(SEGMENTS)})"
SQL_VECTOR_COHORTS = f"registry(cohort, platform, tissue, px_um) AS (VALUES {_values(VECTOR_COHORTS)})"

# Predictions: truth = code of the part type, calls = a code from the brand (7 values, so one class
# is called but never true) or from the part size (6 values).
TYPE_CODES = {"ECONOMY": 0, "LARGE": 1, "MEDIUM": 2, "PROMO": 3, "SMALL": 4, "STANDARD": 5}


def predictions(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    truth = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv]), F.col("native_label"))
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    calls = F.array(F.struct(F.lit("brand").alias("method"), (brand % 7).alias("y_pred")),
                    F.struct(F.lit("size").alias("method"), (F.col("size").cast("long") % 6).alias("y_pred")))
    return (c.select("cell_id", "cohort", F.col("cohort").alias("held"), F.lit("LOCO").alias("protocol"),
                     truth.cast("long").alias("y_true"), F.explode(calls).alias("_c"))
            .select("cell_id", "cohort", "held", "_c.method", "protocol", "y_true", "_c.y_pred"))


SQL_PREDS = SQL_CELLS + """,
preds AS (
  SELECT cell_id, cohort, cohort AS held, method, 'LOCO' AS protocol,
         CAST(CASE native_label WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2
              WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 5 END AS BIGINT) AS y_true,
         CASE method WHEN 'brand' THEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 7
              ELSE CAST(size AS BIGINT) % 6 END AS y_pred
  FROM cells CROSS JOIN (VALUES ('brand'), ('size')) AS m(method))"""
