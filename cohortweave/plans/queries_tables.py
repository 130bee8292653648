"""Ingest, identity, panels, sampling, splits and sinks over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.numeric import r6
from cohortweave.functions.text import lookup_key, name_key
from cohortweave.operators import identity as I
from cohortweave.operators import joins as J
from cohortweave.operators import sampling as SM
from cohortweave.operators import splits as SP
from cohortweave.operators import tables as S
from cohortweave.operators.distribution import ecdf, row_order
from cohortweave.plans.registry import query
from cohortweave.plans.tables import (
    IDS, MARKERS, SQL_CELLS, SQL_LONG, SQL_POINTS, SQL_PREDS, SQL_RANKED, SQL_SEGMENTS, SQL_VECTOR_COHORTS,
    SQL_VECTORS, SQL_VRANKED, cell_values, values_by_cell, cells, points, predictions, segment_registry, table, vector_registry, vectors,
)
from cohortweave.session import dealt, materialise
from cohortweave.sources import loaders as L
from cohortweave.sources import sinks as K
from cohortweave.sources.specs import AreaRule, CohortSpec, MarkerRule, TableSpec


# ------------------------------------------------------------------------------- ingest
def _order_spec(d: str) -> CohortSpec:
    """Orders as a spec-loaded dataset, joined n:1 to its customers."""
    return CohortSpec(
        name="ORD", platform="imaging", tissue="north", role="train", px_um=0.5,
        base=TableSpec(f"{d}/orders.parquet", columns={
            "image_id": "o_orderkey", "patient_id": "o_custkey", "x_px": "o_totalprice", "y_px": "o_custkey",
            "native_label": "o_orderstatus"}),
        joins=(TableSpec(f"{d}/customer.parquet", columns={"balance": "c_acctbal", "nation": "c_nationkey"},
                         left_on=("o_custkey",), right_on=("c_custkey",)),),
        markers=MarkerRule("pattern", regex="price$"),
        area=AreaRule("divide", numerator="balance", denominator="nation"))


@query("spec_load", """
SELECT 'ORD' AS cohort, 'ORD|' || o_orderkey AS image_id, 'ORD|' || o_custkey AS patient_id, o_totalprice AS x_px, CAST(o_custkey AS DOUBLE) AS y_px,
       round(c_acctbal / nullif(c_nationkey, 0), 6) + 0.0 AS area_px2, o_orderstatus AS native_label, CAST(1 AS DOUBLE) AS label_confidence,
       round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) AS o_totalprice
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def spec_load(spark, d):
    df, markers = L.load(spark, _order_spec(d))
    return df.select("cohort", "image_id", "patient_id", "x_px", "y_px", r6("area_px2").alias("area_px2"), "native_label",
                     F.col("label_confidence").cast("double").alias("label_confidence"),
                     *[F.round(F.col(m).cast("double"), 2).alias(m) for m in markers])


@query("spec_load_row_ids", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS lo, count(*) - 1 AS hi, count(*) AS ids FROM orders")
def spec_load_row_ids(spark, d):
    df, _ = L.load(spark, _order_spec(d))
    df = dealt(df.select("cell_id"), table(spark, d, "orders").count(), "cell_id")  # distinct ids are held by the tasks
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("lo"), F.max("cell_id").alias("hi"),
                  F.countDistinct("cell_id").alias("ids"))


def _rule_columns(spark, d, rule):
    cols = L.resolve_markers(spark, rule, table(spark, d, "lineitem").columns)
    li = table(spark, d, "lineitem").select("l_returnflag", *cols)
    return li.unpivot(["l_returnflag"], cols, "marker", "value").groupBy("l_returnflag", "marker").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query("marker_range_rule", """WITH l AS (SELECT l_returnflag, marker, value FROM (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
 UNPIVOT (value FOR marker IN (l_quantity, l_extendedprice, l_discount, l_tax)))
SELECT l_returnflag, marker, count(*) AS n, round(avg(value), 6) AS mean FROM l GROUP BY 1, 2""")
def marker_range_rule(spark, d):
    return _rule_columns(spark, d, MarkerRule("range", start="l_quantity", end="l_tax"))


@query("marker_pattern_rule", """WITH l AS (SELECT l_returnflag, marker, value FROM (SELECT l_returnflag, l_discount, l_tax FROM lineitem)
 UNPIVOT (value FOR marker IN (l_discount, l_tax)))
SELECT l_returnflag, marker, count(*) AS n, round(avg(value), 6) AS mean FROM l GROUP BY 1, 2""")
def marker_pattern_rule(spark, d):
    return _rule_columns(spark, d, MarkerRule("pattern", regex="_(discount|tax)$"))


@query("marker_exclude_rule", """WITH l AS (SELECT l_returnflag, marker, value FROM (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
 UNPIVOT (value FOR marker IN (l_quantity, l_extendedprice, l_discount, l_tax)))
SELECT l_returnflag, marker, count(*) AS n, round(avg(value), 6) AS mean FROM l GROUP BY 1, 2""")
def marker_exclude_rule(spark, d):
    return _rule_columns(spark, d, MarkerRule("exclude", columns=(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")))


def _own_path(spark, name):
    import uuid

    from cohortweave.session import shared_dir
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("marker_file_rule", """WITH l AS (SELECT l_returnflag, marker, value FROM (SELECT l_returnflag, l_extendedprice, l_tax FROM lineitem)
 UNPIVOT (value FOR marker IN (l_extendedprice, l_tax)))
SELECT l_returnflag, marker, count(*) AS n, round(avg(value), 6) AS mean FROM l GROUP BY 1, 2""")
def marker_file_rule(spark, d):
    """Markers named by a file without header."""
    path = _own_path(spark, "markers")
    spark.createDataFrame([(c,) for c in table(spark, d, "lineitem").columns if c in ("l_extendedprice", "l_tax")], "name string").write.csv(path)
    return _rule_columns(spark, d, MarkerRule("file", path=path, header=False))


@query("headerless_csv", """SELECT code, count(*) AS n, min(c_custkey) AS lo, max(c_custkey) AS hi
FROM (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'NaN' ELSE c_mktsegment END AS code FROM customer) GROUP BY 1""")
def headerless_csv(spark, d):
    """Customers written as text without header and read back: NA, NaN and the empty text are data, only nothing is missing."""
    k, path = F.col("c_nationkey") % 5, _own_path(spark, "customers")
    code = F.when(k == 0, "NA").when(k == 1, "").when(k == 3, "NaN").when(k == 4, F.col("c_mktsegment"))
    table(spark, d, "customer").select("c_custkey", code.alias("code")).write.csv(path)
    back = L.read_table(spark, path, "csv", header=False).toDF("c_custkey", "code").withColumn("c_custkey", F.col("c_custkey").cast("long"))
    return back.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


@query("standard_table_round_trip", f"""WITH {SQL_CELLS} SELECT cohort, count(*) AS n, count(DISTINCT image_id) AS images, count(DISTINCT cell_id) AS cells,
 round(sum(quantity), 3) AS quantity, round(avg(totalprice), 6) AS totalprice FROM cells GROUP BY 1""")
def standard_table_round_trip(spark, d):
    """The cell table through the sink, one folder a cohort, and read back whole."""
    path = _own_path(spark, "standard")
    K.write_standard(cells(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images"), F.count_distinct("cell_id").alias("cells"),
                                      F.round(F.sum("quantity"), 3).alias("quantity"), r6(F.avg("totalprice")).alias("totalprice"))


@query("standard_metadata", f"""WITH {SQL_CELLS}
SELECT cohort, count(*) AS n_cells, count(DISTINCT image_id) AS n_images, count(DISTINCT patient_id) AS n_patients, 7 AS n_markers FROM cells GROUP BY 1""")
def standard_metadata(spark, d):
    return K.metadata(cells(spark, d), MARKERS).drop("markers")


@query("row_ids", f"""WITH {SQL_CELLS}
SELECT cohort, cell_id, row_number() OVER (PARTITION BY cohort ORDER BY cell_id) - 1 AS row_id FROM cells""")
def row_ids(spark, d):
    return row_order(cells(spark, d).select("cohort", "cell_id"), ["cohort"], "cell_id", "row_id")


@query("area_rule", """SELECT p_partkey, round(p_retailprice / nullif(p_size - 1, 0), 6) AS area_px2 FROM part""")
def area_rule(spark, d):
    p = table(spark, d, "part").withColumn("z", F.col("p_size") - 1)
    return p.select("p_partkey", r6(L.area_expr(AreaRule("divide", numerator="p_retailprice", denominator="z"))).alias("area_px2"))


@query("region_properties", """SELECT user_id AS image, CAST(json_extract_string(props, '$.k') AS BIGINT) AS region, round(avg(value), 6) AS cx,
 round(avg(hour(ts)), 6) AS cy, count(*) AS area, round(avg(value), 6) AS mean_value FROM events
 WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 GROUP BY 1, 2""")
def region_properties(spark, d):
    px = table(spark, d, "events").select(F.col("user_id").alias("image"), F.get_json_object("props", "$.k").cast("long").alias("region"),
                                          F.col("value"), F.hour("ts").alias("y"))
    r = K.region_properties(px, "image", "region", "value", "y", ["value"])
    return r.select("image", "region", r6("cx").alias("cx"), r6("cy").alias("cy"), "area", r6("mean_value").alias("mean_value"))


@query("patient_from_image", """SELECT DISTINCT source || CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS image_id, source AS patient_id
 FROM labels JOIN documents USING (doc_id)""")
def patient_from_image(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    x = x.select(F.concat("source", F.when(F.col("quality") == 1, "A").otherwise("B")).alias("image_id")).distinct()
    return x.withColumn("patient_id", K.patient_from_image("image_id"))


@query("predictions_contract", f"""WITH {SQL_PREDS}
SELECT method, held, protocol, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS st, CAST(sum(y_pred) AS BIGINT) AS sp FROM preds GROUP BY 1, 2, 3""")
def predictions_contract(spark, d):
    """Round trip through the partitioned sink."""
    from cohortweave.session import shared_dir
    import uuid
    path = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    for _ in range(2):  # saving again replaces, so the counts stay
        K.save_predictions(predictions(spark, d), path)
    return K.load_predictions(spark, path).groupBy("method", "held", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("st"), F.sum("y_pred").alias("sp"))


@query("fingerprints", """
WITH h AS (SELECT o_orderstatus, md5(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS h FROM orders)
SELECT o_orderstatus, 'v1:' || count(*) || ':' || sha256(
   CAST(sum(CAST(CAST('0x' || substr(h, 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '|' ||
   CAST(sum(CAST(CAST('0x' || substr(h, 13, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM h GROUP BY 1""")
def fingerprints(spark, d):
    return K.fingerprint(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("stale_artifacts", "SELECT o_orderstatus, o_orderstatus <> 'F' AS stale FROM orders GROUP BY 1")
def stale_artifacts(spark, d):
    """The manifest was recorded before the priorities of all but the F orders were rewritten."""
    cols = ["o_orderkey", "o_orderpriority"]
    now = K.fingerprint(table(spark, d, "orders"), ["o_orderstatus"], cols)
    old = table(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("old"))
    return K.stale(now, K.fingerprint(old, ["o_orderstatus"], cols), ["o_orderstatus"]).select("o_orderstatus", "stale")


@query("table_diff", """SELECT true AS same_columns,
 (SELECT count(*) FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END FROM orders)) AS only_a,
 (SELECT count(*) FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS s FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders)) AS only_b,
 'different' AS status""")
def table_diff(spark, d):
    a = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.lit(1.5).alias("seconds"))
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus"))).withColumn("seconds", F.lit(2.5))
    return K.table_diff(a, b, ["seconds"])


# ------------------------------------------------------------------------------- reshape, panels
@query("unpivot_cells", f"WITH {SQL_LONG} SELECT cohort, marker, count(*) AS n, round(sum(value), 2) AS s FROM long GROUP BY 1, 2")
def unpivot_cells(spark, d):
    return cell_values(spark, d).groupBy("cohort", "marker").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("pivot_cells", f"WITH {SQL_CELLS} SELECT cohort, cell_id, quantity AS u_quantity, size AS u_size FROM cells")
def pivot_cells(spark, d):
    return S.to_wide(S.to_long(cells(spark, d), ["cohort", "cell_id"], ["quantity", "size"]), ["cohort", "cell_id"], ["quantity", "size"], prefix="u_")


# Column registry of the cells: discount and tax carry one identity in two segments.
SQL_REG = """reg AS (SELECT cohort, raw_column, CASE WHEN raw_column IN ('discount', 'tax') AND cohort IN ('BUILDING', 'FURNITURE') THEN 'RATE|pan|none'
   WHEN raw_column = 'size' AND cohort = 'MACHINERY' THEN '' ELSE upper(raw_column) || '|pan|none' END AS triple
  FROM (SELECT DISTINCT c_mktsegment AS cohort FROM customer) CROSS JOIN (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax'), ('size'), ('retailprice'), ('totalprice')) m(raw_column))"""


def column_registry(spark, d):
    r = table(spark, d, "customer").select(F.col("c_mktsegment").alias("cohort")).distinct().withColumn("raw_column", F.explode(F.lit(list(MARKERS))))
    rate = F.col("raw_column").isin("discount", "tax") & F.col("cohort").isin("BUILDING", "FURNITURE")
    none = (F.col("raw_column") == "size") & (F.col("cohort") == "MACHINERY")
    t = F.when(rate, "RATE|pan|none").when(none, "").otherwise(F.concat(F.upper("raw_column"), F.lit("|pan|none")))
    return r.withColumn("triple", t).withColumn("gene", F.substring_index("triple", "|", 1)).withColumn(
        "kind", F.when(none, "unknown").when(F.col("raw_column") == "tax", "complex").otherwise("protein"))


@query("duplicate_column_mean", f"""WITH {SQL_LONG}, {SQL_REG}
SELECT cohort, cell_id, triple, round(avg(value), 6) AS value FROM long JOIN (SELECT cohort, raw_column AS marker, triple FROM reg WHERE triple <> '') USING (cohort, marker) GROUP BY 1, 2, 3""")
def duplicate_column_mean(spark, d):
    return S.mean_of_duplicates(values_by_cell(spark, d), column_registry(spark, d), ["cohort", "cell_id"]).withColumn("value", r6("value"))


@query("duplicate_columns", f"""WITH {SQL_REG} SELECT cohort, triple, string_agg(raw_column, '|' ORDER BY raw_column) AS raw_columns, count(*) AS n FROM reg
 WHERE triple <> '' GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_columns(spark, d):
    return S.duplicate_columns(column_registry(spark, d))


@query("vocabulary", f"""WITH {SQL_REG} SELECT triple, CAST(row_number() OVER (ORDER BY triple) - 1 AS INTEGER) AS idx, split_part(triple, '|', 1) AS gene, n_cohorts
 FROM (SELECT triple, count(DISTINCT cohort) AS n_cohorts FROM reg WHERE triple <> '' GROUP BY 1)""")
def vocabulary(spark, d):
    return S.vocabulary(column_registry(spark, d))


@query("shared_panel", f"""WITH {SQL_REG} SELECT triple, count(DISTINCT cohort) AS n_cohorts FROM reg WHERE triple <> '' GROUP BY 1
 HAVING count(DISTINCT cohort) = (SELECT count(DISTINCT cohort) FROM reg)""")
def shared_panel(spark, d):
    return S.shared_panel(S.panel(column_registry(spark, d)), "triple")


@query("training_panel", f"""WITH {SQL_REG}, f AS (SELECT DISTINCT cohort AS held FROM reg),
 x AS (SELECT 'loco_' || held AS fold, triple, count(DISTINCT cohort) FILTER (cohort <> held) AS k, bool_or(cohort = held) AS in_held
       FROM (SELECT DISTINCT cohort, triple FROM reg WHERE triple <> '') CROSS JOIN f GROUP BY 1, 2)
 SELECT fold, triple, in_held FROM x WHERE k = (SELECT count(*) - 1 FROM f)""")
def training_panel(spark, d):
    p = S.panel(column_registry(spark, d))
    folds = p.select(F.concat(F.lit("loco_"), "cohort").alias("fold"), F.col("cohort").alias("held")).distinct()
    return S.training_panels(p, folds, "triple")


@query("panel_pairs", f"""WITH {SQL_REG}, p AS (SELECT DISTINCT cohort, triple FROM reg WHERE triple <> ''), c AS (SELECT cohort, count(*) AS n FROM p GROUP BY 1)
SELECT x.cohort AS a, y.cohort AS b, (SELECT count(*) FROM p p1 JOIN p p2 USING (triple) WHERE p1.cohort = x.cohort AND p2.cohort = y.cohort) AS shared,
  x.n AS n_a, y.n AS n_b, round((SELECT count(*) FROM p p1 JOIN p p2 USING (triple) WHERE p1.cohort = x.cohort AND p2.cohort = y.cohort)
   / CAST(x.n + y.n - (SELECT count(*) FROM p p1 JOIN p p2 USING (triple) WHERE p1.cohort = x.cohort AND p2.cohort = y.cohort) AS DOUBLE), 6) AS jaccard
FROM c x JOIN c y ON x.cohort <> y.cohort""")
def panel_pairs(spark, d):
    return S.panel_pairs(S.panel(column_registry(spark, d)), "triple").withColumn("jaccard", r6("jaccard"))


@query("pair_covariates", f"""WITH {SQL_CELLS}, {SQL_SEGMENTS}, {SQL_REG}, p AS (SELECT DISTINCT cohort, triple FROM reg WHERE triple <> ''),
cl AS (SELECT DISTINCT cohort, native_label || (CASE WHEN cohort < 'G' THEN 'x' ELSE '' END) AS label FROM cells),
pn AS (SELECT cohort, count(*) AS n FROM p GROUP BY 1), cn AS (SELECT cohort, count(*) AS k FROM cl GROUP BY 1),
sh AS (SELECT a.cohort AS source, b.cohort AS target, count(*) AS shared FROM p a JOIN p b USING (triple) WHERE a.cohort <> b.cohort GROUP BY 1, 2),
cm AS (SELECT a.cohort AS source, b.cohort AS target, count(*) AS common FROM cl a JOIN cl b USING (label) WHERE a.cohort <> b.cohort GROUP BY 1, 2)
SELECT sh.source, sh.target, shared, round(shared / CAST(na.n + nb.n - shared AS DOUBLE), 6) AS jaccard, na.n AS n_src, nb.n AS n_tgt,
  ra.tissue = rb.tissue AS same_tissue, ra.platform = rb.platform AS same_platform, ca.k AS src_classes, cb.k AS tgt_classes,
  round(coalesce(common, 0) / CAST(cb.k AS DOUBLE), 6) AS class_cover
FROM sh LEFT JOIN cm USING (source, target) JOIN pn na ON na.cohort = source JOIN pn nb ON nb.cohort = target
JOIN registry ra ON ra.cohort = source JOIN registry rb ON rb.cohort = target JOIN cn ca ON ca.cohort = source JOIN cn cb ON cb.cohort = target""")
def pair_covariates(spark, d):
    cls = cells(spark, d).select("cohort", F.concat("native_label", F.when(F.col("cohort") < "G", "x").otherwise("")).alias("label"))
    t = S.pair_covariates(S.panel(column_registry(spark, d)), segment_registry(spark), cls, "triple")
    return t.withColumn("jaccard", r6("jaccard")).withColumn("class_cover", r6("class_cover"))


# Vector panels: cohort C1 has no values on m00, C2 none on m01 (unmeasured, not zero).
SQL_PANELV = SQL_VRANKED + """, pv AS (SELECT * FROM vranked WHERE NOT (cohort = 'C1' AND marker = 'm00') AND NOT (cohort = 'C2' AND marker = 'm01'))"""


def panel_values(spark, d):
    v = vectors(spark, d).where("NOT (cohort = 'C1' AND marker = 'm00') AND NOT (cohort = 'C2' AND marker = 'm01')")
    return ecdf(v, ["cohort", "marker"], "value", ["cell_id"])


def _vocab(df):
    from pyspark.sql.window import Window
    return df.select("marker").distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("marker")) - 1)


SQL_SLOTS = """ms AS (SELECT DISTINCT marker FROM pv), cl AS (SELECT DISTINCT cohort, cell_id FROM pv),
slots AS (SELECT cl.cohort, cl.cell_id, ms.marker, pv.u FROM cl CROSS JOIN ms LEFT JOIN pv ON pv.cohort = cl.cohort AND pv.cell_id = cl.cell_id AND pv.marker = ms.marker)"""


def slots(spark, d, fill=None):
    """Every slot of every row's panel vector."""
    u = panel_values(spark, d)
    vocab = _vocab(u)
    v = S.panel_vectors(u, vocab, ["cohort", "cell_id"], "u", fill=fill)
    each = v.select("cohort", "cell_id", F.posexplode(F.arrays_zip("u", "present")).alias("idx", "_s"))
    return each.join(vocab.select("idx", "marker"), "idx").select("cohort", "cell_id", "marker", r6("_s.u").alias("u"), F.col("_s.present").alias("present"))


@query("panel_vectors", f"WITH {SQL_PANELV}, {SQL_SLOTS} SELECT cohort, cell_id, marker, round(u, 6) AS u, u IS NOT NULL AS present FROM slots")
def panel_vectors(spark, d):
    return slots(spark, d)


@query("zero_filled_vectors", f"WITH {SQL_PANELV}, {SQL_SLOTS} SELECT cohort, cell_id, marker, round(coalesce(u, 0), 6) AS u FROM slots")
def zero_filled_vectors(spark, d):
    return slots(spark, d, 0.0).drop("present")


SQL_CONFID = """conf AS (SELECT c_mktsegment AS cohort, CASE WHEN c_mktsegment = 'BUILDING' THEN 'n/a' WHEN c_mktsegment = 'FURNITURE' THEN '1'
   ELSE CAST(round(c_acctbal / 5000, 6) AS VARCHAR) END AS raw, c_custkey FROM customer),
cc AS (SELECT *, least(greatest(coalesce(try_cast(raw AS DOUBLE), 1), 0), 1) AS conf FROM conf)"""


def confidences(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("cohort"), "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "n/a").when(F.col("c_mktsegment") == "FURNITURE", "1")
        .otherwise(F.round(F.col("c_acctbal") / 5000, 6).cast("string")).alias("raw"))


@query("confidence", f"""WITH {SQL_CONFID} SELECT cohort, c_custkey, round(conf, 6) + 0.0 AS conf FROM cc WHERE cohort IN (SELECT cohort FROM cc GROUP BY 1 HAVING min(conf) < max(conf))""")
def confidence(spark, d):
    return S.sanitise_confidence(confidences(spark, d), "raw").select("cohort", "c_custkey", r6("conf").alias("conf"))


@query("confidence_summary", f"""WITH {SQL_CONFID} SELECT cohort, count(*) AS cells, count(DISTINCT conf) AS distinct_values, round(min(conf), 6) + 0.0 AS lo, round(max(conf), 6) AS hi,
 count(DISTINCT conf) > 1 AS informative FROM cc GROUP BY 1""")
def confidence_summary(spark, d):
    return S.confidence_summary(confidences(spark, d), "raw").withColumn("lo", r6("lo")).withColumn("hi", r6("hi"))


@query("non_finite_audit", """SELECT event_type, count(*) FILTER (value <> 0 AND json_extract_string(props, '$.k') <> '0') AS kept,
  count(*) FILTER (value = 0 OR json_extract_string(props, '$.k') = '0') AS dropped FROM events GROUP BY 1""")
def non_finite_audit(spark, d):
    e = table(spark, d, "events").select(
        "event_type", F.when(F.col("value") == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("x"),
        F.when(F.get_json_object("props", "$.k") == "0", F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("y"))
    return S.non_finite_audit(e, ["event_type"], ["x", "y"])


@query("missing_token_share", """SELECT c_mktsegment AS cohort, round(avg(CASE WHEN c_nationkey IN (0, 1) THEN 1.0 ELSE 0 END), 6) AS missing_share FROM customer GROUP BY 1""")
def missing_token_share(spark, d):
    pid = F.concat_ws("|", "c_mktsegment", F.when(F.col("c_nationkey") == 0, "nan").when(F.col("c_nationkey") == 1, "unknown").otherwise(F.col("c_nationkey").cast("string")))
    return S.missing_token_share(table(spark, d, "customer").select(F.col("c_mktsegment").alias("cohort"), pid.alias("p")), ["cohort"], "p").withColumn(
        "missing_share", r6("missing_share"))


@query("train_zscore", f"""WITH {SQL_LONG}, st AS (SELECT marker, avg(ln(1 + greatest(value, 0))) AS mu, stddev_samp(ln(1 + greatest(value, 0))) AS sd FROM long WHERE cohort <> 'MACHINERY' GROUP BY 1)
SELECT cohort, cell_id, marker, round((ln(1 + greatest(value, 0)) - mu) / greatest(sd, 1e-6), 6) + 0.0 AS z FROM long JOIN st USING (marker) WHERE cohort = 'MACHINERY'""")
def train_zscore(spark, d):
    v = cell_values(spark, d).withColumn("value", S.log_clip(F.col("value"))).withColumn("tr", F.col("cohort") != "MACHINERY")
    return S.zscore_by_train(v, ["marker"], "value", "tr").where("NOT tr").select("cohort", "cell_id", "marker", r6("z").alias("z"))


@query("dense_codes", """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code FROM part""")
def dense_codes(spark, d):
    return S.dense_codes(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "code")


@query("micron_scaling", f"""WITH {SQL_POINTS}, {SQL_VECTOR_COHORTS}
SELECT cell_id, round(x_px * px_um * CASE WHEN cohort = 'C1' THEN 1.2 ELSE 1 END, 6) AS x_um, round(y_px * px_um * CASE WHEN cohort = 'C1' THEN 1.2 ELSE 1 END, 6) AS y_um FROM points JOIN registry USING (cohort)""")
def micron_scaling(spark, d):
    p = S.scale_coordinates(points(spark, d), vector_registry(spark), factors={"C1": 1.2})
    return p.select("cell_id", r6("x_um").alias("x_um"), r6("y_um").alias("y_um"))


@query("registry_lookup", f"""WITH {SQL_CELLS}, {SQL_SEGMENTS} SELECT platform, tissue, count(*) AS cells FROM cells JOIN registry USING (cohort) GROUP BY 1, 2""")
def registry_lookup(spark, d):
    return J.lookup_checked(cells(spark, d), segment_registry(spark), ["cohort"], "cohort").groupBy("platform", "tissue").agg(F.count(F.lit(1)).alias("cells"))


@query("unmatched_audit", """SELECT c_mktsegment, count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS unmatched FROM customer LEFT JOIN
 (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey) ON c_custkey = o_custkey GROUP BY 1""")
def unmatched_audit(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return J.unmatched_audit(J.left_join_one(table(spark, d, "customer"), o, ["c_custkey"]), ["c_mktsegment"], ["o_orderkey"])


@query("label_map_join", f"""WITH {SQL_CELLS} SELECT cohort, CASE native_label WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 END AS cluster, count(*) AS n
 FROM cells WHERE native_label IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY 1, 2""")
def label_map_join(spark, d):
    m = (table(spark, d, "customer").select(F.col("c_mktsegment").alias("cohort")).distinct()
         .withColumn("_m", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(c).alias("cluster")) for n, c in (
             ("ECONOMY", 0), ("SMALL", 0), ("LARGE", 1), ("PROMO", -1))]))).select("cohort", "_m.*"))
    return J.map_labels(cells(spark, d), m).groupBy("cohort", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("value_semi_join", f"""WITH {SQL_CELLS} SELECT cohort, count(*) AS n FROM cells WHERE cell_id IN (SELECT cell_id FROM cells WHERE quantity > 25) GROUP BY 1""")
def value_semi_join(spark, d):
    c = cells(spark, d)
    return c.join(c.where("quantity > 25").select("cell_id"), "cell_id", "left_semi").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("default_filled_join", f"""WITH {SQL_CONFID} SELECT o_orderkey, round(coalesce(conf, 1), 6) + 0.0 AS conf FROM orders LEFT JOIN
 (SELECT * FROM cc WHERE cohort IN (SELECT cohort FROM cc GROUP BY 1 HAVING min(conf) < max(conf))) ON o_custkey = c_custkey""")
def default_filled_join(spark, d):
    c = S.sanitise_confidence(confidences(spark, d), "raw").select(F.col("c_custkey").alias("o_custkey"), "conf")
    return J.default_filled(table(spark, d, "orders"), c, ["o_custkey"], "conf", 1.0).select("o_orderkey", r6("conf").alias("conf"))


@query("cohort_pairs", f"WITH {SQL_CELLS}, c AS (SELECT DISTINCT cohort FROM cells) SELECT x.cohort AS a, y.cohort AS b FROM c x JOIN c y ON x.cohort < y.cohort")
def cohort_pairs(spark, d):
    return J.roster_pairs(cells(spark, d), "cohort")


@query("row_union", "SELECT 'ORD' AS cohort, count(*) AS n, CAST(0 AS BIGINT) AS with_value FROM orders UNION ALL SELECT 'EVT', count(*), count(value) FROM events")
def row_union(spark, d):
    o = table(spark, d, "orders").select(F.lit("ORD").alias("cohort"), "o_totalprice")
    e = table(spark, d, "events").select(F.lit("EVT").alias("cohort"), "value")
    return o.unionByName(e, allowMissingColumns=True).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"))


@query("deduplicate", f"WITH {SQL_CELLS} SELECT cohort, count(*) AS images FROM (SELECT DISTINCT cohort, image_id, patient_id FROM cells) GROUP BY 1")
def deduplicate(spark, d):
    return cells(spark, d).select("cohort", "image_id", "patient_id").dropDuplicates().groupBy("cohort").agg(F.count(F.lit(1)).alias("images"))


@query("subset_artifacts", """WITH seen AS (SELECT n_regionkey AS artifact_id, c_mktsegment AS m FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment < chr(70 + 3 * n_regionkey) GROUP BY 1, 2),
art AS (SELECT 'artifact' || artifact_id AS artifact, count(*) AS n, list(m) AS seen FROM seen GROUP BY 1),
fold AS (SELECT 'loco_' || f.c AS fold, list(t.c) AS train FROM (SELECT DISTINCT c_mktsegment AS c FROM customer) f JOIN (SELECT DISTINCT c_mktsegment AS c FROM customer) t ON f.c <> t.c GROUP BY 1)
SELECT fold, arg_max(artifact, (n, artifact)) AS artifact, max(n) AS n_seen FROM fold LEFT JOIN art ON list_has_all(train, seen) GROUP BY 1""")
def subset_artifacts(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = c.where(F.col("c_mktsegment") < F.chr(F.lit(70) + 3 * F.col("n_regionkey"))).groupBy(
        F.concat(F.lit("artifact"), F.col("n_regionkey").cast("string")).alias("artifact")).agg(F.collect_set("c_mktsegment").alias("seen"))
    pairs = J.roster_pairs(table(spark, d, "customer").select(F.col("c_mktsegment").alias("cohort")), "cohort", ordered=True)
    folds = pairs.groupBy(F.concat(F.lit("loco_"), "a").alias("fold")).agg(F.collect_set("b").alias("train"))
    return S.newest_subset_artifact(seen, folds).withColumn("n_seen", F.col("n_seen").cast("long"))


# ------------------------------------------------------------------------------- identity
DECORATE = {0: ":Cyc_12_ch_4", 1: " - second batch", 2: ":probe", 3: ""}


def raw_names(spark, d):
    """Part names as raw column names: brand number = cohort, decorated by part key."""
    p = table(spark, d, "part")
    dec = F.element_at(F.create_map(*[F.lit(x) for kv in DECORATE.items() for x in kv]), (F.col("p_partkey") % 4).cast("int"))
    return p.select(F.col("p_brand").alias("cohort"), F.concat("p_name", dec).alias("raw_column")).distinct()


SQL_NAMES = """names AS (SELECT DISTINCT p_brand AS cohort, p_name || CASE p_partkey % 4 WHEN 0 THEN ':Cyc_12_ch_4' WHEN 1 THEN ' - second batch' WHEN 2 THEN ':probe' ELSE '' END AS raw_column FROM part)"""


@query("strip_decoration", """SELECT DISTINCT p_brand AS cohort, p_name || CASE p_partkey % 4 WHEN 0 THEN ':Cyc_12_ch_4' WHEN 1 THEN ' - second batch' WHEN 2 THEN ':probe' ELSE '' END AS raw_column,
  p_name AS stripped, upper(replace(p_name, ' ', '')) AS key FROM part""")
def strip_decoration(spark, d):
    return I.parse_names(raw_names(spark, d)).select("cohort", "raw_column", "stripped", "key")


@query("split_key", """SELECT DISTINCT p_name, form, CASE form WHEN 'iso' THEN 'CD45' WHEN 'pho' THEN 'S' || upper(replace(p_name, ' ', '')) WHEN 'his' THEN 'H3' ELSE p_name END AS core,
  CASE form WHEN 'iso' THEN 'RA' WHEN 'his' THEN 'K9ac' ELSE 'pan' END AS epitope, CASE form WHEN 'pho' THEN 'phospho' ELSE 'none' END AS modification
FROM part CROSS JOIN (VALUES ('iso'), ('pho'), ('his'), ('raw')) f(form)""")
def split_key_query(spark, d):
    from cohortweave.functions.text import split_key
    p = table(spark, d, "part").select("p_name").distinct().withColumn("form", F.explode(F.lit(["iso", "pho", "his", "raw"])))
    name = (F.when(F.col("form") == "iso", "CD45-ra").when(F.col("form") == "pho", F.concat(F.lit("pS"), F.upper(F.regexp_replace("p_name", " ", ""))))
            .when(F.col("form") == "his", "H3K9ac").otherwise(F.col("p_name")))
    k = split_key("n")
    return p.withColumn("n", name).select("p_name", "form", k["core"].alias("core"), k["epitope"].alias("epitope"), k["modification"].alias("modification"))


@query("lookup_keys", """SELECT n_nationkey, upper(replace(n_name, '_', '')) AS lookup, lower(replace(n_name, '_', ' ')) AS name_key FROM nation""")
def lookup_keys(spark, d):
    return table(spark, d, "nation").select("n_nationkey", lookup_key("n_name").alias("lookup"), name_key("n_name").alias("name_key"))


def name_dims(spark, d):
    """Dimension tables derived from the parts: nouns are symbols, two nouns alias one symbol, and so on."""
    noun = F.substring_index("p_name", " ", -1)
    p = table(spark, d, "part").select("p_name", noun.alias("noun")).distinct()
    cx = p.where("noun = 'ring'").select(lookup_key("p_name").alias("key"), F.upper("noun").alias("name"), F.lit("FAMILY").alias("kind"), F.lit("R1|R2").alias("members"))
    el = p.where("noun = 'rod'").select(lookup_key("p_name").alias("key"), F.upper("noun").alias("name"), F.lit("ELEMENT").alias("kind"), F.lit("").alias("members"))
    ov = p.where("p_name LIKE 'hot %' AND noun <> 'ring' AND noun <> 'rod'").select(lookup_key("p_name").alias("key"), F.upper("noun").alias("gene"), F.lit("").alias("id"))
    sym = p.where("noun IN ('bolt', 'gear')").select(F.lit("symbol").alias("source"), F.regexp_replace("p_name", " ", "-").alias("spelling"), F.upper("noun").alias("symbol"), F.concat(F.lit("ID:"), F.upper("noun")).alias("id"))
    ali = p.where("noun = 'widget'").select(F.lit("alias").alias("source"), F.col("p_name").alias("spelling"), F.lit("WIDGET").alias("symbol"), F.lit("ID:W").alias("id"))
    con = p.where("noun = 'plate'").select(F.lit("alias").alias("source"), F.explode(F.array(
        F.struct(F.col("p_name").alias("spelling"), F.lit("PA").alias("symbol")), F.struct(F.upper("p_name").alias("spelling"), F.lit("PB").alias("symbol")))).alias("s")).select("source", "s.*", F.lit("ID:P").alias("id"))
    prot = p.where("noun = 'gizmo'").select(F.col("p_name").alias("query"), F.lit(1).alias("rank"), F.lit("GIZ").alias("gene"), F.lit("Q1").alias("accession"), F.lit("x").alias("name"))
    return cx.unionByName(el), ov, sym.unionByName(ali).unionByName(con), prot


def resolved(spark, d):
    cx, ov, sym, prot = name_dims(spark, d)
    return I.resolve(I.parse_names(raw_names(spark, d)), cx, ov, sym, prot)


SQL_RESOLVED = SQL_NAMES + """,
parsed AS (SELECT *, trim(regexp_replace(split_part(raw_column, ':', 1), ' - .*$', '')) AS stripped FROM names),
res AS (SELECT *, split_part(stripped, ' ', 2) AS noun, upper(replace(stripped, ' ', '')) AS k FROM parsed),
r AS (SELECT cohort, raw_column, stripped,
  CASE WHEN noun = 'ring' THEN 'FAMILY:RING' WHEN noun = 'rod' THEN 'ELEMENT:ROD' WHEN stripped LIKE 'hot %' THEN 'GENE:' || upper(noun)
       WHEN noun IN ('bolt', 'gear') THEN 'ID:' || upper(noun) WHEN noun = 'widget' THEN 'ID:W' WHEN noun = 'gizmo' THEN 'protein:Q1' ELSE '' END AS resolved_id,
  CASE WHEN noun = 'ring' THEN 'complex' WHEN noun = 'rod' THEN 'non_protein' WHEN stripped LIKE 'hot %' THEN 'protein'
       WHEN noun IN ('bolt', 'gear', 'widget', 'gizmo') THEN 'protein' ELSE 'unknown' END AS kind,
  CASE WHEN noun IN ('ring', 'rod') THEN 'complex_table' WHEN stripped LIKE 'hot %' THEN 'manual' WHEN noun IN ('bolt', 'gear') THEN 'symbol'
       WHEN noun = 'widget' THEN 'alias' WHEN noun = 'gizmo' THEN 'protein_name' ELSE 'unresolved' END AS source,
  CASE WHEN noun = 'plate' AND stripped NOT LIKE 'hot %' THEN 'alias_conflict:PA|PB' WHEN noun NOT IN ('ring', 'rod', 'bolt', 'gear', 'widget', 'gizmo') AND stripped NOT LIKE 'hot %' THEN 'no_hit' ELSE '' END AS note FROM res),
reg AS (SELECT *, CASE WHEN resolved_id <> '' THEN resolved_id || '|pan|none' ELSE '' END AS triple FROM r)"""


@query("resolve_names", f"WITH {SQL_RESOLVED} SELECT cohort, raw_column, stripped, resolved_id, kind, source, note, triple FROM reg")
def resolve_names(spark, d):
    return resolved(spark, d).select("cohort", "raw_column", "stripped", "resolved_id", "kind", "source", "note", "triple")


@query("resolution_coverage", f"WITH {SQL_RESOLVED} SELECT kind, source, count(*) AS columns, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM reg GROUP BY 1, 2")
def resolution_coverage(spark, d):
    return I.coverage(resolved(spark, d)).withColumn("share_pct", r6("share_pct"))


@query("name_sharing", f"""WITH {SQL_RESOLVED} SELECT 'verbatim' AS method, count(*) AS markers, count(*) FILTER (k >= 2) AS shared FROM (SELECT raw_column, count(DISTINCT cohort) AS k FROM reg GROUP BY 1)
 UNION ALL SELECT 'resolved', count(*), count(*) FILTER (k >= 2) FROM (SELECT triple, count(DISTINCT cohort) AS k FROM reg WHERE triple <> '' GROUP BY 1)""")
def name_sharing(spark, d):
    return I.sharing(resolved(spark, d))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("availability_matrix", f"""WITH {SQL_RESOLVED}, t AS (SELECT DISTINCT triple, cohort FROM reg WHERE triple <> '' AND kind <> 'non_protein'),
b AS (SELECT 'Brand#' || i AS cohort FROM range(1, 26) r(i))
SELECT k.triple, k.n_cohorts, b.cohort, CAST(t.cohort IS NOT NULL AS INTEGER) AS present
FROM (SELECT triple, CAST(count(*) AS INTEGER) AS n_cohorts FROM t GROUP BY 1) k CROSS JOIN b LEFT JOIN t ON t.triple = k.triple AND t.cohort = b.cohort""")
def availability_matrix(spark, d):
    return I.availability(resolved(spark, d), BRANDS).unpivot(["triple", "n_cohorts"], [F.col(f"`{b}`") for b in BRANDS], "cohort", "present")


@query("availability_distribution", f"""WITH {SQL_RESOLVED}, n AS (SELECT triple, count(DISTINCT cohort) AS k FROM reg WHERE triple <> '' AND kind <> 'non_protein' GROUP BY 1)
SELECT CAST(at_least AS INTEGER) AS at_least, count(*) FILTER (k >= at_least) AS markers FROM n CROSS JOIN (VALUES (25), (20), (10), (2)) t(at_least) GROUP BY 1""")
def availability_distribution(spark, d):
    return I.availability_distribution(resolved(spark, d), [25, 20, 10, 2])


@query("review_queue", f"""WITH {SQL_RESOLVED} SELECT stripped, stripped AS core, note, string_agg(DISTINCT cohort, ', ' ORDER BY cohort) AS cohorts FROM reg WHERE kind = 'unknown' GROUP BY 1, 2, 3""")
def review_queue(spark, d):
    return I.review_queue(resolved(spark, d))


@query("never_merge", f"""WITH {SQL_RESOLVED}, lk AS (SELECT k, arg_min(triple, (cohort, raw_column)) AS triple FROM (
   SELECT upper(regexp_replace(raw_column, '[^A-Za-z0-9]', '', 'g')) AS k, * FROM reg UNION ALL SELECT upper(regexp_replace(stripped, '[^A-Za-z0-9]', '', 'g')), * FROM reg) GROUP BY 1)
SELECT a.p AS a, b.p AS b, coalesce(x.triple, '-') AS triple_a, coalesce(y.triple, '-') AS triple_b,
  CASE WHEN x.triple IS NULL OR y.triple IS NULL THEN 'NOT IN DATA' WHEN x.triple = '' OR y.triple = '' THEN 'UNRESOLVED' WHEN x.triple <> y.triple THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT DISTINCT p_name AS p FROM part) a JOIN (SELECT DISTINCT p_name AS p FROM part) b ON split_part(a.p, ' ', 1) = split_part(b.p, ' ', 1) AND a.p < b.p
LEFT JOIN lk x ON x.k = upper(replace(a.p, ' ', '')) LEFT JOIN lk y ON y.k = upper(replace(b.p, ' ', ''))""")
def never_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("adj")).distinct()
    rules = p.join(p.withColumnRenamed("a", "b"), "adj").where("a < b").select("a", "b")
    return I.check_never_merge(resolved(spark, d), rules)


@query("must_merge", f"""WITH {SQL_RESOLVED}, m AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS grp, p_name FROM part),
 x AS (SELECT grp, p_name, arg_min(triple, (cohort, raw_column)) AS triple FROM m LEFT JOIN reg ON stripped = p_name GROUP BY 1, 2)
SELECT grp AS "group", count(triple) AS in_data, count(*) AS "of", count(DISTINCT triple) AS distinct_triples,
  CASE WHEN bool_or(triple = '') THEN 'FAIL (unresolved)' WHEN count(DISTINCT triple) = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM x GROUP BY 1""")
def must_merge(spark, d):
    p = table(spark, d, "part").select("p_name").distinct().groupBy(F.substring_index("p_name", " ", -1).alias("group")).agg(
        F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("members"))
    return I.check_must_merge(resolved(spark, d), p)


@query("non_protein_leak", f"WITH {SQL_RESOLVED} SELECT cohort, raw_column FROM reg WHERE kind = 'protein' AND stripped LIKE '% rod'")
def non_protein_leak(spark, d):
    return I.non_protein_leak(resolved(spark, d), name_dims(spark, d)[0]).select("cohort", "raw_column")


# ------------------------------------------------------------------------------- sampling and splits
@query("round_robin_sample", f"""WITH {SQL_CELLS},
k AS (SELECT cohort, patient_id, native_label, cell_id, md5('sample|' || cell_id) AS k FROM cells),
t AS (SELECT *, row_number() OVER (PARTITION BY cohort, patient_id, native_label ORDER BY k) - 1 AS turn FROM k)
SELECT cohort, cell_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY turn, k) AS p FROM t) WHERE p <= 2000""")
def round_robin_sample(spark, d):
    c = cells(spark, d).select("cohort", "patient_id", "native_label", "cell_id")
    return SM.round_robin(c, ["cohort"], ["patient_id", "native_label"], "cell_id", 2000).select("cohort", "cell_id", "turn")


@query("uniform_sample", f"""WITH {SQL_CELLS} SELECT cohort, cell_id FROM (SELECT cohort, cell_id, row_number() OVER (PARTITION BY cohort ORDER BY md5('draw|' || cell_id)) AS p FROM cells) WHERE p <= 3000""")
def uniform_sample(spark, d):
    return SM.uniform(cells(spark, d).select("cohort", "cell_id"), ["cohort"], "cell_id", 3000)


@query("class_balanced_sample", f"""WITH {SQL_CELLS},
p AS (SELECT cohort, native_label, cell_id, row_number() OVER (PARTITION BY cohort, native_label ORDER BY md5('bal|' || cell_id)) - 1 AS pos FROM cells),
s AS (SELECT cohort, native_label, count(*) AS n FROM cells GROUP BY 1, 2),
q AS (SELECT *, greatest(1, sum(n) OVER (PARTITION BY cohort) // count(*) OVER (PARTITION BY cohort)) AS q FROM s),
a AS (SELECT cohort, native_label, cell_id, pos AS draw FROM p JOIN q USING (cohort, native_label) WHERE n >= q AND pos < q),
dr AS (SELECT cohort, native_label, n, unnest(range(CAST(q AS BIGINT))) AS draw FROM q WHERE n < q),
b AS (SELECT dr.cohort, dr.native_label, cell_id, draw FROM dr JOIN p ON p.cohort = dr.cohort AND p.native_label = dr.native_label
  AND p.pos = CAST(('0x' || substr(md5('bal|' || dr.cohort || '|' || dr.native_label || '|' || draw), 1, 15)) AS BIGINT) % n)
SELECT cohort, native_label, cell_id, CAST(draw AS BIGINT) AS draw FROM a UNION ALL SELECT cohort, native_label, cell_id, draw FROM b""")
def class_balanced_sample(spark, d):
    return SM.class_balanced(cells(spark, d).select("cohort", "native_label", "cell_id"), ["cohort"], "native_label", "cell_id")


@query("marker_mask", f"""WITH {SQL_LONG} SELECT cohort, cell_id, marker, row_number() OVER (PARTITION BY cohort, cell_id ORDER BY md5('mask|' || cohort || '|' || cell_id || '|' || marker), marker) <= 1 AS hidden FROM long""")
def marker_mask(spark, d):
    return SM.mask_markers(values_by_cell(spark, d), ["cohort", "cell_id"], "marker").select("cohort", "cell_id", "marker", "hidden")


SQL_SHIFT = SQL_POINTS + """,
o AS (SELECT image_id, cell_id, row_number() OVER (PARTITION BY image_id ORDER BY cell_id) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n,
      CAST(('0x' || substr(md5('shuffle|' || image_id), 1, 15)) AS BIGINT) AS h FROM points),
sh AS (SELECT a.image_id, a.cell_id, b.cell_id AS donor FROM o a JOIN o b ON a.image_id = b.image_id AND b.i = (a.i + CASE WHEN a.n >= 2 THEN 1 + a.h % greatest(a.n - 1, 1) ELSE 0 END) % a.n)"""


@query("within_image_shuffle", f"WITH {SQL_SHIFT} SELECT image_id, cell_id, donor FROM sh")
def within_image_shuffle(spark, d):
    return SM.derangement(points(spark, d), ["image_id"], "cell_id")


@query("shuffle_moved", f"WITH {SQL_SHIFT} SELECT image_id, CAST(avg(CASE WHEN cell_id <> donor THEN 1.0 ELSE 0 END) AS DOUBLE) AS moved, count(*) AS n FROM sh GROUP BY 1")
def shuffle_moved(spark, d):
    return SM.moved_fraction(SM.derangement(points(spark, d), ["image_id"], "cell_id"), ["image_id"], "cell_id")


SQL_PLAN = SQL_CELLS + """,
im AS (SELECT cohort, image_id, patient_id AS unit, count(*) AS cells FROM cells GROUP BY 1, 2, 3),
un AS (SELECT DISTINCT cohort, unit FROM im),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5('split|' || cohort || '|' || unit)) - 1 AS pos, count(*) OVER (PARTITION BY cohort) AS n FROM un),
pt AS (SELECT cohort, unit, n, CASE WHEN pos < greatest(1, round_even(CAST(0.20 * n AS DECIMAL(18,6)), 0)) THEN 'test'
   WHEN pos < greatest(1, round_even(CAST(0.20 * n AS DECIMAL(18,6)), 0)) + greatest(1, round_even(CAST(0.12 * n AS DECIMAL(18,6)), 0)) THEN 'val' ELSE 'train' END AS part FROM rk),
plan AS (SELECT im.*, part, n AS units FROM im JOIN pt USING (cohort, unit))"""


@query("split_plan", f"WITH {SQL_PLAN} SELECT cohort, image_id, unit, 'patient' AS unit_kind, part, units FROM plan")
def split_plan(spark, d):
    return SP.split_plan(cells(spark, d)).select("cohort", "image_id", "unit", "unit_kind", "part", "units")


@query("split_fallback", """WITH c AS (SELECT 'C' || (user_id % 5) AS cohort, user_id AS image_id FROM events),
un AS (SELECT DISTINCT cohort, cohort || '|' || image_id AS unit FROM c),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5('split|' || cohort || '|' || unit)) - 1 AS pos, count(*) OVER (PARTITION BY cohort) AS n FROM un)
SELECT cohort, unit AS image_id, 'image' AS unit_kind, CASE WHEN pos < greatest(1, round_even(CAST(0.20 * n AS DECIMAL(18,6)), 0)) THEN 'test'
   WHEN pos < greatest(1, round_even(CAST(0.20 * n AS DECIMAL(18,6)), 0)) + greatest(1, round_even(CAST(0.12 * n AS DECIMAL(18,6)), 0)) THEN 'val' ELSE 'train' END AS part FROM rk""")
def split_fallback(spark, d):
    p = points(spark, d).select("cohort", F.concat_ws("|", "cohort", "image_id").alias("image_id"),
                                F.concat(F.col("cohort"), F.lit("|unknown")).alias("patient_id"))
    return SP.split_plan(p).select("cohort", "image_id", "unit_kind", "part")


@query("split_summary", f"""WITH {SQL_PLAN} SELECT cohort, 'patient' AS unit_kind, count(*) AS images, max(units) AS units,
 count(DISTINCT unit) FILTER (part = 'train') AS units_train, count(DISTINCT unit) FILTER (part = 'val') AS units_val, count(DISTINCT unit) FILTER (part = 'test') AS units_test,
 round(sum(cells) FILTER (part = 'train') / CAST(sum(cells) AS DOUBLE), 6) AS cells_train, round(sum(cells) FILTER (part = 'val') / CAST(sum(cells) AS DOUBLE), 6) AS cells_val,
 round(sum(cells) FILTER (part = 'test') / CAST(sum(cells) AS DOUBLE), 6) AS cells_test FROM plan GROUP BY 1""")
def split_summary(spark, d):
    s = SP.split_summary(SP.split_plan(cells(spark, d)))
    for c in ("cells_train", "cells_val", "cells_test"):
        s = s.withColumn(c, r6(c))
    return s


@query("split_masks", f"WITH {SQL_PLAN} SELECT cohort, part, count(*) AS n FROM cells JOIN (SELECT cohort, image_id, part FROM plan) USING (cohort, image_id) GROUP BY 1, 2")
def split_masks(spark, d):
    c = cells(spark, d)
    return SP.attach_split(c, SP.split_plan(c)).groupBy("cohort", "part").agg(F.count(F.lit(1)).alias("n"))


@query("nesting_violations", """SELECT o_orderpriority AS cohort, o_orderstatus AS image_id, count(DISTINCT o_custkey) AS patients FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) > 1""")
def nesting_violations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("cohort"), F.col("o_orderstatus").alias("image_id"), F.col("o_custkey").alias("patient_id"))
    return SP.nesting_violations(o)


@query("multi_image_patients", f"""WITH {SQL_CELLS}, i AS (SELECT DISTINCT cohort, image_id, patient_id FROM cells)
SELECT cohort, image_id, patient_id FROM i WHERE (cohort, patient_id) IN (SELECT (cohort, patient_id) FROM i GROUP BY cohort, patient_id HAVING count(*) >= 2)""")
def multi_image_patients(spark, d):
    return SP.multi_image_patients(cells(spark, d))


@query("probe_holdout", f"""WITH {SQL_CELLS},
k AS (SELECT cohort, image_id, cell_id, row_number() OVER (PARTITION BY cohort ORDER BY md5('trainpool|' || cell_id)) - 1 AS pos, count(*) OVER (PARTITION BY cohort) AS n FROM cells),
r AS (SELECT *, CASE WHEN pos < least(500, n // 5) THEN 'probe' ELSE 'train' END AS role FROM k)
SELECT cohort, image_id, cell_id, role FROM r WHERE role = 'train' OR image_id IN (SELECT image_id FROM r WHERE role = 'train')""")
def probe_holdout(spark, d):
    return SP.probe_holdout(cells(spark, d).select("cohort", "image_id", "cell_id"), "cell_id", 500)


@query("capped_draw", f"""WITH {SQL_PLAN}, x AS (SELECT cohort, cell_id, part, row_number() OVER (PARTITION BY cohort, part ORDER BY md5('draw|' || part || '|' || cell_id)) AS p
  FROM cells JOIN (SELECT cohort, image_id, part FROM plan) USING (cohort, image_id))
SELECT cohort, part, count(*) AS n, min(cell_id) AS lo FROM x WHERE part <> 'train' OR p <= 4000 GROUP BY 1, 2""")
def capped_draw(spark, d):
    c = materialise(cells(spark, d).select("cohort", "image_id", "patient_id", "cell_id"))
    x = SP.draw(SP.attach_split(c, SP.split_plan(c)), "cell_id", {"train": 4000})
    return x.groupBy("cohort", "part").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("lo"))


@query("comparability", """SELECT c_mktsegment AS fold, CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing_b' WHEN c_mktsegment = 'FURNITURE' THEN 'n_class' ELSE '' END AS mismatch,
 c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AS comparable FROM customer GROUP BY 1""")
def comparability(spark, d):
    a = cells(spark, d).groupBy(F.col("cohort").alias("fold")).agg(F.countDistinct("native_label").alias("n_class"), F.max("native_label").alias("space"))
    b = a.where("fold <> 'BUILDING'").withColumn("n_class", F.when(F.col("fold") == "FURNITURE", 0).otherwise(F.col("n_class")))
    return SP.comparability(a, b, "fold", ["space", "n_class"])


__all__ = ["IDS", "SQL_VECTORS", "SQL_RANKED", "column_registry", "SQL_REG", "panel_values", "SQL_PANELV"]
