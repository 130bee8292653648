"""Scores over predictions, partition agreement, gates and reference predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.numeric import r6
from cohortweave.operators import agreement as A
from cohortweave.operators import exact_null as EN
from cohortweave.operators import metrics as M
from cohortweave.operators.joins import side_by_side
from cohortweave.plans.registry import query
from cohortweave.plans.tables import SQL_CELLS, SQL_PREDS, SQL_SEGMENTS, cells, predictions, segment_registry, table

K = ["method", "held"]
SQL_CONF = SQL_PREDS + """,
conf AS (SELECT method, held, y_true, y_pred, count(*) AS n FROM preds GROUP BY 1, 2, 3, 4)"""
R4 = "round_even(CAST({} AS DECIMAL(28,14)), 4)"


def sql_per_class(name: str = "pc", where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT t.method, t.held, t.cls, support, precision, recall, f1,
         CAST({R4.format('precision')} AS DOUBLE) AS precision_r, CAST({R4.format('recall')} AS DOUBLE) AS recall_r,
         CAST({R4.format('f1')} AS DOUBLE) AS f1_r
  FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
    FROM (SELECT a.method, a.held, a.cls, support, CASE WHEN coalesce(called, 0) > 0 THEN tp / CAST(called AS DOUBLE) ELSE 0 END AS precision,
                 tp / CAST(support AS DOUBLE) AS recall
          FROM (SELECT method, held, y_true AS cls, CAST(sum(n) AS BIGINT) AS support,
                       coalesce(sum(n) FILTER (y_true = y_pred), 0) AS tp FROM conf GROUP BY 1, 2, 3) a
          LEFT JOIN (SELECT method, held, y_pred AS cls, sum(n) AS called FROM conf GROUP BY 1, 2, 3) b
          USING (method, held, cls)) WHERE {where}) t)"""


SQL_PC = SQL_CONF + "," + sql_per_class()
DROPPED = 2
SQL_PCD = SQL_PC + "," + sql_per_class("pcd", f"cls <> {DROPPED}")


def drop_list(spark):
    return spark.createDataFrame([(DROPPED,)], "cls bigint")


def conf(spark, d):
    return M.confusion(predictions(spark, d), K)


@query("confusion_matrix", f"""WITH {SQL_CONF}
SELECT * FROM conf WHERE y_pred IN (SELECT y_true FROM conf)""")
def confusion_matrix(spark, d):
    return M.confusion_matrix(conf(spark, d), K)


@query("per_class_scores", f"""WITH {SQL_PC}
SELECT method, held, cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       precision_r, recall_r, f1_r FROM pc""")
def per_class_scores(spark, d):
    return M.per_class(conf(spark, d), K).select(
        *K, "cls", "support", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
        "precision_r", "recall_r", "f1_r")


@query("macro_scores", f"""WITH {SQL_PCD}
SELECT method, held, count(*) AS classes, round(avg(f1_r), 6) AS macro_f1, round(avg(f1), 6) AS macro_f1_exact,
       round(avg(recall_r), 6) AS balanced_accuracy, round(sum(f1_r * support) / sum(support), 6) AS weighted_f1
FROM pcd GROUP BY 1, 2""")
def macro_scores(spark, d):
    m = M.macro(M.per_class(conf(spark, d), K, drop_list(spark)), K)
    return m.select(*K, "classes", *[r6(c).alias(c) for c in ("macro_f1", "macro_f1_exact", "balanced_accuracy", "weighted_f1")])


def sql_kappa(name: str, where: str) -> str:
    return f"""
{name}_m AS (SELECT * FROM conf WHERE {where} AND y_pred IN (SELECT y_true FROM conf) AND {where.replace('y_true', 'y_pred')}),
{name} AS (
  SELECT method, held, (po - pe) / (1 - pe) AS cohen_kappa FROM (
    SELECT method, held, sum(n) FILTER (y_true = y_pred) / CAST(sum(n) AS DOUBLE) AS po FROM {name}_m GROUP BY 1, 2)
  JOIN (SELECT method, held, sum(r * c) / max(t * t) AS pe FROM
        (SELECT method, held, y_true AS cls, CAST(sum(n) AS DOUBLE) AS r FROM {name}_m GROUP BY 1, 2, 3)
        JOIN (SELECT method, held, y_pred AS cls, CAST(sum(n) AS DOUBLE) AS c FROM {name}_m GROUP BY 1, 2, 3) USING (method, held, cls)
        JOIN (SELECT method, held, CAST(sum(n) AS DOUBLE) AS t FROM {name}_m GROUP BY 1, 2) USING (method, held) GROUP BY 1, 2)
  USING (method, held))"""


@query("cohen_kappa", f"""WITH {SQL_CONF}, {sql_kappa('kp', 'y_true <> 2')}
SELECT method, held, round(cohen_kappa, 6) + 0.0 AS cohen_kappa FROM kp""")
def cohen_kappa(spark, d):
    return M.kappa(conf(spark, d), K, drop_list(spark)).select(*K, r6("cohen_kappa").alias("cohen_kappa"))


@query("confused_pairs", f"""WITH {SQL_CONF}
SELECT method, held, y_true, y_pred, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY method, held ORDER BY n DESC, y_true, y_pred) AS rank FROM conf
  WHERE y_true <> y_pred AND y_pred IN (SELECT y_true FROM conf)) WHERE rank <= 10""")
def confused_pairs(spark, d):
    return M.confused_pairs(conf(spark, d), K)


@query("support_stratified_f1", f"""WITH {SQL_PC},
bins(bin, lo, hi) AS (VALUES ('rare (<50)', 0, 50), ('small (50-200)', 50, 200), ('medium (200-1000)', 200, 1000),
                             ('large (>=1000)', 1000, 999999999999))
SELECT k.method, k.held, bins.bin, count(pc.cls) AS n_classes, round(avg(pc.f1_r), 6) AS mean_f1
FROM (SELECT DISTINCT method, held FROM pc) k CROSS JOIN bins
LEFT JOIN pc ON pc.method = k.method AND pc.held = k.held AND support >= lo AND support < hi GROUP BY 1, 2, 3""")
def support_stratified_f1(spark, d):
    return M.support_stratified(M.per_class(conf(spark, d), K), K).select(*K, "bin", "n_classes", r6("mean_f1").alias("mean_f1"))


@query("per_platform_f1", f"""WITH {SQL_PREDS}, {SQL_SEGMENTS},
conf AS (SELECT method, platform AS held, y_true, y_pred, count(*) AS n FROM preds JOIN registry USING (cohort) GROUP BY 1, 2, 3, 4),
{sql_per_class()}
SELECT method, held AS platform, round(avg(f1_r), 6) AS macro_f1, CAST(any_value(n_cells) AS BIGINT) AS n_cells
FROM pc JOIN (SELECT method, held, sum(n) AS n_cells FROM conf GROUP BY 1, 2) USING (method, held) GROUP BY 1, 2""")
def per_platform_f1(spark, d):
    return M.per_platform(predictions(spark, d), segment_registry(spark), ["method"]).select(
        "method", "platform", r6("macro_f1").alias("macro_f1"), "n_cells")


SQL_REFS = SQL_PREDS + """,
held_out AS (SELECT DISTINCT cell_id, cohort, held, protocol, y_true FROM preds WHERE method = 'brand'),
train AS (SELECT h.held, t.y_true, count(*) AS n FROM held_out t JOIN (SELECT DISTINCT held FROM held_out) h ON t.cohort <> h.held GROUP BY 1, 2),
maj AS (SELECT held, arg_max(y_true, (n, -y_true)) AS majority FROM train GROUP BY 1),
refs AS (SELECT cell_id, cohort, held, protocol, y_true, method,
         CASE method WHEN 'majority' THEN majority
              ELSE CAST(('0x' || substr(md5('baseline|' || cell_id), 1, 15)) AS BIGINT) % 6 END AS y_pred
         FROM held_out JOIN maj USING (held) CROSS JOIN (VALUES ('majority'), ('random')) m(method))"""


@query("reference_predictors", f"""WITH {SQL_REFS}, conf AS (SELECT method, held, y_true, y_pred, count(*) AS n FROM refs GROUP BY 1, 2, 3, 4),
{sql_per_class()}
SELECT method, held, count(*) AS classes, round(avg(f1_r), 6) AS macro_f1 FROM pc GROUP BY 1, 2""")
def reference_predictors(spark, d):
    p = predictions(spark, d).where("method = 'brand'")
    # training rows of a fold = all rows minus the held cohort's: subtract counts instead of re-scanning per fold
    n = p.groupBy("held", "y_true").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy("y_true").agg(F.sum("n").alias("t"))
    train = n.join(tot, "y_true").withColumn("n", F.col("t") - F.col("n"))
    maj = train.groupBy("held").agg(F.max_by("y_true", F.struct(F.col("n"), -F.col("y_true"))).alias("majority"))
    refs = M.reference_predictors(p, maj, ["held"], 6)
    return M.macro(M.per_class(M.confusion(refs, K), K), K).select(*K, "classes", r6("macro_f1").alias("macro_f1"))


@query("score_report", f"""WITH {SQL_PCD}, {sql_kappa('kp', 'y_true <> 2')}
SELECT method, held, a.classes, round(a.macro_f1, 6) AS macro_f1_reliable, round(b.macro_f1, 6) AS macro_f1_all_classes,
       round(ba, 6) AS balanced_accuracy, round(wf, 6) AS weighted_f1, round(cohen_kappa, 6) + 0.0 AS cohen_kappa
FROM (SELECT method, held, count(*) AS classes, avg(f1_r) AS macro_f1, avg(recall_r) AS ba, sum(f1_r * support) / sum(support) AS wf
      FROM pcd GROUP BY 1, 2) a JOIN (SELECT method, held, avg(f1_r) AS macro_f1 FROM pc GROUP BY 1, 2) b USING (method, held)
JOIN kp USING (method, held)""")
def score_report(spark, d):
    s = M.score_report(predictions(spark, d), K, drop_list(spark))
    return s.select(*K, "classes", *[r6(c).alias(c) for c in (
        "macro_f1_reliable", "macro_f1_all_classes", "balanced_accuracy", "weighted_f1", "cohen_kappa")])


SQL_DELTA = SQL_PC + """,
mf AS (SELECT method, held, avg(f1_r) AS f FROM pc GROUP BY 1, 2),
delta AS (SELECT held, a.f - b.f AS x FROM mf a JOIN mf b USING (held) WHERE a.method = 'brand' AND b.method = 'size')"""


@query("paired_folds", f"""WITH {SQL_DELTA},
d AS (SELECT list(x ORDER BY held) AS xs, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM delta),
f AS (SELECT n, mean, sd, list_sum(list_transform(range(CAST(n AS BIGINT)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN xs[i + 1] ELSE -xs[i + 1] END)) / n AS fm
      FROM d, range(32) t(m))
SELECT 'brand-size' AS comparison, CAST(max(n) AS INTEGER) AS n, round(max(mean), 6) + 0.0 AS mean, round(max(mean) - 2.776445105 * max(sd) / sqrt(max(n)), 6) AS lo,
       round(max(mean) + 2.776445105 * max(sd) / sqrt(max(n)), 6) AS hi,
       round(avg(CASE WHEN abs(fm) >= abs(mean) - 1e-12 THEN 1.0 ELSE 0 END), 6) AS p FROM f""")
def paired_folds(spark, d):
    m = M.macro(M.per_class(conf(spark, d), K), K).select("method", "held", "macro_f1")
    j = side_by_side(m.where("method = 'brand'").drop("method"), m.where("method = 'size'").drop("method"), ["held"])
    deltas = j.select(F.lit("brand-size").alias("comparison"), "held", (F.col("macro_f1_a") - F.col("macro_f1_b")).alias("x"))
    return EN.paired(deltas, ["comparison"], "x").select(
        "comparison", "n", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"), r6("p").alias("p"))


@query("zero_f1_audit", f"""WITH {SQL_PC}
SELECT method, held, count(*) AS classes, count(*) FILTER (f1_r = 0) AS zero, count(*) FILTER (f1_r < 0.1) AS below_10,
       round(avg(CASE WHEN f1_r = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share, round(median(f1_r), 6) AS median_f1,
       CAST(median(support) FILTER (f1_r = 0) AS DOUBLE) AS median_support_zero, CAST(median(support) FILTER (f1_r <> 0) AS DOUBLE) AS median_support_other,
       round(avg(f1_r) FILTER (f1_r <> 0), 6) AS mean_f1_nonzero FROM pc GROUP BY 1, 2""")
def zero_f1_audit(spark, d):
    z = M.zero_f1_audit(M.per_class(conf(spark, d), K), K)
    return z.select(*K, "classes", "zero", "below_10", *[r6(c).alias(c) for c in (
        "zero_share", "median_f1", "median_support_zero", "median_support_other", "mean_f1_nonzero")])


# Votes: three calls per cell (brand code, size code, supplier-free price code).
SQL_VOTES = SQL_CELLS + """,
votes AS (SELECT cohort, cell_id, CASE s WHEN 0 THEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 3
            WHEN 1 THEN CAST(size AS BIGINT) % 3 ELSE CAST(quantity AS BIGINT) % 3 END AS vote
          FROM cells CROSS JOIN (VALUES (0), (1), (2)) t(s))"""


def votes(spark, d):
    c = cells(spark, d)
    v = F.array(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long") % 3, F.col("size").cast("long") % 3, F.col("quantity").cast("long") % 3)
    return c.select("cohort", "cell_id", F.explode(v).alias("vote"))


@query("vote_coverage", f"""WITH {SQL_VOTES},
c AS (SELECT cohort, cell_id, vote, count(*) AS c FROM votes GROUP BY 1, 2, 3)
SELECT cohort, cell_id, arg_max(vote, (c, -vote)) AS modal, round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS coverage FROM c GROUP BY 1, 2""")
def vote_coverage(spark, d):
    return M.vote_coverage(votes(spark, d), ["cohort", "cell_id"], "vote").select("cohort", "cell_id", "modal", r6("coverage").alias("coverage"))


SQL_COV = SQL_PC + """,
cov AS (SELECT method, held, cls, f1, CAST(support AS DOUBLE) AS support, precision, recall FROM pc)"""


@query("covariate_correlations", f"""WITH {SQL_COV},
l AS (SELECT f1, covariate, x FROM cov UNPIVOT (x FOR covariate IN (support, precision, recall)))
SELECT covariate, round(r, 6) + 0.0 AS r, n, round(r * sqrt(n - 2) / sqrt(1 - r * r), 5) + 0.0 AS t
FROM (SELECT covariate, corr(x, f1) AS r, count(*) AS n FROM l GROUP BY 1)""")
def covariate_correlations(spark, d):
    pc = M.per_class(conf(spark, d), K)
    return M.covariate_correlations(pc, "f1", ["support", "precision", "recall"]).select(
        "covariate", r6("r").alias("r"), "n", (F.round("t", 5) + F.lit(0.0)).alias("t"))


@query("leave_one_out_correlation", f"""WITH {SQL_COV},
u AS (SELECT held AS dropped FROM cov UNION SELECT 'none')
SELECT dropped, count(*) AS n, round(corr(recall, f1), 6) AS r FROM u JOIN cov ON cov.held <> u.dropped GROUP BY 1""")
def leave_one_out_correlation(spark, d):
    pc = M.per_class(conf(spark, d), K)
    return M.leave_one_out_correlation(pc, "held", "recall", "f1").select("dropped", "n", r6("r").alias("r"))


RULES = (("1", "mean_delta", ">", 0.0, 1, 0), ("2", "classes", "==", 6.0, 1, 0), ("3", "mean_delta", ">=", 0.5, 1, 1),
         ("4", "max_pairs", "<", 0.0, 0, 0), ("5", "absent", ">", 0.0, 0, 0))
RULE_SCHEMA = "check string, quantity string, relation string, threshold double, required int, waived int"
SQL_GATE = SQL_DELTA + """,
measured AS (SELECT 'mean_delta' AS quantity, avg(x) AS value FROM delta UNION ALL
             SELECT 'classes', CAST(count(DISTINCT cls) AS DOUBLE) FROM pc UNION ALL
             SELECT 'max_pairs', CAST(max(n) AS DOUBLE) FROM conf),
rules(chk, quantity, relation, threshold, required, waived) AS (VALUES ('1', 'mean_delta', '>', CAST(0 AS DOUBLE), 1, 0), ('2', 'classes', '==', 6, 1, 0),
  ('3', 'mean_delta', '>=', 0.5, 1, 1), ('4', 'max_pairs', '<', 0, 0, 0), ('5', 'absent', '>', 0, 0, 0)),
g AS (SELECT chk, quantity, value, relation, threshold, required, waived,
   coalesce(CASE relation WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold
            WHEN '==' THEN value = threshold END, false) AS ok FROM rules LEFT JOIN measured USING (quantity)),
gated AS (SELECT *, CASE WHEN value IS NULL THEN 'NOT MEASURED' WHEN ok THEN 'PASS' WHEN waived = 1 THEN 'WAIVED' ELSE 'FAIL' END AS status,
  required = 1 AND NOT ok AND waived = 0 AS blocking FROM g)"""


def _gated(spark, d):
    c = conf(spark, d)
    pc = M.per_class(c, K)
    m = M.macro(pc, K).select("method", "held", "macro_f1")
    j = side_by_side(m.where("method = 'brand'").drop("method"), m.where("method = 'size'").drop("method"), ["held"])
    measured = (j.agg(F.avg(F.col("macro_f1_a") - F.col("macro_f1_b")).alias("value")).select(F.lit("mean_delta").alias("quantity"), "value")
                .unionByName(pc.agg(F.countDistinct("cls").cast("double").alias("value")).select(F.lit("classes").alias("quantity"), "value"))
                .unionByName(c.agg(F.max("n").cast("double").alias("value")).select(F.lit("max_pairs").alias("quantity"), "value")))
    return M.gate(measured, spark.createDataFrame(RULES, RULE_SCHEMA))


@query("gate_checks", f"""WITH {SQL_GATE}
SELECT chk AS check, quantity, round(value, 6) + 0.0 AS value, relation, threshold, required, waived, status, blocking FROM gated""")
def gate_checks(spark, d):
    return _gated(spark, d).withColumn("value", r6("value"))


@query("gate_verdict", f"""WITH {SQL_GATE}
SELECT count(*) FILTER (required = 1) AS required, count(*) FILTER (required = 1 AND status = 'PASS') AS passed,
  count(*) FILTER (required = 1 AND status = 'WAIVED') AS waived, count(*) FILTER (blocking) AS blocking,
  CASE WHEN count(*) FILTER (blocking) > 0 THEN 'FAIL' WHEN count(*) FILTER (required = 1 AND status = 'WAIVED') > 0 THEN 'SHIPPED UNDER WAIVER'
       ELSE 'PASS' END AS verdict FROM gated""")
def gate_verdict(spark, d):
    return M.gate_verdict(_gated(spark, d))


@query("arm_table", f"""WITH {SQL_PC}
SELECT held, round(avg(f1_r) FILTER (method = 'brand'), 6) AS brand, round(avg(f1_r) FILTER (method = 'size'), 6) AS size FROM pc GROUP BY 1""")
def arm_table(spark, d):
    m = M.macro(M.per_class(conf(spark, d), K), K)
    return M.arm_table(m.withColumn("macro_f1", r6("macro_f1")), "held", "method", ["brand", "size"], "macro_f1")


# ------------------------------------------------------------------ partition agreement
SQL_LBL = "lab AS (SELECT source, lang, quality, toxic FROM labels JOIN documents USING (doc_id))"


def labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("contingency", f"WITH {SQL_LBL} SELECT lang, quality, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY 1, 2")
def contingency(spark, d):
    return A.contingency(labelled(spark, d), "lang", "quality")


def sql_ari(table_sql: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""
t AS ({table_sql}),
ii AS (SELECT {k} sum(n * (n - 1) / 2) AS idx, sum(n) AS tot FROM t {g}),
aa AS (SELECT {k} sum(n * (n - 1) / 2) AS ai FROM (SELECT {k} a, sum(n) AS n FROM t GROUP BY {k} a) {g}),
bb AS (SELECT {k} sum(n * (n - 1) / 2) AS bi FROM (SELECT {k} b, sum(n) AS n FROM t GROUP BY {k} b) {g}),
ari AS (SELECT {k} tot AS n, CASE WHEN (ai + bi) / 2 > ai * bi / (tot * (tot - 1) / 2)
  THEN (idx - ai * bi / (tot * (tot - 1) / 2)) / ((ai + bi) / 2 - ai * bi / (tot * (tot - 1) / 2)) ELSE 0 END AS ari
  FROM ii JOIN aa {using} JOIN bb {using})"""


@query("adjusted_rand", f"""WITH {SQL_LBL}, {sql_ari('SELECT source AS a, quality AS b, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY 1, 2')}
SELECT n, round(ari, 6) + 0.0 AS ari FROM ari""")
def adjusted_rand(spark, d):
    return A.ari(A.contingency(labelled(spark, d), "source", "quality"), "source", "quality").withColumn("ari", r6("ari"))


@query("weighted_adjusted_rand", f"""WITH {SQL_CELLS},
{sql_ari('SELECT cohort, native_label AS a, p_brand AS b, sum(quantity) AS n FROM cells GROUP BY 1, 2, 3', 'cohort')}
SELECT cohort, n, round(ari, 6) + 0.0 AS ari FROM ari""")
def weighted_adjusted_rand(spark, d):
    t = A.contingency(cells(spark, d), "native_label", "p_brand", ["cohort"], "quantity")
    return A.ari(t, "native_label", "p_brand", ["cohort"]).withColumn("ari", r6("ari"))


SQL_ENT = """
t AS (SELECT cohort, native_label AS a, p_brand AS b, sum(quantity) AS n FROM cells GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY cohort) AS tot, sum(n) OVER (PARTITION BY cohort, a) AS x, sum(n) OVER (PARTITION BY cohort, b) AS y FROM t),
e AS (SELECT cohort, sum(n / tot * ln(n * tot / (x * y))) AS mi, -sum(n / tot * ln(x / tot)) AS hx, -sum(n / tot * ln(y / tot)) AS hy FROM w GROUP BY 1)"""


@query("weighted_nmi", f"""WITH {SQL_CELLS}, {SQL_ENT} SELECT cohort, round(2 * mi / greatest(1e-12, hx + hy), 6) AS nmi FROM e""")
def weighted_nmi(spark, d):
    t = A.contingency(cells(spark, d), "native_label", "p_brand", ["cohort"], "quantity")
    return A.nmi(t, "native_label", "p_brand", ["cohort"]).select("cohort", r6("nmi").alias("nmi"))


@query("v_measure", f"""WITH {SQL_CELLS}, {SQL_ENT} SELECT cohort, round(mi / hx, 6) AS homogeneity, round(mi / hy, 6) AS completeness,
  round(2 * (mi / hx) * (mi / hy) / (mi / hx + mi / hy), 6) AS v_measure FROM e""")
def v_measure(spark, d):
    t = A.contingency(cells(spark, d), "native_label", "p_brand", ["cohort"], "quantity")
    v = A.v_measure(t, "native_label", "p_brand", ["cohort"])
    return v.select("cohort", *[r6(c).alias(c) for c in ("homogeneity", "completeness", "v_measure")])


@query("adjusted_mutual_information", f"""WITH {SQL_LBL},
t AS (SELECT lang AS a, quality AS b, count(*) AS n FROM lab GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY a) AS x, sum(n) OVER (PARTITION BY b) AS y FROM t),
e AS (SELECT sum(n / CAST(tot AS DOUBLE) * ln(CAST(n AS DOUBLE) * tot / (CAST(x AS DOUBLE) * y))) AS mi,
  -sum(n / CAST(tot AS DOUBLE) * ln(x / CAST(tot AS DOUBLE))) AS hx, -sum(n / CAST(tot AS DOUBLE) * ln(y / CAST(tot AS DOUBLE))) AS hy FROM w),
ra AS (SELECT a, sum(n) AS ai FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS bj FROM t GROUP BY 1), tt AS (SELECT sum(n) AS N FROM t),
g AS (SELECT CAST(ai AS BIGINT) AS ai, CAST(bj AS BIGINT) AS bj, CAST(N AS BIGINT) AS N, unnest(range(greatest(1, CAST(ai + bj - N AS BIGINT)), CAST(least(ai, bj) AS BIGINT) + 1)) AS k FROM ra, rb, tt),
m AS (SELECT sum((k / CAST(N AS DOUBLE)) * ln(N * CAST(k AS DOUBLE) / (CAST(ai AS DOUBLE) * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(N - ai + 1) + lgamma(N - bj + 1)
  - lgamma(N + 1) - lgamma(k + 1) - lgamma(ai - k + 1) - lgamma(bj - k + 1) - lgamma(N - ai - bj + k + 1))) AS emi FROM g)
SELECT round(emi, 6) AS emi, round((mi - emi) / ((hx + hy) / 2 - emi), 5) + 0.0 AS ami FROM e, m""")
def adjusted_mutual_information(spark, d):
    t = A.contingency(labelled(spark, d), "lang", "quality")
    return A.adjusted_mutual_information(t, "lang", "quality").select(
        r6("emi").alias("emi"), (F.round("ami", 5) + F.lit(0.0)).alias("ami"))
