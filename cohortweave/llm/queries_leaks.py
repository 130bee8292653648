"""Query and SQL of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortweave.llm import decontaminate as D
from cohortweave.llm.registry import query, table

OP12_SQL = rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{D.UPPER}', '{D.LOWER}'), '{D.BETWEEN}'), lambda x: x <> '') AS ws FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS name, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{D.UPPER}', '{D.LOWER}'), '{D.BETWEEN}'), lambda x: x <> '') AS ws FROM benchmark),
sized AS (SELECT name, ws, least(len(ws), {D.WIDTH}) AS n FROM items WHERE len(ws) > 0),
placed AS (SELECT name, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT name, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM placed),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM words, sizes WHERE len(ws) >= n),
found AS (SELECT r, i, p.n, name FROM (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM places) p JOIN windows USING (n, w)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(DISTINCT name) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(name))), ',')) AS s FROM found GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


@query("op12_decontamination", OP12_SQL)
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return D.contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
