"""Query and SQL of the vector codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import ball_codes
from cohortweave.llm.registry import query, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def codes_sql() -> str:
    """The rounds written out: full search, exact sums, floor division."""
    floor_div = "((s - ((s % c) + c) % c) // c)"
    nearest = """SELECT r, p, x, arg_min(struct_pack(e := e, d := d), struct_pack(d := d, e := e)) AS best
      FROM (SELECT x.r, x.p, x.x, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.v[i]) * (x.x[i] - b.v[i]))) AS d
            FROM parts x JOIN {books} b ON b.p = x.p) GROUP BY r, p, x"""
    steps = []
    for i in range(ROUNDS):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(books=f'b{i}')}),
t{i} AS (SELECT p, best.e AS e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS c
       FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, best.e, i),
m{i} AS (SELECT p, e, list({floor_div} ORDER BY i) AS v FROM t{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)""")
    between = ",\n".join(steps)
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
sized AS (SELECT * FROM kept WHERE len(x) = (SELECT len(x) FROM kept WHERE r = 1)),
parts AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS x
  FROM sized, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS v FROM parts WHERE r <= {ENTRIES}),
{between},
f AS MATERIALIZED ({nearest.format(books=f'b{ROUNDS}')}),
numbers AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS n, unnest(range(len(v))) AS i FROM b{ROUNDS})),
rows_ AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM rows_ JOIN sized USING (r), numbers"""


@query("op11_vector_codes", codes_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, fitted = ball_codes.encode(table(spark, folder, "embeddings"), PARTS, ENTRIES, ROUNDS)
    return ball_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(fitted.sha256 if fitted else None).alias("codebooks_sha256"))
