"""Rows that the tests share."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("words", T.StringType()),
                     T.StructField("shard", T.StringType()), T.StructField("_words", T.LongType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to a in is that river stone light garden walks slowly under green".split())
                    + rng.choice(["", "", ".", ",", "\n", "er", "ing"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows; extra columns with clashing names."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "de", None, "xx"]), "s", 1, "w", "x", 3) for i in range(12)]
    rows += [(20, base, "en", None, None, None, None, None), (21, base, None, "s", 1, None, "x", None),
             (22, base.replace("river", "lake"), "en", "s", 1, "w", "x", 1), (23, None, None, None, None, None, None, None),
             (24, "", "en", "s", 0, "", "", 0), (25, " \t\n ", "en", "s", 0, "", "", 0),
             (26, "Ünïcode 日本語 \U0001F600 <|im_end|> ﬁ", "fr", "s", 0, "", "", 0), (27, prose(rng, 30_000), "en", "s", 0, "", "", 0),
             (28, "one word", "es", "s", 0, "", "", 0), (28, "one word", "es", "s", 0, "", "", 0),
             (29, base, "en", "s", 0, "", "", 0), (29, "other text", "en", "s", 0, "", "", 0),
             (None, base, "en", "s", 0, "", "", 0), (None, None, None, None, None, None, None, None)]
    return rows
