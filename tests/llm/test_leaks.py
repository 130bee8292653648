"""Decontamination against a plain search of every window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from cohortweave.llm import decontaminate

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sid", T.LongType()),
                      T.StructField("name", T.StringType()), T.StructField("window", T.StringType())])


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    windows = {}
    for i, t, *_ in items:
        ws = words(t)
        n = min(width, len(ws))
        for k in range(len(ws) - n + 1 if ws else 0):
            windows.setdefault(tuple(ws[k:k + n]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t, *_ in docs:
        ws, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                names = windows.get(tuple(ws[k:k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


def material(rng, odd):
    """Items of all lengths, some sharing passages; documents that quote them at the start, in the end, twice, cut short or changed."""
    say = [f"{a}{b}" for a in ("ba", "né", "ri", "日") for b in ("x", "q7", "é", "lo")]
    text = lambda n: " ".join(rng.choice(say) for _ in range(n))
    shared = text(14)
    items = [(i, text(n), 1, "n", "w") for i, n in enumerate([10, 11, 25, 40, 9, 5, 4, 3, 2])]
    items += [(20 + i, f"{text(3)} {shared}, {text(2)}", 1, None, "w") for i in range(30)]
    items += [(2, text(12), None, "n", None), (None, text(15), 1, "n", "w"), (None, "Some other-words of an item without id, ten or more", 1, "", ""),
              (60, None, 1, "n", "w"), (61, "", 1, "n", "w"), (62, " -- ", 1, "n", "w"), (63, "LONE", 1, "n", "w"), (0, items[0][1], 1, "n", "w")]
    docs, ascii_upper = list(odd), {ord(c): c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}
    for i in range(60):
        quote = words(rng.choice(items)[1])
        cut = rng.choice([quote, quote[1:], quote[:-1], quote + quote, quote[:6] + ["other"] + quote[6:], quote[::-1]])
        docs.append((100 + i, " ".join([text(rng.choice([0, 3, 40])), rng.choice([", ", "\n\n", " "]).join(cut).translate(ascii_upper), text(rng.choice([0, 2]))]),
                     "en", "s", 1, "w", "x", 3))
    docs += [(300 + i % 7, f"{shared} {shared}", "en", "s", 1, "w", "x", 3) for i in range(80)]
    return items, docs


@pytest.mark.parametrize("most", [200_000, 0])
def test_every_window_is_found(spark, odd, docs_schema, many_chunks, most):
    items, docs = material(random.Random(3), [tuple(r) for r in odd.collect()])
    for some in (items, [i for i in items if len(words(i[1])) >= 10], [(1, "lone", 1, "n", "w")]):
        got = decontaminate.contaminated_documents(spark.createDataFrame(docs, docs_schema), spark.createDataFrame(some, ITEMS), most=most)
        assert rows(got) == brute(docs, some)
        if some is items and most:
            assert sum(r["contaminated"] for r in got.collect()) > 100


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three", 1, "n", "w")], ITEMS)
    nothing = spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminated_documents(none, items).count() == 0
    got = decontaminate.contaminated_documents(odd, nothing).collect()
    assert len(got) == odd.count() and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in got)
    assert {r["items_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_wide_windows_are_refused(odd, spark):
    with pytest.raises(ValueError):
        decontaminate.contaminated_documents(odd, spark.createDataFrame([], ITEMS), width=11, shingle=5)
