"""Document quality by divergence from language references.

A text's character-class histogram and its histogram of common words are compared with those of its
language by Jensen-Shannon distance. The references are sums over all texts of a language, so they
follow the corpus; a text is only judged by a histogram it has enough material for. A text that declares
no listed language is judged by the nearest of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.words import window_hashes, words_of
from cohortweave.session import materialise

# Frequent function words of each language, the bins of its word histogram.
COMMON = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "on", "as", "are", "be", "this"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
OTHER_LANGUAGE = "other"
CLASSES = ("upper", "lower", "digit", "space", "stop", "symbol")
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.30
MIN_CHARS = 200
MIN_WORDS = 100
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def add_base(df: DataFrame, text: str, words: str) -> DataFrame:
    """`df` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    `text` and `words` are columns: the non-null text and its words. The windows of three words are
    compared by 64-bit hashes; only a text in which some hash repeats sorts them with their places.
    """
    t = F.col(text)
    df = df.withColumn("_w3", window_hashes(words, 3))
    df = df.withColumn("_sorted", F.sort_array("_w3"))
    df = df.withColumn("_twice", F.exists(F.sequence(F.lit(1), F.greatest(F.size("_sorted"), F.lit(1))),
                                          lambda i: F.get("_sorted", i) == F.get("_sorted", i - 1)))
    pairs = F.sort_array(F.transform("_w3", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_pairs", F.when(F.col("_twice"), pairs).otherwise(nothing))
    repeated = F.filter("_pairs", lambda x, i: (x["h"] == F.get("_pairs", i - 1)["h"])
                        | (x["h"] == F.get("_pairs", i + 1)["h"]))
    df = df.withColumn("_places", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    # every repeated window covers three words, less what the window before it has covered
    covered = F.aggregate(
        "_places", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    df = df.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0))
    n_words = F.size(words).cast("long")
    return df.select(
        *[c for c in df.columns if c not in ("_w3", "_sorted", "_twice", "_pairs", "_places", "_lines")],
        n_words.alias("n_words"), F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def among(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def guessed(lang: Column) -> Column:
    """Name of the reference for texts without a listed language."""
    return F.concat(F.lit("?"), lang)


def add_histograms(df: DataFrame, text: str, words: str, lang: str) -> DataFrame:
    """`df` plus _lang, _chars, _common and _own.

    _lang is the declared language, or null if `lang` names none of COMMON. _chars holds counts by
    character class. _common has one entry (of the declared language) or, without one, an entry of each
    language: counts of its common words, then of all other words. _own is the declared language or the
    one with the most common words in the text, null if the text has none.
    """
    t = F.col(text)
    bare = F.lower(F.translate(F.array_join(F.col(words), " "), ".,;:!?", ""))
    df = (df.withColumn("_lang", F.when(F.col(lang).isin(list(COMMON)), F.col(lang)))
          .withColumn("_marks", F.regexp_replace(t, r"\p{L}+", ""))
          .withColumn("_upper", F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")))
          .withColumn("_bare", F.split(bare, " ")))
    lists = F.lit(None).cast("array<struct<lang:string,bins:array<string>,frequent:array<string>>>")
    entries = [F.struct(F.lit(name).alias("lang"), F.array(*[F.lit(w) for w in ws]).alias("bins"),
                        F.filter("_bare", among(ws)).alias("frequent")) for name, ws in COMMON.items()]
    for name, entry in zip(COMMON, entries):
        lists = F.when(F.col("_lang") == name, F.array(entry)).otherwise(lists)
    df = df.withColumn("_lists", F.when(F.col("_lang").isNull(), F.array(*entries)).otherwise(lists))
    n, marks = F.length(t), F.length("_marks")
    digit = marks - F.length(F.translate("_marks", "0123456789", ""))
    space = marks - F.length(F.translate("_marks", WHITE, ""))
    stop = marks - F.length(F.translate("_marks", ".,;:!?'\"()-", ""))
    chars = [F.col("_upper"), n - marks - F.col("_upper"), digit, space, stop, marks - digit - space - stop]
    counts = lambda e: F.transform(e["bins"], lambda b: F.size(F.filter(e["frequent"], lambda x: x == b)))
    common = F.transform("_lists", lambda e: F.struct(e["lang"].alias("lang"), F.concat(
        counts(e).cast("array<double>"), F.array((F.size(words) - F.size(e["frequent"])).cast("double"))).alias("counts")))
    # the most common words first; of equal ones the last language by name
    guess = F.array_max(F.transform("_lists", lambda e: F.struct(F.size(e["frequent"]).alias("n"), e["lang"].alias("lang"))))
    return (df.withColumn("_chars", F.array(*[c.cast("double") for c in chars]))
            .withColumn("_common", common)
            .withColumn("_own", F.coalesce("_lang", F.when(guess["n"] > 0, guess["lang"])))
            .drop("_marks", "_upper", "_bare", "_lists"))


def references(histograms: DataFrame) -> DataFrame:
    """One row a reference: _ref, _chars_ref, _common_ref. At most 2 * len(COMMON) rows.

    The reference named like a language sums the texts that declare it and judges these alone. The one
    named guessed() sums the texts without a listed language that come nearest to it as well.
    """
    widest = 1 + max(map(len, COMMON.values()))
    own = F.get(F.filter("_common", lambda c: c["lang"] == F.col("_own")), F.lit(0))["counts"]
    names = [f"c{i}" for i in range(len(CLASSES))] + [f"w{i}" for i in range(widest)]
    cells = [F.get("_chars", F.lit(i)) for i in range(len(CLASSES))] + [F.get("_counts", F.lit(i)) for i in range(widest)]
    sums = histograms.where(F.col("_own").isNotNull()).withColumn("_counts", own).groupBy(
        "_own", F.col("_lang").isNotNull().alias("_declared")).agg(*[F.sum(c).alias(k) for k, c in zip(names, cells)])
    both = F.when(F.col("_declared"), F.array(F.col("_own"), guessed(F.col("_own")))).otherwise(F.array(guessed(F.col("_own"))))
    out = sums.withColumn("_ref", F.explode(both)).groupBy("_ref").agg(*[F.sum(k).alias(k) for k in names])
    return out.select("_ref", F.array(*names[:len(CLASSES)]).alias("_chars_ref"),
                      F.filter(F.array(*names[len(CLASSES):]), lambda x: x.isNotNull()).alias("_common_ref"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count histograms; null if one is empty."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    share = lambda a, total: F.transform(a, lambda x: x / total)
    sp, sq = add(p), add(q)
    terms = F.zip_with(share(p, sp), share(q, sq), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(add(terms), F.lit(0.0))))


def add_verdict(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds char_distance, word_distance and kept. A histogram from too little material is not used.

    A text without a listed language has the distance of its nearest reference.
    """
    entries = F.collect_list(F.struct("_ref", F.struct("_chars_ref", "_common_ref")))
    df = df.crossJoin(F.broadcast(refs.agg(F.map_from_entries(entries).alias("_refs"))))  # one row, at most 2 * len(COMMON) entries
    ref = lambda name: F.try_element_at("_refs", name)
    declared = F.col("_lang").isNotNull()
    by_chars = F.when(declared, js_distance(F.col("_chars"), ref(F.col("_lang"))["_chars_ref"])).otherwise(
        F.array_min(F.transform(F.map_values("_refs"), lambda r: js_distance(F.col("_chars"), r["_chars_ref"]))))
    by_words = F.when(declared, js_distance(F.get("_common", F.lit(0))["counts"], ref(F.col("_lang"))["_common_ref"])).otherwise(
        F.array_min(F.transform("_common", lambda c: js_distance(c["counts"], ref(guessed(c["lang"]))["_common_ref"]))))
    chars = F.aggregate("_chars", F.lit(0.0), lambda s, x: s + x)
    df = (df.withColumn("char_distance", F.when(chars >= MIN_CHARS, by_chars))
          .withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, by_words)))
    far = ((F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE)
           | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE))
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop("_lang", "_chars", "_common", "_own", "_refs")


def features(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_lang_in", F.col(lang_col))
    df = df.withColumn("_words", words_of(F.col("_text")))
    return add_histograms(add_base(df, "_text", "_words"), "_text", "_words", "_lang_in").drop(
        "_text", "_words", "_lang_in")


def scored(docs: DataFrame, keys: dict[str, Column], text_col: str, lang_col: str) -> DataFrame:
    """`keys` of every row, the base counts, both distances and kept. The features are stored, so no later
    filter is folded into the array expressions."""
    slim = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    rows = materialise(features(slim, "_t", "_l").drop("_t", "_l"))
    return add_verdict(rows, references(rows))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, the base counts, both distances and kept for every row.

    Null text has no words, so it fails the base rule. A text whose language is null or not in
    COMMON is compared with every language and judged by the nearest; a language without a word list has no
    reference of its own. Null ids and repeated rows are scored like any other. An empty
    table gives no rows. Other columns are not read.
    """
    return scored(docs, {id_col: F.col(id_col)}, text_col, lang_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, that score_documents() keeps.

    Equal ids, texts and languages have one verdict, so only hashes of rejected rows are joined.
    """
    row = F.xxhash64(id_col, text_col, lang_col)
    found = scored(docs, {"_rejected": row}, text_col, lang_col)
    name = f"_rejected_{uuid.uuid4().hex}"  # no column of docs has it
    rejected = materialise(found.where(~F.col("kept")).select(F.col("_rejected").alias(name)).distinct())
    return docs.join(rejected, row == F.col(name), "left_anti")
