"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is a run of `width` item words (the whole item if it has fewer). Its tokens are its shingles of up to
`shingle` words. Shingles are ordered by how often the documents hold them, rarest first; a text that contains a
window holds all its shingles, so its necessary prefix is the rarest one, and only that is joined. The shingle's
offset and the window's length bound where the window may lie in the document; what is left is verified by the
shingles that cover the window end to end. Words are compared, not only their hashes.

One pass over the documents keeps, of every document, one base row and the places of benchmark shingles. All later
joins work on those places, so no text is shuffled and no row is repeated per pair of equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.session import materialise, materialise_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, SHINGLE = 10, 5
SENT = 200_000  # rows of a benchmark table that are broadcast; a larger one is joined by shuffle
NO_ITEMS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: SHA-256 of no bytes


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), "")


def sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def item_windows(items: DataFrame, width: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """name, window (its words), len of every distinct window of every item; items without words have none."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), words_of(F.col(text_col)).alias("_w"))
    named = named.where(F.size("_w") > 0).withColumn("len", F.least(F.size("_w"), F.lit(width)))
    at = F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("len") + 1))
    return named.withColumn("_i", at).select("name", F.slice("_w", F.col("_i"), F.col("len")).alias("window"), "len").distinct()


def shingle_words(words: str, start: Column, n: int) -> list[Column]:
    """The n words from 0-based `start`."""
    return [F.get(F.col(words), start + k) for k in range(n)]


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, len, offset, size (words), hash and w0.. of every shingle of every window."""
    size = F.least(F.col("len"), F.lit(shingle))
    placed = windows.select("wid", "len", "window", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("offset"))
    words = [F.when(F.col("size") > k, w).alias(f"w{k}") for k, w in enumerate(shingle_words("window", F.col("offset"), shingle))]
    named = placed.select("wid", "len", "offset", "size", *words)
    return named.withColumn("hash", F.xxhash64(*[f"w{k}" for k in range(shingle)]))


def shingle_places(docs: DataFrame, known: DataFrame, sizes: list[int], shingle: int, rows: int, most: int) -> DataFrame:
    """Stored table: one base row of each document (place -1, n_words) and one row for each place where a
    known shingle begins (rid, place, sid). rid names a row of this table's one computation."""
    names = [f"w{k}" for k in range(shingle)]
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("_w"))
    base = base.withColumn("n_words", F.size("_w"))
    placed = base.withColumn("place", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    size = F.lit(shingle)
    if len(sizes) > 1:  # short items: shorter shingles begin at every place as well
        each = F.when(F.col("place") < 0, F.array(F.lit(shingle))).otherwise(F.array(*[F.lit(n) for n in sizes]))
        placed, size = placed.withColumn("at_size", F.explode(each)), F.col("at_size")
    words = [F.when((F.col("place") >= 0) & (size > k), w).alias(n)
             for k, (n, w) in enumerate(zip(names, shingle_words("_w", F.col("place"), shingle)))]
    whole = placed.select("rid", "doc_id", "n_words", "place", size.alias("at_size"), *words)
    # a base row's key is its own, so that base rows spread where the join is a shuffle; it has no words to match
    keyed = whole.withColumn("_h", F.when(F.col("place") < 0, F.xxhash64("rid")).otherwise(F.xxhash64(*names)))
    same = (F.col("_h") == F.col("hash")) & (F.col("at_size") == F.col("size")) & (F.col("w0") == F.col("k0"))
    for k in range(1, shingle):
        same &= (F.col("size") <= k) | (F.col(f"w{k}") == F.col(f"k{k}"))
    mine = known.select("sid", "hash", "size", *[F.col(n).alias(f"k{k}") for k, n in enumerate(names)])
    hit = keyed.join(sent(mine, rows, most), same, "left")
    return materialise(hit.where(F.col("sid").isNotNull() | (F.col("place") < 0)).select("rid", "doc_id", "n_words", "place", "sid"))


def contaminated_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, id_col: str = "doc_id",
                           text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = SENT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`.

    Texts of any length are read whole; null and empty texts have no words and are clean. Rows of equal ids and
    null ids stay rows of their own. Items without words match nothing; items of equal id are one item, those
    without id are one item named by the empty text. Empty tables: no documents give no rows, without items every
    document is clean. Other columns are not read.
    """
    if width > 2 * shingle:
        raise ValueError("two shingles must cover a window")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    owned, n_owned = materialise_counted(item_windows(items, width, shingle, item_col, item_text))
    # equal windows are one: wid is the least of their places in the stored table
    numbered = owned.withColumn("_n", F.monotonically_increasing_id())
    windows = numbered.groupBy("window", "len").agg(F.min("_n").alias("wid"))
    windows = materialise(windows)
    tokens = materialise(window_shingles(windows, shingle))
    names = [f"w{k}" for k in range(shingle)]
    known, n_known = materialise_counted(tokens.groupBy("size", "hash", *names).agg(F.min(F.struct("wid", "offset")).alias("sid")))
    known = known.withColumn("sid", F.col("sid.wid") * width + F.col("sid.offset"))
    sizes = sorted({r[0] for r in known.select("size").distinct().collect()} | {shingle})  # at most `shingle` numbers
    places = shingle_places(slim, known, sizes, shingle, n_known, most)
    base = places.where("place < 0").select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    hits = places.where("place >= 0").select("rid", "place", "sid", "n_words")

    # rarest first: the one shingle of each window that is joined
    seen = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("seen"))
    ids = known.select("size", F.col("sid"), *[F.col(n).alias(f"k{i}") for i, n in enumerate(names)], F.col("hash").alias("_h"))
    match = (F.col("_h") == F.col("hash")) & (tokens["size"] == ids["size"])
    for i, n in enumerate(names):
        match &= F.col(n).eqNullSafe(F.col(f"k{i}"))
    named = tokens.join(ids, match).select("wid", "len", "offset", tokens["size"].alias("size"), "sid")
    window = Window.partitionBy("wid")  # at most `width` shingles
    ranked = named.join(seen, "sid", "left").withColumn("_all", F.count("seen").over(window) == F.count(F.lit(1)).over(window))
    cover = window.orderBy("offset")
    ranked = ranked.withColumn("head", F.first("sid").over(cover)).withColumn(
        "tail", F.last("sid").over(cover.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    prefix = ranked.where("_all").withColumn("_rank", F.row_number().over(window.orderBy("seen", "sid", "offset"))).where("_rank = 1")
    prefix, n_prefix = materialise_counted(prefix.select("sid", "wid", "len", "offset", "size", "head", "tail"))

    # candidates within their bounds, verified by the shingles that begin and end the window
    start = F.col("place") - F.col("offset")
    within = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    near = hits.join(sent(prefix, n_prefix, most), "sid").where(within).select(
        "rid", start.alias("start"), "wid", "len", "size", "head", "tail")
    one = hits.select("rid", F.col("place").alias("start"), F.col("sid").alias("head"))
    two = hits.select("rid", F.col("place").alias("last"), F.col("sid").alias("tail"))
    near = near.join(one, ["rid", "start", "head"], "left_semi").withColumn("last", F.col("start") + F.col("len") - F.col("size"))
    true = materialise(near.join(two, ["rid", "last", "tail"], "left_semi").select("rid", "wid", "start", "len"))
    return base.join(covered_words(true), "rid", "left").join(
        listed_items(true, numbered, windows, n_owned, most), "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def covered_words(true: DataFrame) -> DataFrame:
    """rid, n_hit: words inside any occurrence (a document's occurrences are at most its words)."""
    spans = true.groupBy("rid", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    return spans.withColumn("_new", new).groupBy("rid").agg(F.sum("_new").cast("long").alias("n_hit"))


def listed_items(true: DataFrame, owned: DataFrame, windows: DataFrame, rows: int, most: int) -> DataFrame:
    """rid, n_items, items_sha256. Documents with the same windows share one list, so that a passage common to
    many documents and many items is not expanded for each pair of them."""
    held = true.groupBy("rid").agg(F.array_sort(F.collect_set("wid")).alias("wids")).withColumn(
        "kind", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256))
    held = materialise(held)
    kinds = held.groupBy("kind").agg(F.first("wids").alias("wids")).select("kind", F.explode("wids").alias("wid"))
    names = owned.join(windows, ["window", "len"]).select("wid", "name")
    lists = kinds.join(sent(names, rows, most), "wid").groupBy("kind").agg(F.array_sort(F.collect_set("name")).alias("names"))
    lists, n = materialise_counted(lists.select("kind", F.size("names").cast("long").alias("n_items"),
                                                F.sha2(F.array_join("names", ","), 256).alias("items_sha256")))
    return held.select("rid", "kind").join(sent(lists, n, most), "kind").drop("kind")
