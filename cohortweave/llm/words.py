"""Word lists and hashes of whole texts as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x09-\x0D\x20]+"


def words_of(text: Column) -> Column:
    """The runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def window_hashes(words: str, n: int) -> Column:
    """64-bit hash of every n consecutive words of the array column `words`; none with fewer words.

    `words` must be a column of its own (it is read once for each place in the array).
    """
    places = F.sequence(F.lit(0), F.size(words) - n)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, hashes).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(words: str, n: int) -> Column:
    """window_hashes(); with 1 to n - 1 words the whole sequence is the one shingle."""
    return F.when(F.size(words).between(1, n - 1), F.array(F.xxhash64(F.concat_ws(" ", F.col(words))))).otherwise(
        window_hashes(words, n))
