"""Numeric column helpers: missing values, guarded division, rounding and ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """Double with NaN and the infinities turned into NULL, so aggregates skip them."""
    x = col(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL where den is zero (ANSI division would raise)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def share(cond: Column) -> Column:
    """Aggregate: fraction of rows where cond holds (NULL counts as false)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def r6(c: str | Column) -> Column:
    """Round to six decimals and fold -0.0 into 0.0 for stable comparison."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def half_even(c: str | Column, digits: int = 4) -> Column:
    """Banker's rounding on the decimal value, as Python's round()."""
    return F.bround(col(c).cast("decimal(28,14)"), digits).cast("double")


def order_key(purpose: str, *cols: str | Column) -> Column:
    """Reproducible pseudo-random order: md5 of a purpose tag and an identity."""
    return F.md5(F.concat_ws("|", F.lit(purpose), *[col(c).cast("string") for c in cols]))


def mid_rank(n_upto: str | Column, n_at: str | Column) -> Column:
    """Average rank of a tied value from its inclusive running count and tie count."""
    return col(n_upto).cast("double") - (col(n_at).cast("double") - 1.0) / 2.0
