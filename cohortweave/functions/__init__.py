"""Column expressions shared by the operators."""

from cohortweave.functions.numeric import clean, half_even, mid_rank, order_key, r6, safe_div, share
from cohortweave.functions.text import lookup_key, name_key, split_key, strip_decoration

__all__ = [
    "clean", "half_even", "mid_rank", "order_key", "r6", "safe_div", "share",
    "lookup_key", "name_key", "split_key", "strip_decoration",
]
