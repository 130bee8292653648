"""Column-name cleaning and key splitting for measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.functions.numeric import col

# --- fixed values: how vendors decorate a column name -------------------------------
CYCLE_SUFFIX = r"(?i):\s*Cyc[_ ]?\d+[_ ]?ch[_ ]?\d+\s*$"
DESCRIPTION_SUFFIX = r"\s+-\s+.*$"
HISTONE_MARK = r"(?i)^(?:H)?H3\s*[-_ ]?(K\d+(?:ac|me\d?))$"
ISOFORM = r"(?i)^(CD45)\s*[-_ ]?(RA|RO|RB|RC)$"
PHOSPHO = r"^(?:p|phospho)[-_ ]?(?=[A-Z])(.+)$"
PHOSPHO_CORE_NAMES = {"S6": "RPS6"}
# ------------------------------------------------------------------------------------


def strip_decoration(raw: str | Column) -> Column:
    """Drop the cycle/channel suffix, any ':' tail and a ' - description' tail."""
    s = F.trim(F.regexp_replace(col(raw).cast("string"), CYCLE_SUFFIX, ""))
    s = F.trim(F.split(s, ":", 2)[0])
    return F.trim(F.regexp_replace(s, DESCRIPTION_SUFFIX, ""))


def split_key(name: str | Column) -> Column:
    """Struct (core, epitope, modification) of a stripped name."""
    n = F.trim(col(name))
    phospho_core = F.regexp_extract(n, PHOSPHO, 1)
    for short, full in PHOSPHO_CORE_NAMES.items():
        phospho_core = F.when(phospho_core == short, F.lit(full)).otherwise(phospho_core)

    def triple(core: Column, epitope: Column, modification: str) -> Column:
        return F.struct(core.alias("core"), epitope.alias("epitope"),
                        F.lit(modification).alias("modification"))

    return (
        F.when(n.rlike(HISTONE_MARK),
               triple(F.lit("H3"), F.regexp_extract(n, HISTONE_MARK, 1), "none"))
        .when(n.rlike(ISOFORM),
              triple(F.regexp_extract(n, ISOFORM, 1), F.upper(F.regexp_extract(n, ISOFORM, 2)), "none"))
        .when(n.rlike(PHOSPHO), triple(phospho_core, F.lit("pan"), "phospho"))
        .otherwise(triple(n, F.lit("pan"), "none"))
    )


def lookup_key(s: str | Column) -> Column:
    """Upper-cased letters and digits only."""
    return F.regexp_replace(F.upper(col(s).cast("string")), "[^A-Z0-9]", "")


def name_key(s: str | Column) -> Column:
    """Lower-cased words separated by single blanks."""
    t = F.regexp_replace(F.lower(col(s).cast("string")), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))
