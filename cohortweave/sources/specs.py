"""Declarative dataset specs: adding a dataset means adding a spec, not code."""

from __future__ import annotations

from dataclasses import dataclass, field

STANDARD_COLUMNS = (
    "cell_id", "cohort", "image_id", "patient_id", "x_px", "y_px", "area_px2",
    "native_label", "label_confidence",
)
UNKNOWN_PATIENT = "unknown"


@dataclass(frozen=True)
class TableSpec:
    """A file and, for joined tables, its key columns and the columns to take (new -> source)."""

    path: str
    format: str = "parquet"
    columns: dict[str, str] = field(default_factory=dict)
    left_on: tuple[str, ...] = ()
    right_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class MarkerRule:
    """Which columns are markers: pattern | exclude | range | file."""

    kind: str
    regex: str = ""
    columns: tuple[str, ...] = ()
    start: str = ""
    end: str = ""
    path: str = ""
    header: bool = True
    column: str = ""


@dataclass(frozen=True)
class AreaRule:
    """column: take one column; divide: numerator / denominator."""

    kind: str
    column: str = ""
    numerator: str = ""
    denominator: str = ""


@dataclass(frozen=True)
class CohortSpec:
    """One dataset. `base` has one row per cell; `expression` holds markers when they live apart."""

    name: str
    platform: str
    tissue: str
    role: str
    px_um: float
    base: TableSpec
    markers: MarkerRule
    joins: tuple[TableSpec, ...] = ()
    expression: TableSpec | None = None
    area: AreaRule | None = None
