"""Read a dataset through its spec into the standard cell table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortweave.functions.numeric import clean, safe_div
from cohortweave.operators.joins import left_join_one
from cohortweave.sources.specs import (
    STANDARD_COLUMNS, UNKNOWN_PATIENT, AreaRule, CohortSpec, MarkerRule,
)


def read_table(spark: SparkSession, path: str, fmt: str, columns: Sequence[str] | None = None,
               header: bool = True, placed: bool = False) -> DataFrame:
    """Parquet, or CSV read as plain strings so that a literal 'NA' and a quoted empty text stay data.

    `placed` adds where a row comes from: _file, _part (start of the part read at once; 0 for Parquet, whose rows
    know their number in the file) and _at (number in the part, up to a constant).
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = (spark.read.option("header", header).option("inferSchema", False)
              .option("emptyValue", "").option("nullValue", "\u0000").option("nanValue", "\u0000").csv(path))
    else:
        raise ValueError(f"unknown format {fmt}")
    wanted = [quoted(c) for c in (df.columns if columns is None else columns)]
    if placed and fmt == "parquet":
        wanted += [F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_part"), F.col("_metadata.row_index").alias("_at")]
    elif placed:
        in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        wanted += [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), in_task.alias("_at")]
    return df.select(*wanted)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`").alias(name)


def columns_of(spark: SparkSession, path: str, fmt: str) -> list[str]:
    """Column names only; no rows are read."""
    return read_table(spark, path, fmt).columns


def require_columns(needed: Sequence[str], available: Sequence[str], what: str) -> None:
    missing = sorted(set(needed) - set(available))
    if missing:
        raise KeyError(f"{what} is missing columns: {missing}")


def resolve_markers(spark: SparkSession, rule: MarkerRule, available: Sequence[str]) -> list[str]:
    """Turn a marker rule into concrete column names."""
    available = list(available)
    if rule.kind == "pattern":
        rx = re.compile(rule.regex)
        return [c for c in available if rx.search(c)]
    if rule.kind == "exclude":
        return [c for c in available if c not in set(rule.columns)]
    if rule.kind == "range":
        require_columns([rule.start, rule.end], available, "marker range")
        i, j = available.index(rule.start), available.index(rule.end)
        if i > j:
            raise ValueError(f"marker range starts at {rule.start}, after its end {rule.end}")
        return available[i:j + 1]
    if rule.kind == "file":
        t = read_table(spark, rule.path, "csv", header=rule.header)
        name = rule.column or t.columns[0]
        listed = [r[0] for r in t.select(quoted(name)).where(quoted(name).isNotNull()).collect()]
        require_columns(listed, available, "marker file")
        return listed
    raise ValueError(f"unknown marker rule {rule.kind}")


def area_expr(rule: AreaRule | None):
    """Area column under the rule; NULL without one, and NULL on a zero denominator."""
    if rule is None:
        return F.lit(None).cast("double")
    if rule.kind == "column":
        return quoted(rule.column).cast("double")
    if rule.kind == "divide":
        return safe_div(quoted(rule.numerator), quoted(rule.denominator))
    raise ValueError(f"unknown area rule {rule.kind}")


def number_rows(df: DataFrame, out: str = "cell_id") -> DataFrame:
    """0..n-1 in file order, without a shuffle of the rows and without storing them.

    df comes from `read_table(..., placed=True)`. A row's place is its file, the part of the file that is read at
    once, and its number there; parts are counted in a scan that reads no column. Ids depend on the files alone for
    Parquet; for text, on the files and on how they are cut for reading, which a session keeps.
    """
    parts = df.groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part of a file, always broadcast: dealt out by file, all rows of a file would meet in one task
    offsets = parts.select("_file", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_o"))
    return df.join(F.broadcast(offsets), ["_file", "_part"]).withColumn(out, (F.col("_o") + F.col("_at")).cast("long")).drop("_file", "_part", "_at", "_o")


def standardise(df: DataFrame, cohort: str, mapping: dict[str, str], markers: Sequence[str],
                area: AreaRule | None = None) -> DataFrame:
    """The nine standard columns plus the markers under their own names."""
    clash = set(markers) & set(STANDARD_COLUMNS)
    if clash:
        raise KeyError(f"[{cohort}] marker names collide with standard columns: {sorted(clash)}")

    def text(name: str, default: str | None = None):
        if name in mapping:
            return quoted(mapping[name]).cast("string")
        if name in df.columns and default is not None:
            return quoted(name).cast("string")
        return F.lit(default)

    def number(name: str):
        """A quoted empty text is no number."""
        return F.nullif(quoted(name), F.lit("")) if isinstance(df.schema[name].dataType, T.StringType) else quoted(name)

    conf = (F.coalesce(F.expr(f"try_cast(`{mapping['label_confidence']}` as float)"), F.lit(1.0))
            if "label_confidence" in mapping else F.lit(1.0))
    return df.select(
        "cell_id",
        F.lit(cohort).alias("cohort"),
        F.concat_ws("|", F.lit(cohort), text("image_id")).alias("image_id"),
        F.concat_ws("|", F.lit(cohort),
                    F.coalesce(text("patient_id", UNKNOWN_PATIENT), F.lit("nan"))).alias("patient_id"),
        clean(number(mapping["x_px"])).alias("x_px"),
        clean(number(mapping["y_px"])).alias("y_px"),
        area_expr(area).alias("area_px2"),
        text("native_label").alias("native_label"),
        conf.cast("float").alias("label_confidence"),
        *[clean(number(m)).cast("float").alias(m) for m in markers],
    )


def load(spark: SparkSession, spec: CohortSpec) -> tuple[DataFrame, list[str]]:
    """Standard table and marker list of one dataset; only needed columns are scanned."""
    base = spec.base
    base_cols = columns_of(spark, base.path, base.format)
    joined = {new for j in spec.joins for new in j.columns}
    need = set(base.columns.values())
    if spec.area is not None:
        need |= {c for c in (spec.area.column, spec.area.numerator, spec.area.denominator) if c}
    for j in [*spec.joins, *([spec.expression] if spec.expression else [])]:
        need |= set(j.left_on)
    markers = None
    if spec.expression is None:
        markers = resolve_markers(spark, spec.markers, base_cols)
        need |= set(markers)
    need -= joined
    require_columns(sorted(need), base_cols, f"[{spec.name}] base table")
    df = number_rows(read_table(spark, base.path, base.format,
                                [c for c in base_cols if c in need], placed=True))
    for j in spec.joins:
        aux = read_table(spark, j.path, j.format).select(
            *[quoted(r).alias(f"_k{i}") for i, r in enumerate(j.right_on)],
            *[quoted(src).alias(new) for new, src in j.columns.items()])
        df = left_join_one(df, aux, list(j.left_on), [f"_k{i}" for i in range(len(j.right_on))])
    if spec.expression is not None:
        e = spec.expression
        e_cols = columns_of(spark, e.path, e.format)
        markers = resolve_markers(spark, spec.markers, [c for c in e_cols if c not in e.right_on])
        aux = read_table(spark, e.path, e.format).select(
            *[quoted(r).alias(f"_k{i}") for i, r in enumerate(e.right_on)],
            *[quoted(m) for m in markers])
        df = left_join_one(df, aux, list(e.left_on), [f"_k{i}" for i in range(len(e.right_on))])
    mapping = dict(base.columns)
    return standardise(df, spec.name, mapping, markers, spec.area), markers


def load_all(spark: SparkSession, specs: Sequence[CohortSpec]) -> DataFrame:
    """Row union of every dataset; a marker a dataset lacks is NULL there."""
    out = None
    for s in specs:
        df, _ = load(spark, s)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def registry(spark: SparkSession, specs: Sequence[CohortSpec]) -> DataFrame:
    """cohorts dimension: cohort, platform, tissue, role, px_um."""
    schema = T.StructType([
        T.StructField("cohort", T.StringType()), T.StructField("platform", T.StringType()),
        T.StructField("tissue", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("px_um", T.DoubleType())])
    return spark.createDataFrame(
        [(s.name, s.platform, s.tissue, s.role, float(s.px_um)) for s in specs], schema)
