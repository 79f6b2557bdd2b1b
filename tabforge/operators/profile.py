"""Profiles, validation and detection of column roles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.types import is_floating, is_numeric, logical_type

# Column names that mark the target, and the distinct-value
# bounds of the role rules.
TARGET_NAMES = ("target", "label", "y", "class", "output", "species", "outcome", "result")
TARGET_DISTINCT_BELOW = 20
MAX_INTEGER_CLASSES = 20
HIGH_NULL_PCT = 0.1
TEXT_SAMPLE = 5
TEXT_MIN_AVG = 20

# Modality tags of each kind of source.
MODALITIES = {
    "file": ("tabular",),
    "database": ("tabular",),
    "object_store": ("tabular",),
    "feature_set": ("tabular",),
    "document": ("text",),
    "image": ("image",),
    "audio": ("audio", "tabular"),
    "kafka": ("stream", "tabular"),
    "rest_poll": ("stream", "tabular"),
    "websocket": ("stream",),
}

BINARY, MULTICLASS, REGRESSION = "binary_classification", "multiclass", "regression"


def present(name: str, data_type: T.DataType) -> Column:
    """The column, null where it counts as missing (null, or NaN for floats)."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if is_floating(data_type) else c


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: name, logical type, row count, missing count and share.

    A single aggregate over one scan, whatever the number of columns.
    """
    fields = df.schema.fields
    counts = [F.count(present(f.name, f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)]
    totals = df.agg(F.count(F.lit(1)).alias("row_count"), *counts)
    per_column = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(logical_type(f.dataType)).alias("logical_type"),
            F.col("row_count"),
            (F.col("row_count") - F.col(f"n{i}")).alias("nulls"),
        )
        for i, f in enumerate(fields)
    ]
    rows = totals.select(F.inline(F.array(*per_column)))
    share = F.when(F.col("row_count") > 0, F.col("nulls") / F.col("row_count")).otherwise(0.0)
    return rows.withColumn("null_pct", share)


def table_profile(df: DataFrame, *, data_types: Iterable[str] = MODALITIES["file"],
                  sample_path: str | None = None, target: str | None = None) -> DataFrame:
    """One row for the table: counts, columns, nulls and modality tags."""
    cols = profile_columns(df).orderBy("position")
    entry = F.collect_list(F.struct("position", "column_name", "logical_type", "nulls"))
    one = cols.agg(F.max("row_count").alias("row_count"), F.sort_array(entry).alias("e"))
    return one.select(
        "row_count",
        F.size("e").alias("column_count"),
        F.map_from_arrays("e.column_name", "e.logical_type").alias("columns"),
        F.map_from_arrays("e.column_name", "e.nulls").alias("nulls"),
        F.array(*[F.lit(t) for t in data_types]).alias("data_types"),
        F.lit(sample_path).cast("string").alias("sample_path"),
        F.lit(target).cast("string").alias("target_col"),
    )


def high_null_columns(profile: DataFrame, above: float = HIGH_NULL_PCT) -> DataFrame:
    """Columns whose share of missing values is strictly above the bound."""
    return profile.where((F.col("row_count") > 0) & (F.col("null_pct") > above)).select(
        "column_name", "null_pct")


class ValidationError(ValueError):
    """A table breaks its declared schema rules."""


def validate_schema(df: DataFrame, required_columns: Iterable[str] = (),
                    max_null_pct: float | None = None, *, fail: bool = False) -> DataFrame:
    """Violations, one row each; empty when the table passes.

    With ``fail`` the violations are raised instead of returned.
    """
    have = set(df.columns)
    missing = [c for c in required_columns if c not in have]
    parts = []
    if max_null_pct is not None:
        limit = F.lit(float(max_null_pct))
        parts.append(profile_columns(df).where(F.col("null_pct") > limit).select(
            F.lit("max_null_pct").alias("rule"), "column_name",
            F.col("null_pct").alias("observed"), limit.alias("allowed")))
    if missing:
        absent = [(("missing_column"), c, 0.0, 1.0) for c in missing]
        parts.append(df.sparkSession.createDataFrame(
            absent, "rule string, column_name string, observed double, allowed double"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "rule string, column_name string, observed double, allowed double")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if fail:
        found = out.collect()
        if found:
            raise ValidationError("; ".join(
                f"{r.rule} {r.column_name}: {r.observed:g} (allowed {r.allowed:g})" for r in found))
    return out


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None, *,
                    rsd: float | None = None) -> DataFrame:
    """Number of distinct present values per column.

    Exact counts run one column at a time, so each aggregates on its own
    values and no row is expanded per column.  With ``rsd`` all columns are
    estimated in a single pass.
    """
    names = list(columns) if columns is not None else df.columns
    schema = {f.name: f.dataType for f in df.schema.fields}
    if rsd is not None:
        one = df.agg(*[F.approx_count_distinct(present(n, schema[n]), rsd).alias(f"n{i}")
                       for i, n in enumerate(names)])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("n_distinct"))
            for i, n in enumerate(names)])))
    out = None
    for n in names:
        part = df.agg(F.count_distinct(present(n, schema[n])).alias("n_distinct")).select(
            F.lit(n).alias("column_name"), "n_distinct")
        out = part if out is None else out.unionByName(part)
    return out


def bounded_distinct(df: DataFrame, column: str, at_most: int) -> int:
    """Exact number of distinct present values, or ``at_most + 1`` when there are more."""
    return bounded_distincts(df, [column], at_most)[column]


def bounded_distincts(df: DataFrame, columns: Iterable[str], at_most: int) -> dict[str, int]:
    """The same for several columns, in two passes over the table.

    The first pass is a small sketch per column.  With at most 20 values over
    512 registers its estimate is 512 * ln(512 / 492) = 20.4 or less, so an
    estimate above the bound proves the bound is exceeded.  Only the columns
    that may still be small are counted exactly; they shuffle few values per task.
    """
    if at_most > MAX_INTEGER_CLASSES:
        raise ValueError(f"the bound must be {MAX_INTEGER_CLASSES} or less")
    values = {c: present(c, df.schema[c].dataType) for c in columns}
    names = list(values)
    estimates = df.agg(*[F.approx_count_distinct(values[c], 0.05).alias(f"n{i}")
                         for i, c in enumerate(names)]).first()
    out = {c: at_most + 1 for c in names}
    small = [c for i, c in enumerate(names) if estimates[i] <= at_most]
    if small:
        exact = {r.column_name: r.n_distinct for r in distinct_counts(df, small).collect()}
        out |= {c: min(exact[c], at_most + 1) for c in small}
    return out


def detect_target(df: DataFrame, *, sample_rows: int | None = None,
                  order_by: str | None = None) -> str | None:
    """Name of the likely target column, or None.

    The first column with a telling name; else the last column when it is text
    or has fewer than 20 distinct values.  The values of the whole table count
    unless ``sample_rows`` asks for a look at the head only.
    """
    for name in df.columns:
        if name.lower() in TARGET_NAMES:
            return name
    last = df.schema.fields[-1]
    if isinstance(last.dataType, T.StringType):
        return last.name
    if isinstance(last.dataType, (T.MapType, T.ArrayType, T.StructType)):
        return None
    head = df
    if sample_rows is not None:
        head = (df.orderBy(order_by) if order_by else df).limit(sample_rows)
    few = bounded_distinct(head, last.name, TARGET_DISTINCT_BELOW - 1) < TARGET_DISTINCT_BELOW
    return last.name if few else None


def detect_task_type(df: DataFrame, label: str,
                     max_classes: int | None = MAX_INTEGER_CLASSES) -> str:
    """Task implied by a label column.

    Text and booleans are classes; integers are classes up to ``max_classes``
    distinct values (always, when it is None); all else is regression.
    """
    return task_from_count(df.schema[label].dataType, _class_count(df, label), max_classes)


def _class_count(df: DataFrame, label: str) -> int:
    if not isinstance(df.schema[label].dataType, (T.StringType, T.BooleanType, T.IntegralType)):
        return MAX_INTEGER_CLASSES + 1
    return bounded_distinct(df, label, MAX_INTEGER_CLASSES)


def task_from_count(data_type: T.DataType, n_distinct: int, max_classes: int | None) -> str:
    if isinstance(data_type, (T.StringType, T.BooleanType)):
        return BINARY if n_distinct == 2 else MULTICLASS
    if isinstance(data_type, T.IntegralType):
        if n_distinct == 2:
            return BINARY
        if max_classes is None or n_distinct <= max_classes:
            return MULTICLASS
    return REGRESSION


def task_types(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Exact distinct count and task of several label columns."""
    counts = {r.column_name: r.n_distinct for r in distinct_counts(df, list(labels)).collect()}
    rows = [(label, n, task_from_count(df.schema[label].dataType, n, MAX_INTEGER_CLASSES))
            for label, n in counts.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_distinct bigint, task string")


def find_text_column(df: DataFrame, order_by: str | None = None) -> str | None:
    """First text column whose first five present values average over 20 characters.

    Falls back to the first text column.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return None
    found = {r.column_name: r.avg_len for r in head_lengths(df, names, order_by).collect()}
    return next((n for n in names if found.get(n) is not None and found[n] > TEXT_MIN_AVG), names[0])


def head_lengths(df: DataFrame, names: Iterable[str], order_by: str | None = None,
                 n: int = TEXT_SAMPLE) -> DataFrame:
    """Mean length of the first ``n`` present values of each text column.

    With a key each task keeps its ``n`` first rows in a heap; nothing is
    sorted as a whole, and only lengths leave the scan.
    """
    out = None
    for name in names:
        lengths = df.where(F.col(f"`{name}`").isNotNull()).select(
            *([F.col(order_by).alias("__key")] if order_by else []), F.char_length(F.col(f"`{name}`")).alias("len"))
        head = (lengths.orderBy("__key", "len") if order_by else lengths).limit(n)
        part = head.agg(F.avg("len").alias("avg_len")).select(F.lit(name).alias("column_name"), "avg_len")
        out = part if out is None else out.unionByName(part)
    return out


def file_info(df: DataFrame, **target_options) -> DataFrame:
    """Row count, columns with type and numeric flag, and the detected target."""
    target = detect_target(df, **target_options)
    return profile_columns(df).select(
        "row_count", "column_name", "logical_type",
        F.col("logical_type").isin("int", "float", "decimal").alias("is_numeric"),
        F.lit(target).cast("string").alias("detected_target"),
    )


def numeric_flags(schema: T.StructType) -> Mapping[str, bool]:
    return {f.name: is_numeric(f.dataType) for f in schema.fields}
