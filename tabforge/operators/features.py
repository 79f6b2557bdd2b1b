"""Feature and label columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.types import is_numeric
from tabforge.operators.rows import with_row_index

def target_name(df: DataFrame, target: str | None = None) -> str:
    """The wanted target, or the last column when it is absent."""
    return target if target and target in df.columns else df.columns[-1]


def split_features_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    name = target_name(df, target)
    return df.drop(name), df.select(name)


def features_then_target(df: DataFrame, target: str | None = None) -> DataFrame:
    """The same split as one table: features in order, target last."""
    name = target_name(df, target)
    return df.select(*[c for c in df.columns if c != name], name)


def align_features(df: DataFrame, features: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """The trained features in trained order; a missing one is an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.select(*keep, *features)


def select_numeric(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    keep = list(keep)
    return df.select(*keep, *[f.name for f in df.schema.fields
                              if is_numeric(f.dataType) and f.name not in keep])


def scoring_vector(df: DataFrame, features: Sequence[str], keep: Iterable[str] = (),
                   target: str | None = None) -> DataFrame:
    """Features as doubles in profile order; an absent or null feature is 0."""
    cols = []
    for f in features:
        if f == target:
            continue
        value = F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)
        cols.append(value.alias(f))
    return df.select(*keep, *cols)


def label_ids(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Sorted distinct labels numbered from 0, NaN last: range-sorted, numbered by partition offsets."""
    values = df.select(label).where(F.col(f"`{label}`").isNotNull()).distinct()
    return with_row_index(values, f"`{label}`", out)


def encode_labels(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Add the label's id; a null label has a null id.

    One plan for any number of labels: adaptive execution sends a small label table to all tasks and
    splits a hot label otherwise.
    """
    return df.join(label_ids(df, label, out), label, "left").select(*[f"`{c}`" for c in df.columns], out)
