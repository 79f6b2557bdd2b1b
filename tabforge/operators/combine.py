"""Stacking tables by column name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.types import common_type


def reconcile_types(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Cast shared columns of all frames to one type each, so stacking cannot fail."""
    target: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            target[f.name] = common_type(target[f.name], f.dataType) if f.name in target else f.dataType
    return [
        df.select(*[
            F.col(f"`{f.name}`") if f.dataType == target[f.name]
            else _cast(f"`{f.name}`", f.dataType, target[f.name]).alias(f.name)
            for f in df.schema.fields
        ])
        for df in frames
    ]


def _cast(name: str, have: T.DataType, want: T.DataType):
    complex_types = (T.ArrayType, T.StructType, T.MapType)
    if isinstance(want, T.StringType) and isinstance(have, complex_types):
        return F.to_json(name)
    return F.col(name).cast(want)


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column missing from a frame is null there.

    Columns come in first-seen order.  No shuffle: this is a union of scans.
    """
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reconcile_types(frames))


def merge_sources(sources: dict[str, DataFrame], tag: str | None = "source") -> DataFrame:
    """Stack named sources, with the source name in column ``tag``."""
    frames = list(sources.values())
    if tag:
        frames = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return stack_by_name(frames)
