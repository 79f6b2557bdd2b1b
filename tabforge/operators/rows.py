"""Head samples, exact row positions and fixed-size chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.workspace import cut_lineage

_POSITION_BITS = 33


def sample_rows(df: DataFrame, n: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by key; any ``n`` rows without one."""
    if n < 0:
        raise ValueError("n must not be negative")
    return (df.orderBy(*_as_list(order_by)) if order_by else df).limit(n)


def with_row_index(df: DataFrame, order_by: str | Sequence[str] | None = None,
                   index: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row, in key order or in scan order.

    Rows are range-partitioned by key with a per-row tie-breaker, so a key that
    holds most rows is still split over many tasks.  The sorted rows are
    checkpointed, which fixes the partitions; then one count per partition
    gives each partition's offset.  No window runs over the whole table.
    """
    placed = _placed(df, _as_list(order_by))
    # One row per partition: bounded by the number of shuffle partitions.
    earlier = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(_PID).agg(F.count("*").alias("__count")).select(
        _PID, F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), _PID).select(*df.columns, (F.col("__offset") + F.col(_AT)).alias(index))


_PID, _AT = "__pid", "__at"


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in key order in fixed partitions, with the partition and the place in it."""
    if keys:
        tie = "__tie"
        df = df.withColumn(tie, F.monotonically_increasing_id())
        df = df.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    placed = cut_lineage(df).withColumn(_AT, F.monotonically_increasing_id())
    return placed.withColumn(_PID, F.shiftright(_AT, _POSITION_BITS).cast("int")).withColumn(
        _AT, F.col(_AT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))


def chunk_rows(df: DataFrame, chunk_size: int, order_by: str | Sequence[str] | None = None,
               chunk: str = "chunk_id") -> DataFrame:
    """Number the rows' chunks of ``chunk_size`` rows from 0."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    indexed = with_row_index(df, order_by, "__row")
    return indexed.withColumn(chunk, chunk_of(F.col("__row"), chunk_size)).drop("__row")


def chunk_of(row_index: Column, chunk_size: int) -> Column:
    return F.floor(row_index / chunk_size)


def rank_in_groups(df: DataFrame, by: Sequence[str], order_by: Sequence[str],
                   rank: str = "rank") -> DataFrame:
    """1-based position of each row inside its group, in key order.

    Rows are sorted by group and order over range partitions, so a group of any size is spread over tasks.  A
    group's rows before a partition are counted once for each partition it lies in; the join with these counts is by
    partition and group, so it is spread as the sort is.
    """
    placed = _placed(df, [*by, *order_by])
    parts = placed.groupBy(_PID, *by).agg(F.count("*").alias("__count"), F.min(_AT).alias("__first"))
    earlier = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__count").over(earlier), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (_PID, *by)]
    joined = placed.alias("a").join(parts.alias("b"), same)
    return joined.select(*[f"a.{c}" for c in df.columns],
                         (F.col("__before") + F.col(f"a.{_AT}") - F.col("__first") + 1).alias(rank))


def running_totals(df: DataFrame, by: Sequence[str], order_by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Add, for each ``column: name``, the sum of the column over the earlier rows of the group, in key order; 0 for the first.

    Rows are sorted over range partitions as for ranks.  A window adds up within one partition, the sums of
    a group's earlier partitions are its offset; there is one such row for each partition that the group lies in.
    """
    placed = _placed(df, [*by, *order_by])
    inside = Window.partitionBy(_PID, *by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(_PID, *by).agg(*[F.sum(c).alias(f"__{n}") for c, n in values.items()])
    parts = parts.select(_PID, *by, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in values.values()])
    summed = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{n}") for c, n in values.items()])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (_PID, *by)]
    return summed.alias("a").join(parts.alias("b"), same).select(
        *[f"a.{c}" for c in df.columns], *[(F.col(f"a.__in_{n}") + F.col(f"b.__{n}")).alias(n) for n in values.values()])


def _as_list(order_by) -> list[str]:
    if order_by is None:
        return []
    return [order_by] if isinstance(order_by, str) else list(order_by)
