"""Structured Streaming versions of decoding, profiling and scoring.

Decoding and scoring are the batch functions: they are column expressions and
Spark ML transforms, so the same code runs on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tabforge.functions.types import logical_type
from tabforge.operators.profile import present


def drain(stream: DataFrame, sink: str, checkpoint: str, *, name: str | None = None) -> DataFrame:
    """Process everything that is available now into Parquet, exactly once.

    Running it again with the same checkpoint continues after the last batch.
    """
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    query = writer.trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def drop_repeated(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key, of those that come again within ``delay`` of its event time.

    The state holds one entry for each key until the watermark, the latest event time less ``delay``, has passed it by
    ``delay``; so it is bounded by the keys of that span, not by the stream.  Rows older than the watermark are dropped: a key
    that is polled again long after never comes twice, and neither does a row that is later than ``delay``.
    """
    at = "__event_time"  # watermarks need times with a zone; only differences count
    timed = stream.withColumn(at, F.col(event_time).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop(at)


def write_batches(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """All available rows with the number of their micro-batch, one folder for each.

    A batch that is replayed after a failure replaces its folder, so its rows are there once whatever
    had been written of them before.
    """
    def handle(batch: DataFrame, sequence: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/sequence={sequence}")

    for_each_batch(stream, handle, checkpoint).awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("sequence", LongType())])
    return stream.sparkSession.read.schema(schema).parquet(sink)


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None],
                   checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Call ``handle(batch, sequence)`` per micro-batch; sequences start at 0.

    Without an interval the query ends when all available input is processed.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def profile_totals(df: DataFrame) -> DataFrame:
    """Mergeable counts of one batch: rows, and present values per column."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *[
        F.count(present(f.name, f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(logical_type(f.dataType)).alias("logical_type"), F.col("row_count"),
                 (F.col("row_count") - F.col(f"n{i}")).alias("nulls"))
        for i, f in enumerate(fields)])))


def stream_profile(stream: DataFrame, totals_path: str, checkpoint: str) -> DataFrame:
    """Profile of everything streamed so far.

    Each micro-batch writes its counts to a folder of its own number, so a
    replayed batch replaces its counts instead of adding them twice.
    """
    def handle(batch: DataFrame, sequence: int) -> None:
        profile_totals(batch).write.mode("overwrite").parquet(f"{totals_path}/batch={sequence}")

    for_each_batch(stream, handle, checkpoint).awaitTermination()
    return merge_profiles(stream.sparkSession.read.parquet(totals_path))


def merge_profiles(totals: DataFrame) -> DataFrame:
    """Add up the counts of several batches."""
    merged = totals.groupBy("position", "column_name", "logical_type").agg(
        F.sum("row_count").alias("row_count"), F.sum("nulls").alias("nulls"))
    share = F.when(F.col("row_count") > 0, F.col("nulls") / F.col("row_count")).otherwise(0.0)
    return merged.withColumn("null_pct", share)
