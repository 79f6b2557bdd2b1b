"""The given tables as streams: results equal the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.messages import explode_messages, parse_messages
from tabforge.functions.workspace import scratch_path
from tabforge.plans import models as MO
from tabforge.registered.base import query, r6, table
from tabforge.registered.messages import EXPLODED, PARSED, event_messages
from tabforge.registered.models import KEY, line_model
from tabforge.registered.profiles import LINEITEM, profile_sql
from tabforge.streaming import batches as B


def stream(spark, sf_dir, name: str) -> DataFrame:
    """A table's file as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(spark, frame: DataFrame) -> DataFrame:
    root = scratch_path(spark, "stream")
    return B.drain(frame, f"{root}/rows", f"{root}/checkpoint")


@query("stream_parse_messages", PARSED)
def stream_parse_messages(spark, sf_dir):
    messages = event_messages(stream(spark, sf_dir, "events"))
    return drained(spark, parse_messages(messages, "message", {"k": "bigint"}))


@query("stream_explode_messages", EXPLODED)
def stream_explode_messages(spark, sf_dir):
    messages = event_messages(stream(spark, sf_dir, "events"))
    return drained(spark, explode_messages(messages, "message", {"k": "bigint"}))


@query("stream_profile", profile_sql("SELECT * FROM lineitem", LINEITEM))
def stream_profile(spark, sf_dir):
    root = scratch_path(spark, "stream")
    profile = B.stream_profile(stream(spark, sf_dir, "lineitem"), f"{root}/totals", f"{root}/checkpoint")
    return profile.select("column_name", "logical_type", "row_count", "nulls", r6("null_pct").alias("null_pct"))


@query("stream_score")
def stream_score(spark, sf_dir):
    """Every line item scored as it arrives, with the model of the batch query."""
    model, _, _ = line_model(spark, sf_dir)
    scored = MO.predict_with_confidence(model, stream(spark, sf_dir, "lineitem"), keep=KEY)
    return drained(spark, scored).select(*KEY, "prediction", F.round("confidence", 6).alias("confidence"))


def polls(spark, sf_dir) -> DataFrame:
    """``events`` as a source that is polled: eight files, which hold every event twice, read a file a batch."""
    folder = scratch_path(spark, "polls")
    events = table(spark, sf_dir, "events")
    for _ in range(2):
        events.repartition(4, "event_id").write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_drop_repeated", "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events")
def stream_drop_repeated(spark, sf_dir):
    # The files are no later than each other than the table is long.
    return drained(spark, B.drop_repeated(polls(spark, sf_dir), ["event_id"], "ts", "3650 days"))


@query("stream_numbered_batches", """
    SELECT event_id, event_type, 2 AS times, 2 AS batches, true AS numbered FROM events
""")
def stream_numbered_batches(spark, sf_dir):
    """Each row of the polled source comes in two batches of eight, which are numbered from 0."""
    root = scratch_path(spark, "stream")
    rows = B.write_batches(polls(spark, sf_dir).select("event_id", "event_type"), f"{root}/rows", f"{root}/checkpoint")
    return rows.groupBy("event_id", "event_type").agg(
        F.count("*").alias("times"), F.count_distinct("sequence").alias("batches"), (F.max("sequence") < 8).alias("numbered"))
