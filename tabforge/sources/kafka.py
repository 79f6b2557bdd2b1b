"""Kafka topics, bounded or streaming.  Decoding is ``functions.messages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_options(topic: str, bootstrap_servers: str = "localhost:9092", *,
                  auto_offset_reset: str = "earliest", batch_size: int | None = None,
                  group_id: str | None = None) -> dict[str, str]:
    out = {
        "kafka.bootstrap.servers": bootstrap_servers,
        "subscribe": topic,
        "startingOffsets": auto_offset_reset,
    }
    if batch_size:
        out["maxOffsetsPerTrigger"] = str(batch_size)
    if group_id:
        out["kafka.group.id"] = group_id
    return out


def read_kafka(spark: SparkSession, topic: str, bootstrap_servers: str = "localhost:9092", *,
               max_messages: int | None = None, auto_offset_reset: str = "earliest",
               group_id: str | None = None) -> DataFrame:
    """Messages present now, all of them unless ``max_messages`` is given."""
    opts = kafka_options(topic, bootstrap_servers, auto_offset_reset=auto_offset_reset,
                         group_id=group_id)
    df = spark.read.format("kafka").options(**opts, endingOffsets="latest").load()
    return df.limit(max_messages) if max_messages else df


def stream_kafka(spark: SparkSession, topic: str, bootstrap_servers: str = "localhost:9092", *,
                 batch_size: int | None = None, auto_offset_reset: str = "earliest",
                 group_id: str | None = None) -> DataFrame:
    """Streaming messages; offsets live in the query's checkpoint."""
    opts = kafka_options(topic, bootstrap_servers, auto_offset_reset=auto_offset_reset,
                         batch_size=batch_size, group_id=group_id)
    return spark.readStream.format("kafka").options(**opts).load()
