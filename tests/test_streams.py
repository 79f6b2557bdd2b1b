from conftest import rows
from pyspark.sql import functions as F

from tabforge.functions.messages import parse_messages
from tabforge.functions.workspace import scratch_path
from tabforge.operators.profile import profile_columns
from tabforge.plans import models as MO
from tabforge.plans import training as TR
from tabforge.streaming import batches as B


def _stream(spark, df, parts=4):
    path = scratch_path(spark, "input")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def test_decoding_equals_batch(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 == 0, "oops").when(F.col("id") % 4 == 1, "[1]").otherwise(
        F.format_string('{"x": %d}', "id")).alias("m"))
    stream, _ = _stream(spark, df)
    root = scratch_path(spark, "out")
    got = B.drain(parse_messages(stream, "m", {"x": "int"}), f"{root}/rows", f"{root}/cp")
    assert rows(got) == rows(parse_messages(df, "m", {"x": "int"}))


def test_drain_continues_where_it_stopped(spark):
    stream, path = _stream(spark, spark.range(10), 2)
    root = scratch_path(spark, "out")
    assert B.drain(stream, f"{root}/rows", f"{root}/cp").count() == 10
    spark.range(10, 15).write.mode("append").parquet(path)
    assert rows(B.drain(stream, f"{root}/rows", f"{root}/cp")) == sorted(((i,) for i in range(15)), key=repr)


def test_batches_are_numbered_from_zero(spark):
    stream, _ = _stream(spark, spark.range(8), 4)
    seen = []
    B.for_each_batch(stream, lambda df, i: seen.append((i, df.count())), scratch_path(spark, "cp")).awaitTermination()
    assert [i for i, _ in seen] == list(range(len(seen))) and len(seen) == 4
    assert sum(n for _, n in seen) == 8


def test_profile_equals_batch(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("v"))
    stream, _ = _stream(spark, df)
    root = scratch_path(spark, "out")
    got = B.stream_profile(stream, f"{root}/totals", f"{root}/cp")
    assert rows(got.select("column_name", "row_count", "nulls")) == rows(
        profile_columns(df).select("column_name", "row_count", "nulls"))


def test_scoring_equals_batch(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("a"), F.array(F.rand(1), F.rand(2)).alias("v"))
    df = df.withColumn("y", F.when(F.col("a") > 4, "hi").otherwise("lo")).checkpoint()
    for model in (TR.train_random_forest(df, "y", features=["a", "v"], n_estimators=3, max_depth=3),
                  TR.train_boosted(df, "y", features=["a", "v"], n_estimators=2, max_depth=2)):
        stream, _ = _stream(spark, df)
        root = scratch_path(spark, "out")
        scored = MO.predict_with_confidence(model, stream, keep=["id"])
        got = B.drain(scored, f"{root}/rows", f"{root}/cp")
        assert rows(got) == rows(MO.predict_with_confidence(model, df, keep=["id"]))
