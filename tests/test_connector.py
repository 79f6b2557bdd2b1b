"""A saved feature set as a data source."""

import pytest
from pyspark.sql import functions as F

from tabforge.plans.feature_sets import FeatureSets
from tabforge.sources.connector import data_files, planned, register
from tabforge.streaming.batches import drain


@pytest.fixture
def saved(spark, tmp_path):
    register(spark)
    sets = FeatureSets(spark, f"file://{tmp_path}/sets")
    df = spark.range(1000).selectExpr(
        "id", "cast(id % 7 as int) k", "if(id % 5 = 0, null, concat('t', id)) t", "array(id, null) a", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) ts",
        "cast(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as timestamp) at", "id / 3 d").repartition(3)
    sets.save(df, "some")
    return sets.info("some").first().data_path, df


def bag(df):
    return sorted(map(repr, df.collect()))


def test_the_source_equals_the_table(spark, saved):
    path, df = saved
    got = spark.read.format("feature_set").load(path)
    assert [f.simpleString() for f in got.schema] == [f.simpleString() for f in df.schema] and bag(got) == bag(df)
    assert got.rdd.getNumPartitions() == len(planned(path, [f for _, f in data_files(path)], 64 << 20)) == 3


def test_columns_are_pruned_and_missing_ones_are_null(spark, saved):
    path, df = saved
    got = spark.read.format("feature_set").schema("t string, later int, id long").load(path)
    assert bag(got) == bag(df.select("t", F.lit(None).cast("int").alias("later"), "id"))


def test_filters_reach_the_scan(spark, saved):
    path, df = saved
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "true")
        for where in ("k = 3", "k > 3 and id <= 500", "t = 't11'", "t is not null and k < 2", "t is null", "k in (1, 2)", "d >= 12.5"):
            assert bag(spark.read.format("feature_set").option("filters", True).load(path).where(where)) == bag(df.where(where)), where
    finally:
        spark.conf.set(key, before)


def test_row_groups_are_dealt(spark, tmp_path):
    register(spark)
    path = f"file://{tmp_path}/groups"
    spark.range(20000).coalesce(1).write.option("parquet.block.size", 1 << 14).option("parquet.page.size", 1 << 12).parquet(path)
    parts = planned(path, [f for _, f in data_files(path)], 1)
    got = spark.read.format("feature_set").option("partitionBytes", 1).load(path)
    assert got.rdd.getNumPartitions() == len(parts) and got.agg(F.sum("id")).first()[0] == sum(range(20000))


def test_a_stream_keeps_its_offset(spark, tmp_path):
    register(spark)
    folder, sink, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    add = lambda a, b: spark.range(a, b).repartition(2).write.mode("append").parquet(folder)
    run = lambda: sorted(r.id for r in drain(spark.readStream.format("feature_set").load(folder), sink, checkpoint).collect())
    add(0, 50)
    assert run() == list(range(50))
    assert run() == list(range(50))
    add(50, 80)
    assert run() == list(range(80))


def test_no_path_and_no_files(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="path"):
        spark.read.format("feature_set").load()
    with pytest.raises(Exception):
        spark.read.format("feature_set").load(f"file://{tmp_path}/none")
