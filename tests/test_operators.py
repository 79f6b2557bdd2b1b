import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tabforge.functions import text as X
from tabforge.functions.types import common_type, logical_type
from tabforge.operators import combine, features, metrics, profile, ranking, runs
from tabforge.operators.rows import chunk_rows, rank_in_groups, sample_rows, with_row_index


def metric_map(df):
    return {r.metric: r.value for r in df.collect()}


# --- types, text, stacking ---

@pytest.mark.parametrize("a, b, want", [
    (T.IntegerType(), T.LongType(), T.LongType()), (T.LongType(), T.DoubleType(), T.DoubleType()),
    (T.IntegerType(), T.StringType(), T.StringType()), (T.DateType(), T.TimestampType(), T.TimestampType()),
    (T.DecimalType(5, 2), T.IntegerType(), T.DecimalType(12, 2)), (T.BooleanType(), T.LongType(), T.StringType()),
    (T.DecimalType(38, 0), T.DecimalType(38, 10), T.DoubleType()), (T.NullType(), T.DateType(), T.DateType()),
])
def test_common_type(a, b, want):
    assert common_type(a, b) == want == common_type(b, a)


def test_logical_types():
    got = [logical_type(t) for t in (T.ByteType(), T.FloatType(), T.DecimalType(3, 1), T.TimestampNTZType(),
                                     T.ArrayType(T.LongType()), T.BinaryType())]
    assert got == ["int", "float", "decimal", "timestamp", "array", "binary"]


def test_stacking_keeps_order_and_nulls(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, [1])], "k double, arr array<int>")
    c = spark.createDataFrame([("q", 3)], "arr string, extra int")
    df = combine.merge_sources({"a": a, "b": b, "c": c})
    assert df.columns == ["k", "s", "source", "arr", "extra"]
    assert rows(df) == sorted([(1.0, "x", "a", None, None), (2.5, None, "b", "[1]", None),
                               (None, None, "c", "q", 3)], key=repr)


def test_path_helpers(spark):
    df = spark.createDataFrame([("a/b/c.TXT",), ("c.tar.gz",), (".hidden",), ("dir.d/plain",)], "p string")
    got = df.select(X.file_name(F.col("p")), X.parent_name(F.col("p")), X.suffix(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c.TXT", "b", ".txt"), ("c.tar.gz", "", ".gz"), (".hidden", "", ""),
                                       ("plain", "dir.d", "")]


# --- profile, validation, roles ---

@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1.0, "x", 0), (float("nan"), None, 1), (None, "z", 0)], "a double, b string, label int")


def test_profile_counts_null_and_nan(gaps):
    got = {r.column_name: (r.logical_type, r.row_count, r.nulls) for r in profile.profile_columns(gaps).collect()}
    assert got == {"a": ("float", 3, 2), "b": ("string", 3, 1), "label": ("int", 3, 0)}
    one = profile.table_profile(gaps, target="label").first()
    assert (one.row_count, one.column_count, one.nulls["a"], one.target_col) == (3, 3, 2, "label")


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    assert rows(profile.profile_columns(df)) == [(0, "a", "int", 0, 0, 0.0)]
    assert profile.high_null_columns(profile.profile_columns(df)).count() == 0


def test_null_bounds_are_strict(spark):
    df = spark.range(10).select(F.when(F.col("id") > 0, F.col("id")).alias("tenth"),
                                F.when(F.col("id") > 1, F.col("id")).alias("fifth"))
    assert rows(profile.high_null_columns(profile.profile_columns(df))) == [("fifth", 0.2)]
    assert profile.validate_schema(df, max_null_pct=0.2).count() == 0


def test_validation(gaps):
    found = profile.validate_schema(gaps, ["a", "zz"], 0.5)
    assert {(r.rule, r.column_name) for r in found.collect()} == {("missing_column", "zz"), ("max_null_pct", "a")}
    assert profile.validate_schema(gaps, ["a"]).count() == 0
    with pytest.raises(profile.ValidationError, match="zz"):
        profile.validate_schema(gaps, ["zz"], fail=True)


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 22, 40, 500])
def test_bounded_distinct_is_exact(spark, n):
    df = spark.range(n * 7).select((F.col("id") % n * 7919).alias("v"))
    assert profile.bounded_distinct(df, "v", 20) == min(n, 21)
    assert profile.bounded_distinct(df, "v", 2) == min(n, 3)


@pytest.mark.parametrize("values, kind, want", [
    ([0, 1, 0, 1, 0], "int", "binary_classification"), ([0, 1, 2, 0, 1, 2], "int", "multiclass"),
    ([1.5, 2.7, 3.1, 100.0, 0.5], "double", "regression"), (["a", "b"], "string", "binary_classification"),
    (["a"], "string", "multiclass"), (list(range(21)), "bigint", "regression"), ([7], "int", "multiclass"),
    ([True, False], "boolean", "binary_classification"), ([0, 1, None], "int", "binary_classification"),
])
def test_task_type(spark, values, kind, want):
    df = spark.createDataFrame([(v,) for v in values], f"y {kind}")
    assert profile.detect_task_type(df, "y") == want


def test_task_type_without_cap(spark):
    assert profile.detect_task_type(spark.range(50), "id", max_classes=None) == "multiclass"


def test_target_detection(spark):
    iris = spark.createDataFrame([(5.1, 3.5, "setosa")], "sepal_length double, sepal_width double, species string")
    assert profile.detect_target(iris) == "species"
    assert profile.detect_target(spark.createDataFrame([(1, 2)], "Y int, z int")) == "Y"
    assert profile.detect_target(spark.range(100)) is None
    assert profile.detect_target(spark.range(100), sample_rows=10, order_by="id") == "id"
    assert profile.detect_target(spark.createDataFrame([(1, "q")], "k int, note string")) == "note"


def test_text_column(spark):
    df = spark.createDataFrame([(i, "pos", "a long review text of the product") for i in range(8)],
                               "id int, sentiment string, review string")
    assert profile.find_text_column(df, "id") == "review"
    assert profile.find_text_column(df.drop("review"), "id") == "sentiment"
    assert profile.find_text_column(df.select("id")) is None


# --- row positions ---

@pytest.mark.parametrize("parts", [1, 4, 32])
def test_row_index_does_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(parts)
    got = with_row_index(df, "k").collect()
    assert len(got) == 1000 and all(r.k == r.row_index for r in got)


def test_row_index_with_one_hot_key(spark):
    df = spark.range(999).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    got = sorted((r.row_index, r.k) for r in with_row_index(df, "k").collect())
    assert [i for i, _ in got] == list(range(999))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_row_index_of_identical_rows_is_spread(spark):
    df = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_row_index(df, "k").withColumn("p", F.spark_partition_id())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.row_index for r in got.collect()) == list(range(4000))
    assert got.select("p").distinct().count() > 1


def test_row_index_in_scan_order(spark):
    got = with_row_index(spark.range(0, 100, 1, 7)).collect()
    assert all(r.id == r.row_index for r in got)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 60), size=st.integers(1, 20))
def test_chunks_have_the_right_sizes(spark, n, size):
    got = chunk_rows(spark.range(n), size, "id").groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(math.ceil(n / size)))
    assert all(r["count"] == size for r in got[:-1])


def test_sample(spark):
    assert rows(sample_rows(spark.range(100).repartition(5), 3, "id")) == [(0,), (1,), (2,)]
    assert sample_rows(spark.range(5), 99).count() == 5
    with pytest.raises(ValueError):
        chunk_rows(spark.range(5), 0)


def test_rank_in_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("a", 2), (None, 4), (None, 1)], "g string, v int")
    assert rows(rank_in_groups(df, ["g"], ["v"])) == sorted(
        [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 9, 1), (None, 1, 1), (None, 4, 2)], key=repr)


# --- feature columns ---

def test_split_and_align(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    x, y = features.split_features_target(df)
    assert (x.columns, y.columns) == (["a", "b"], ["y"])
    assert features.split_features_target(df, "a")[1].columns == ["a"]
    assert features.split_features_target(df, "nope")[1].columns == ["y"]
    assert features.align_features(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="zz"):
        features.align_features(df, ["a", "zz"])


def test_scoring_vector(spark):
    df = spark.createDataFrame([(None, 2)], "f1 int, f2 int")
    assert rows(features.scoring_vector(df, ["f1", "f2", "f3", "t"], target="t")) == [(0.0, 2.0, 0.0)]


def test_label_codes_follow_sort_order(spark):
    df = spark.createDataFrame([(10,), (2,), (10,), (None,), (-1,), (7,)], "y int")
    got = {(r.y, r.label_id) for r in features.encode_labels(df, "y").collect()}
    assert got == {(-1, 0), (2, 1), (7, 2), (10, 3), (None, None)}


# --- metrics ---

def test_binary_metrics_by_hand(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 1], [0, 1, 0, 0, 1])), "y int, p int")
    assert metric_map(metrics.evaluate(df, "y", "p")) == pytest.approx({"accuracy": 0.8, "f1": 0.8})


def test_f1_is_zero_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    assert metric_map(metrics.binary_metrics(df, "y", "p")) == {"accuracy": 1.0, "f1": 0.0}


def test_positive_label(spark):
    assert metrics.positive_label(spark.createDataFrame([("a",), ("b",)], "y string"), "y") == "b"
    assert metrics.positive_label(spark.createDataFrame([(1,), (2,)], "y int"), "y") == 1
    assert metrics.positive_label(spark.createDataFrame([(3,), (2,)], "y int"), "y") == 3


def test_weighted_f1_counts_classes_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b"), ("b", None), (None, "a")], "y string, p string")
    got = metric_map(metrics.evaluate(df, "y", "p", "multiclass"))
    assert got == pytest.approx({"accuracy": 0.5, "f1": 2 / 3})


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 2.9)], "y double, p double")
    assert metric_map(metrics.evaluate(df, "y", "p")) == pytest.approx({"rmse": 0.1, "mae": 0.1})


def test_metrics_by_group(spark):
    df = spark.createDataFrame([("r1", 1, 1), ("r1", 0, 0), ("r2", 1, 0), ("r2", 1, 1)], "r string, y int, p int")
    got = {(r.r, r.metric): r.value for r in metrics.binary_metrics(df, "y", "p", by=["r"]).collect()}
    assert got == pytest.approx({("r1", "accuracy"): 1, ("r1", "f1"): 1, ("r2", "accuracy"): 0.5, ("r2", "f1"): 2 / 3})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=40))
def test_weighted_f1_against_plain_python(spark, pairs):
    want = 0.0
    for c in "abcd":
        tp = sum(y == p == c for y, p in pairs)
        sup, called = sum(y == c for y, _ in pairs), sum(p == c for _, p in pairs)
        if sup + called:
            want += 2 * tp / (sup + called) * sup / len(pairs)
    got = metric_map(metrics.multiclass_metrics(spark.createDataFrame(pairs, "y string, p string"), "y", "p"))
    assert got["f1"] == pytest.approx(want)


# --- ranking, runs ---

@pytest.mark.parametrize("n, tags, top", [
    (5, ["tabular"], {"xgboost": 0.9, "lightgbm": 0.8, "random_forest": 0.3, "lstm_tabular": 0.3}),
    (5001, ["tabular"], {"xgboost": 0.9, "lightgbm": 0.88, "random_forest": 0.85, "lstm_tabular": 0.7}),
    (50, ["text"], {"lora_text": 0.9, "xgboost": 0.0}), (50, ["image"], {"cnn_image": 0.9, "lora_text": 0.0}),
])
def test_suitability(spark, n, tags, top):
    got = ranking.rank_algorithms(spark.createDataFrame([(n, tags)], "row_count bigint, data_types array<string>"))
    scores = {r.algorithm: r.score for r in got.collect()}
    assert {k: scores[k] for k in top} == top
    assert [r.score for r in got.orderBy("rank").collect()] == sorted(scores.values(), reverse=True)


def _metrics(spark, *pairs):
    return spark.createDataFrame(list(pairs), "metric string, value double")


def test_compare_runs_keeps_zero_and_missing(spark):
    a = _metrics(spark, ("f1", 0.82), ("accuracy", 0.0), ("mae", 2.0))
    b = _metrics(spark, ("f1", 0.89), ("accuracy", 0.91), ("rmse", 1.0))
    got = {r.metric: r for r in runs.compare_runs(a, b).collect()}
    assert got["f1"].delta == pytest.approx(0.07)
    assert got["accuracy"].value_a == 0.0 and got["accuracy"].delta == pytest.approx(0.91)
    assert got["mae"].value_b is None and got["mae"].delta is None
    assert (got["rmse"].higher_is_better, got["f1"].higher_is_better) == (False, True)


def test_leaderboard_and_best_model(spark):
    m = spark.createDataFrame([
        ("r1", "a", "f1", 0.5), ("r1", "b", "f1", 0.9), ("r1", "c", "f1", 0.9), ("r1", "a", "rmse", 1.0),
        ("r1", "b", "rmse", 2.0), ("r1", "d", "f1", None)], "run_name string, plugin_name string, metric string, value double")
    got = {(r.metric, r.plugin_name): r["rank"] for r in runs.leaderboard(m).collect()}
    assert got == {("f1", "b"): 1, ("f1", "c"): 2, ("f1", "a"): 3, ("f1", "d"): 4, ("rmse", "a"): 1, ("rmse", "b"): 2}
    assert rows(runs.best_model(m, "f1")) == [("r1", "b", "f1", 0.9)]
    assert rows(runs.best_model(m, "rmse")) == [("r1", "a", "rmse", 1.0)]


def test_insights(spark):
    importance = spark.createDataFrame([("petal_length", 0.85), ("sepal_width", 0.15)], "feature string, score double")
    clean = spark.createDataFrame([("petal_length", 150, 0.0)], "column_name string, row_count bigint, null_pct double")
    got = runs.insights(_metrics(spark, ("accuracy", 0.94)), importance, clean)
    assert rows(got) == [("dominant_feature", "petal_length", 0.85)]
    dirty = clean.withColumn("null_pct", F.lit(0.2))
    got = runs.insights(_metrics(spark, ("accuracy", 0.69)), importance.where("score < 0.5"), dirty)
    assert {r.rule for r in got.collect()} == {"low_accuracy", "high_null_rate"}


def test_relative_importance_truncates(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 0.0)], "feature string, score double")
    assert {r.feature: r.relative_pct for r in runs.relative_importance(df).collect()} == {"a": 100, "b": 66, "c": 0}
    assert rows(runs.top_feature(df)) == [("a", 3.0)]


def test_run_log_views(spark):
    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(4)]
    log = spark.createDataFrame([("r1", "load", "running", t[0]), ("r1", "load", "succeeded", t[1]),
                                 ("r1", "train", "failed", t[2])], "run_name string, node_id string, state string, ts timestamp")
    assert rows(runs.node_states(log, ["load", "train", "export"])) == [
        ("r1", "export", "pending"), ("r1", "load", "succeeded"), ("r1", "train", "failed")]
    assert rows(runs.run_progress(runs.node_states(log))) == [("r1", 1, 2)]


def test_model_catalog_from_paths(spark):
    df = spark.createDataFrame([
        ("/p/runs/run_001/artifacts/rf_model/metadata/part-0", '{"task":"multiclass","features":["a","b"]}'),
        ("/p/runs/run_002/artifacts/other_model/metadata/part-0", "{}"),
        ("/p/runs/run_002/artifacts/merged.parquet", "{}")], "path string, metadata string")
    got = [tuple(r)[:5] for r in runs.model_catalog(df).orderBy("run_name").collect()]
    assert got == [("run_001", "train_random_forest", "random_forest", "multiclass", 2),
                   ("run_002", "train_other", "other", "unknown", 0)]


def test_binary_metrics_choose_the_positive_text(spark):
    df = spark.createDataFrame([("no", "no"), ("yes", "yes"), ("yes", "no")], "y string, p string")
    got = {r.metric: r.value for r in metrics.binary_metrics(df, "y", "p").collect()}
    assert got["f1"] == pytest.approx(2 / 3)
