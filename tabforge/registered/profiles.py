"""Profiling, validation, roles and feature columns over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import features as FE
from tabforge.operators import profile as P
from tabforge.operators.ranking import rank_algorithms
from tabforge.registered.base import query, r6, table


def profile_sql(source: str, columns: dict[str, str]) -> str:
    """SQL for a column profile; float columns count NaN as missing."""
    parts = []
    for name, kind in columns.items():
        gone = f"{name} IS NULL" + (f" OR isnan({name})" if kind == "float" else "")
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS logical_type, count(*) AS row_count, "
            f"count(*) FILTER (WHERE {gone}) AS nulls, "
            f"round(count(*) FILTER (WHERE {gone}) / count(*), 6) AS null_pct FROM ({source})")
    return " UNION ALL ".join(parts)


LINEITEM = {
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
    "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp",
}
DIRTY = {"event_id": "int", "ts": "timestamp", "user_id": "int", "event_type": "string",
         "value": "float", "props": "string"}
DIRTY_SQL = """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props FROM events
"""


def dirty_events(spark, sf_dir) -> DataFrame:
    """Events with null and NaN values at known places."""
    key = F.col("event_id")
    value = F.when(key % 7 == 0, None).when(key % 11 == 0, float("nan")).otherwise(F.col("value"))
    props = F.when(key % 3 != 0, F.col("props"))
    return table(spark, sf_dir, "events").withColumn("value", value).withColumn("props", props)


def _profile(df: DataFrame) -> DataFrame:
    return P.profile_columns(df).select(
        "column_name", "logical_type", "row_count", "nulls", r6("null_pct").alias("null_pct"))


@query("profile_table", profile_sql("SELECT * FROM lineitem", LINEITEM))
def profile_table(spark, sf_dir):
    return _profile(table(spark, sf_dir, "lineitem"))


@query("profile_missing_values", profile_sql(DIRTY_SQL, DIRTY))
def profile_missing_values(spark, sf_dir):
    return _profile(dirty_events(spark, sf_dir))


@query("table_profile", """
SELECT count(*) AS row_count, 4 AS column_count, count(*) - count(quality) AS quality_nulls,
       'text,tabular' AS data_types FROM documents LEFT JOIN labels USING (doc_id)
""")
def table_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    one = P.table_profile(rows, data_types=("text", "tabular"))
    return one.select("row_count", "column_count", F.col("nulls")["quality"].alias("quality_nulls"),
                      F.concat_ws(",", "data_types").alias("data_types"))


@query("high_null_columns",
       f"SELECT column_name, null_pct FROM ({profile_sql(DIRTY_SQL, DIRTY)}) WHERE null_pct > 0.1")
def high_null_columns(spark, sf_dir):
    found = P.high_null_columns(P.profile_columns(dirty_events(spark, sf_dir)))
    return found.select("column_name", r6("null_pct").alias("null_pct"))


@query("validate_schema", f"""
SELECT 'max_null_pct' AS rule, column_name, null_pct AS observed, CAST(0.2 AS DOUBLE) AS allowed
FROM ({profile_sql(DIRTY_SQL, DIRTY)}) WHERE null_pct > 0.2
UNION ALL SELECT 'missing_column', 'session_id', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
""")
def validate_schema(spark, sf_dir):
    broken = P.validate_schema(dirty_events(spark, sf_dir), ["event_id", "session_id"], 0.2)
    return broken.select("rule", "column_name", r6("observed").alias("observed"), "allowed")


@query("file_info", """
SELECT (SELECT count(*) FROM embeddings) AS row_count, c.column_name, c.logical_type, c.is_numeric,
       'label' AS detected_target
FROM (VALUES ('vec_id', 'int', true), ('embedding', 'array', false), ('label', 'int', true))
     AS c(column_name, logical_type, is_numeric)
""")
def file_info(spark, sf_dir):
    return P.file_info(table(spark, sf_dir, "embeddings"))


_LAST_COLUMNS = {"labels": "toxic", "orders": "o_orderpriority", "part": "p_retailprice",
                 "lineitem": "l_shipdate", "embeddings": "label", "nation": "n_regionkey",
                 "supplier": "s_acctbal", "customer": "c_mktsegment"}


_KEYS = {"labels": "doc_id", "orders": "o_orderkey", "part": "p_partkey", "lineitem": "l_orderkey",
         "embeddings": "vec_id", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey"}


def _target_sql(head: int | None = None) -> str:
    parts = []
    for name, last in _LAST_COLUMNS.items():
        source = f"SELECT {last} FROM {name}" + (f" ORDER BY {_KEYS[name]} LIMIT {head}" if head else "")
        text = last in ("o_orderpriority", "c_mktsegment")
        test = "count(*) > 0" if text or last == "label" else f"count(DISTINCT {last}) < 20"
        parts.append(f"SELECT '{name}' AS table_name, CASE WHEN {test} THEN '{last}' END AS detected_target "
                     f"FROM ({source})")
    return " UNION ALL ".join(parts)


def _targets(spark, sf_dir, **options) -> DataFrame:
    rows = [(name, P.detect_target(table(spark, sf_dir, name), order_by=_KEYS[name], **options))
            for name in _LAST_COLUMNS]
    return spark.createDataFrame(rows, "table_name string, detected_target string")


@query("detect_target", _target_sql())
def detect_target(spark, sf_dir):
    return _targets(spark, sf_dir)


@query("detect_target_head", _target_sql(1000))
def detect_target_head(spark, sf_dir):
    """The rule on a preview: the first 1000 rows decide."""
    return _targets(spark, sf_dir, sample_rows=1000)


_TASKS = {
    "lineitem": ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey", "l_discount"],
    "orders": ["o_orderpriority", "o_custkey", "o_totalprice"],
    "labels": ["quality", "toxic"],
    "embeddings": ["label"],
    "part": ["p_brand", "p_size"],
}
_TEXT_LABELS = ("l_returnflag", "l_linestatus", "o_orderpriority", "p_brand")
_FLOAT_LABELS = ("l_discount", "o_totalprice")


def _task_sql() -> str:
    parts = []
    for name, labels in _TASKS.items():
        for c in labels:
            if c in _FLOAT_LABELS:
                rule = "'regression'"
            elif c in _TEXT_LABELS:
                rule = "CASE WHEN n = 2 THEN 'binary_classification' ELSE 'multiclass' END"
            else:
                rule = ("CASE WHEN n = 2 THEN 'binary_classification' WHEN n <= 20 THEN 'multiclass' "
                        "ELSE 'regression' END")
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, n AS n_distinct, {rule} AS task "
                         f"FROM (SELECT count(DISTINCT {c}) AS n FROM {name})")
    return " UNION ALL ".join(parts)


@query("detect_task_type", _task_sql())
def detect_task_type(spark, sf_dir):
    parts = [P.task_types(table(spark, sf_dir, name), labels).select(
        F.lit(name).alias("table_name"), "column_name", "n_distinct", "task")
        for name, labels in _TASKS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("detect_task_type_uncapped", """
SELECT 'lineitem' AS table_name, 'l_suppkey' AS column_name, CASE WHEN count(DISTINCT l_suppkey) = 2
       THEN 'binary_classification' ELSE 'multiclass' END AS task FROM lineitem
UNION ALL SELECT 'labels', 'toxic', CASE WHEN count(DISTINCT toxic) = 2
       THEN 'binary_classification' ELSE 'multiclass' END FROM labels
UNION ALL SELECT 'lineitem', 'l_tax', CASE WHEN count(*) > 0 THEN 'regression' END FROM lineitem
""")
def detect_task_type_uncapped(spark, sf_dir):
    """Integers are classes whatever their number."""
    rows = [(t, c, P.detect_task_type(table(spark, sf_dir, t), c, max_classes=None))
            for t, c in (("lineitem", "l_suppkey"), ("labels", "toxic"), ("lineitem", "l_tax"))]
    return spark.createDataFrame(rows, "table_name string, column_name string, task string")


_TEXT_COLUMNS = {
    "documents": ("doc_id", ["text", "lang", "source"]),
    "conversations": ("conv_id", ["role", "text"]),
    "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]),
    "pages": ("page_id", ["url", "html"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type"]),
}


def _text_sql() -> str:
    parts = []
    for name, (key, columns) in _TEXT_COLUMNS.items():
        tests = " ".join(
            f"WHEN (SELECT avg(n) FROM (SELECT length({c}) AS n FROM {name} WHERE {c} IS NOT NULL "
            f"ORDER BY {key}, length({c}) LIMIT 5)) > 20 THEN '{c}'" for c in columns)
        parts.append(f"SELECT '{name}' AS table_name, CASE {tests} ELSE '{columns[0]}' END AS text_column")
    return " UNION ALL ".join(parts)


@query("find_text_column", _text_sql())
def find_text_column(spark, sf_dir):
    rows = [(name, P.find_text_column(table(spark, sf_dir, name), key))
            for name, (key, _) in _TEXT_COLUMNS.items()]
    return spark.createDataFrame(rows, "table_name string, text_column string")


@query("encode_labels", """
SELECT p_brand AS label, dense_rank() OVER (ORDER BY p_brand) - 1 AS label_id, count(*) AS n
FROM part GROUP BY p_brand
""")
def encode_labels(spark, sf_dir):
    coded = FE.encode_labels(table(spark, sf_dir, "part"), "p_brand")
    return coded.groupBy(F.col("p_brand").alias("label"), "label_id").agg(F.count(F.lit(1)).alias("n"))


@query("encode_labels_missing", """
WITH t AS (SELECT CASE WHEN l_quantity = 1 THEN 'NaN'::DOUBLE WHEN l_quantity = 2 THEN NULL ELSE l_quantity END AS y FROM lineitem),
     ids AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS label_id FROM (SELECT DISTINCT y FROM t WHERE y IS NOT NULL))
SELECT CAST(t.y AS INTEGER) AS label, isnan(t.y) AS is_nan, ids.label_id, count(*) AS n
FROM (SELECT * FROM t) t LEFT JOIN ids ON t.y = ids.y GROUP BY ALL
""".replace("CAST(t.y AS INTEGER)", "CASE WHEN NOT isnan(t.y) THEN CAST(t.y AS INTEGER) END"))
def encode_labels_missing(spark, sf_dir):
    """NaN is a label and comes last; null is none."""
    q = F.col("l_quantity").cast("double")
    y = F.when(q == 1, F.lit(float("nan"))).when(q != 2, q)
    coded = FE.encode_labels(table(spark, sf_dir, "lineitem").select(y.alias("y")), "y")
    nan = F.when(F.col("y").isNotNull(), F.isnan("y")).alias("is_nan")
    label = F.when(~F.isnan("y"), F.col("y").cast("int")).alias("label")
    return coded.groupBy(label, nan, "label_id").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in LINEITEM))
def distinct_counts(spark, sf_dir):
    return P.distinct_counts(table(spark, sf_dir, "lineitem"))


@query("split_features_target", "SELECT * FROM lineitem")
def split_features_target(spark, sf_dir):
    return FE.features_then_target(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("align_features", "SELECT l_orderkey, l_linenumber, l_tax, l_quantity, l_discount FROM lineitem")
def align_features(spark, sf_dir):
    return FE.align_features(table(spark, sf_dir, "lineitem"), ["l_tax", "l_quantity", "l_discount"],
                             keep=["l_orderkey", "l_linenumber"])


@query("select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_numeric(spark, sf_dir):
    return FE.select_numeric(table(spark, sf_dir, "part"), keep=["p_partkey"])


@query("scoring_vector", """
SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(coalesce(quality, 0) AS DOUBLE) AS quality,
       CAST(0 AS DOUBLE) AS readability
FROM documents LEFT JOIN labels USING (doc_id)
""")
def scoring_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    return FE.scoring_vector(rows, ["n_chars", "quality", "toxic", "readability"], keep=["doc_id"],
                             target="toxic")


_MODALITIES = {"lineitem": ["tabular"], "documents": ["text", "tabular"], "pages": ["text"],
               "nation": ["tabular"], "embeddings": ["image", "tabular"], "region": ["tabular"]}


def _ranking_sql() -> str:
    profiles = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, {tags} AS tags FROM {t}" for t, tags in _MODALITIES.items())
    scores = " UNION ALL ".join(
        f"SELECT table_name, '{a}' AS algorithm, CAST(CASE WHEN list_contains(tags, '{tag}') THEN {s} ELSE 0 END "
        "AS DOUBLE) AS score FROM p" for a, tag, s in (
            ("random_forest", "tabular", "CASE WHEN rows < 10 THEN 0.3 ELSE 0.85 END"),
            ("xgboost", "tabular", "0.9"),
            ("lightgbm", "tabular", "CASE WHEN rows > 5000 THEN 0.88 ELSE 0.8 END"),
            ("lstm_tabular", "tabular", "CASE WHEN rows >= 50 THEN 0.7 ELSE 0.3 END"),
            ("cnn_image", "image", "0.9"), ("lora_text", "text", "0.9")))
    return (f"WITH p AS ({profiles}) SELECT table_name, algorithm, score, row_number() OVER "
            f"(PARTITION BY table_name ORDER BY score DESC, algorithm) AS rank FROM ({scores})")


@query("rank_algorithms", _ranking_sql())
def rank(spark, sf_dir):
    profiles = [
        table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), "row_count", F.array(*[F.lit(x) for x in tags]).alias("data_types"))
        for t, tags in _MODALITIES.items()]
    return rank_algorithms(reduce(DataFrame.unionByName, profiles), by=("table_name",))
