"""Metrics, run analysis and insights; predictions come from simple rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.workspace import scratch_path
from tabforge.operators import metrics as M
from tabforge.operators import profile as P
from tabforge.operators import runs as R
from tabforge.plans.models import write_report
from tabforge.registered.base import query, r6, table
from tabforge.registered.profiles import DIRTY, DIRTY_SQL, dirty_events, profile_sql

# --- predictions by rule ---------------------------------------------------------

_QUALITY = """SELECT quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p
              FROM documents JOIN labels USING (doc_id)"""


def quality_rule(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(F.col("quality").alias("y"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("p"))


_FLAGS = """SELECT l_suppkey, l_returnflag AS y,
  CASE WHEN l_shipdate < TIMESTAMP '1997-06-01' THEN 'A' WHEN l_quantity > 30 THEN 'R' ELSE 'N' END AS p1,
  CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 'A' WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS p2,
  CASE WHEN l_linenumber % 3 = 0 THEN 'A' WHEN l_linenumber % 3 = 1 THEN 'R' ELSE 'X' END AS p3
  FROM lineitem"""


def flag_rules(spark, sf_dir) -> DataFrame:
    """Return flags with three rule-based predictions."""
    shipped = F.col("l_shipdate") < F.lit("1997-06-01").cast("timestamp_ntz")
    done, third = F.col("l_linestatus") == "F", F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("y"),
        F.when(shipped, "A").when(F.col("l_quantity") > 30, "R").otherwise("N").alias("p1"),
        F.when(done & (F.col("l_discount") > 0.05), "A").when(done, "R").otherwise("N").alias("p2"),
        F.when(third == 0, "A").when(third == 1, "R").otherwise("X").alias("p3"))


_PRICE = """SELECT o_totalprice AS y, 100000 + 2000.0 * (o_custkey % 100) AS p1, 250000.0 AS p2 FROM orders"""


def price_rules(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("y"), (100000 + 2000.0 * (F.col("o_custkey") % 100)).alias("p1"),
        F.lit(250000.0).alias("p2"))


# --- metrics ----------------------------------------------------------------------

def binary_sql(source: str) -> str:
    return f"""
    WITH s AS ({source}), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = p) AS hit,
      count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 1) AS act,
      count(*) FILTER (WHERE p = 1) AS called FROM s)
    SELECT 'accuracy' AS metric, round(hit / n, 6) AS value FROM t
    UNION ALL SELECT 'f1', round(CASE WHEN act + called > 0 THEN 2 * tp / (act + called) ELSE 0 END, 6) FROM t"""


def multiclass_sql(source: str, by: str = "") -> str:
    """Accuracy and weighted F1 per group of ``by`` columns."""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    (WITH s AS ({source}), c AS (
       SELECT {cols} cls, sum(sup) AS sup, sum(called) AS called, sum(tp) AS tp FROM (
         SELECT {cols} y AS cls, 1 AS sup, 0 AS called, CASE WHEN y = p THEN 1 ELSE 0 END AS tp FROM s
         UNION ALL SELECT {cols} p, 0, 1, 0 FROM s) GROUP BY {cols} cls),
     m AS (SELECT {cols} sum(tp) / sum(sup) AS accuracy,
            sum(2.0 * tp / (sup + called) * sup) / sum(sup) AS f1 FROM c {group})
     SELECT {cols} 'accuracy' AS metric, CAST(accuracy AS DOUBLE) AS value FROM m
     UNION ALL SELECT {cols} 'f1', CAST(f1 AS DOUBLE) FROM m)"""


def regression_sql(source: str) -> str:
    return f"""
    (SELECT 'rmse' AS metric, sqrt(avg((y - p) * (y - p))) AS value FROM ({source})
     UNION ALL SELECT 'mae', avg(abs(y - p)) FROM ({source}))"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", r6("value"))


@query("metrics_binary", binary_sql(_QUALITY))
def metrics_binary(spark, sf_dir):
    return rounded(M.binary_metrics(quality_rule(spark, sf_dir), "y", "p"))


_P1 = f"SELECT y, p1 AS p FROM ({_FLAGS})"
_P2 = f"SELECT y, p2 AS p FROM ({_FLAGS})"


@query("metrics_multiclass", f"SELECT metric, round(value, 6) AS value FROM {multiclass_sql(_P1)}")
def metrics_multiclass(spark, sf_dir):
    return rounded(M.multiclass_metrics(flag_rules(spark, sf_dir), "y", "p1"))


@query("json_report", f"SELECT metric, round(value, 6) AS value FROM {multiclass_sql(_P1)}")
def json_report(spark, sf_dir):
    """Metrics written as a report and read back."""
    report = rounded(M.multiclass_metrics(flag_rules(spark, sf_dir), "y", "p1"))
    path = scratch_path(spark, "report")
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("metrics_regression",
       f"SELECT metric, round(value, 6) AS value FROM {regression_sql(f'SELECT y, p1 AS p FROM ({_PRICE})')}")
def metrics_regression(spark, sf_dir):
    return rounded(M.regression_metrics(price_rules(spark, sf_dir), "y", "p1"))


@query("metrics_detected_task", f"""
SELECT 'quality' AS target, metric, value FROM ({binary_sql(_QUALITY)})
UNION ALL SELECT 'returnflag', metric, round(value, 6) FROM {multiclass_sql(_P2)}
UNION ALL SELECT 'totalprice', metric, round(value, 6) FROM {regression_sql(f'SELECT y, p2 AS p FROM ({_PRICE})')}
""")
def metrics_detected_task(spark, sf_dir):
    parts = (("quality", quality_rule(spark, sf_dir), "p"), ("returnflag", flag_rules(spark, sf_dir), "p2"),
             ("totalprice", price_rules(spark, sf_dir), "p2"))
    frames = [M.evaluate(df, "y", p).select(F.lit(name).alias("target"), "metric", r6("value").alias("value"))
              for name, df, p in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("confusion_matrix", f"SELECT y AS y_true, p AS y_pred, count(*) AS n FROM ({_P1}) GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(flag_rules(spark, sf_dir), "y", "p1")


@query("confusion_table", f"""
SELECT y AS y_true, count(*) FILTER (WHERE p = 'A') AS pred_a, count(*) FILTER (WHERE p = 'N') AS pred_n,
       count(*) FILTER (WHERE p = 'R') AS pred_r FROM ({_P1}) GROUP BY y
""")
def confusion_table(spark, sf_dir):
    counts = M.confusion_matrix(flag_rules(spark, sf_dir), "y", "p1")
    return M.confusion_table(counts, ["A", "N", "R"]).toDF("y_true", "pred_a", "pred_n", "pred_r")


# --- model comparison --------------------------------------------------------------

_RULES = {"random_forest": "p1", "xgboost": "p2", "lightgbm": "p3"}
_LONG = " UNION ALL ".join(
    f"SELECT 'run_' || l_suppkey AS run_name, '{name}' AS plugin_name, y, {p} AS p FROM ({_FLAGS})"
    for name, p in _RULES.items())


def model_metrics(spark, sf_dir) -> DataFrame:
    """Metrics of three rules ("models") on each supplier's rows ("runs")."""
    rules = F.array(*[F.struct(F.lit(n).alias("plugin_name"), F.col(p).alias("p")) for n, p in _RULES.items()])
    rows = flag_rules(spark, sf_dir).select(
        F.concat(F.lit("run_"), F.col("l_suppkey").cast("string")).alias("run_name"), "y", F.inline(rules))
    return rounded(M.multiclass_metrics(rows, "y", "p", by=("run_name", "plugin_name")))


_MODEL_METRICS = (f"SELECT run_name, plugin_name, metric, round(value, 6) AS value "
                  f"FROM {multiclass_sql(_LONG, 'run_name, plugin_name')}")


@query("leaderboard", f"""
SELECT run_name, plugin_name, metric, value, row_number() OVER
       (PARTITION BY run_name, metric ORDER BY value DESC, plugin_name) AS rank FROM ({_MODEL_METRICS})
""")
def leaderboard(spark, sf_dir):
    return R.leaderboard(model_metrics(spark, sf_dir))


@query("best_model", f"""
SELECT run_name, plugin_name, metric, value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY value DESC, plugin_name) AS rk
  FROM ({_MODEL_METRICS}) WHERE metric = 'f1') WHERE rk = 1
""")
def best_model(spark, sf_dir):
    return R.best_model(model_metrics(spark, sf_dir), "f1")


@query("compare_runs", f"""
WITH a AS (SELECT metric, round(value, 6) AS value FROM {multiclass_sql(_P1)}),
     b AS (SELECT metric, round(value, 6) AS value FROM {multiclass_sql(_P2)}
           UNION ALL SELECT metric, round(value, 6) FROM {regression_sql(f'SELECT y, p1 AS p FROM ({_PRICE})')})
SELECT metric, a.value AS value_a, b.value AS value_b, round(b.value - a.value, 6) AS delta,
       metric NOT IN ('rmse', 'mae') AS higher_is_better
FROM a FULL OUTER JOIN b USING (metric)
""")
def compare_runs(spark, sf_dir):
    flags = flag_rules(spark, sf_dir)
    a = rounded(M.multiclass_metrics(flags, "y", "p1"))
    b = rounded(M.multiclass_metrics(flags, "y", "p2").unionByName(
        M.regression_metrics(price_rules(spark, sf_dir), "y", "p1")))
    return R.compare_runs(a, b).withColumn("delta", r6("delta"))


# --- feature importance --------------------------------------------------------------

_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber")
_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS score FROM lineitem"
    for c in _FEATURES)


def correlation_importance(spark, sf_dir) -> DataFrame:
    """Strength of each numeric column's linear link to the price, in one pass."""
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in _FEATURES])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), r6(F.abs(c)).alias("score")) for c in _FEATURES])))


@query("top_feature", f"SELECT feature, score FROM ({_CORR}) ORDER BY score DESC, feature LIMIT 1")
def top_feature(spark, sf_dir):
    return R.top_feature(correlation_importance(spark, sf_dir))


@query("relative_importance", f"""
SELECT feature, score, CAST(trunc(score / (SELECT max(score) FROM ({_CORR})) * 100) AS INTEGER) AS relative_pct
FROM ({_CORR})
""")
def relative_importance(spark, sf_dir):
    return R.relative_importance(correlation_importance(spark, sf_dir))


@query("insights", f"""
SELECT 'low_accuracy' AS rule, metric AS subject, value FROM (SELECT metric, round(value, 6) AS value
  FROM {multiclass_sql(_P1)}) WHERE metric = 'accuracy' AND value < 0.7
UNION ALL SELECT 'dominant_feature', feature, score FROM (
  SELECT * FROM ({_CORR}) ORDER BY score DESC, feature LIMIT 1) WHERE score > 0.8
UNION ALL SELECT 'high_null_rate', column_name, null_pct FROM ({profile_sql(DIRTY_SQL, DIRTY)}) WHERE null_pct > 0.1
""")
def insights(spark, sf_dir):
    found = R.insights(rounded(M.multiclass_metrics(flag_rules(spark, sf_dir), "y", "p1")),
                       correlation_importance(spark, sf_dir), P.profile_columns(dirty_events(spark, sf_dir)))
    return rounded(found)


# --- run logs and catalogs ---------------------------------------------------------------

_STATE = """CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'succeeded' WHEN 'view' THEN 'running'
            WHEN 'purchase' THEN 'approved' ELSE 'skipped' END"""
_NODES = ("ingest", "validate", "train", "export")
_LOG = f"""SELECT 'run_' || user_id AS run_name, user_id AS run_id,
           ['ingest', 'validate', 'train', 'export'][CAST(floor(value) AS BIGINT) % 4 + 1] AS node_id,
           {_STATE} AS state, ts FROM events"""


def run_log(spark, sf_dir) -> DataFrame:
    """Events as a log of node states: users are runs."""
    states = {"error": "failed", "click": "succeeded", "view": "running", "purchase": "approved"}
    kind = F.col("event_type")
    state = None
    for event, s in states.items():
        state = F.when(kind == event, s) if state is None else state.when(kind == event, s)
    node = F.element_at(F.array(*[F.lit(n) for n in _NODES]), (F.floor("value") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_name"),
        F.col("user_id").alias("run_id"), node.alias("node_id"), state.otherwise("skipped").alias("state"), "ts")


_PROGRESS = f"""SELECT run_name, count(*) FILTER (WHERE state IN ('succeeded', 'approved', 'skipped')) AS done,
                count(*) AS total FROM ({_LOG}) GROUP BY run_name"""


@query("run_progress", _PROGRESS)
def run_progress(spark, sf_dir):
    return R.run_progress(run_log(spark, sf_dir))


@query("run_summary", f"""
SELECT run_name, done, total, first_metric, value FROM ({_PROGRESS}) LEFT JOIN (
  SELECT run_name, metric AS first_metric, value FROM ({_MODEL_METRICS})
  WHERE metric = 'accuracy' AND plugin_name = 'xgboost') USING (run_name)
""")
def run_summary(spark, sf_dir):
    position = F.when(F.col("metric") == "accuracy", 0).otherwise(1)
    reports = model_metrics(spark, sf_dir).where(F.col("plugin_name") == "xgboost")
    return R.run_summary(run_log(spark, sf_dir), reports.withColumn("position", position))


@query("latest_run", f"SELECT run_name, run_id FROM ({_LOG}) ORDER BY run_id DESC LIMIT 1")
def latest_run(spark, sf_dir):
    return R.latest_run(run_log(spark, sf_dir).select("run_name", "run_id"))


@query("latest_node_state", f"""
WITH l AS (SELECT run_name, node_id, arg_max(state, ts) AS state FROM ({_LOG}) GROUP BY 1, 2)
SELECT r.run_name, n.node_id, coalesce(l.state, 'pending') AS state
FROM (SELECT DISTINCT run_name FROM l) r
CROSS JOIN (SELECT unnest(['ingest', 'validate', 'train', 'export', 'deploy']) AS node_id) n
LEFT JOIN l ON l.run_name = r.run_name AND l.node_id = n.node_id
""")
def latest_node_state(spark, sf_dir):
    return R.node_states(run_log(spark, sf_dir).drop("run_id"), [*_NODES, "deploy"])


_FOLDERS = ("rf", "xgb", "lgbm", "lstm", "custom")
_TASK_NAMES = ("binary_classification", "multiclass", "regression")


def model_files(spark, sf_dir) -> DataFrame:
    """A model metadata file per order."""
    key = F.col("o_orderkey")
    folder = F.element_at(F.array(*[F.lit(f) for f in _FOLDERS]), (key % 5 + 1).cast("int"))
    task = F.element_at(F.array(*[F.lit(t) for t in _TASK_NAMES]), (key % 3 + 1).cast("int"))
    names = F.transform(F.sequence(F.lit(1), (key % 7 + 1).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string")))
    path = F.concat(F.lit("/proj/runs/run_"), F.col("o_custkey").cast("string"), F.lit("/artifacts/"), folder,
                    F.lit("_model/metadata/part-"), key.cast("string"))
    meta = F.to_json(F.struct(task.alias("task"), names.alias("features")))
    return table(spark, sf_dir, "orders").select(path.alias("path"), meta.alias("metadata"))


_CATALOG = """
SELECT 'run_' || o_custkey AS run_name,
       ['random_forest', 'xgboost', 'lightgbm', 'lstm_tabular', 'custom'][o_orderkey % 5 + 1] AS plugin_name,
       ['binary_classification', 'multiclass', 'regression'][o_orderkey % 3 + 1] AS task,
       CAST(o_orderkey % 7 + 1 AS INTEGER) AS n_features FROM orders
"""


@query("model_catalog", _CATALOG)
def model_catalog(spark, sf_dir):
    return R.model_catalog(model_files(spark, sf_dir)).select("run_name", "plugin_name", "task", "n_features")


@query("model_lookup", f"SELECT * FROM ({_CATALOG}) WHERE run_name = 'run_1' AND plugin_name = 'xgboost'")
def model_lookup(spark, sf_dir):
    found = R.find_models(R.model_catalog(model_files(spark, sf_dir)), "run_1", "xgboost")
    return found.select("run_name", "plugin_name", "task", "n_features")


# --- ranked metrics ---------------------------------------------------------------

def auc_sql(source: str, by: str = "") -> str:
    """``source`` gives y, s and, with ``by``, that column."""
    keys, group = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""
    WITH s AS ({source}), c AS (
      SELECT {keys}s, sum(y) AS pos, sum(1 - y) AS neg FROM s WHERE y IS NOT NULL AND s IS NOT NULL GROUP BY {keys}s),
    b AS (SELECT *, coalesce(sum(neg) OVER ({group}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT {keys}'auc' AS metric, round(CASE WHEN sum(pos) * sum(neg) > 0
      THEN sum(pos * (2 * below + neg))::DOUBLE / (2 * sum(pos) * sum(neg))::DOUBLE END, 9) AS value
    FROM b {"GROUP BY " + by if by else ""}"""


_RANKED = "SELECT quality AS y, source, {score} AS s FROM documents JOIN labels USING (doc_id)"
_HOT = "CASE WHEN doc_id % 3 = 0 THEN 200 ELSE n_chars END"


def ranked(spark, sf_dir, score: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("quality AS y", "source", f"{score} AS s")


def auc_rows(frame: DataFrame) -> DataFrame:
    return frame.withColumn("value", F.round("value", 9))


@query("metrics_auc", auc_sql(_RANKED.format(score="n_chars")))
def metrics_auc(spark, sf_dir):
    return auc_rows(M.ranked_auc(ranked(spark, sf_dir, "n_chars"), "y", "s"))


@query("metrics_auc_by_source", auc_sql(_RANKED.format(score="n_chars"), "source"))
def metrics_auc_by_source(spark, sf_dir):
    return auc_rows(M.ranked_auc(ranked(spark, sf_dir, "n_chars"), "y", "s", by=["source"]))


@query("metrics_auc_hot_score", auc_sql(_RANKED.format(score=_HOT)))
def metrics_auc_hot_score(spark, sf_dir):
    """One score holds a third of the rows."""
    return auc_rows(M.ranked_auc(ranked(spark, sf_dir, _HOT), "y", "s"))


@query("metrics_auc_lines", auc_sql("SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS s FROM lineitem"))
def metrics_auc_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "l_extendedprice AS s")
    return auc_rows(M.ranked_auc(rows, "y", "s"))
