"""Feature-set versions saved from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.workspace import scratch_path
from tabforge.plans.feature_sets import FeatureSets, latest_versions, next_versions, save_merged
from tabforge.registered.base import query, table
from tabforge.registered.profiles import DIRTY, DIRTY_SQL, dirty_events, profile_sql
from tabforge.sources.connector import register
from tabforge.streaming.batches import drain


def filled_store(spark, sf_dir) -> FeatureSets:
    """Customers saved twice (the second time with fewer columns) and suppliers once."""
    store = FeatureSets(spark, scratch_path(spark, "features"))
    customers = table(spark, sf_dir, "customer")
    store.save(customers, "customers", tags=["v1", "production"], run_id=42)
    store.save(customers.drop("c_mktsegment"), "customers", tags=["v2"])
    store.save(table(spark, sf_dir, "supplier"), "suppliers")
    return store


_META = ("name", "version", "row_count", "column_count")
_LIST = """
SELECT 'customers' AS name, 2 AS version, count(*) AS row_count, 4 AS column_count FROM customer
UNION ALL SELECT 'suppliers', 1, count(*), 4 FROM supplier
"""


@query("feature_set_save", "SELECT 'events' AS feature_name, 1 AS version, count(*) AS row_count FROM events")
def feature_set_save(spark, sf_dir):
    store = FeatureSets(spark, scratch_path(spark, "features"))
    return save_merged(store, dirty_events(spark, sf_dir), "events", tags=["v1"])


@query("feature_set_load", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def feature_set_load(spark, sf_dir):
    return filled_store(spark, sf_dir).load("customers")


@query("feature_set_load_pinned", "SELECT * FROM customer")
def feature_set_load_pinned(spark, sf_dir):
    return filled_store(spark, sf_dir).load("customers", 1)


@query("feature_set_list", _LIST)
def feature_set_list(spark, sf_dir):
    return filled_store(spark, sf_dir).list().select(*_META)


@query("feature_set_versions", """
SELECT 'customers' AS name, v AS version, count(*) AS row_count, 6 - v AS column_count
FROM customer, (VALUES (1), (2)) t(v) GROUP BY v
""")
def feature_set_versions(spark, sf_dir):
    return filled_store(spark, sf_dir).versions("customers").select(*_META)


@query("feature_set_info", f"""
SELECT 'events' AS name, 1 AS version, row_count, column_name, logical_type, nulls
FROM ({profile_sql(DIRTY_SQL, DIRTY)})
""")
def feature_set_info(spark, sf_dir):
    """Column profile of a version out of the catalog, as observed while it was written."""
    store = FeatureSets(spark, scratch_path(spark, "features"))
    store.save(dirty_events(spark, sf_dir), "events")
    return store.columns("events")


@query("feature_set_delete", """
SELECT 'customers' AS name, 1 AS deleted, count(*) AS row_count, 3 AS next_version FROM customer
""")
def feature_set_delete(spark, sf_dir):
    """After deleting the newest version the older one is the latest; numbers are not reused."""
    store = filled_store(spark, sf_dir)
    deleted = store.delete("customers", 2)
    version = store.save(store.load("customers"), "customers").version
    return store.load("customers").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("customers").alias("name"), F.lit(deleted).alias("deleted"), "row_count",
        F.lit(version).alias("next_version"))


_ORDER_VERSIONS = """SELECT 'c' || o_custkey AS name, CAST(o_orderkey % 50 AS INTEGER) AS version,
                     o_totalprice AS size FROM orders"""


@query("feature_next_version", f"SELECT name, max(version) + 1 AS next_version FROM ({_ORDER_VERSIONS}) GROUP BY name")
def feature_next_version(spark, sf_dir):
    """Next number per name over a large catalog: orders as versions of customers."""
    return next_versions(_order_versions(spark, sf_dir))


@query("feature_latest_versions", f"""
SELECT name, max(version) AS version FROM ({_ORDER_VERSIONS}) GROUP BY name
""")
def feature_latest_versions(spark, sf_dir):
    return latest_versions(_order_versions(spark, sf_dir)).select("name", "version")


def _order_versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"),
        (F.col("o_orderkey") % 50).cast("int").alias("version"), F.col("o_totalprice").alias("size"))


# --- a saved feature set through its own source ---------------------------------------

_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem"


#: Rows of a file; a table of a few rows still gets several files.
FILE_ROWS = 1_000_000


def saved_lines(spark, sf_dir) -> str:
    """Path of a version with several files and row groups."""
    sets = FeatureSets(spark, scratch_path(spark, "sets"))
    lines = table(spark, sf_dir, "lineitem")
    sets.save(lines.repartition(max(4, -(-lines.count() // FILE_ROWS)), "l_orderkey"), "lines")
    register(spark)
    return sets.info("lines").first().data_path


@query("source_feature_set", f"{_LINES} WHERE l_quantity > 25")
def source_feature_set(spark, sf_dir):
    rows = spark.read.format("feature_set").schema(
        "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz").load(saved_lines(spark, sf_dir))
    return rows.where("l_quantity > 25")


@query("source_feature_set_stream", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def source_feature_set_stream(spark, sf_dir):
    """The same files as a stream."""
    path, root = saved_lines(spark, sf_dir), scratch_path(spark, "stream")
    rows = spark.readStream.format("feature_set").load(path)
    rows = drain(rows.select("l_returnflag", "l_quantity"), f"{root}/rows", f"{root}/checkpoint")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
