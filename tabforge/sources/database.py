"""Database queries over JDBC."""

from __future__ import annotations

import os
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

# Dialect of a connection string to its JDBC sub-protocol.
JDBC_DIALECTS = {
    "postgresql": "postgresql",
    "postgres": "postgresql",
    "mysql": "mysql",
    "mariadb": "mariadb",
    "mssql": "sqlserver",
    "sqlite": "sqlite",
}


def jdbc_connection(dsn: str) -> dict[str, str]:
    """``url``, ``user`` and ``password`` of a connection string.

    Environment variables (``$NAME`` or ``${NAME}``) are expanded first.  A
    ``jdbc:`` URL is used as it is.
    """
    dsn = os.path.expandvars(dsn)
    if dsn.startswith("jdbc:"):
        return {"url": dsn}
    parts = urlsplit(dsn)
    dialect = JDBC_DIALECTS.get(parts.scheme.split("+")[0])
    if dialect is None:
        raise ValueError(f"no JDBC dialect for {parts.scheme!r}; pass a jdbc: URL")
    if dialect == "sqlite":
        return {"url": f"jdbc:sqlite:{dsn.split(':///', 1)[-1]}"}
    host = parts.hostname or "localhost"
    port = f":{parts.port}" if parts.port else ""
    database = parts.path.lstrip("/")
    if dialect == "sqlserver":
        url = f"jdbc:sqlserver://{host}{port};databaseName={database}"
    else:
        query = f"?{parts.query}" if parse_qsl(parts.query) else ""
        url = f"jdbc:{dialect}://{host}{port}/{database}{query}"
    out = {"url": url}
    if parts.username:
        out["user"] = unquote(parts.username)
    if parts.password:
        out["password"] = unquote(parts.password)
    return out


def jdbc_options(dsn: str, query: str, *, fetch_size: int = 10_000,
                 partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None) -> dict[str, str]:
    """Reader options; with a partition column the query runs as parallel range reads."""
    out = {**jdbc_connection(dsn), "dbtable": f"({query.rstrip().rstrip(';')}) q",
           "fetchsize": str(fetch_size)}
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                "upperBound": str(upper_bound), "numPartitions": str(num_partitions)}
    return out


def read_jdbc(spark: SparkSession, dsn: str, query: str, **kwargs) -> DataFrame:
    """Rows of a database query; filters and columns are pushed into the database."""
    return spark.read.format("jdbc").options(**jdbc_options(dsn, query, **kwargs)).load()


def sample_jdbc(spark: SparkSession, dsn: str, query: str, n: int, **kwargs) -> DataFrame:
    """First ``n`` rows; Spark pushes the limit into the database."""
    return read_jdbc(spark, dsn, query, **kwargs).limit(n)
