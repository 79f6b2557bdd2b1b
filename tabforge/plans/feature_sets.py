"""Versioned feature sets: Parquet data plus one small catalog row per version."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import workspace
from tabforge.functions.types import logical_type
from tabforge.operators.profile import present

CATALOG_SCHEMA = (
    "name string, version int, row_count bigint, column_count int, columns map<string,string>, "
    "nulls map<string,bigint>, column_order array<string>, created_at timestamp, data_path string, "
    "run_id bigint, tags array<string>, deleted boolean"
)


class FeatureSets:
    """Feature sets under one root folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- catalog --

    def _entries(self) -> DataFrame:
        pattern = f"{self.root}/_catalog/*"
        if not workspace.glob_has_match(self.spark, pattern):
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(pattern)

    def catalog(self) -> DataFrame:
        """Rows of all versions that have not been deleted."""
        entries = self._entries()
        gone = entries.where("deleted").select("name", "version")
        return entries.where("not deleted").join(gone, ["name", "version"], "left_anti").drop("deleted")

    def list(self) -> DataFrame:
        return latest_versions(self.catalog()).orderBy("name")

    def versions(self, name: str) -> DataFrame:
        return self.catalog().where(F.col("name") == name).orderBy("version")

    def info(self, name: str, version: int | None = None) -> DataFrame:
        """Catalog row of one version, the latest by default."""
        rows = self.catalog().where(F.col("name") == name)
        return rows.where(F.col("version") == version) if version is not None else latest_versions(rows)

    def columns(self, name: str, version: int | None = None) -> DataFrame:
        """Profile of a version from the catalog, without reading its data."""
        return self.info(name, version).select(
            "name", "version", "row_count",
            F.posexplode("column_order").alias("position", "column_name"), "columns", "nulls",
        ).select("name", "version", "row_count", "column_name",
                 F.col("columns")[F.col("column_name")].alias("logical_type"),
                 F.col("nulls")[F.col("column_name")].alias("nulls"))

    # -- data --

    def save(self, df: DataFrame, name: str, *, tags: Iterable[str] = (),
             run_id: int | None = None) -> Receipt:
        """Write the next version in one pass; counts are observed during the write.

        A version number is claimed first, so concurrent saves get different
        numbers.  The catalog row comes last and publishes the version.
        """
        if not re.fullmatch(r"[^/\s_.][^/\s]*", name or ""):
            raise ValueError(f"bad feature_name {name!r}")
        version = self._claim(name)
        path = f"{self.root}/{name}/v{version:03d}"
        fields = df.schema.fields
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
            F.count(present(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)])
        watched.write.mode("errorifexists").parquet(path)
        counts = seen.get
        rows = counts["rows"]
        self._append((
            name, version, rows, len(fields),
            {f.name: logical_type(f.dataType) for f in fields},
            {f.name: rows - counts[f"c{i}"] for i, f in enumerate(fields)},
            [f.name for f in fields], path, run_id, list(tags), False,
        ))
        return Receipt(name, version, rows)

    def load(self, name: str, version: int | None = None) -> DataFrame:
        found = self.info(name, version).select("data_path").collect()
        if not found:
            wanted = f"{name} version {version}" if version is not None else name
            raise KeyError(f"feature set {wanted} not found")
        return self.spark.read.parquet(found[0].data_path)

    def delete(self, name: str, version: int | None = None) -> int:
        """Delete one version or all; returns how many.  Numbers are not reused."""
        rows = self.catalog().where(F.col("name") == name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.select("version", "data_path").collect()
        for r in found:
            self._append((name, r.version, None, None, None, None, None, r.data_path, None, None, True))
            workspace.delete_tree(self.spark, r.data_path)
        return len(found)

    # -- storage --

    def _claim(self, name: str) -> int:
        """Next number after all claims ever made, so numbers are never reused."""
        folder = f"{self.root}/_claims/{name}"
        taken = [int(f[1:]) for f in workspace.file_names(self.spark, folder) if re.fullmatch(r"v\d+", f)]
        n = max(taken, default=0) + 1
        while not workspace.claim(self.spark, f"{folder}/v{n:06d}"):
            n += 1
        return n

    def _append(self, values: tuple) -> None:
        name, version, deleted = values[0], values[1], values[-1]
        row = self.spark.createDataFrame([(*values[:7], None, *values[7:])], CATALOG_SCHEMA)
        row = row.withColumn("created_at", F.current_timestamp())
        kind = "deleted" if deleted else "saved"
        row.coalesce(1).write.mode("errorifexists").parquet(
            f"{self.root}/_catalog/{name}-v{version:06d}-{kind}")


@dataclass(frozen=True)
class Receipt:
    feature_name: str
    version: int
    row_count: int


def latest_versions(catalog: DataFrame) -> DataFrame:
    """The row with the highest version of each name."""
    row = F.struct(*[c for c in catalog.columns if c != "name"])
    return catalog.groupBy("name").agg(F.max_by(row, "version").alias("r")).select("name", "r.*").select(
        *catalog.columns)


def next_versions(catalog: DataFrame) -> DataFrame:
    """The version number each name would get next."""
    return catalog.groupBy("name").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def save_merged(store: FeatureSets, merged: DataFrame, feature_name: str | None,
                tags: Iterable[str] = (), run_id: int | None = None) -> DataFrame:
    """Save merged data as a feature set; the receipt as a one-row table."""
    if not feature_name:
        raise ValueError("feature_name is required")
    r = store.save(merged, feature_name, tags=tags, run_id=run_id)
    return store.spark.createDataFrame(
        [(r.feature_name, r.version, r.row_count)], "feature_name string, version int, row_count bigint")
