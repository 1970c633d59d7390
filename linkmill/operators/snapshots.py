"""Versions of a table, kept before each change, and restoring from them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.operators.merge import fill_missing, last_by


class Snapshots:
    """A table's versions under one path: rows in version=<n>, and a log row (version, schema, number of keys, reason) that is
    written last, so a version that broke off is never seen and its number is used again."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def log(self) -> DataFrame:
        """version, schema, n_keys, reason of all finished versions."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        schema = "schema string, n_keys long, reason string, version int"
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema).select("version", "schema", "n_keys", "reason")
        return self.spark.read.schema(schema).parquet(f"{self.path}/log").select("version", "schema", "n_keys", "reason")

    def save(self, table: DataFrame, reason: str, before_mark=None) -> int:
        """Keeps the table as its next version and gives its number, from 1. before_mark is called before the log row."""
        version = (self.log().agg(F.max("version")).first()[0] or 0) + 1
        at = f"{self.path}/rows/version={version}"
        table.write.mode("overwrite").parquet(at)
        if before_mark:
            before_mark()
        n = self.spark.read.schema(table.schema).parquet(at).select(*self.keys).distinct().count()
        row = self.spark.createDataFrame([(table.schema.json(), n, reason)], "schema string, n_keys long, reason string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        return version

    def read(self, version: int) -> DataFrame:
        schema = self.log().where(F.col("version") == version).first()
        if schema is None:
            raise ValueError(f"no finished version {version}")
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema.schema))).parquet(f"{self.path}/rows/version={version}")

    def restore(self, current: DataFrame, cols: list[str], least: int = 5) -> DataFrame:
        """Null columns of `current` filled from the latest finished version that has more than `least` of them for the key.

        Versions may lack columns; one without a key is passed over. A version's repeated keys count by the row that
        has most of the columns, then by their values."""
        held = None
        for r in self.log().select("version").collect():  # one row a change of the table
            rows = self.read(r.version)
            if set(self.keys) <= set(rows.columns):
                kind = {f.name: f.dataType for f in current.schema}
                rows = rows.select(*self.keys, *((F.col(c) if c in rows.columns else F.lit(None)).cast(kind[c]).alias(c) for c in cols), F.lit(r.version).alias("_v"))
                held = rows if held is None else held.unionByName(rows)
        if held is None:
            return current
        held = held.withColumn("_n", sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)))
        best = last_by(held.where(F.col("_n") > least), self.keys, [F.desc("_v"), F.desc("_n"), *cols])
        return fill_missing(current, best.drop("_v", "_n"), self.keys, cols, zero_is_missing=False)
