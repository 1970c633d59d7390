"""Reading and writing tables: tolerant scans, parameter tables, keyed appends, tiered outputs."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.operators.merge import new_rows
from linkmill.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def latin_files(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """The files of a path, and those of them with a line that isn't UTF-8: one look over the lines."""
    lines = spark.read.text(path)
    names = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("f")).distinct().collect()  # a row a file
    plain = lambda uri: unquote(urlsplit(uri).path)
    bad = {plain(r.f) for r in names}
    files = lines.inputFiles()
    return files, [f for f in files if plain(f) in bad]


def csv(spark: SparkSession, path: str, schema: str, encoding: str | None = None, strict: bool = False) -> DataFrame:
    """A CSV table with a header; each file in UTF-8, or in Latin-1 if it isn't, unless an encoding is given.

    A missing path gives an empty table, as does an unreadable one. strict raises for it instead, and fails on
    bad rows and on another header."""
    if not exists(spark, path):
        return empty(spark, schema)

    def read(paths: str | list[str], encoding: str) -> DataFrame:
        reader = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"')
        return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", not strict).csv(paths)

    if encoding:
        return read(path, encoding)
    try:
        files, latin = latin_files(spark, path)
    except PySparkException:
        if strict:
            raise
        return empty(spark, schema)
    if len(latin) in (0, len(files)):
        return read(path, "ISO-8859-1" if latin else "UTF-8")
    plain = lambda some: [unquote(f) for f in some]
    return read(plain(f for f in files if f not in set(latin)), "UTF-8").unionByName(read(plain(latin), "ISO-8859-1"))


def texts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All columns as text, nulls as empty text."""
    return csv(spark, path, ", ".join(f"`{n}` string" for n in names)).na.fill("")


def some_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, in their order; the scan reads no others."""
    return df.select(*[c for c in wanted if c in df.columns])


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or a CSV one with a header as text where the path ends in .csv."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def first_available(spark: SparkSession, paths: list[str], schema: str, alternates: dict[str, list[str]] | None = None) -> DataFrame:
    """The first table that exists, in the given schema, else an empty one.

    A column that the table lacks is taken from the first of its alternates that is there, else null; text that
    isn't of its type becomes null."""
    wanted = T.StructType.fromDDL(schema)
    for p in paths:
        if exists(spark, p):
            df = table(spark, p)
            cols = []
            for f in wanted.fields:
                name = next((x for x in [f.name, *(alternates or {}).get(f.name, [])] if x in df.columns), None)
                cols.append((F.col(f"`{name}`").try_cast(f.dataType) if name else F.lit(None).cast(f.dataType)).alias(f.name))
            return df.select(*cols)
    return empty(spark, schema)


def optional(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A Parquet or CSV table, or an empty one where it is missing or lacks its key."""
    if exists(spark, path):
        df = table(spark, path)
        if key in df.columns:
            return df
    return empty(spark, schema)


def works(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WORK).json(path)


def authors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUTHOR).json(path)


def studies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STUDY).json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """{key: {...}} objects, one a line, as rows (key, value columns); bad lines give none."""
    lines = spark.read.text(path).select(F.from_json("value", f"map<string,struct<{value}>>").alias("m"))
    return lines.where("m is not null").select(F.explode("m").alias("key", "v")).select("key", "v.*")


def parameters(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """A parameter table as text; where a wanted name is missing the column in its place is taken. Blank keys go."""
    if not exists(spark, path):
        return empty(spark, ", ".join(f"`{w}` string" for w in wanted))
    df = spark.read.option("header", True).csv(path)
    cols = [F.trim(F.col(f"`{w if w in df.columns else df.columns[min(i, len(df.columns) - 1)]}`")).alias(w) for i, w in enumerate(wanted)]
    return df.select(*cols).where(F.coalesce(F.col(wanted[0]), F.lit("")) != "")


def check_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """df, if it has exactly these columns in this order."""
    if df.columns != expected:
        raise ValueError(f"columns are {df.columns}, expected {expected}")
    return df


def overwrite(df: DataFrame, path: str, order: list[str], sort: list) -> None:
    """The table written anew, columns and rows in a fixed order."""
    df.select(*order).orderBy(*sort).write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], order: list | None = None) -> None:
    """Appends the rows whose key the table lacks; sent again it appends nothing."""
    have = df.sparkSession.read.parquet(path) if exists(df.sparkSession, path) else df.limit(0)
    new_rows(df, have, keys, order).write.mode("append").parquet(path)


def pending(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that are not completed."""
    return keys.join(done.select(key).distinct(), key, "left_anti")


def quarantine(df: DataFrame, key: Column, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON column parses, with `parsed`, and (key, message) of those that do not."""
    out = df.withColumn("parsed", F.from_json(raw, schema))
    bad = F.col(raw).isNotNull() & (F.trim(raw) != "") & F.col("parsed").isNull()
    return out.where(~F.coalesce(bad, F.lit(False))), out.where(bad).select(key.cast("string").alias("key"), F.lit("bad JSON").alias("message"))


def by_tier(df: DataFrame, tier: str, path: str, flags: str | None = None) -> None:
    """all, review (REVIEW), rejects (not HIGH) and flagged rows as tables."""
    df.persist()
    parts = {
        "all": F.lit(True), "review": F.col(tier) == "REVIEW", "rejects": F.col(tier) != "HIGH"
    } | ({"flagged": F.size(flags) > 0} if flags else {})
    for name, condition in parts.items():
        df.where(condition).write.mode("overwrite").parquet(f"{path}/{name}")
    df.unpersist()


def export_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with headers; arrays joined by pipes, nulls as empty text."""
    flat = [
        F.array_join(
            F.transform(f.name, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "|"
        ).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def log_errors(errors: DataFrame, path: str) -> None:
    """Appends (key, message) rows with the time; a row that is logged already isn't logged again."""
    append_new(errors.withColumn("at", F.current_timestamp()), path, ["key", "message"])
