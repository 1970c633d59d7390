"""Pages of a large table by their place: a stored order with a directory of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE_ROWS = 100_000
#: Rows of a part of the order, about, which is then cut into ranges: the driver samples the bounds of parts only.
PART_ROWS = 500_000


def _by(order: list[tuple[str, bool]]) -> list[Column]:
    """Sort columns of (name, descending); nulls come last."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def write_pages(df: DataFrame, order: list[tuple[str, bool]], path: str, range_rows: int = RANGE_ROWS) -> None:
    """Writes df in the order of (column, descending), which must be total, as ranges in folders, and their directory:
    range, n, before (rows of earlier ranges), last (its last row's values of the order)."""
    df.limit(0).write.parquet(f"{path}/shape")  # an empty table has no range to tell the columns
    n = max(1, -(-df.count() // max(range_rows, PART_ROWS)))
    parts = df.repartitionByRange(n, *_by(order)).withColumn("_part", F.spark_partition_id().cast("long"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*_by(order))) - 1
    dealt = parts.withColumn("range", F.shiftleft("_part", 32) + F.floor(place / range_rows)).drop("_part")
    dealt.sortWithinPartitions("range", *_by(order)).write.partitionBy("range").parquet(f"{path}/rows")
    kept = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    backwards = [F.col(c).asc_nulls_first() if down else F.col(c).desc_nulls_first() for c, down in order]
    last = kept.withColumn("_r", F.row_number().over(W.partitionBy("range").orderBy(*backwards))).where("_r = 1")
    sizes = kept.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    directory = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    directory.join(last.select("range", F.struct(*(c for c, _ in order)).alias("last")), "range").coalesce(1).write.parquet(f"{path}/directory")


def _ranges(spark: SparkSession, path: str, which: Column) -> list:
    return spark.read.parquet(f"{path}/directory").where(which).orderBy("range").collect()  # those of one page


def _rows(spark: SparkSession, path: str, found: list) -> DataFrame:
    shape = spark.read.parquet(f"{path}/shape").schema
    rows = spark.read.schema(shape.add("range", "long")).parquet(f"{path}/rows")
    return rows.where(F.col("range").isin([r.range for r in found])).drop("range")


def page_at(spark: SparkSession, path: str, order: list[tuple[str, bool]], number: int, size: int) -> DataFrame:
    """The page of that number, from 1: only the ranges that hold it are read."""
    first = (number - 1) * size
    found = _ranges(spark, path, (F.col("before") < first + size) & (F.col("before") + F.col("n") > first))
    return _rows(spark, path, found).orderBy(*_by(order)).offset(first - found[0].before if found else 0).limit(size)


def page_after(spark: SparkSession, path: str, order: list[tuple[str, bool]], values: dict, size: int) -> DataFrame:
    """The `size` rows after the one with these values of the order (not null), from the first range that reaches further."""

    def later(of) -> Column:
        out = F.lit(False)
        for c, down in reversed(order):
            x, v = of(c), F.lit(values[c])
            beyond = x < v if down else x > v
            out = F.coalesce(beyond, F.lit(True)) | ((x == v) & out)
        return out

    reach = _ranges(spark, path, later(lambda c: F.col(f"last.{c}")))
    need, rows = [], 0
    for r in reach:  # the first may hold as little as one row after the values
        need.append(r)
        rows += r.n if len(need) > 1 else 0
        if rows >= size:
            break
    return _rows(spark, path, need).where(later(F.col)).orderBy(*_by(order)).limit(size)
