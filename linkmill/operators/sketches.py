"""Figures that are kept up batch by batch: sketches as stored columns, merged at reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers (as a power of two) of the sketch for distinct values: a relative standard error of 1.04 / sqrt(2**12), 1.6 %.
DISTINCT_BITS = 12
#: Size of the sketch for quantiles: ranks are wrong by about 0.7 % (with 99 % confidence) at 400.
QUANTILE_SIZE = 400


def batch_figures(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """Per group: rows n, total, and sketches of the distinct values of a column and of another's quantiles.

    A row a group and batch is stored; the raw rows of earlier batches are not read again. Nulls don't count."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.hll_sketch_agg(distinct, F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(v, F.lit(QUANTILE_SIZE)).alias("value_sketch")
    )


def merged_figures(figures: DataFrame, by: list[str], points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per group over all batches: n, total, n_distinct (approximate) and q, the approximate quantiles."""
    one = figures.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("d"),
        F.kll_merge_agg_double("value_sketch").alias("v")
    )
    q = F.kll_sketch_get_quantile_double("v", F.array(*map(F.lit, points)))
    return one.select(*by, "n", "total", F.hll_sketch_estimate("d").alias("n_distinct"), F.when(F.kll_sketch_get_n_double("v") > 0, q).alias("q"))
