"""Percentiles, ranks and nearest values without a window over a whole table.

A window without PARTITION BY goes to one task. So ranks are taken over distinct values, of which
each carries its count, in ranges of values: each range is ranked on its own and shifted by the
totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64
#: So many distinct values go through one window, sorted in one task.
FEW = 200_000


def with_below(counts: DataFrame, by: list[str], value: str, n: str = "_n") -> DataFrame:
    """Distinct values with counts n, and _below: the sum of n over the smaller values of the same `by`.

    Up to FEW different values, which are counted first, are summed by one window. More are dealt into RANGES by
    their approximate quantiles, so that a long tail fills no range alone."""
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    if counts.select(value).limit(FEW + 1).count() <= FEW:
        return counts.withColumn("_below", F.coalesce(F.sum(n).over(earlier(W.partitionBy(*by).orderBy(value))), F.lit(0)))
    points = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cut = counts.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), points, F.lit(10 * RANGES)).alias("_cuts"))
    dealt = counts.join(cut, by) if by else counts.join(F.broadcast(cut))  # one row
    at = F.size(F.filter("_cuts", lambda x: x < F.col(value).cast("double")))
    dealt = dealt.withColumn("_part", at).drop("_cuts")
    sums = dealt.groupBy(*by, "_part").agg(F.sum(n).alias("_s"))  # RANGES rows for each `by` at most
    before = sums.select(*by, "_part", F.coalesce(F.sum("_s").over(earlier(W.partitionBy(*by).orderBy("_part"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(n).over(earlier(W.partitionBy(*by, "_part").orderBy(value))), F.lit(0))
    out = dealt.withColumn("_inside", inside).join(before, [*by, "_part"])
    return out.withColumn("_below", F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def value_ranks(df: DataFrame, metric: str, of: str | None = None) -> DataFrame:
    """Distinct values _v with _n rows, and _below: rows with a smaller one. Nulls are left out.

    of: a boolean column; only its true rows count in _n and _below, but each value of df has a row."""
    flag = F.col(of) if of else F.lit(True)
    counts = df.where(F.col(metric).isNotNull()).groupBy(F.col(metric).alias("_v")).agg(F.count_if(flag).alias("_n"))
    return with_below(counts, [], "_v").select("_v", "_n", "_below")


def quantiles(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Per group: by, n, and q, the exact quantiles as doubles, interpolated between neighbours; nulls are left out.

    The rows at the wanted places are found by running counts over distinct values, so no group's values are
    held in one buffer."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    rows = with_below(counts, by, "_v")
    rows = rows.join(total, by) if by else rows.join(F.broadcast(total))
    found = []
    for i, p in enumerate(points):
        place = F.lit(p) * (F.col("_total") - 1)
        for name, at in ((f"_lo{i}", F.floor(place)), (f"_hi{i}", F.ceil(place))):
            found.append(F.max(F.when((F.col("_below") <= at) & (at < F.col("_below") + F.col("_n")), F.col("_v"))).alias(name))
    out = rows.groupBy(*by).agg(F.max("_total").alias("n"), *found)
    share = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    q = [F.col(f"_lo{i}") + share(p) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, p in enumerate(points)]
    return out.select(*by, "n", F.array(*q).alias("q"))


def percentile_rank(df: DataFrame, metric: str, name: str = "pct") -> DataFrame:
    """df with the percentile rank of metric, ties averaged, 100 for the single greatest; null for null."""
    ranks = value_ranks(df, metric)
    total = ranks.agg(F.sum("_n").alias("_total"))
    scored = ranks.join(F.broadcast(total)).select("_v", ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total") * 100).alias(name))
    return df.join(scored, df[metric] == scored["_v"], "left").drop("_v")


def tier_percentile(df: DataFrame, metric: str, tier: str, name: str = "pct") -> DataFrame:
    """Percentiles against the rows of a tier: these by averaged ranks, others by the share of the tier that
    is below them. Missing values, and all values where the tier is empty, have 50."""
    ranks = value_ranks(df, metric, tier)
    total = ranks.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    scored = ranks.join(F.broadcast(total))
    joined = df.join(scored, df[metric] == scored["_v"], "left")
    pct = F.when(F.col("_v").isNull() | (F.col("_total") == 0), 50.0).when(
        F.col(tier), (F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total") * 100
    ).otherwise(F.col("_below") / F.col("_total") * 100)
    return joined.withColumn(name, pct).drop("_v", "_n", "_below", "_total")


def outside_ranks(values: DataFrame, population: DataFrame, metrics: list[str]) -> DataFrame:
    """For each row of values and each metric: percentile (share below), rank (1 + count above), n and top share.

    The row's columns besides metrics are kept. Each value is compared with all of the population by one
    pass over its distinct values, not by a join of both tables."""
    keep = [c for c in values.columns if c not in metrics]
    ask = values.unpivot(keep, metrics, "metric", "value")
    have = population.unpivot([], metrics, "metric", "value").where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("n"))
    both = have.select("metric", "value", "n").unionByName(
        ask.select("metric", "value").where("value is not null").distinct().withColumn("n", F.lit(0).cast("long"))
    )
    both = both.groupBy("metric", "value").agg(F.sum("n").alias("n"))
    ranked = with_below(both, ["metric"], "value", "n").withColumnRenamed("_below", "below")
    ranked = ranked.join(both.groupBy("metric").agg(F.sum("n").alias("total")), "metric")
    out = ask.join(ranked, ["metric", "value"], "left")
    above = F.col("total") - F.col("below") - F.col("n")
    return out.select(
        *keep, "metric", "value", (100 * F.col("below") / F.col("total")).alias("pct"), (above + 1).alias("rank"),
        F.col("total").alias("n"), (100 * (above + 1) / F.col("total")).alias("top_share")
    )


def tier_label(pct: str):
    """A label by percentile; labels and bounds are fixed values."""
    p = F.col(pct)
    return F.when(p >= 90, "Top 10%").when(p >= 75, "Top 25%").when(p >= 50, "Above median").when(p >= 25, "Below median").otherwise("Bottom 25%")


def nearest_k(df: DataFrame, metric: str, value: float, key: str, k: int = 10) -> DataFrame:
    """The k rows nearest to value, by distance then key."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.abs(F.col(metric) - value), key).limit(k)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of rows, counted from 1, over a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def side_by_side(df: DataFrame, key: str, a, b, metrics: list[str]) -> DataFrame:
    """Two rows as columns: metric, a, b."""
    two = df.where(F.col(key).isin(a, b)).unpivot([key], metrics, "metric", "value")
    return two.groupBy("metric").agg(
        F.max(F.when(F.col(key) == a, F.col("value"))).alias("a"),
        F.max(F.when(F.col(key) == b, F.col("value"))).alias("b")
    )
