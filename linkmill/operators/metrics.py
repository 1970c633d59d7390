"""Bibliometric aggregates: one groupBy each, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def h_index(df: DataFrame, by: list[str], cites: str) -> DataFrame:
    """The largest h such that h rows of a group have h citations or more; nulls count as 0.

    Counted from the number of rows per (group, citations), so a group with very many rows is a few
    rows before any window sees it."""
    counts = df.groupBy(*by, F.coalesce(F.col(cites).cast("long"), F.lit(0)).alias("c")).agg(F.count("*").alias("n"))
    at_least = F.sum("n").over(W.partitionBy(*by).orderBy(F.desc("c")))
    return counts.withColumn("m", at_least).groupBy(*by).agg(F.max(F.least("c", "m")).alias("h_index"))


def i_index(cites: str, threshold: int = 10) -> Column:
    return F.count_if(F.coalesce(F.col(cites), F.lit(0)) >= threshold)


def share_true(c: Column) -> Column:
    """Share of true among known values; 0 without any."""
    return F.coalesce(F.avg(c.cast("int")), F.lit(0.0))


def share_abroad(codes: Column, local: list[str]) -> Column:
    """Share of rows with a country that is not local; rows without countries count as local."""
    away = F.size(F.array_except(F.filter(codes, lambda c: c.isNotNull() & (c != "")), F.array(*map(F.lit, local)))) > 0
    return F.coalesce(F.avg(F.when(away, 1.0).otherwise(0.0)), F.lit(0.0))


def country_codes(c: Column, nested: bool = True) -> Column:
    """Codes of an author list: slots divided by pipes, in a slot by commas. nested=False keeps a slot whole."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), "[|,]" if nested else "\\|"), lambda x: F.upper(F.trim(x)))


def share_position(c: str, position: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(c) == position, 1.0).otherwise(0.0)), F.lit(0.0))


def span(year: str) -> list[Column]:
    y = F.col(year).try_cast("int")
    return [F.coalesce(F.min(y), F.lit(0)).alias("first_year"), F.coalesce(F.max(y), F.lit(0)).alias("last_year")]


def upper_median(c: str) -> Column:
    """The element in the middle, of two the greater: percentile_disc from above."""
    return F.expr(f"-percentile_disc(0.5) within group (order by -{c})")


def author_stats(
    links: DataFrame, works: DataFrame, author: str, work: str, cites: str, year: str, fwci: str, is_oa: str,
    position: str, roster: DataFrame | None = None
) -> DataFrame:
    """Per author: works, citations, h and i10 index, FWCI mean and median, open-access share, shares as
    first and last author, first and last year. Authors of the roster without works have zeros and no FWCI."""
    joined = links.join(works, work, "left")
    base = joined.groupBy(author).agg(
        F.count_if(F.col(work).isNotNull()).alias("pub_count"),
        F.coalesce(F.sum(F.col(cites).try_cast("long")), F.lit(0)).alias("citations"),
        i_index(cites).alias("i10_index"), F.avg(fwci).alias("fwci_mean"), F.median(fwci).alias("fwci_median"),
        share_true(F.col(is_oa)).alias("oa_rate"), share_position(position, "first").alias("first_rate"),
        share_position(position, "last").alias("last_rate"), *span(year),
    )
    out = base.join(h_index(joined, [author], cites), author, "left")
    if roster is not None:
        zero = ["pub_count", "citations", "i10_index", "oa_rate", "first_rate", "last_rate", "first_year", "last_year", "h_index"]
        out = roster.select(author).distinct().join(out, author, "left").na.fill(0, zero)
    return out


def distinct_on(df: DataFrame, by: str, cols: list[str], name: str) -> DataFrame:
    """Distinct combinations of columns per group, nulls as empty text."""
    return df.groupBy(by).agg(F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias(name))


def relevance(df: DataFrame, by: str, flag: str) -> DataFrame:
    """Rows, flagged rows and their percentage with one decimal (half to even) per group."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_relevant"))
    return out.withColumn("pct", F.bround(100 * F.col("n_relevant") / F.col("n"), 1))


def one_per_key(df: DataFrame, by: list[str], key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a group: keys are the first of the given texts that is not empty.

    order should be a total order: of rows that tie in all of it any may stay. Rows without any key
    share the null key, so a group keeps one of them."""
    k = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in key])
    w = W.partitionBy(*by, "_k").orderBy(*order)
    return df.withColumn("_k", k).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def profiles_merged(
    works: DataFrame, profiles: DataFrame, member: str, profile: str, doi: str, title: str, cites: str,
    order: list[Column], prefix: int = 80
) -> DataFrame:
    """Works, citations and h index of members over all their profiles, each work once by DOI or title start."""
    joined = profiles.join(works, profile)
    once = one_per_key(joined, [member], [F.lower(F.col(doi)), F.substring(F.lower(F.col(title)), 1, prefix)], order)
    sums = once.groupBy(member).agg(F.count("*").alias("works"), F.sum(cites).alias("citations"))
    return sums.join(h_index(once, [member], cites), member)


def merge_rule(candidates: DataFrame, member: str, works: str, limit: int = 200) -> DataFrame:
    """Members with exactly one other profile and fewer works together than the limit."""
    return candidates.groupBy(member).agg(F.count("*").alias("n"), F.sum(works).alias("works")).where((F.col("n") == 1) & (F.col("works") < limit))


def weighted_share(topics: Column, words: list[str]) -> Column:
    """Share of the topics' counts that falls on topics with a word; topics is an array of (name, n)."""
    from linkmill.functions.vocab import holds_any

    total = F.aggregate(topics, F.lit(0).cast("long"), lambda a, t: a + t["n"])
    on = F.aggregate(topics, F.lit(0).cast("long"), lambda a, t: a + F.when(holds_any(t["name"], words), t["n"]).otherwise(F.lit(0).cast("long")))
    return F.when(total > 0, on / total).otherwise(0.0)


def positive_mean(c: str) -> Column:
    return F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 2)
