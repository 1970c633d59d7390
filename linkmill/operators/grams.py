"""Which texts contain which patterns, by an inverted index of character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmill.operators.joins import HOT_ROWS, grid_join, settled

#: Characters of a gram; a shorter pattern is its own gram.
SIZE = 3


def grams(text: Column, n: int = SIZE) -> Column:
    """The different n-grams of a text. A look-ahead matches at every place, so long texts take linear time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contained(
    patterns: DataFrame, texts: DataFrame, pattern: str, key: str, text: str, most: int = HOT_ROWS, size: int = SIZE
) -> DataFrame:
    """(pattern, key, text) for all pairs where the text contains the pattern, inside a word too.

    Texts are indexed by their grams, those only that a pattern has. Each pattern looks up the rarest of its
    grams (of equals the first), and what it finds is verified. A gram of many patterns or texts is dealt out to several
    tasks, and so is a text with many candidates; texts themselves move once for each part, not for each gram.
    Patterns of `size` characters or fewer find just the texts that hold them; for short texts a larger size than the usual
    one keeps candidates from growing with the product of patterns and texts. Patterns are taken once each; null and empty ones lie in nothing. texts has one row a key; null keys are left out."""
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern != ''").distinct()
    length = F.length("pattern")
    probes = p.select("pattern", F.explode(F.when(length < size, F.array("pattern")).otherwise(grams(F.col("pattern"), size))).alias("gram"))
    sizes = [r.n for r in p.select(F.least(length, F.lit(size)).alias("n")).distinct().collect()] or [size]  # at most `size`
    every = F.array_distinct(F.concat(*(grams(F.col("text"), n) for n in sorted(sizes))))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    postings = rows.select("key", F.explode(every).alias("gram")).join(probes.select("gram").distinct(), "gram", "left_semi")
    postings = settled(postings)
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
    chosen = probes.join(counts, "gram", "left").groupBy("pattern").agg(rarest.alias("r")).select("pattern", "r.gram")
    found = settled(grid_join(settled(chosen), postings, "gram", "pattern", "key", most).select("pattern", "key"))
    found = grid_join(found, rows, "key", "pattern", "key", most).where(F.contains("text", "pattern"))
    return settled(found).select(F.col("pattern").alias(pattern), F.col("key").alias(key), F.col("text").alias(text))
