"""TF-IDF similarity of texts over blocked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmill.operators.corpus_weights import words
from linkmill.operators.joins import dealt_join


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, term): a row for each word and pair of words."""
    rows = df.select(F.col(key).alias("k"), words(text).alias("w"))
    pairs = F.when(
        F.size("w") > 1,
        F.transform(
            F.sequence(F.lit(1), F.size("w") - 1),
            lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))
        )
    ).otherwise(F.array().cast("array<string>"))
    return rows.select("k", F.explode(F.concat("w", pairs)).alias("term"))


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): words and pairs of words, weight (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), each text's weights of length 1."""
    tf = terms(df, key, text).groupBy("k", "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n_docs"))
    docs = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select(
        "term", (1 + F.log((1 + F.col("n_docs")) / (1 + F.col("df")))).alias("idf")
    )
    raw = tf.join(docs, "term").select("k", "term", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
    norm = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("x") / F.col("norm")).alias("weight"))


def similarity(weights: DataFrame, key: str, pairs: DataFrame, a: str, b: str, others: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) with their cosine: only terms that both have meet. others has the weights of b, if weights has not."""
    x = dealt_join(pairs, weights.select(F.col(key).alias(a), "term", F.col("weight").alias("wa")), a, b)
    both = x.join((weights if others is None else others).select(F.col(key).alias(b), "term", F.col("weight").alias("wb")), [b, "term"])
    return both.groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def alike(left: DataFrame, right: DataFrame, key: str, a: str, b: str, least: float) -> DataFrame:
    """(a, b, cosine): all pairs of a left and a right text with a cosine of at least `least` (> 0).

    left and right are tables of tf_idf() weights that can be read again; terms that no left text has
    may be missing on the right. In one order of all terms, the frequent ones last, each text leaves out
    as many at its end as cannot reach `least` alone: their part of its length is smaller, or the
    products with the other side's largest weights are. Where two texts share none of the terms that are
    left, all shared ones lie at the end of one of the two, so the pair is below `least`. A term
    that is frequent is dealt out by the right texts' keys.
    """
    bound = least - 1e-9
    of = lambda df, side: df.groupBy("term").agg(F.max("weight").alias(f"top_{side}"), F.count("*").alias(f"n_{side}"))
    terms = of(left, a).join(of(right, b), "term")

    def prefix(df, side, other):
        last = Window.partitionBy(key).orderBy(F.desc(f"n_{b}"), "term").rowsBetween(Window.unboundedPreceding, 0)
        rows = df.join(terms, "term").select(
            F.col(key).alias(side), "term", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(last)).alias("part"),
            F.sum(F.col("weight") * F.col(f"top_{other}")).over(last).alias("most")
        )
        return rows.where(F.least("part", "most") >= bound).select(side, "term")

    pairs = dealt_join(prefix(right, b, a), prefix(left, a, b), "term", b).select(a, b).distinct()
    return similarity(left, key, pairs, a, b, right).where(F.col("cosine") >= least)


def points(cosine, bands: tuple = ((0.35, 15), (0.20, 8))):
    out = F.lit(0)
    for least, p in sorted(bands):
        out = F.when(cosine >= least, p).otherwise(out)
    return out


def group_similarity(texts: DataFrame, group: str, place: str, text: str, most: int = 8_000, best_of: int = 5) -> DataFrame:
    """(group, n_texts, similarity, points): the best cosine of a group's own text, at place 0, with its others, at places
    1 to best_of. Each group is a corpus of its own.

    Terms are words and pairs of words of two characters or more; the `most` with the highest count in the group are taken,
    of equals the first. A weight is (1 + ln tf) * (1 + ln((1 + n) / (1 + df))) with n and df of the group. Groups
    without an own text or without others (null and empty ones are none) are left out; without a common term it is 0.
    Terms are added up by group and term before a group's rows meet; a group holds best_of + 1 texts at most."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = texts.select(F.col(group).alias("g"), F.col(place).cast("int").alias("i"), low.alias("t")).where(F.col("i").between(0, best_of) & (F.trim("t") != ""))
    whole = F.count("*").alias("n_texts"), F.max((F.col("i") == 0).cast("int")).alias("own")
    groups = rows.groupBy("g").agg(*whole).where("own = 1 and n_texts > 1").select("g", "n_texts")
    words = rows.select("g", "i", F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, size(w))"), lambda a, b: F.concat_ws(" ", a, b))
    each = words.select("g", "i", F.explode(F.concat("w", pairs)).alias("term"))
    tf = [F.count_if(F.col("i") == k).alias(f"t{k}") for k in range(best_of + 1)]
    by_term = each.groupBy("g", "term").agg(F.count("*").alias("total"), *tf)
    first = Window.partitionBy("g").orderBy(F.desc("total"), "term")
    by_term = by_term.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).join(groups, "g")
    df = sum((F.col(f"t{k}") > 0).cast("int") for k in range(best_of + 1))
    by_term = by_term.withColumn("idf", 1 + F.log((1 + F.col("n_texts")) / (1 + df)))
    w = [F.when(F.col(f"t{k}") > 0, (1 + F.log(f"t{k}")) * F.col("idf")).otherwise(0.0) for k in range(best_of + 1)]
    sums = by_term.select("g", *(x.alias(f"w{k}") for k, x in enumerate(w))).groupBy("g").agg(
        *(F.sqrt(F.sum(F.col(f"w{k}") * F.col(f"w{k}"))).alias(f"l{k}") for k in range(best_of + 1)),
        *(F.sum(F.col("w0") * F.col(f"w{k}")).alias(f"d{k}") for k in range(1, best_of + 1))
    )
    cosines = [F.when(F.col(f"d{k}") > 0, F.col(f"d{k}") / (F.col("l0") * F.col(f"l{k}"))).otherwise(0.0) for k in range(1, best_of + 1)]
    best = F.coalesce(F.array_max(F.array(*cosines)), F.lit(0.0))
    out = groups.join(sums, "g", "left").select(F.col("g").alias(group), "n_texts", best.alias("similarity"))
    return out.withColumn("points", points(F.col("similarity")))
