"""Members of a roster with their links: context, metrics, names, backfills, and score variants by name parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmill.functions import names as N
from linkmill.functions import similarity as S
from linkmill.functions import vocab as V
from linkmill.operators import merge
from linkmill.operators.linkage import codes, prepared, topic_labels
from linkmill.operators.ranks import top_per_group

c = F.col


def context(members: DataFrame, name: str, texts: list[str], hospitals: str, practices: str) -> DataFrame:
    """members with trimmed text columns, the normalised name, all free text as one, and places to look for."""
    kinds = dict(members.dtypes)
    out = members.select(*[F.trim(F.coalesce(x, F.lit(""))).alias(x) if kinds[x] == "string" else c(x) for x in members.columns])
    filled = [F.nullif(c(t), F.lit("")) for t in texts]
    return out.withColumn("norm_name", N.normalise_name(c(name))).withColumn("free_text", F.concat_ws(" ", *filled)).withColumn(
        "places", F.array_distinct(F.concat(N.pipe_patterns(c(hospitals)), N.pipe_patterns(c(practices))))
    )


def joined(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """base with other's columns; where both have a column other's holds."""
    return base.drop(*[x for x in other.columns if x in base.columns and x != key]).join(other, key, "left")


def detail(members: DataFrame, stats: DataFrame, key: str, from_stats: list[str]) -> DataFrame:
    """members and stats side by side; the listed columns come from stats where it has them."""
    s = stats.select(key, *[c(x).alias(f"_s_{x}") for x in from_stats])
    out = members.join(s, key, "left")
    return out.select(
        *[c(x) for x in members.columns if x not in from_stats],
        *[F.coalesce(f"_s_{x}", x if x in members.columns else F.lit(None)).alias(x) for x in from_stats]
    )


def mapped(df: DataFrame, key: str, table: DataFrame, value: str, otherwise: str = "Unknown") -> DataFrame:
    """df with a value looked up in a table that has a row per key."""
    return df.join(table.select(key, value), key, "left").na.fill(otherwise, [value])


def author_metrics(authors: DataFrame, local: tuple = ("AU", "NZ")) -> DataFrame:
    """id, works, citations, h, institution, country, ever_local, now_local and labels of author records."""
    every, now = codes(authors)
    here = F.array(*map(F.lit, local))
    first = F.try_element_at(c("last_known_institutions"), F.lit(1))
    return authors.select(
        N.last_segment(c("id")).alias("id"), "display_name", c("works_count").alias("works"),
        c("cited_by_count").alias("citations"), c("summary_stats.h_index").alias("h"),
        first["display_name"].alias("institution"), F.upper(first["country_code"]).alias("country"),
        F.arrays_overlap(F.concat(every, now), here).alias("ever_local"),
        F.arrays_overlap(now, here).alias("now_local"), topic_labels(c("topics")).alias("labels"),
    )


def refreshed(links: DataFrame, metrics: DataFrame, author: str) -> DataFrame:
    """Links with fresh metrics of their author; links without a record keep theirs."""
    shared = [x for x in metrics.columns if x in links.columns and x != author]
    return merge.upsert(links.dropDuplicates(), metrics.select(author, *shared), [author], shared, insert=False)


def override_links(links: DataFrame, overrides: DataFrame, metrics: DataFrame, member: str, author: str) -> DataFrame:
    """Forced ids on all links, with the id's metrics and tier HIGH; members without a link get one."""
    o = overrides.select(c("name").alias(member), c("id").alias(author)).join(metrics, author, "left").withColumn("tier", F.lit("HIGH"))
    cols = [x for x in o.columns if x in links.columns and x != member]
    return merge.upsert(links, o, [member], cols)


def first_last_matches(left: DataFrame, right: DataFrame, left_name: str, right_name: str, unique: bool = True) -> DataFrame:
    """Pairs with the same first and last word. unique: only words that one right row has; else the greatest name of several."""
    a = left.withColumn("_fl", N.first_last(N.normalise_name(c(left_name)))).where("_fl != ''")
    b = right.withColumn("_fl", N.first_last(N.normalise_name(c(right_name)))).where("_fl != ''")
    if unique:
        b = b.join(b.groupBy("_fl").agg(F.count("*").alias("_n")).where("_n = 1").select("_fl"), "_fl", "left_semi")
    else:
        b = top_per_group(b, ["_fl"], [F.desc(right_name)], 1)
    return a.join(b, "_fl").drop("_fl")


def backfilled(review: DataFrame, found: DataFrame, name: str, rank: str) -> DataFrame:
    """For each name the found record with the same display name, else the first by rank: name, id, exact. found has (name, display_name, id)."""
    rows = review.select(name).distinct().join(found, name).withColumn("exact", F.lower(F.trim(name)) == F.lower(F.trim("display_name")))
    return top_per_group(rows, [name], [F.desc("exact"), rank, "id"], 1).select(name, "id", "exact")


def retitled(members: DataFrame, found: DataFrame, name: str, manual: DataFrame | None = None) -> DataFrame:
    """members with the title before the name replaced by the found one (name, title); a manual list wins."""
    t = found.select(name, c("title").alias("_t"))
    if manual is not None:
        t = t.join(manual.select(name), name, "left_anti").unionByName(manual.select(name, c("title").alias("_t")))
    out = members.join(t, name, "left")
    return out.withColumn(
        "new_name",
        F.when(F.coalesce("_t", F.lit("")) != "", F.concat_ws(" ", "_t", N.strip_title(c(name)))).otherwise(c(name))
    ).drop("_t")


def thin_stats(links: DataFrame, cols: list[str]) -> DataFrame:
    """Accepted links as a statistics table of the given columns."""
    return links.where("tier = 'HIGH'").select(*cols)


def demoted(links: DataFrame, listed: DataFrame, rejected: DataFrame, member: str, author: str) -> tuple[DataFrame, DataFrame]:
    """Listed pairs (name, id) go from HIGH to REVIEW and onto the list of rejected pairs, once each."""
    mark = listed.select(c("name").alias(member), c("id").alias(author)).distinct().withColumn("_hit", F.lit(True))
    out = links.join(mark, [member, author], "left").withColumn(
        "tier", F.when(c("_hit") & (c("tier") == "HIGH"), "REVIEW").otherwise(c("tier"))
    ).drop("_hit")
    return out.select(*links.columns), merge.keyed_append(listed.select("name", "id"), rejected, ["name", "id"])


def profile(member_ids: DataFrame, details: DataFrame, key: str, author: str, lists: list[str]) -> DataFrame:
    """Members with array columns of their author's details; empty arrays without any."""
    out = member_ids.select(key, author).join(details.select(author, *lists), author, "left")
    kinds = {f.name: f.dataType for f in details.schema.fields}
    return out.select(key, *[F.coalesce(x, F.array().cast(kinds[x])).alias(x) for x in lists])


def verdict_lists(verdicts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """From outside verdicts: title changes (title differs from the found one), and pairs that are false."""
    changes = verdicts.where(
        (F.coalesce("found_title", F.lit("")) != "") & (F.lower("found_title") != N.title_of(c(name)))
    ).select(name, c("found_title").alias("title"))
    return changes, verdicts.where(~c("match") & c("id").isNotNull()).select(c(name).alias("name"), "id").distinct()


def works_in_range(works: Column, lo: int, hi: int, points: int, above: int = 0) -> Column:
    return F.when(works.between(lo, hi), points).when(works > hi, above).otherwise(0)


def score_contained(member: Column, found: Column, local: Column, on: Column, works: Column, h: Column) -> Column:
    """Points where the last word lies inside the found name (40) and the first word or its initial does (20)."""
    m, f = N.strip_title(F.lower(member)), F.lower(found)
    words = F.filter(F.split(F.trim(m), "\\s+"), lambda t: t != "")
    last, first = F.try_element_at(words, F.lit(-1)), F.when(F.size(words) > 1, F.try_element_at(words, F.lit(1)))
    hit = f.contains(last)
    name = F.when(hit, 40 + F.when(first.isNotNull() & f.contains(F.left(first, F.lit(1))), 20).otherwise(0)).otherwise(0)
    total = name + F.when(local, 25).otherwise(0) + F.when(on, 15).otherwise(0) + works_in_range(
        works, 5, 500, 10, 5
    ) + F.when(h >= 10, 5).otherwise(0)
    return F.when(F.size(words) == 0, 0).otherwise(total)


def ratio_points(m_last: Column, m_first: Column, f_last: Column, f_first: Column) -> Column:
    """Points by the similarity of last names (50, 35, 15) and first names (20, 12 for the initial, else -10); null if the
    last names are no match."""
    last = S.ratio(F.lower(m_last), F.lower(f_last))
    first = S.ratio(F.lower(m_first), F.lower(f_first))
    both = (F.coalesce(m_first, F.lit("")) != "") & (F.coalesce(f_first, F.lit("")) != "")
    given = F.when(~both, 0).when(first >= 90, 20).when(F.lower(F.left(m_first, F.lit(1))) == F.lower(F.left(f_first, F.lit(1))), 12).otherwise(-10)
    return F.when(last >= 95, 50).when(last >= 85, 35).when(last >= 70, 15) + given


def score_with(points: Column, m_last: Column, f_last: Column, local: Column, on: Column, works: Column) -> Column:
    """score_ratio() with ratio_points() that are known already."""
    total = points + F.when(local, 15).otherwise(0) + F.when(on, 10).otherwise(0) + works_in_range(works, 1, 600, 5)
    return F.when((F.coalesce(m_last, F.lit("")) == "") | (F.coalesce(f_last, F.lit("")) == ""), 0).otherwise(F.coalesce(total, F.lit(0)))


def score_ratio(m_last: Column, m_first: Column, f_last: Column, f_first: Column, local: Column, on: Column, works: Column) -> Column:
    """Points by the similarity of last names (50, 35, 15; less is no match) and first names (20, 12 for the initial, else -10)."""
    return score_with(ratio_points(m_last, m_first, f_last, f_first), m_last, f_last, local, on, works)


def score_first_last(first: Column, last: Column, found: Column, ever_local: Column, now_local: Column, n_on: Column, works: Column) -> Column:
    """Points for last (40) and first name (30) inside the found name; local history is required, and with
    history only a topic of the domain too."""
    f = F.lower(found)
    given = F.when(f.contains(F.lower(first)) | f.startswith(F.lower(F.left(first, F.lit(1)))), 30).otherwise(0)
    total = 40 + given + F.when(now_local, 25).otherwise(15) + F.when(works >= 20, 5).when(works >= 5, 2).otherwise(0)
    return F.when(~f.contains(F.lower(last)) | ~ever_local | (~now_local & (n_on == 0)), 0).otherwise(total)


# Least points that the variants accept.
VARIANT_ACCEPT = {"strict": 80, "loose": 75, "ratio": 35, "contained": 30, "graded": 85, "topical": 45}


def accepted_variant(pairs: DataFrame, variant: str, member: str, score: str, rank: str, author: str) -> DataFrame:
    """The best candidate of each member, where it reaches what the variant accepts."""
    return top_per_group(pairs, [member], [F.desc(score), rank, author], 1).where(c(score) >= VARIANT_ACCEPT[variant])


def first_last_tier(score: Column, works: Column, n_on: Column) -> Column:
    """MEDIUM from 70 points, else LOW; more than 20 works need a topic of the domain for each 20 of them."""
    from linkmill.operators.linkage import ratio_check

    return F.when((works > 20) & ~ratio_check(works, n_on), "REJECTED").when(score >= 70, "MEDIUM").otherwise("LOW")


def topical_tier(ever_local: Column, n_on: Column) -> Column:
    return F.when(~ever_local | (n_on == 0), "MEDIUM").otherwise("HIGH")


def fp_counts(links: DataFrame, flags: str) -> DataFrame:
    """Links by the number of their doubts."""
    return links.groupBy(F.size(flags).alias("n_flags")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def works_titles(works: DataFrame, author: str, title: str, abstract: str, cites: str, k: int = 5, order: list | None = None) -> DataFrame:
    """Each author's k most cited works as `title. abstract`; ties by `order`, else by title."""
    w = W.partitionBy(author).orderBy(F.desc(cites), *(order or [title]))
    rows = works.withColumn("_r", F.row_number().over(w)).where(c("_r") <= k)
    return rows.select(author, F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))).alias("text"))


def catalog_hit(names: Column, institutions: list[str]) -> Column:
    return V.any_inside(names, institutions)
