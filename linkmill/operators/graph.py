"""Graphs of members that share works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.functions import vocab as V

#: Members of a work, about, in one part of its join.
PART = 1_000
#: Rows or pairs of a task, about.
TASK_ROWS = 250_000


def coauthor_edges(links: DataFrame, member: str, work: str, least: int = 1, most_members: int | None = None) -> DataFrame:
    """Unordered pairs of members (a < b) with the number of works they share, if that is `least` or more.

    Members meet in a join on the work. A work with more than PART members is dealt into parts: each member
    stands in one part on the left and in all on the right, so no list of a work is gathered in one row.
    Links and pairs are counted first, so that a task has about TASK_ROWS of them however many there are.
    most_members leaves out works with more (a consortium list says little about two members)."""
    tasks = lambda n: max(1, -(-int(n) // TASK_ROWS))
    rows = links.select(F.col(work).alias("w"), F.col(member).alias("m")).where("w is not null and m is not null")
    rows = rows.repartition(tasks(links.count()), "w", "m").distinct()
    size = rows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    if most_members:
        size = size.where(F.col("n") <= most_members)
    n = F.col("n").cast("double")
    n_right, n_pairs = (x or 0 for x in size.agg(F.sum(n * F.ceil(n / PART)), F.sum(n * (n - 1) / 2)).first())
    rows = rows.join(size.select("w", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "w")
    left = rows.select("w", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("part"), F.col("m").alias("a"))
    right = rows.select("w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("m").alias("b"))
    left, right = (x.repartition(tasks(n_right), "w", "part") for x in (left, right))
    pairs = left.join(right, ["w", "part"]).where("a < b").repartition(tasks(n_pairs), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def degrees(edges: DataFrame, hub: int = 15, strong: int = 6) -> DataFrame:
    """Per member: neighbours, weighted degree and its class."""
    ends = edges.select(F.col("a").alias("member"), "weight").unionByName(edges.select(F.col("b").alias("member"), "weight"))
    out = ends.groupBy("member").agg(F.count("*").alias("neighbours"), F.sum("weight").alias("degree"))
    return out.withColumn("role", F.when(F.col("degree") >= hub, "hub").when(F.col("degree") >= strong, "strong").otherwise("other"))


def graph_stats(links: DataFrame, member: str, work: str, least: int = 2) -> DataFrame:
    """One row: nodes and edges of weight `least` or more, the greatest weight over all pairs, density in percent."""
    edges = coauthor_edges(links, member, work)
    strong = edges.where(F.col("weight") >= least)
    nodes = strong.select(F.explode(F.array("a", "b")).alias("m")).agg(F.count_distinct("m").alias("n_nodes"))
    sums = edges.agg(F.count_if(F.col("weight") >= least).alias("n_edges"), F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"))
    out = nodes.join(F.broadcast(sums))
    n = F.col("n_nodes")
    return out.withColumn("density_pct", F.when(n > 1, 200 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0))


def seed_ring(candidates: DataFrame, links: DataFrame, seeds: DataFrame, member: str, work: str, bonus: int = 30) -> DataFrame:
    """Candidates that share a work with a seed: candidate, shared works, shared seeds, bonus.

    candidates and seeds each have the member column; a member of both is not its own seed."""
    mine = links.join(candidates.select(member).distinct(), member, "left_semi").select(F.col(member).alias("candidate"), work).distinct()
    theirs = links.join(seeds.select(member).distinct(), member, "left_semi").select(F.col(member).alias("seed"), work).distinct()
    met = mine.join(theirs, work).where("candidate <> seed")
    return met.groupBy("candidate").agg(
        F.count_distinct(work).alias("shared_works"), F.count_distinct("seed").alias("shared_seeds")
    ).withColumn("bonus", F.lit(bonus))


def promoted(
    review: DataFrame, ring: DataFrame, member: str, author: str, on: list[str], accept: int = 110, first: int = 5
) -> DataFrame:
    """Links under review after the seed ring: total_score and score_verdict with the ring's bonus, tier, accepted, method, note.

    ring: seed_ring() of the authors. A link whose author shares works with a seed gets the bonus, unless the author
    has works but none of the first topics is of the domain; from `accept` points on it becomes HIGH. Others stay as they
    are. Needs total_score, score_verdict, tier, accepted, method, works, labels; nulls of figures count as 0."""
    r = ring.select(F.col("candidate").alias("_c"), F.col("shared_works").alias("_n"), F.col("bonus").alias("_b"))
    out = review.join(r, review[author] == r["_c"], "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    shares = zero("_n") > 0
    vetoed = shares & (zero("works") > 0) & (V.count_on(F.col("labels"), on, first) == 0)
    better = shares & ~vetoed
    score = zero("total_score") + F.col("_b")
    high = better & (score >= accept)
    note = F.when(vetoed, F.concat(F.lit("shared works but no topic of the domain in "), zero("works"), F.lit(" works")))
    note = note.when(better, F.concat("_n", F.lit(" shared works: "), zero("total_score"), F.lit(" + "), "_b", F.lit(" = "), score))
    new = {
        "total_score": F.when(better, score).otherwise(F.col("total_score")),
        "score_verdict": F.when(better, zero("score_verdict") + F.col("_b")).otherwise(F.col("score_verdict")),
        "tier": F.when(high, "HIGH").otherwise(F.col("tier")), "accepted": high | F.coalesce("accepted", F.lit(False)),
        "method": F.when(high, "shared_works").otherwise(F.col("method")), "note": note,
    }
    return out.select(*(F.col(x) for x in review.columns if x not in new), *(v.alias(k) for k, v in new.items()))


def top_coauthors(works: DataFrame, member: str, names: str, own: str, k: int = 30) -> DataFrame:
    """The k names that stand most often beside each member's in an array of names; names with the own surname are left out."""
    from linkmill.operators.ranks import top_per_group

    rows = works.select(member, own, F.explode(names).alias("name")).where(~F.lower("name").contains(F.lower(F.col(own))) & (F.trim("name") != ""))
    return top_per_group(rows.groupBy(member, "name").agg(F.count("*").alias("n")), [member], [F.desc("n"), "name"], k)


def ego(edges: DataFrame, member) -> DataFrame:
    """A member's neighbours with weights."""
    return edges.where((F.col("a") == member) | (F.col("b") == member)).select(
        F.when(F.col("a") == member, F.col("b")).otherwise(F.col("a")).alias("neighbour"), "weight"
    )


def ego_of(links: DataFrame, member: str, work: str, one) -> DataFrame:
    """What ego() finds in coauthor_edges(), from the works of the one member: no pairs of others are made."""
    rows = links.select(F.col(work).alias("w"), F.col(member).alias("m")).where("w is not null and m is not null")
    own = rows.where(F.col("m") == one).select("w").distinct()
    others = rows.where(F.col("m") != one).join(own, "w", "left_semi").distinct()
    return others.groupBy(F.col("m").alias("neighbour")).agg(F.count("*").alias("weight"))
