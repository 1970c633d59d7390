"""Filters and aggregates of a filtered cohort: key figures, trends, matrices, searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmill.operators.ranks import quantiles, top_per_group

c = F.col


@dataclass(frozen=True)
class Filters:
    """What a cohort is restricted to; None or empty: not restricted. Columns: state, specialty, country; year, type, relevant."""

    states: tuple = ()
    specialties: tuple = ()
    countries: tuple = ()
    years: tuple | None = None
    types: tuple = ()
    relevant: bool | None = None
    text: str | None = None


def members(df: DataFrame, f: Filters) -> DataFrame:
    """State and country by equality, specialties by any of them inside the text."""
    out = df.where(c("state").isin(*f.states)) if f.states else df
    out = out.where(F.exists(F.array(*map(F.lit, f.specialties)), lambda s: c("specialty").contains(s))) if f.specialties else out
    return out.where(c("country").isin(*f.countries)) if f.countries else out


def works(df: DataFrame, f: Filters) -> DataFrame:
    """Years, both ends included (works without a year go), types, relevance and a literal text in the title."""
    out = df.where(c("year").between(*f.years)) if f.years else df
    out = out.where(c("type").isin(*f.types)) if f.types else out
    out = out.where(c("relevant") == f.relevant) if f.relevant is not None else out
    return out.where(F.lower("title").contains(f.text.lower())) if f.text else out


def accepted(df: DataFrame, flag: str, tier: str, name: str) -> DataFrame:
    """Accepted names: by the flag if any row has it, else by tier HIGH, else all."""
    have = df.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("_f"), F.coalesce(F.bool_or(c(tier) == "HIGH"), F.lit(False)).alias("_t"))
    return df.join(F.broadcast(have)).where(
        F.when(c("_f"), F.coalesce(c(flag), F.lit(False))).when(c("_t"), c(tier) == "HIGH").otherwise(True)
    ).select(name).distinct()


def only(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    """Rows whose column is among the names' only column."""
    n = names.toDF("_n")
    return df.join(n, df[col] == n["_n"], "left_semi")


def plausible_years(df: DataFrame, year: str, least: int = 1960) -> DataFrame:
    return df.where(c(year).isNull() | (c(year) >= least))


def text_search(df: DataFrame, cols: list[str], query: str) -> DataFrame:
    """Rows that hold the query, literally and without regard to case, in one of the columns."""
    q = query.lower()
    hit = F.lit(False)
    for x in cols:
        hit = hit | F.coalesce(F.lower(x).contains(q), F.lit(False))
    return df.where(hit)


def search_text(*cols: str) -> Column:
    """Lower-cased text of several columns for literal search."""
    return F.lower(F.trim(F.concat_ws(" ", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in cols])))


def trend(df: DataFrame, year: str, flag: str, since: int = 2005) -> DataFrame:
    """Per year: rows with the flag and others."""
    return df.where(c(year) >= since).groupBy(year).agg(
        F.count_if(c(flag)).alias("relevant"), F.count_if(~F.coalesce(c(flag), F.lit(False))).alias("other")
    )


def top_groups(df: DataFrame, col: str, k: int, blank: str = "(unknown)") -> DataFrame:
    """The k most frequent values, blanks under a name, ties by value."""
    value = F.when(F.coalesce(F.trim(col), F.lit("")) == "", blank).otherwise(c(col))
    return df.groupBy(value.alias(col)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def in_order(df: DataFrame, col: str, order: list[str], other: str = "Unknown") -> DataFrame:
    """Counts by value, in a given order, then others; blanks under `other`."""
    value = F.when(F.coalesce(F.trim(col), F.lit("")) == "", other).otherwise(c(col))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), c(col)).cast("int"), F.lit(0))
    return df.groupBy(value.alias(col)).agg(F.count("*").alias("n")).withColumn(
        "place", F.when(place == 0, len(order) + 1).otherwise(place)
    ).orderBy("place", col)


def matrix(df: DataFrame, row: str, col: str, k_rows: int, k_cols: int | None = None) -> DataFrame:
    """Counts of row x col as (row, col, n), zeros too, for the k most frequent rows (and columns)."""
    rows = top_groups(df.where(c(row).isNotNull()), row, k_rows).select(row)
    cols = (
        top_groups(
            df.where(c(col).isNotNull()), col, k_cols
        ) if k_cols else df.where(c(col).isNotNull()).join(rows, row, "left_semi").select(col).distinct()
    ).select(col)
    counts = df.join(F.broadcast(rows), row, "left_semi").groupBy(row, col).agg(F.count("*").alias("n"))
    return cols.join(F.broadcast(rows)).join(counts, [row, col], "left").na.fill(0, ["n"])


def quantile_bands(df: DataFrame, metrics: list[str], points: tuple = (0.25, 0.5, 0.75, 0.95), approximate: bool = False) -> DataFrame:
    """Per metric: n and its quantiles, interpolated; approximate ones need bounded memory."""
    long = df.select(*[c(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    if approximate:
        out = long.groupBy("metric").agg(F.count("value").alias("n"), F.percentile_approx("value", F.array(*map(F.lit, points))).alias("q"))
    else:
        out = quantiles(long, ["metric"], "value", points)
    return out.select("metric", "n", *[c("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def histogram(df: DataFrame, metric: str, bins: int) -> DataFrame:
    """bin (0 to bins - 1), n, and the lower edge, over equal widths from least to greatest; empty bins have 0."""
    ends = df.agg(F.min(metric).cast("double").alias("lo"), F.max(metric).cast("double").alias("hi"))
    width = F.when(c("hi") > c("lo"), (c("hi") - c("lo")) / bins).otherwise(1.0)
    rows = df.where(c(metric).isNotNull()).join(F.broadcast(ends)).select(
        F.least(F.floor((c(metric) - c("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")
    )
    all_bins = df.sparkSession.range(bins).select(c("id").cast("int").alias("bin")).join(F.broadcast(ends)).withColumn(
        "edge", c("lo") + c("bin") * width
    )
    return all_bins.join(rows.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", "edge", F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(hist: DataFrame, sigma: float = 1.2, reach: int = 5) -> DataFrame:
    """A histogram with its counts weighted over `reach` bins to each side by a gaussian; weights that fall outside are left out."""
    import math

    w = W.orderBy("bin")  # a histogram is a few dozen rows
    terms, weights = F.lit(0.0), F.lit(0.0)
    for d in range(-reach, reach + 1):
        g = math.exp(-0.5 * (d / sigma) ** 2)
        n = F.lag("n", -d).over(w) if d else c("n")
        terms, weights = terms + F.coalesce(n, F.lit(0)) * g, weights + F.when(n.isNotNull(), g).otherwise(0.0)
    return hist.withColumn("smooth", terms / weights)


def box(df: DataFrame, by: str, metric: str) -> DataFrame:
    """Per group: n, least, quartiles, greatest, mean, standard deviation; rows without a group are left out."""
    rows = df.where(c(metric).isNotNull())
    sums = rows.groupBy(by).agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.avg(metric).alias("mean"), F.stddev(metric).alias("sd"))
    q = quantiles(rows, [by], metric, (0.25, 0.5, 0.75))
    return q.join(sums, by).select(by, "n", "lo", c("q")[0].alias("q1"), c("q")[1].alias("median"), c("q")[2].alias("q3"), "hi", "mean", "sd")


def enough(df: DataFrame, metrics: list[str], least: int = 5) -> DataFrame:
    """(metric, value) rows of the metrics with at least so many values."""
    long = df.select(*[c(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value").where("value is not null")
    return long.join(F.broadcast(long.groupBy("metric").agg(F.count("*").alias("n")).where(c("n") >= least).select("metric")), "metric", "left_semi")


def key_figures(roster: DataFrame, works_: DataFrame, links: DataFrame, trials: DataFrame, awards: DataFrame) -> DataFrame:
    """One row: members, linked members, works, relevant works, citations, trials, awards and funded members."""
    parts = [
        roster.agg(F.count("*").alias("n_members")), links.agg(F.count_distinct("member").alias("n_linked")),
        works_.agg(
            F.count("*").alias("n_works"), F.count_if(c("relevant")).alias("n_relevant"),
            F.coalesce(F.sum("citations"), F.lit(0)).alias("citations")
        ),
        trials.agg(F.count_distinct("trial_id").alias("n_trials")),
        awards.agg(F.count("*").alias("n_awards"), F.count_distinct("member").alias("n_funded_members")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.withColumn(
        "linked_pct", F.when(c("n_members") > 0, 100 * c("n_linked") / c("n_members")).otherwise(0.0)
    ).withColumn("relevant_pct", F.when(c("n_works") > 0, 100 * c("n_relevant") / c("n_works")).otherwise(0.0))


def expertise(df: DataFrame, member: str, topic: str, citations: str) -> DataFrame:
    """Works and citations per member and topic."""
    return df.where(c(topic).isNotNull()).groupBy(member, topic).agg(F.count("*").alias("works"), F.sum(citations).alias("citations"))


def experts(df: DataFrame, member: str, topic: str, title: str, citations: str, keyword: str, k: int = 25) -> DataFrame:
    """The k members with most works whose topic or title holds the keyword; a work that does in both counts twice."""
    q = keyword.lower()
    by_topic = df.where(F.lower(topic).contains(q))
    by_title = df.where(F.lower(title).contains(q))
    both = by_topic.unionByName(by_title).groupBy(member).agg(F.count("*").alias("works"), F.sum(citations).alias("citations"))
    return both.orderBy(F.desc("works"), F.desc("citations"), member).limit(k)


def top_terms(df: DataFrame, member: str, terms: str, k: int, sep: str = "\\|", least: int = 3) -> DataFrame:
    """The k most frequent terms of each member, lower case, of some length."""
    rows = df.select(
        member, F.explode(F.split(terms, sep)).alias("term")
    ).withColumn("term", F.lower(F.trim("term"))).where(F.length("term") >= least)
    return top_per_group(rows.groupBy(member, "term").agg(F.count("*").alias("n")), [member], [F.desc("n"), "term"], k)


def modal(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, of several the smallest."""
    return top_per_group(df.where(c(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n")), [by], [F.desc("n"), value], 1)


def first_owner(works_: DataFrame, work: str, authors: str, members_: DataFrame, member: str) -> DataFrame:
    """Works with the member of the first author whose last word and first initial fit; the smallest name of several."""
    from linkmill.operators.linkage import fitting

    met = fitting(works_.select(work, F.posexplode(authors).alias("at", "name")), "name", members_, member).groupBy(work)
    met = met.agg(F.min(F.struct("at", "owner")).alias("x"), F.min("owner").alias("least"), F.max("owner").alias("most"))
    return met.select(work, c("x.owner").alias("owner"), (c("least") != c("most")).alias("ambiguous"))


def options(df: DataFrame, col: str, sep: str | None = None) -> DataFrame:
    """Distinct non-blank values in order, exploded where a separator is given."""
    value = F.explode(F.split(col, sep)) if sep else c(col)
    return df.select(F.trim(value).alias(col)).where(F.coalesce(c(col), F.lit("")) != "").distinct().orderBy(col)


def progress(df: DataFrame, action: str) -> DataFrame:
    """Rows, decided ones, by action."""
    return df.agg(
        F.count("*").alias("total"), F.count(action).alias("done"),
        F.count_if(c(action).startswith("accept")).alias("accepted"),
        F.count_if(c(action) == "reject").alias("rejected")
    )


def snapshot(figures: DataFrame, top_members: DataFrame, topics: DataFrame, states: DataFrame) -> DataFrame:
    """A report as rows (section, place, line): figures, members, topics, states. Inputs are short lists with (name, n)."""
    f = figures.select(*[c(x).cast("double").alias(x) for x in figures.columns]).unpivot([], figures.columns, "name", "n")
    out = None
    for section, df in (("figures", f), ("members", top_members), ("topics", topics), ("states", states)):
        rows = df.select(
            F.lit(section).alias("section"), F.row_number().over(W.orderBy(F.desc("n"), "name")).alias("place"),
            F.concat_ws(": ", "name", F.format_number(c("n").cast("double"), 0)).alias("line")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def worklist(review: DataFrame, flagged: DataFrame, resolved: DataFrame, decisions: DataFrame, name: str) -> DataFrame:
    """Names under review or flagged, once each, with their link and decision, and whether they are each."""
    r, g = review.select(name).distinct().withColumn("in_review", F.lit(True)), flagged.select(name).distinct().withColumn("is_flagged", F.lit(True))
    out = r.join(g, name, "full").na.fill(False, ["in_review", "is_flagged"]).join(resolved, name, "left").join(decisions, name, "left")
    return out.withColumn("decided", c("action").isNotNull())


def eligible(
    links: DataFrame, tier: str, id_: str, priority: str, name: str, tiers: tuple = ("HIGH", "REVIEW"),
    must_only: bool = False
) -> DataFrame:
    """Links whose works are fetched: of these tiers, with an id; must before nice, then by name."""
    out = links.where(c(tier).isin(*tiers) & (F.coalesce(F.trim(id_), F.lit("")) != ""))
    out = out.where(c(priority) == "must") if must_only else out
    return out.orderBy(F.when(c(priority) == "must", 0).when(c(priority) == "nice", 1).otherwise(2), name)


def stage_names(links: DataFrame, tier: str, name: str, tiers: tuple = ("HIGH",)) -> DataFrame:
    """Links of these tiers whose normalised name isn't empty."""
    from linkmill.functions.names import normalise_name

    return links.where(c(tier).isin(*tiers) & (normalise_name(c(name)) != ""))


def lacking(links: DataFrame, id_: str, metric: str) -> DataFrame:
    """Links with an id whose metric is null or 0."""
    return links.where((F.coalesce(F.trim(id_), F.lit("")) != "") & (F.coalesce(c(metric), F.lit(0)) == 0))


def scatter(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key and metrics of the rows that have all of them."""
    return df.select(key, *metrics).na.drop(subset=metrics)


def concentration(df: DataFrame, value: str, key: str, k: int = 60) -> DataFrame:
    """The k rows with the largest positive value; ties by key."""
    return df.where(c(value) > 0).orderBy(F.desc(value), key).limit(k)


def impact(df: DataFrame, h: str, fwci: str, citations: str) -> DataFrame:
    """One row: rows, the median of h (exact, from running counts), the mean of fwci, all citations."""
    median = quantiles(df, [], h, (0.5,)).select(c("q")[0].alias("median_h"))
    sums = df.agg(F.count("*").alias("n"), F.avg(fwci).alias("mean_fwci"), F.coalesce(F.sum(citations), F.lit(0)).alias("citations"))
    return sums.join(F.broadcast(median)).select("n", "median_h", "mean_fwci", "citations")  # one row each


def trial_report(df: DataFrame, trial: str, member: str, status: str, start: str, k: int = 15) -> DataFrame:
    """Rows (section, label, n): trials in all, members, trials by status and by start year, the k members with most."""
    none = F.lit(None).cast("string")
    n = F.count_distinct(trial).alias("n")
    by = lambda section, label: df.groupBy(label.alias("label")).agg(n).select(F.lit(section).alias("section"), "label", "n")
    out = df.agg(n).select(F.lit("total").alias("section"), none.alias("label"), "n")
    out = out.unionByName(df.agg(F.count_distinct(member).alias("n")).select(F.lit("members").alias("section"), none.alias("label"), "n"))
    out = out.unionByName(by("status", c(status))).unionByName(by("year", F.left(start, F.lit(4))))
    most = df.groupBy(member).agg(n).orderBy(F.desc("n"), member).limit(k)
    return out.unionByName(most.select(F.lit("investigator").alias("section"), c(member).cast("string").alias("label"), "n"))


def heat_rows(df: DataFrame, member: str, year: str, topic: str) -> DataFrame:
    """Works by member, year and topic, in long form."""
    return df.groupBy(member, year, topic).agg(F.count("*").alias("n"))


def of_member(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one member."""
    return df.where(c(key) == value)


def works_of_hits(works_: DataFrame, hits: DataFrame, work: str) -> DataFrame:
    """Works that a search of the index found."""
    return works_.join(hits.select(work).distinct(), work, "left_semi")


def grid_figures(df: DataFrame, citations: str, is_open: str) -> DataFrame:
    """One row: works, citations, open ones."""
    return df.agg(F.count("*").alias("works"), F.coalesce(F.sum(citations), F.lit(0)).alias("citations"), F.count_if(is_open).alias("open"))


def with_members(found: DataFrame, members_: DataFrame, stats: DataFrame, name: str, order: list) -> DataFrame:
    """Search results with each member's columns and figures, one row a member: of several rows of a name in
    members_ or stats the first by `order`, of columns that both have. Names without a row keep nulls."""
    first = lambda df: top_per_group(df, [name], order, 1)
    mine, figures = first(members_), first(stats).drop(*(x for x in members_.columns if x != name))
    return found.join(mine, name, "left").join(figures, name, "left")


def roster_view(df: DataFrame, tiers: tuple = ("HIGH",), state: str | None = None, priority: str | None = None) -> DataFrame:
    """Members of some tiers (any case), HIGH unless told, of a state and a priority; None and `All` are no filter."""
    out = df.where(c("tier").isin(*(x.upper() for x in tiers)))
    for name, value in (("state", state), ("priority", priority)):
        out = out.where(c(name) == value) if value not in (None, "All", "") else out
    return out
