"""Nested work, award, trial and page records as flat rows, by expressions over structs and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmill.functions import names as N
from linkmill.operators.joins import once, settled

c = F.col


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _list(arr: Column, f) -> Column:
    """An element of text for each entry, empty text for null; no entries for a null list."""
    return F.coalesce(F.transform(arr, lambda x: _text(f(x))), F.array().cast("array<string>"))


def abstract(index: Column) -> Column:
    """A text from {word: [positions]}, words in order of their positions; empty for null."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " "), F.lit(""))


def author_position(authorships: Column, author: Column) -> Column:
    """first, last or middle; the only author is first; empty if the author is not there."""
    at = F.coalesce(F.array_position(_list(authorships, lambda a: N.strip_id(a["author"]["id"])), N.strip_id(author)), F.lit(0))
    return F.when(at == 0, "").when(at == 1, "first").when(at == F.size(authorships), "last").otherwise("middle")


def is_corresponding(authorships: Column, author: Column) -> Column:
    """Whether the author's first place in the list is a corresponding one."""
    mine = F.filter(authorships, lambda a: N.strip_id(a["author"]["id"]) == N.strip_id(author))
    return F.coalesce(F.try_element_at(mine, F.lit(1))["is_corresponding"], F.lit(False))


def distinct_in(authorships: Column, f) -> Column:
    """How many different non-empty values the authors' lists hold."""
    values = F.flatten(F.transform(authorships, lambda a: F.coalesce(f(a), F.array().cast("array<string>"))))
    return F.coalesce(F.size(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), F.lit(0))


def work_columns(author_name: Column, author_id: Column) -> dict[str, Column]:
    """The 61 columns of a work, in order. Lists stay arrays; export joins them by pipes."""
    none = F.array().cast("array<string>")
    topic, goal = F.try_element_at(c("topics"), F.lit(1)), F.try_element_at(c("sustainable_development_goals"), F.lit(1))
    place, source, top = c("primary_location"), c("primary_location.source"), F.coalesce(c("cited_by_percentile_year.max"), F.lit(-1.0))
    full = F.coalesce(c("has_fulltext"), F.when(F.coalesce(place["pdf_url"], F.lit("")) != "", True).when(place.isNotNull(), False))
    return {
        "work_id": N.strip_id(c("id")), "author": author_name, "doi": N.valid_doi(c("doi")), "title": c("title"),
        "year": c("publication_year"), "date": c("publication_date"), "language": c("language"), "type": c("type"),
        "indexed": F.coalesce(c("indexed_in"), none),
        "countries": distinct_in(c("authorships"), lambda a: a["countries"]),
        "organisations": distinct_in(c("authorships"), lambda a: a["institutions"]["id"]), "fwci": c("fwci"),
        "full_text": full, "citations": c("cited_by_count"), "retracted": c("is_retracted"),
        "locations": F.coalesce(c("locations_count"), F.when(c("locations").isNotNull(), F.size("locations"))),
        "references": c("referenced_works_count"), "pmid": c("ids.pmid"),
        "location_id": F.coalesce(N.strip_id(source["id"]), F.lit("")), "location_oa": place["is_oa"],
        "landing_page": place["landing_page_url"], "pdf": place["pdf_url"], "issn": source["issn_l"],
        "publisher": source["host_organization_name"], "publication_type": source["type"],
        "journal": source["display_name"], "open_access": c("open_access.is_oa"), "oa_type": c("open_access.oa_status"),
        "apc_value": c("apc_list.value"), "apc_currency": c("apc_list.currency"), "apc_usd": c("apc_list.value_usd"),
        "citations_normalised": c("cited_by_percentile_year.min"), "top_1": F.when(top >= 99, "Yes").otherwise("No"),
        "top_10": F.when(top >= 90, "Yes").otherwise("No"), "percentile_min": c("cited_by_percentile_year.min"),
        "percentile_max": c("cited_by_percentile_year.max"), "topic_id": F.coalesce(N.strip_id(topic["id"]), F.lit("")),
        "subtopic": topic["subfield"]["display_name"], "topic_field": topic["field"]["display_name"],
        "topic_domain": topic["domain"]["display_name"], "abstract": abstract(c("abstract_inverted_index")),
        "author_position": author_position(c("authorships"), author_id),
        "authors_countries": _list(c("authorships"), lambda a: F.array_join(F.coalesce(a["countries"], none), ",")),
        "corresponding": _list(
            F.filter("authorships", lambda a: F.coalesce(a["is_corresponding"], F.lit(False))),
            lambda a: a["author"]["display_name"]
        ),
        "affiliations": _list(
            c("authorships"), lambda a: F.array_join(_list(a["institutions"], lambda i: i["display_name"]), ",")
        ),
        "author_names": _list(c("authorships"), lambda a: a["author"]["display_name"]),
        "orcids": _list(
            c("authorships"), lambda a: F.coalesce(F.nullif(N.strip_id(a["author"]["orcid"]), F.lit("")), F.lit("None"))
        ),
        "topic": topic["display_name"], "topic_subfield": topic["subfield"]["display_name"],
        "keywords": _list(c("keywords"), lambda k: k["display_name"]),
        "keyword_scores": _list(c("keywords"), lambda k: k["score"]),
        "concepts": _list(c("concepts"), lambda k: k["display_name"]),
        "concept_levels": _list(c("concepts"), lambda k: k["level"]),
        "concept_scores": _list(c("concepts"), lambda k: k["score"]),
        "mesh_ids": _list(c("mesh"), lambda m: m["descriptor_ui"]),
        "mesh_terms": _list(c("mesh"), lambda m: m["descriptor_name"]), "sdg": goal["display_name"],
        "sdg_score": goal["score"],
        "grants": _list(
            c("awards"), lambda a: F.concat(_text(a["funder_display_name"]), F.lit(": "), _text(a["display_name"]))
        ),
        "counts_years": _list(c("counts_by_year"), lambda y: y["year"]),
        "counts_citations": _list(c("counts_by_year"), lambda y: F.coalesce(y["cited_by_count"], F.lit(0))),
    }


def flat_works(works: DataFrame, author_name: str, author_id: str, with_awards: bool = False) -> DataFrame:
    """A row per work record, with the columns of work_columns(); with_awards keeps the nested awards too."""
    cols = [v.alias(k) for k, v in work_columns(c(author_name), c(author_id)).items()]
    return works.select(*cols, *([F.coalesce(c("awards"), F.array().cast(works.schema["awards"].dataType)).alias("awards")] if with_awards else []))


def author_links(works: DataFrame, author_name: str, author_id: str) -> DataFrame:
    """author, author id, work id, position, corresponding: a row per work record."""
    return works.select(
        c(author_name).alias("author"), N.strip_id(c(author_id)).alias("author_id"),
        N.strip_id(c("id")).alias("work_id"), author_position(c("authorships"), c(author_id)).alias("position"),
        is_corresponding(c("authorships"), c(author_id)).alias("is_corresponding")
    )


def funding(links: DataFrame, awards: DataFrame) -> DataFrame:
    """Author x award for each linked work; awards is (work_id, awards array). Equal rows once."""
    a = awards.select("work_id", F.explode("awards").alias("a"))
    first = lambda *xs: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs], F.lit(""))
    rows = a.select(
        "work_id", first(a["a"]["funder_id"], a["a"]["funder"]).alias("funder_id"),
        first(a["a"]["funder_display_name"]).alias("funder_name"), first(a["a"]["funder_ror"]).alias("funder_ror"),
        first(a["a"]["id"], a["a"]["award_id"]).alias("award_id"), first(a["a"]["display_name"]).alias("award_name"),
        first(a["a"]["funder_award_id"], a["a"]["award_id"]).alias("funder_award_id")
    )
    return links.select("author", "work_id").distinct().join(rows, "work_id").dropDuplicates(
        ["author", "work_id", "funder_id", "award_id", "funder_award_id"]
    )


def study_rows(studies: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """A row per study and member who is one of its officials (by the gate on both names), with the first such role.

    A name is compared once, however many studies have it."""
    p = "protocolSection"
    official = f"{p}.contactsLocationsModule.overallOfficials"
    last = lambda x: F.element_at(F.split(x, " "), -1)
    names = settled(studies.select(F.explode(f"{official}.name").alias("_name")).distinct())
    names = names.select("_name", N.normalise_name(c("_name")).alias("_norm")).withColumn("_last", last("_norm")).where("_norm != ''")
    m = members.select(c(member), N.normalise_name(c(member)).alias("_m")).withColumn("_last", last("_m")).where("_m != ''")
    fits = settled(names.join(m, "_last").where(N.names_gate(c("_m"), c("_norm"))).select(once(c("_name")).alias("_name"), c(member)))
    status = f"{p}.statusModule"
    joined = lambda x: F.array_join(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")), "|")
    cols = {
        "trial_id": c(f"{p}.identificationModule.nctId"),
        "title": N.first_nonempty(
            c(f"{p}.identificationModule.briefTitle"), c(f"{p}.identificationModule.officialTitle")
        ),
        "status": c(f"{status}.overallStatus"), "condition": joined(c(f"{p}.conditionsModule.conditions")),
        "intervention": joined(c(f"{p}.armsInterventionsModule.interventions.name")),
        "phase": joined(c(f"{p}.designModule.phases")), "start_date": c(f"{status}.startDateStruct.date"),
        "completion_date": N.first_nonempty(
            c(f"{status}.primaryCompletionDateStruct.date"), c(f"{status}.completionDateStruct.date")
        ),
        "role": F.coalesce(c("_o.role"), c("_o.officialRole")),
        "sponsor": c(f"{p}.sponsorCollaboratorsModule.leadSponsor.name"),
    }
    from linkmill.operators.ranks import top_per_group

    flat = {k: v for k, v in cols.items() if k != "role"}
    rows = studies.select(*(v.alias(k) for k, v in flat.items()), F.posexplode(official).alias("_at", "_o"))
    rows = rows.select("_at", c("_o.name").alias("_name"), *(cols[k].alias(k) if k == "role" else c(k) for k in cols))
    rows = rows.join(fits, "_name").select(c(member), "_at", *cols)
    return top_per_group(rows, [member, "trial_id"], ["_at"], 1).drop("_at")


def trial_rows(matches: DataFrame, trials: DataFrame, conditions: DataFrame, interventions: DataFrame) -> DataFrame:
    """Matched (name, trial_id) with the trial's columns and its sorted distinct conditions and interventions; once each."""
    rolled = lambda df, col: df.where(c(col).isNotNull()).groupBy("trial_id").agg(
        F.array_join(F.array_sort(F.collect_set(col)), "|").alias(f"{col}s")
    )
    out = matches.join(trials, "trial_id", "left").join(rolled(conditions, "condition"), "trial_id", "left").join(
        rolled(interventions, "intervention"), "trial_id", "left"
    )
    return out.na.fill("", ["conditions", "interventions"]).dropDuplicates(["name", "trial_id"])


def page_rows(pages: DataFrame, key: str, html: str, pattern: str, cell: str = "tr") -> DataFrame:
    """Table rows of pages that hold an id of the pattern: key, id, title, href.

    The title is the first link's text, else the longest cell without the id; href the first link's target."""
    row = F.regexp_extract_all(F.coalesce(c(html), F.lit("")), F.lit(f"(?is)(<{cell}\\b.*?</{cell}>)"), 1)
    rows = pages.select(c(key), F.explode(row).alias("row")).withColumn("id", F.regexp_extract("row", f"({pattern})", 1)).where("id != ''")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " "))
    cells = F.transform(F.regexp_extract_all("row", F.lit("(?is)<td[^>]*>(.*?)</td>"), 1), plain)
    others = F.filter(cells, lambda x: ~x.contains(c("id")))
    longest = F.aggregate(others, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    link = plain(F.regexp_extract("row", "(?is)<a\\b[^>]*>(.*?)</a>", 1))
    return rows.select(
        key, "id", F.when(link != "", link).otherwise(longest).alias("title"),
        F.regexp_extract("row", "(?is)<a\\b[^>]*href=[\"']([^\"']*)", 1).alias("href")
    )


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Targets of all links of pages, and their number on the page."""
    links = F.regexp_extract_all(F.coalesce(c(html), F.lit("")), F.lit("<a [^>]*href=\"([^\"]*)\""), 1)
    return pages.select(key, F.explode(links).alias("href")).groupBy(key, "href").agg(F.count("*").alias("n"))


def expertise_text(free: Column, tags: Column) -> Column:
    """Free text, then the tags that it does not hold already, each once, joined by semicolons."""
    low = F.lower(F.coalesce(free, F.lit("")))
    more = F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (F.trim(t) != "") & ~low.contains(F.lower(F.trim(t)))))
    return F.concat_ws("; ", F.nullif(F.trim(F.coalesce(free, F.lit(""))), F.lit("")), F.nullif(F.array_join(more, "; "), F.lit("")))


def research_topics(topics: Column, generic: list[str], k: int = 5, first: int = 10) -> Column:
    """The first k of the first ten topic names that are not generic and longer than three characters."""
    names = F.transform(F.slice(topics, 1, first), lambda t: t["display_name"])
    return F.slice(F.filter(names, lambda n: n.isNotNull() & (F.length(n) > 3) & ~F.lower(n).isin([g.lower() for g in generic] or [""])), 1, k)


def topic_details(authors: DataFrame, key: str, first: int = 10) -> DataFrame:
    """The first topics of each record, with their places: key, place, topic, subfield, field, domain, n."""
    rows = authors.select(c(key), F.posexplode(F.slice("topics", 1, first)).alias("place", "t"))
    return rows.select(
        key, "place", c("t.display_name").alias("topic"), c("t.subfield.display_name").alias("subfield"),
        c("t.field.display_name").alias("field"), c("t.domain.display_name").alias("domain"), c("t.count").alias("n")
    )


def year_series(authors: DataFrame, key: str) -> DataFrame:
    """Works and citations by year, a row each, nulls as 0."""
    return authors.select(c(key), F.explode("counts_by_year").alias("y")).select(
        key, c("y.year").alias("year"), F.coalesce("y.works_count", F.lit(0)).alias("works"),
        F.coalesce("y.cited_by_count", F.lit(0)).alias("citations")
    )


def with_priority(members: DataFrame, source: str, name: str, must: tuple = ("Both", "Register")) -> DataFrame:
    """members with priority must or nice, must first, then by name."""
    return members.withColumn(
        "priority", F.when(F.trim(source).isin(*must), "must").otherwise("nice")
    ).orderBy(F.when(c("priority") == "must", 0).otherwise(1), name)


def proven(number: Column, specialty: Column, prefix: str, word: str) -> Column:
    """Whether a registration number and a specialty prove the profession."""
    return F.upper(F.trim(F.coalesce(number, F.lit("")))).startswith(prefix) & F.lower(F.coalesce(specialty, F.lit(""))).contains(word)


def aliases(df: DataFrame, new_to_old: dict[str, str]) -> DataFrame:
    """df with both names of each renamed column, where one of them is there."""
    for new, old in new_to_old.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumn(new, c(old))
        elif new in df.columns and old not in df.columns:
            df = df.withColumn(old, c(new))
    return df


def investigators(df: DataFrame, role: str, country: str, wanted: str, place: str) -> DataFrame:
    """Rows of the wanted role whose country text holds the place, without regard to case."""
    return df.where((F.trim(role) == wanted) & F.lower(F.coalesce(c(country), F.lit(""))).contains(place.lower()))


def united(*lists: Column) -> Column:
    """The entries of several lists, each once, in the order in which they come first."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def number(x: Column) -> Column:
    """A number from text; null for anything else."""
    return F.trim(x.cast("string")).try_cast("double")
