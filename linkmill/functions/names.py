"""Person names and other short strings as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles before a name, letters after it, and name forms of titles.
TITLES = ["associate\\s+professor", "assoc\\.?\\s*prof\\.?", "a/prof\\.?", "professor", "prof\\.?", "dr\\.?", "mr\\.?", "mrs\\.?", "ms\\.?", "miss"]
POST_NOMINALS = ["AM", "OAM", "FAFRM", "FRACP", "FRCP", "FRCPE", "FRACGP", "PhD", "MD", "MBBS", "MRCP", "BSc\\.?", "MSc\\.?", "BMed"]
TRUE_TEXTS = ["true", "1", "yes", "t"]
FALSE_TEXTS = ["false", "0", "no", "f"]
ID_PREFIX = "^https?://(openalex|orcid)\\.org/"
DOI_PREFIX = "(?i)^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*"


def _folds() -> tuple[str, str]:
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def ascii_fold(c: Column) -> Column:
    """Letters with marks lose the marks; what has no ASCII form vanishes."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), "[^\\x00-\\x7F]", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def normalise_name(c: Column) -> Column:
    """A name for comparison: folded, first comma swapped, titles and post-nominals gone, lower case.

    Null and empty give an empty string."""
    t = ascii_fold(F.coalesce(c, F.lit("")))
    head, tail = F.regexp_extract(t, "^([^,]*),(?s:(.*))$", 1), F.regexp_extract(t, "^([^,]*),(?s:(.*))$", 2)
    t = F.when(t.contains(","), F.concat(F.trim(tail), F.lit(" "), F.trim(head))).otherwise(t)
    t = F.regexp_replace(t, f"(?i)^(?:\\s*(?:{'|'.join(TITLES)})\\s+)+", "")
    for _ in range(2):
        t = F.regexp_replace(t, f"(?i)\\b(?:{'|'.join(POST_NOMINALS)})\\b\\.?", "")
    t = F.regexp_replace(t, "[.()\\[\\]\"',]+", " ")
    return F.lower(collapsed(t))


def normalise_letters(c: Column) -> Column:
    """The variant that keeps letters and spaces only."""
    return F.lower(collapsed(F.regexp_replace(ascii_fold(F.coalesce(c, F.lit(""))), "[^A-Za-z ]", "")))


def strip_title(c: Column) -> Column:
    """The name without titles before it, otherwise as it is."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?i)^(?:\\s*(?:{'|'.join(TITLES)})\\s+)+", ""))


def title_of(c: Column) -> Column:
    """The first title before a name, lower case without dots; empty without one."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?i)^\\s*({'|'.join(TITLES)})\\s+", 1), "\\.", ""))


def tokens(c: Column) -> Column:
    """The words of a normalised name; an empty array for an empty one."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def last_tokens(norm: Column) -> Column:
    t = tokens(norm)
    return F.when(F.size(t) > 0, F.array(F.element_at(t, -1))).otherwise(F.array().cast("array<string>"))


def first_tokens(norm: Column) -> Column:
    """The first word, the second of three or more, and the initial of each."""
    t = tokens(norm)
    picked = F.when(F.size(t) >= 3, F.slice(t, 1, 2)).otherwise(F.slice(t, 1, 1))
    return F.array_distinct(F.flatten(F.transform(picked, lambda x: F.array(x, F.left(x, F.lit(1))))))


def names_gate(a: Column, b: Column) -> Column:
    """Whether two normalised names share the last word and a first word or initial."""
    return F.coalesce(F.arrays_overlap(last_tokens(a), last_tokens(b)) & F.arrays_overlap(first_tokens(a), first_tokens(b)), F.lit(False))


def first_last(norm: Column) -> Column:
    """First and last word; one word stays alone."""
    t = tokens(norm)
    return F.when(F.size(t) >= 2, F.concat_ws(" ", F.element_at(t, 1), F.element_at(t, -1))).otherwise(norm)


def name_overlap(a: Column, b: Column, stop: list[str]) -> Column:
    """Whether two texts share a word that is no stop word; true where one has none."""
    words = lambda c: F.array_except(tokens(normalise_letters(c)), F.array(*map(F.lit, stop)).cast("array<string>"))
    x, y = words(a), words(b)
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def tri_bool(c: Column) -> Column:
    """True or false from text, null for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(TRUE_TEXTS), True).when(t.isin(FALSE_TEXTS), False)


def strip_id(c: Column) -> Column:
    return F.regexp_replace(c, ID_PREFIX, "")


def last_segment(c: Column) -> Column:
    """What follows the last slash; empty for null."""
    return F.coalesce(F.element_at(F.split(c, "/"), -1), F.lit(""))


def valid_doi(c: Column) -> Column:
    """A DOI without resolver prefix, or null if it is none."""
    t = F.trim(F.regexp_replace(F.trim(c), DOI_PREFIX, ""))
    return F.when(t.rlike("^10\\.\\d{4,}/.+"), t)


def pipe_patterns(c: Column, least: int = 5) -> Column:
    """Entries between pipes without text in brackets, lower case, of some length, each once."""
    each = F.transform(F.split(F.coalesce(c, F.lit("")), "\\|"), lambda e: F.lower(F.trim(F.regexp_replace(e, "\\([^)]*\\)", ""))))
    return F.array_distinct(F.filter(each, lambda e: F.length(e) >= least))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def best_date(*cs: Column) -> Column:
    """The first date text that is not empty, its first ten characters."""
    return F.left(first_nonempty(*cs), F.lit(10))


def year_of(c: Column) -> Column:
    return F.left(c.cast("string"), F.lit(4)).try_cast("int")


def pipe_join(*cs: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.trim(c) for c in cs]), lambda x: x.isNotNull() & (x != "")), "|")


def tidy_list(c: Column) -> Column:
    """Text without stray semicolons and spaces at its ends; null where nothing or `none`, `nan`, `null` is left."""
    t = F.regexp_replace(c, "^[; ]+|[; ]+$", "")
    return F.when(~F.lower(t).isin("", "none", "nan", "null"), t)


def works_bonus(n: Column) -> Column:
    """10 for any work, and log2(n + 1) rounded down on top, 20 at most."""
    return F.when(n > 0, 10 + F.least(F.lit(20), F.floor(F.log2(n + 1)))).otherwise(0).cast("int")


def keyword_match(state: Column, text: Column, keywords: dict[str, list[str]]) -> Column:
    """Whether text holds a keyword of the state; a state without keywords stands for itself, lower case."""
    table = F.create_map(*[x for k, v in keywords.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    low = F.lower(F.coalesce(text, F.lit("")))
    own = F.coalesce(F.try_element_at(table, F.upper(F.trim(state))), F.array(F.lower(F.trim(state))))
    return (F.coalesce(F.trim(state), F.lit("")) != "") & F.exists(own, lambda k: low.contains(k))


def url(template: str, key: Column) -> Column:
    """A template with the key in place of {}; empty text without a key."""
    before, after = template.split("{}")
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit(before), key, F.lit(after))).otherwise("")
