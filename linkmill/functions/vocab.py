"""Tagging by vocabularies and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether lower-cased text holds a word of the vocabulary as it stands; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)) if words else F.lit(False)


def hits(text: Column, words: list[str]) -> Column:
    """holds_any() for a piped column: one of nothing but pipes and spaces is empty."""
    return (F.regexp_replace(F.coalesce(text, F.lit("")), "[|\\s]", "") != "") & holds_any(text, words)


def relevant(columns: dict[str, list[str]]) -> Column:
    """Whether any column hits its own vocabulary."""
    out = F.lit(False)
    for name, words in columns.items():
        out = out | hits(F.col(name), words)
    return out


def first_rule(text: Column, rules: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The label of the first rule, in order, one of whose words the text holds."""
    out = F.lit(otherwise).cast("string")
    for label, words in reversed(rules):
        out = F.when(holds_any(text, words), label).otherwise(out)
    return out


def count_on(labels: Column, words: list[str], first: int | None = None) -> Column:
    """How many of the (first) labels hold a word."""
    some = F.slice(labels, 1, first) if first else labels
    return F.size(F.filter(F.coalesce(some, F.array().cast("array<string>")), lambda x: holds_any(x, words)))


def all_off(labels: Column, on: list[str], off: list[str], first: int = 3) -> Column:
    """Whether each of the first labels is of another domain and none on this one; false without labels."""
    top = F.slice(F.coalesce(labels, F.array().cast("array<string>")), 1, first)
    return (F.size(top) > 0) & F.forall(top, lambda x: holds_any(x, off) & ~holds_any(x, on))


def any_inside(names: Column, patterns: list[str]) -> Column:
    """Whether a pattern lies inside one of the names, without regard to case."""
    return F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: holds_any(n, [p.lower() for p in patterns]))


def flag_labels(flags: Column, labels: dict[str, str]) -> Column:
    """Labels of semicolon- or pipe-separated flags; flags without a label are left out."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    each = F.transform(F.split(F.coalesce(flags, F.lit("")), "[;|]"), lambda f: F.try_element_at(table, F.trim(f)))
    return F.filter(each, lambda x: x.isNotNull())
