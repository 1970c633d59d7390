"""String similarity in percent, from the longest common subsequence, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest shorter string whose subsequence fits the bits of one long.
BITS = 62


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    The shorter string's positions are the bits of one long; each character of the longer one updates
    them with one addition. Where the shorter has more than 62 characters, a row of lengths is kept instead."""
    s = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    t = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    n = F.length(s)
    full = F.pow(F.lit(2.0), F.least(n, F.lit(BITS))).cast("long") - 1
    places = F.transform(chars(s), lambda c, i: F.struct(c.alias("c"), F.pow(F.lit(2.0), F.least(i, F.lit(BITS - 1))).cast("long").alias("bit")))

    def step(v: Column, ch: Column) -> Column:
        m = F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["c"] == ch, p["bit"]).otherwise(F.lit(0).cast("long")))
        u = v.bitwiseAND(m)
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    bits = F.bit_count(F.aggregate(chars(t), full, step).bitwiseXOR(full))

    def row(old: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            here = F.when(F.substring(s, j, 1) == ch, F.element_at(old, j) + 1).otherwise(F.greatest(F.element_at(old, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    long_way = F.element_at(F.aggregate(chars(t), F.array_repeat(F.lit(0), n + 1), row), -1)
    return F.when(n == 0, F.lit(0)).when(n <= BITS, bits).otherwise(long_way)


def ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (both lengths); 0 where one is empty."""
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.lit(200.0) * lcs(a, b) / total).otherwise(F.lit(0.0))


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, "\\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """ratio() of the words in alphabetical order."""
    return ratio(sorted_words(a), sorted_words(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """100 where one side's words include the other's; else the best ratio of the shared words with
    either side, and of the sides, each with the shared words first; 0 where one side is empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, "\\s+"), lambda t: t != ""))
    x, y = words(a), words(b)
    both, left, right = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    text = lambda arr: F.array_join(F.array_sort(arr), " ")
    i = text(both)
    ia, ib = F.trim(F.concat_ws(" ", i, text(left))), F.trim(F.concat_ws(" ", i, text(right)))
    best = F.when(F.size(both) > 0, F.greatest(ratio(ia, ib), ratio(i, ia), ratio(i, ib))).otherwise(ratio(ia, ib))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(
        (F.size(both) > 0) & ((F.size(left) == 0) | (F.size(right) == 0)), F.lit(100.0)
    ).otherwise(best)


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter text with a part of the longer one of the same length."""
    s = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    t = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    starts = F.sequence(F.lit(1), F.length(t) - F.length(s) + 1)
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(F.array_max(F.transform(starts, lambda i: ratio(s, F.substr(t, i, F.length(s))))))


def longest_possible(a: Column, b: Column) -> Column:
    """The most that ratio() and token_sort_ratio() can reach for these lengths: a cheap test before them."""
    return F.lit(200.0) * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
