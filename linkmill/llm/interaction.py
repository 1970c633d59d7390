"""What filters do to each other: decision diagrams of failure masks, for every order of the filters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The first filter's name is A; a mask's lowest bit is its failure.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x20\x09-\x0D]+"


def plain_changes(n: int) -> Iterator[int]:
    """Positions i of swaps (i, i + 1) that lead through all n! orders, each once."""
    if n < 2:
        return
    down, up = list(range(n - 2, -1, -1)), list(range(n - 1))
    before, turn = plain_changes(n - 1), 0
    while True:
        yield from down if turn % 2 == 0 else up
        at = next(before, None)
        if at is None:
            return
        yield at + (turn % 2 == 0)
        turn += 1


class Diagram:
    """A shared decision diagram over failure masks; each node knows the sums of the counts below it.

    Every level is there on every path (sums need no factors for left-out levels); equal nodes of a level are one."""

    def __init__(self, n: int, counts: dict[int, tuple[int, ...]]):
        width = len(next(iter(counts.values())))
        self.n, self.order = n, list(range(n))
        self.sums: list[tuple[int, ...]] = []
        self.kids: list[tuple[int, int]] = []
        self.tables: list[dict] = [{} for _ in range(n + 1)]
        leaves = [self._leaf(counts.get(m, (0,) * width)) for m in range(1 << n)]
        for level in range(n - 1, -1, -1):  # the variable of level 0 is the mask's lowest bit
            half = 1 << level
            leaves = [self._node(level, leaves[m], leaves[m + half]) for m in range(half)]
        self.root = leaves[0]

    def _leaf(self, counts: tuple[int, ...]) -> int:
        found = self.tables[self.n].get(counts)
        if found is None:
            found = self.tables[self.n][counts] = len(self.sums)
            self.sums.append(counts)
            self.kids.append((-1, -1))
        return found

    def _node(self, level: int, passes: int, fails: int) -> int:
        found = self.tables[level].get((passes, fails))
        if found is None:
            found = self.tables[level][passes, fails] = len(self.sums)
            self.sums.append(tuple(x + y for x, y in zip(self.sums[passes], self.sums[fails], strict=True)))
            self.kids.append((passes, fails))
        return found

    def swap(self, level: int) -> None:
        """Changes the places of the variables of a level and the next. Nodes above stay as they are: those of the
        level keep their numbers, for each stands for the same counts as before."""
        mine = list(self.tables[level].values())
        self.tables[level], self.tables[level + 1] = {}, {}
        for u in mine:
            (pp, pf), (fp, ff) = (self.kids[k] for k in self.kids[u])
            self.kids[u] = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.tables[level][self.kids[u]] = u
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, sums kept, sums removed) for each level on the path on which all pass."""
        at = self.root
        for variable in self.order:
            passes, fails = self.kids[at]
            yield variable, self.sums[passes], self.sums[fails]
            at = passes


def steps(n: int, counts: dict[int, tuple[int, ...]]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of n filters.

    counts: (documents, good, toxic) by failure mask. In an order that begins with a filter it removes all its
    failures, in one that ends with it those that no other filter has."""
    d = Diagram(n, counts)
    seen = [(list(d.order), list(d.path()))]
    for level in plain_changes(n):
        d.swap(level)
        seen.append((list(d.order), list(d.path())))
    fails, alone, over_all = [0] * n, [0] * n, [0] * n
    for _, walk in seen:
        for v, _, gone in walk:
            over_all[v] += gone[0]
        fails[walk[0][0]], alone[walk[-1][0]] = walk[0][2][0], walk[-1][2][0]
    for order, walk in seen:
        name = "".join(LETTERS[v] for v in order)
        for i, (v, kept, gone) in enumerate(walk):
            yield name, i + 1, kept[0], gone[0], fails[v] - gone[0], alone[v], gone[1], gone[2], over_all[v]


def corpus_filters(text: Column, words: Column) -> list[Column]:
    """Failures that a text alone decides: few words, repetition, capitals, symbols."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words))
    return [
        n < 50, distinct.cast("long") * 100 < n * 65, F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
        text.rlike(r"[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failure mask, as counts.

    The bits are those of corpus_filters, then: the text equals that of a smaller key, anywhere in the table.
    Equal texts have equal other bits, so rows first become counts by text (its SHA-256), part and key, with a
    key's labels; a hot text is therefore few rows when texts meet. Of these the smallest key's rows pass."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("text")
    )
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    own = corpus_filters(F.col("text"), F.col("words"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(own[1:], 1)), F.when(own[0], 1).otherwise(0))
    rows = rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("digest", "part", "key", "mask").agg(F.count("*").alias("n"))
    marks = labels.select(F.col(f"`{key}`").alias("key"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.where("key is not null").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(marks, "key", "left").fillna(0, ["good", "toxic"])
    of_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("key").alias("least"), F.coalesce(F.min_by("n", "key"), F.lit(0)).alias("n_least"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    of_text = of_text.withColumn("first", F.min("least").over(W.partitionBy("digest")))  # a text's parts, not its rows
    first = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_null")
    split = of_text.select("part", "mask", "good", "toxic", "n", first.alias("passing"))
    again = F.explode(F.array(
        F.struct("mask", F.col("passing").alias("n")),
        F.struct((F.col("mask") + (1 << len(own))).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))
    ))
    split = split.select("part", "good", "toxic", again.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def audit(masks: DataFrame, n_filters: int) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, and lost. masks: part, mask, n, good, toxic."""

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(x)) for m, n, g, x in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        out = pd.DataFrame(list(steps(n_filters, counts)), columns=names)
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    return masks.groupBy("part").applyInPandas(
        of_part, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of corpus_filters and the filter for equal texts: n! * n rows per part.

    Spark counts failure masks, at most 2**n a part; each part's diagram is a task's small work, so parts spread.
    Null or empty text: empty, which fails the first filter only, and as a copy. A null part is the empty string.
    Rows of equal key and text are not copies of each other (no smaller key); rows with a null key are no one's copy
    and have no labels. Of repeated labels, any 1 counts; null labels are none. Labels of other keys are not
    looked at. An empty table has no parts and gives no rows. Other columns are not looked at.
    """
    return audit(failure_masks(docs, labels, key, text, part), 5)
