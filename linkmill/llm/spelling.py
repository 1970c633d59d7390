"""Grouping of spelling variants: k-d trees over letter-count vectors find the words that are one edit apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.common import bounded_batches, passing_tables, thrifty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter runs of a text whose A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]+"
#: One run in so many loses a letter, by a checksum of its document's id and itself.
EVERY = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2

#: Dimensions of a vector: a-z, then 38 for all other code points together.
DIMS = 64
#: Words of at least so many code points are one class; shorter ones are classes by their length.
LONG = 64
#: Cells are split until their words, at 16 and their length each, weigh at most so much ...
CELL_WEIGHT = 1 << 18
#: ... or this part of all words' weight, so that the tree of cells, which every task holds, is bounded.
MOST_CELLS = 1 << 16
#: Vectors in a leaf of the tree within a cell, and queries that it takes at a time.
LEAF, QUERIES = 32, 4096


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: letter runs of all texts, with A-Z lower-cased, of least_letters or more, that occur least_count times.

    If `every` divides the crc32 of `<key>:<run>`, the run loses the code point at the crc32 modulo its length."""
    runs = F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    of = docs.select(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":")).alias("id"), runs.alias("run"))
    of = of.where(F.length("run") >= least_letters).withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    of = of.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
    return of.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after another, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[str]) -> np.ndarray:
    """A vector for each word: how often it has each letter, 255 at most. One edit changes the sum by two at most, as it
    would if no two letters shared a dimension."""
    codes, sizes = code_points(words)
    codes = codes.astype(np.int64)
    dim = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 38)
    row = np.repeat(np.arange(len(words)), sizes)
    return np.minimum(np.bincount(row * DIMS + dim, minlength=len(words) * DIMS), 255).reshape(len(words), DIMS).astype(np.int16)


def classes(words: list[str]) -> np.ndarray:
    return np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LONG)


def box_distance(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of each vector from the nearest point of a box."""
    return np.abs(vectors - np.clip(vectors, low, high)).sum(axis=1)


class Cells:
    """k-d trees whose leaves are cells of the table, a tree for each class of lengths.

    Nodes: (dimension, cut, left, right), with counts below `cut` on the left; a leaf has dimension -1."""

    def __init__(self, weights: dict[int, int]):
        self.nodes, self.weights, self.roots = [], [], {}
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        for c, w in sorted(weights.items()):
            self.roots[c] = self._leaf(w, np.zeros(DIMS, np.int16), np.full(DIMS, 255, np.int16))
        self.slices: dict[int, int] = {}  # of leaves that no cut divides

    def _leaf(self, weight: int, low: np.ndarray, high: np.ndarray) -> int:
        self.nodes.append((-1, 0, -1, -1))
        self.weights.append(weight)
        self.boxes.append((low, high))
        return len(self.nodes) - 1

    def split(self, leaf: int, dim: int, cut: int, below: int) -> None:
        low, high = self.boxes[leaf]
        left_high, right_low = high.copy(), low.copy()
        left_high[dim], right_low[dim] = cut - 1, cut
        left = self._leaf(below, low, left_high)
        self.nodes[leaf] = (dim, cut, left, self._leaf(self.weights[leaf] - below, right_low, high))

    def too_large(self, limit: int) -> list[int]:
        return [i for i, node in enumerate(self.nodes) if node[0] < 0 and self.weights[i] > limit and i not in self.slices]

    def within(self, root: int, vectors: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, which vectors are within the radius of its box): boxes too far away are pruned with all below them."""
        stack = [(root, np.arange(len(vectors)))]
        while stack:
            node, idx = stack.pop()
            idx = idx[box_distance(vectors[idx], *self.boxes[node]) <= radius]
            if len(idx):
                dim, _, left, right = self.nodes[node]
                if dim < 0:
                    yield node, idx
                else:
                    stack += [(left, idx), (right, idx)]

    def of(self, words: list[str], vectors: np.ndarray) -> np.ndarray:
        """The leaf of each word."""
        out, kinds = np.empty(len(words), np.int64), classes(words)
        for c in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == c)
            for leaf, idx in self.within(self.roots[c], vectors[mine], 0):
                out[mine[idx]] = leaf
        return out


def best_cuts(vocabulary: DataFrame, cells: Cells, large: list[int]) -> dict[int, tuple[int, int, int]]:
    """(dimension, cut, weight below) that halves each of these leaves best; leaves of equal vectors have none."""

    def histogram(batches):
        wanted = np.array(large, np.int64)
        for b in batches:
            words = b.column("word").to_pylist()
            vectors = letter_counts(words)
            leaf = cells.of(words, vectors)
            mine = np.flatnonzero(np.isin(leaf, wanted))
            weight = 16 + np.fromiter(map(len, words), np.int64, len(words))[mine]
            row, dim = np.nonzero(vectors[mine])
            keys, at = np.unique((leaf[mine][row] * DIMS + dim) * 256 + vectors[mine][row, dim], return_inverse=True)
            sums = np.bincount(at, weight[row], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys // 256 // DIMS), pa.array(keys // 256 % DIMS), pa.array(keys % 256), pa.array(sums)],
                names=["leaf", "dim", "value", "w"]
            )

    spark = vocabulary.sparkSession
    total = spark.createDataFrame([(i, cells.weights[i]) for i in large], "leaf long, total long")  # MOST_CELLS at most
    counts = vocabulary.select("word").mapInArrow(thrifty(histogram), "leaf long, dim long, value long, w long")
    counts = counts.groupBy("leaf", "dim", "value").agg(F.sum("w").alias("w")).groupBy("leaf", "dim").agg(
        F.sort_array(F.collect_list(F.struct("value", "w"))).alias("values")  # 255 values at most
    )
    from_here = F.transform("values", lambda x: F.struct(x["value"].alias("cut"), F.aggregate(
        F.filter("values", lambda y: y["value"] >= x["value"]), F.lit(0).cast("long"), lambda s, y: s + y["w"]
    ).alias("above")))
    cuts = counts.join(F.broadcast(total), "leaf").select("leaf", "dim", "total", F.explode(from_here).alias("c"))
    cuts = cuts.select("leaf", "dim", "c.cut", (F.col("total") - F.col("c.above")).alias("below"), "total").where("below > 0")
    even = F.struct(F.abs(2 * F.col("below") - F.col("total")).alias("off"), "dim", "cut", "below")
    best = cuts.groupBy("leaf").agg(F.min(even).alias("b")).select("leaf", "b.dim", "b.cut", "b.below")
    return {r.leaf: (r.dim, r.cut, r.below) for r in best.collect()}


def cells_of(vocabulary: DataFrame, cell_weight: int = CELL_WEIGHT) -> Cells:
    """Splits the words of each class until cells are small. Each step halves the large cells by counts that Spark adds
    up by cell, letter and value; only a cut for each cell comes to the driver."""
    sizes = vocabulary.select(F.length("word").alias("k")).groupBy(F.least("k", F.lit(LONG)).alias("c"))
    weights = {r.c: r.w for r in sizes.agg(F.sum(F.col("k") + 16).alias("w")).collect()}
    cells = Cells(weights)
    limit = max(cell_weight, 4 * sum(weights.values()) // MOST_CELLS)
    while large := cells.too_large(limit):
        cuts = best_cuts(vocabulary, cells, large)
        for leaf in large:
            if leaf in cuts:
                cells.split(leaf, *cuts[leaf])
            else:
                cells.slices[leaf] = -(-cells.weights[leaf] // limit)
    return cells


class Tree:
    """A k-d tree over the different vectors of a cell's words, with the words as code points for verification."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        vectors = letter_counts(words)
        self.vectors, of_word = np.unique(vectors, axis=0, return_inverse=True)
        self.by_vector = np.argsort(of_word.ravel(), kind="stable")
        self.first = np.searchsorted(of_word.ravel()[self.by_vector], np.arange(len(self.vectors) + 1))
        self.rank = np.empty(len(words), np.int64)
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.size = len(words[0]) if words else 0
        self.even = all(len(w) == self.size for w in words)
        self.codes = code_points(words)[0].reshape(-1, self.size) if self.even and self.size else None
        self.nodes: list[tuple] = []
        if words:
            self._build(np.arange(len(self.vectors)))

    def _build(self, idx: np.ndarray) -> int:
        own = self.vectors[idx]
        node, low, high = len(self.nodes), own.min(axis=0), own.max(axis=0)
        self.nodes.append((low, high, idx, -1, -1))
        if len(idx) > LEAF:
            dim = int(np.argmax(own.var(axis=0)))
            cut = max(int(np.median(own[:, dim])), int(low[dim]) + 1)
            left, right = idx[own[:, dim] < cut], idx[own[:, dim] >= cut]
            self.nodes[node] = (low, high, None, self._build(left), self._build(right))
        return node

    def vectors_near(self, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of vectors[i] and self.vectors[j] of L1 distance `radius` at most, by box-pruned range search."""
        found_i, found_j, stack = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [(0, np.arange(len(vectors)))]
        while stack:
            node, idx = stack.pop()
            low, high, own, left, right = self.nodes[node]
            idx = idx[box_distance(vectors[idx], low, high) <= radius]
            if len(idx) and own is None:
                stack += [(left, idx), (right, idx)]
            elif len(idx):
                i, j = np.nonzero(np.abs(vectors[idx][:, None] - self.vectors[own][None]).sum(axis=2) <= radius)
                found_i.append(idx[i])
                found_j.append(own[j])
        return np.concatenate(found_i), np.concatenate(found_j)

    def near(self, other: Tree, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) for all words i of the other and j of this that are one edit apart."""
        kept_i, kept_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not self.words or not other.words:
            return kept_i[0], kept_j[0]
        u, v = self.vectors_near(other.vectors, radius)
        for at in range(0, len(u), 1 << 16):
            p, q = u[at : at + (1 << 16)], v[at : at + (1 << 16)]
            n, m = other.first[p + 1] - other.first[p], self.first[q + 1] - self.first[q]
            pair = np.repeat(np.arange(len(p)), n * m)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            i = other.by_vector[other.first[p][pair] + nth // m[pair]]
            j = self.by_vector[self.first[q][pair] + nth % m[pair]]
            yes = self._one_edit(other, i, j)
            kept_i.append(i[yes])
            kept_j.append(j[yes])
        return np.concatenate(kept_i), np.concatenate(kept_j)

    def _one_edit(self, other: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether other.words[i] and self.words[j] differ by one code point inserted, deleted or replaced."""
        if self.codes is None or other.codes is None:
            pairs = zip(i.tolist(), j.tolist(), strict=True)
            return np.fromiter((one_edit(other.words[x], self.words[y]) for x, y in pairs), bool, len(i))
        a, b = other.codes[i], self.codes[j]
        if other.size == self.size:
            return (a != b).sum(axis=1) == 1
        short, long = (a, b) if other.size < self.size else (b, a)
        if long.shape[1] - short.shape[1] != 1:
            return np.zeros(len(i), bool)
        head = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
        tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        return head + tail >= short.shape[1]


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one code point inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[head + (len(a) == len(b)) :] == b[head + 1 :]


def near_words(vocabulary: DataFrame, cell_weight: int = CELL_WEIGHT) -> DataFrame:
    """word, n, n_near, near_n, near_word: how many words are one edit away, and which of them is most frequent.

    vocabulary: word, n; written, words not null and different. Words of a class of lengths lie in cells of k-d trees over
    letter counts. A word searches the cells within distance 2 of its own class, and within 1 of the next class, whose
    words one insertion makes; there it meets a tree over the cell's vectors, and what is near enough is verified
    letter by letter. Rows are chunks of words by cell; a cell's words come to its task before those that search it, which
    pass through in bounded numbers. Words with very many equal vectors, which no cut divides, form a cell in slices that
    are searched one by one. Pairs are summed up in the task and never rows."""
    cells = cells_of(vocabulary, cell_weight)
    first_slice, n_slices = {}, 0
    for leaf, node in enumerate(cells.nodes):
        if node[0] < 0:
            first_slice[leaf] = n_slices
            n_slices += cells.slices.get(leaf, 1)

    def route(batches):
        held: dict[tuple[int, int], tuple[list[str], list[int]]] = {}
        size = 0

        def flushed():
            rows = [(cell, role, *x) for (cell, role), x in held.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cell", "role", "words", "counts"])

        for b in batches:
            words, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
            vectors, kinds = letter_counts(words), classes(words)
            found = [(leaf, 0, at) for leaf, at in grouped(cells.of(words, vectors))]
            for c in np.unique(kinds).tolist():
                mine = np.flatnonzero(kinds == c)
                for role, root, radius in ((1, cells.roots[c], 2), (2, cells.roots.get(c + 1), 1)):
                    if root is not None:
                        found += [(leaf, role, mine[idx]) for leaf, idx in cells.within(root, vectors[mine], radius)]
            for leaf, role, idx in found:
                n = cells.slices.get(leaf, 1)
                for k in idx.tolist():
                    for s in range(n) if role else [sum(words[k].encode()) % n]:
                        into = held.setdefault((first_slice[leaf] + s, role), ([], []))
                        into[0].append(words[k])
                        into[1].append(counts[k])
                        size += 1
            if size >= 50_000:
                yield flushed()
                size = 0
        yield flushed()

    def search(batches):
        cell, tree, own, asking, role = None, None, ([], []), ([], []), 0

        def answers():
            nonlocal asking
            queries, asking = Tree(*asking), ([], [])
            i, j = tree.near(queries, 2 if role == 1 else 1)
            yield from best_of(queries, i, tree, j)
            if role == 2:
                yield from best_of(tree, j, queries, i)

        for b in batches:
            for c, r, words, counts in zip(*(b.column(x).to_pylist() for x in ("cell", "role", "words", "counts")), strict=True):
                if (c, r) != (cell, role) and asking[0]:
                    yield from answers()
                if c != cell:
                    cell, tree, own = c, None, ([], [])
                role = r
                into = asking if r else own
                into[0].extend(words)
                into[1].extend(counts)
                if not r:
                    yield counted(words, counts, np.zeros(len(words), np.int64), [None] * len(words), [None] * len(words))
                elif tree is None:
                    tree = Tree(*own)
                if len(asking[0]) >= QUERIES:
                    yield from answers()
        if asking[0]:
            yield from answers()

    chunks = vocabulary.select("word", "n").mapInArrow(thrifty(route), "cell long, role int, words array<string>, counts array<long>")
    dealt = chunks.repartition("cell").sortWithinPartitions("cell", "role")
    found = bounded_batches(dealt).mapInArrow(thrifty(search), "word string, n long, n_near long, near_n long, near_word string")
    best = F.min(F.when(F.col("near_word").isNotNull(), F.struct((-F.col("near_n")).alias("minus_n"), "near_word")))
    near = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return near.select("word", "n", "n_near", (-F.col("b.minus_n")).alias("near_n"), "b.near_word")


def grouped(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, where it stands) for each different value."""
    order = np.argsort(values, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if len(part):
            yield int(values[part[0]]), part


def counted(words, counts, n_near, near_n, near_words) -> pa.RecordBatch:
    columns = [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(n_near, pa.int64()), pa.array(near_n, pa.int64()), pa.array(near_words, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "near_n", "near_word"])


def best_of(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each word of a in pairs (i, j): the number of its partners in b, and the most frequent, the first of equals."""
    if len(i):
        order = np.lexsort((b.rank[j], -b.counts[j], i))
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        who, with_ = i[order][first], j[order][first]
        n_near = np.diff([*first, len(i)])
        yield counted([a.words[k] for k in who.tolist()], a.counts[who], n_near, b.counts[with_], [b.words[k] for k in with_.tolist()])


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the last form that a word's forms lead to, by pointer jumping. forms: word, form, not null; written.

    A form is at least RATIO times as frequent, so there are no circles and steps double the way each time."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if after.where("next is not null").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variant_forms(
    docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, ratio: int = RATIO, cell_weight: int = CELL_WEIGHT
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of word_counts().

    form is the most frequent word one edit away (of equals the first in code-point order), if it is at least
    `ratio` (2 or more) times as frequent, else null; root is where forms lead to, the word itself if it has none.

    Null and empty texts and texts without letters have no words. A null key counts as the empty string in the
    checksum; repeated rows count again. Very long runs are words as others are (those of LONG code points or more share a
    class). An empty table gives no rows. Other columns are not looked at."""
    if ratio < 2:
        raise ValueError("ratio: 2 or more, else forms could lead in circles")
    spark = docs.sparkSession
    with passing_tables(spark):
        vocabulary = written(word_counts(docs, key, text, every, least_letters, least_count), "words")
        near = near_words(vocabulary, cell_weight).withColumn("yes", F.col("near_n") >= ratio * F.col("n"))
        words = written(
            near.select(
                "word", "n", "n_near", F.expr("if(yes, near_word, null)").alias("form"), F.expr("if(yes, near_n, null)").alias("form_n")
            ), "forms", keep=True
        )
        ends = written(roots_of(words.where("form is not null")), "ends", keep=True)
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
