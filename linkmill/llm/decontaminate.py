"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmill.llm.common import bounded_batches, carried, thrifty, written

WINDOW = 13
#: Most bytes of benchmark text that one set of shift tables may cover; more items go to more sets.
BLOCK_BYTES = 4 << 20
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The runs of 0-9, a-z (A-Z lower-cased first) and characters beyond ASCII."""
    return text.translate(_KEEP).split()


class WuManber:
    """Finds all occurrences of word sequences of one length.

    The text is read through a window of that length. The block of its last two words gives the
    shift: how far the window can move so that no pattern is missed. Where the shift is 0, the block
    is the end of some pattern; its suffix bucket holds these patterns, which are compared directly.
    """

    def __init__(self, length: int, patterns: list[tuple[int | None, list[bytes]]]):
        """patterns: items with their words; each sequence of `length` words of an item is a pattern."""
        self.length, self.block = length, min(2, length)
        self.step = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = defaultdict(list)
        for item, words in patterns:
            n, k = len(words), self.block
            for end in range(k, n + 1):
                b = tuple(words[end - k : end])
                # the block ends some pattern if one fits before it; else it lies that far before the first end
                self.shift[b] = min(self.shift.get(b, self.step), max(0, length - end))
                if end >= length:
                    self.bucket[b].append((words, end - length, item))

    def find(self, words: list[bytes]):
        """Yields (start, item) for each occurrence of a pattern, by ascending start."""
        n, at, k, shift, step = len(words), self.length, self.block, self.shift, self.step
        while at <= n:
            b = tuple(words[at - k : at])
            s = shift.get(b, step)
            if s:
                at += s
                continue
            seen = words[at - self.length : at]
            for own, start, item in self.bucket[b]:
                if own[start : start + self.length] == seen:
                    yield at - self.length, item
            at += 1


def _finders(items: list[tuple[int | None, str]], window: int) -> list[WuManber]:
    by_length: dict[int, list] = defaultdict(list)
    for item, text in items:
        words = words_of((text or "").encode())
        if words:
            by_length[min(window, len(words))].append((item, words))
    return [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searched(rows: DataFrame, items: list, window: int, keep: list[str], hits_only: bool = False) -> DataFrame:
    """Each row's kept columns, n_words, the hit spans and the items found, for one block of items."""
    shipped = rows.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        finders = _finders(shipped.value, window)
        for b in batches:
            counts, spans, found = [], [], []
            for t in b.column("_text").cast(pa.binary()).to_pylist():
                words, hit, ids = words_of(t or b""), [], set()
                for f in finders:
                    for start, item in f.find(words):
                        hit.append((start, start + f.length))
                        ids.add(item)
                counts.append(len(words))
                spans.append([x for s in _merged(hit) for x in s])
                found.append(sorted(ids - {None}))
            got = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *got], names=[*keep, "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if hits_only else out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", n_words long, spans array<int>, items array<long>"
    return bounded_batches(rows).mapInArrow(thrifty(search), schema)


def _joined(found: DataFrame) -> DataFrame:
    """The spans and items that several blocks found in a row as one list each, without overlaps."""

    def join(batches):
        for b in batches:
            many = b.column("spans").to_pylist()
            spans = [[x for s in _merged([(m[i], m[i + 1]) for m in ms for i in range(0, len(m), 2)]) for x in s] for ms in many]
            items = [sorted({i for m in ms for i in m}) for ms in b.column("items").to_pylist()]
            arrays = [b.column("_uid"), b.column("n_words"), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_uid", "n_words", "spans", "items"])

    lists = found.groupBy("_uid").agg(
        F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
        F.collect_list("items").alias("items")
    )
    return lists.mapInArrow(join, "_uid long, n_words long, spans array<int>, items array<long>")


def search_benchmark(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of docs: the columns `keep`, n_words, n_hit, n_items, items, spans, items_sha256, contaminated.

    A window is `window` consecutive words of a benchmark item; an item with fewer words, but some, is
    one window. A document word within any occurrence of a window is hit. Contaminated: n_hit > 0 and
    20 * n_hit >= n_words. Null or wordless texts have no words and no hits; items with null
    ids are hit like others, but are not among n_items, items and items_sha256. A kept column that has the
    name of a result comes back as <name>_of_row.

    The benchmark is read in blocks of at most block_bytes of text (one block unless it is larger);
    each is broadcast and all documents are searched for it where they lie. Only with several blocks are
    hits, never texts, brought together by row.
    """
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("b_text"))
    size = bench.agg(F.sum(F.octet_length("b_text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-2 * size // block_bytes))
    part = lambda k: [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "b_text"), F.lit(n_blocks)) == k).collect()]
    results = ["n_words", "n_hit", "n_items", "items", "spans", "items_sha256", "contaminated"]
    rows, own, back = carried(docs, keep, text, results)
    if n_blocks == 1:
        out = _searched(rows, part(0), window, own)
    else:
        rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()), "decontaminate")
        found = _searched(rows, part(0), window, ["_uid"])
        for k in range(1, n_blocks):
            found = found.unionByName(_searched(rows, part(k), window, ["_uid"], hits_only=True))
        out = rows.select("_uid", *own).join(_joined(found), "_uid")
    n_hit = F.expr("cast(aggregate(sequence(0, size(spans) div 2 - 1), 0L, (n, i) -> n + spans[2 * i + 1] - spans[2 * i]) as bigint)")
    n_hit = F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    sorted_ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.encode(sorted_ids, "UTF-8"), 256)).withColumn("contaminated", contaminated())
    return out.select(*back, *results)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
