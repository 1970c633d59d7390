"""Best-fit packing of token sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkmill.llm.common import bounded_batches, passing_tables, thrifty, written
from linkmill.llm.tokens import encoder, vocabulary

LIMIT, END = 1024, 2
#: Documents of at most this many tokens are placed together, at the end; longer ones by halves of the limit.
LAST_CLASS = 128
#: Rows of a round's table that one task takes, about.
TASK_ROWS = 200_000
#: New sequences are opened when a round places no more than this share of the documents of its class.
PROGRESS = 0.2


def pieces(docs: DataFrame, key: str, text: str, path: str, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most limit tokens.

    Columns: uid, key, piece, start, length, ids_crc32, ids (null without with_ids). uid numbers the pieces
    of a partition one after another. A document's tokens are its ids, then `end`; null text is empty.
    Only a longer document is cut, into pieces of limit tokens, of which the first may be shorter.
    """

    def cut(batches):
        encode, uid = encoder(path), TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                all_ids = np.append(encode(t or ""), np.array([end], "<u4"))
                first = len(all_ids) % limit or limit
                edges = [0, *range(first, len(all_ids) + 1, limit)]
                for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    blob = all_ids[x:y].tobytes()
                    out.append((uid, k, i, x, y - x, zlib.crc32(blob), blob if with_ids else None))
                    uid += 1
            if out:
                columns = zip(zip(*out, strict=True), arrow.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], schema=arrow)

    arrow = pa.schema(
        [
            ("uid", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
            ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())
        ]
    )
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "uid long, key long, piece int, start long, length long, ids_crc32 long, ids binary"
    return bounded_batches(rows).mapInArrow(thrifty(cut), schema)


def few(df: DataFrame, n_rows: int) -> DataFrame:
    """df in as many tasks as so many rows need: the tables of a round are often small, and rounds are many."""
    return df.coalesce(max(1, -(-n_rows // TASK_ROWS)))


def small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of whole numbers as a table that needs no job of its own."""
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names))


def ranked(df: DataFrame, size: str, n_counts: int | None = None, one: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """df, written, with each row's rank (from 0) among those of its size, and the number of rows of each size.

    This is a sort by counting: rows are numbered by size where they lie, and the counts of the partitions
    before are added, so no row moves and no size is gathered. Sizes are integers of a small range.
    n_counts: how many different sizes all partitions have at most, added up, if that is known. one: df has one partition."""
    names = df.columns

    def numbered(batches):
        seen: dict[int, int] = {}
        for b in batches:
            sizes = b.column(size).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            values, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
            before = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            nth = np.empty(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - np.repeat(first - before, counts)
            for v, n in zip(values.tolist(), (before + counts).tolist(), strict=True):
                seen[v] = n
            part = np.full(len(sizes), TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(nth)], names=[*b.schema.names, "part", "nth"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = written(df.mapInArrow(numbered, f"{kinds}, part long, nth long"), "numbered")
    if one:
        of_size = {r[0]: r[1] for r in rows.groupBy(size).agg(F.count("*")).collect()}  # a row for each size
        return rows.select(*names, F.col("nth").alias("rank")), of_size
    earlier = Window.partitionBy(size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(size, "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = written(few(counts, n_counts) if n_counts else counts, "counts")
    of_size = {r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("n")).coalesce(1).collect()}  # a row for each size
    rows = rows.join(counts.drop("n"), [size, "part"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    return rows, of_size


def sweep(items: dict[int, int], slots: dict[int, int]) -> list[tuple[int, int, int]]:
    """Matches items with slots by size: (length, n, first) says that n items of a length are placed, one
    in each of the slots from number `first` on, where slots are numbered by ascending size.

    Both are counts by size. From the largest size down, an item is placed if a slot of its length or more is
    left by the larger ones. Then, from the smallest up, each takes the smallest slot that fits, its successor,
    or the one after its neighbour's where that has it: rank k goes to k + max(successor(j) - j for j <= k).
    """
    sizes = np.array(sorted(slots), np.int64)
    many = np.cumsum([0, *(slots[s] for s in sizes.tolist())])
    smaller = {n: int(many[np.searchsorted(sizes, n)]) for n in items}
    most, above, place = 0, 0, {}
    for n in sorted(items, reverse=True):
        above += items[n]
        without = max(most, above - (int(many[-1]) - smaller[n]))
        place[n] = items[n] - (without - most)
        most = without
    out, k, shift = [], 0, 0
    for n in sorted(items):
        if place[n]:
            shift = max(shift, smaller[n] - k)
            out.append((n, place[n], k + shift))
            k += place[n]
    return out


def classes(limit: int) -> list[tuple[int, int]]:
    """Ranges (above, up to) of lengths that are placed one after another."""
    out, top = [], limit
    while top:
        low = top // 2 if top > LAST_CLASS else 0
        out.append((low, top))
        top = low
    return out


def placed(spark: SparkSession, pieces_: DataFrame, limit: int = LIMIT) -> DataFrame:
    """uid, sequence_id for each row of pieces_ (uid, length), by bulk-synchronous best fit.

    Lengths are taken by classes of halves, the longest first. In a round the pieces of a class and the gaps
    of the sequences are ranked by size; a gap offers as many slots as it takes pieces of the class's largest
    left, one at least. Pieces find their slots by sweep(), a join on the slot's number gives each
    its sequence, the gaps shrink by what they got, and the next round begins. If a round places (almost)
    nothing, as many sequences are opened as the rest needs at least.

    Only counts by length and by gap, limit rows at most, come to the driver. Rounds depend on the limit
    and on the mix of lengths, not on the number of pieces."""
    items, left = ranked(pieces_.select("uid", "length"), "length")
    items = written(items, "items")
    done = dict.fromkeys(left, 0)
    gaps = spark.createDataFrame([], "sequence_id long, gap long, rank long")
    by_gap: dict[int, int] = {}
    opened, found = 0, None
    for low, top in classes(limit):
        while now := {n: left[n] for n in left if low < n <= top and left[n]}:
            most = max(now)
            each = {g: max(1, g // most) for g in by_gap if g >= min(now)}
            slots: dict[int, int] = {}
            base = {}
            for g in sorted(each):
                base[g] = sum(slots.values())
                slots[min(g, most)] = slots.get(min(g, most), 0) + each[g] * by_gap[g]
            moves = sweep(now, slots)
            if moves:
                to = small(spark, [(n, done[n], done[n] + k, first - done[n]) for n, k, first in moves], ["length", "lo", "hi", "shift"])
                who = items.join(F.broadcast(to), "length").where("rank >= lo and rank < hi").select(
                    "uid", "length", (F.col("rank") + F.col("shift")).alias("slot")
                )
                offer = small(spark, [(g, base[g], by_gap[g], each[g]) for g in each], ["gap", "base", "n", "each"])
                free = gaps.join(F.broadcast(offer), "gap").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)))
                free = free.select("sequence_id", (F.col("base") + F.col("j") * F.col("n") + F.col("rank")).alias("slot"))
                got = written(few(who.join(free, "slot").select("uid", "length", "sequence_id"), sum(k for _, k, _ in moves)), "placed")
                found = got if found is None else found.unionByName(got)
                for n, k, _ in moves:
                    done[n], left[n] = done[n] + k, left[n] - k
                used = got.groupBy("sequence_id").agg(F.sum("length").alias("used"))
                gaps = gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            rest = {n: left[n] for n in now if left[n]}
            if rest and sum(k for _, k, _ in moves) <= PROGRESS * sum(now.values()):
                tokens, number = sum(n * k for n, k in rest.items()), sum(rest.values())
                more = max(-(-tokens // limit), -(-number // (limit // min(rest))))
                fresh = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(limit).cast("long").alias("gap"))
                gaps, opened = gaps.select("sequence_id", "gap").unionByName(fresh), opened + more
            smallest = min((n for n in left if left[n]), default=None)
            if smallest is not None:
                gaps, by_gap = ranked(
                    few(gaps.select("sequence_id", "gap").where(F.col("gap") >= smallest), opened), "gap",
                    limit * -(-opened // TASK_ROWS), opened <= TASK_ROWS
                )
    if found is None:
        found = spark.createDataFrame([], "uid long, length long, sequence_id long")
    return found.select("uid", "sequence_id")


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT,
    end: int = END, with_ids: bool = False
) -> DataFrame:
    """Per piece of each document: key, piece, start, length, ids_crc32, ids (with_ids), sequence_id, offset.

    Sequences hold at most limit tokens, each filled from 0 without gaps; tests find at most 0.5 % and one more than
    best fit, longest first, needs. Rows with equal or null keys are documents of their own. An
    empty table gives no pieces.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, key, text, path or vocabulary("byte_bpe_50k.tiktoken"), limit, end, with_ids), "pieces", keep=True)
    with passing_tables(spark):
        places = written(placed(spark, cut, limit), "places", keep=True)
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return cut.join(places, "uid").select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "ids", "sequence_id", offset)
