"""Bounded-space online packing: each partition fills a fixed number of open windows, leftovers merge at the end."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.llm.blocks import to_arrow
from linkmill.llm.common import bounded_batches, thrifty, written
from linkmill.llm.tokens import encoder, vocabulary

LIMIT, END = 2048, 1
#: Windows that a partition keeps open.
OPEN = 32
#: Partitions (or groups of the step before) whose open windows meet in one task when leftovers merge.
MERGED = 64

#: (key, tokens of its document, its document's tokens before it, ids): a piece in a window.
Piece = tuple[object, int, int, np.ndarray]


def tokens_in(pieces: list[Piece]) -> int:
    return sum(len(p[3]) for p in pieces)


def divided(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n tokens of pieces, and the rest."""
    head, at = [], 0
    while n and at < len(pieces):
        key, total, start, ids = pieces[at]
        if len(ids) > n:
            return [*head, (key, total, start, ids[:n])], [(key, total, start + n, ids[n:]), *pieces[at + 1 :]]
        head.append(pieces[at])
        n, at = n - len(ids), at + 1
    return head, pieces[at:]


class OpenWindows:
    """At most `most` open windows of `limit` tokens. put() and close() yield the windows that are emitted."""

    def __init__(self, limit: int = LIMIT, most: int = OPEN):
        self.limit, self.most = limit, most
        self.gaps: list[tuple[int, int]] = []  # (gap, number), ascending: the fullest window first
        self.held: dict[int, list[Piece]] = {}
        self.opened = 0

    def put(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Places pieces that belong together in the fullest window that takes them whole.

        Where none does, a new window is opened, or, if all are open, the fullest is topped up with the
        first of their tokens and emitted, and the rest goes on. What is longer than a window is cut."""
        n = tokens_in(pieces)
        while n >= self.limit:
            head, pieces = divided(pieces, self.limit)
            yield head
            n -= self.limit
        while n:
            at = bisect_left(self.gaps, (n, 0))
            if at == len(self.gaps) and at == self.most:
                gap, number = self.gaps.pop(0)
                head, pieces = divided(pieces, gap)
                n -= gap
                yield self.held.pop(number) + head
                continue
            if at == len(self.gaps):
                gap, number = self.limit, self.opened
                self.held[number] = []
                self.opened += 1
            else:
                gap, number = self.gaps.pop(at)
            self.held[number] += pieces
            if gap == n:
                yield self.held.pop(number)
            else:
                insort(self.gaps, (gap - n, number))
            return

    def left(self) -> Iterator[list[Piece]]:
        """The windows still open, the fullest first."""
        yield from (self.held[number] for _, number in self.gaps)

    def close(self) -> Iterator[list[Piece]]:
        """Emits what is open: the fullest windows topped up from the emptiest; the last tokens as windows of powers of two."""
        rest = list(self.left())
        while len(rest) > 1:
            gap = self.limit - tokens_in(rest[0])
            head, tail = divided(rest.pop(), gap)
            rest[0] = rest[0] + head
            if tail:
                rest.append(tail)
            if tokens_in(rest[0]) == self.limit:
                yield rest.pop(0)
        last = rest[0] if rest else []
        while n := tokens_in(last):
            head, last = divided(last, 1 << (n.bit_length() - 1))
            yield head


def pack_online(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, end: int = END,
    most_open: int = OPEN, with_ids: bool = False
) -> DataFrame:
    """Per piece of each document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (with_ids).

    Documents come as they lie in their partition, as ids and then `end`. Each goes whole into the fullest
    of the partition's open windows that takes it; where none does, a window is opened, and where `most_open`
    are, the fullest is topped up with the document's first tokens and emitted at exactly `limit`. Windows open
    at a partition's end carry their ids on: those of MERGED partitions are placed by the same rule in one task,
    those of MERGED such tasks in another, and so on, so no task sees more than MERGED * most_open windows
    and steps grow with the logarithm of the partitions. The last task's leftovers top each other up, and fewer
    than `limit` last tokens become windows of powers of two. So no sequence needs padding, whatever the data.

    Null text is empty, and an empty document is its end token. Documents with equal or null keys stay documents
    of their own; very long ones fill windows of their own and leave less than a window. Ties go to the window
    opened first. An empty table gives no pieces. Other columns are not looked at.
    """
    kind = docs.schema[key].dataType
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    shape = T.StructType.fromDDL(
        "part int, sequence_id long, open boolean, doc_tokens array<long>, start array<long>, "
        "length array<long>, ids_crc32 array<long>, offset array<long>, ids array<binary>"
    ).add("keys", T.ArrayType(kind))
    arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in shape])

    def batch(windows: list[tuple[bool, list[Piece]]], part: int, first: int) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in arrow}
        for i, (is_open, pieces) in enumerate(windows):
            sizes = [len(p[3]) for p in pieces]
            row = {
                "part": part, "sequence_id": first + i, "open": is_open, "keys": [p[0] for p in pieces],
                "doc_tokens": [p[1] for p in pieces], "start": [p[2] for p in pieces], "length": sizes,
                "ids_crc32": None if is_open else [zlib.crc32(p[3].tobytes()) for p in pieces],
                "offset": [0, *np.cumsum(sizes[:-1]).tolist()],
                "ids": [p[3].tobytes() for p in pieces] if is_open or with_ids else None,
            }
            for k, v in row.items():
                out[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    def fill(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        windows, number = OpenWindows(limit, most_open), part << 32
        for b in batches:
            done: list[tuple[bool, list[Piece]]] = []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(t or ""), np.array([end], "<u4"))
                done += [(False, w) for w in windows.put([(k, len(ids), 0, ids)])]
            if done:
                yield batch(done, part, number)
                number += len(done)
        if rest := [(True, w) for w in windows.left()]:
            yield batch(rest, part, number)

    def merge(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["sequence_id"])
            part = rows[0]["part"] // MERGED
            windows, done = OpenWindows(limit, most_open), []
            for r in rows:
                ids = (np.frombuffer(x, "<u4") for x in r["ids"])
                done += windows.put(list(zip(r["keys"], r["doc_tokens"], r["start"], ids, strict=True)))
            done = [(False, w) for w in [*done, *(windows.close() if last else ())]]
            rest = [] if last else [(True, w) for w in windows.left()]
            return pa.Table.from_batches([batch(done + rest, part, (level << 56) + (part << 32))])

        return run

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    filled = written(bounded_batches(rows).mapInArrow(thrifty(fill), shape), "windows")
    closed, left, level = filled.where("not open"), filled.where("open"), 0
    while True:
        parts, level = (left.agg(F.max("part")).first()[0] or 0) + 1, level + 1
        groups = left.groupBy(F.floor(F.col("part") / MERGED).alias("together"))
        merged = written(groups.applyInArrow(merge(level, parts <= MERGED), shape), "windows")
        closed, left = closed.unionByName(merged.where("not open")), merged.where("open")
        if parts <= MERGED:
            break
    columns = ["keys", "start", "length", "ids_crc32", "doc_tokens", "offset", *(["ids"] if with_ids else [])]
    each = closed.select("sequence_id", F.explode(F.arrays_zip(*columns)).alias("p"))
    of = ["start", "length", "ids_crc32", "doc_tokens"]
    return each.select(
        F.col("p.keys").alias(key), *(f"p.{c}" for c in of), "sequence_id", "p.offset", *(["p.ids"] if with_ids else [])
    )
