"""Documents in compressed blocks: a table of few wide rows that later steps read in the same order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.llm.common import bounded_batches, deltas, thrifty, undeltas, written

BLOCK_BYTES = 1 << 20
#: A document's number is its block's, shifted by this many bits, plus its place in the block.
PLACE_BITS = 20


def packed(
    df: DataFrame, text: str, carry: list[str], extra: Callable[[list[bytes]], dict] | None = None,
    extra_schema: str = "", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Blocks of about block_bytes of text (one document at least), written to the shared folder.

    Columns: block_id, sizes (bytes of each text, -1 for null), blob (the texts, zstd), and for each
    column in `carry` an array c_<name>; `extra` adds arrays computed from the texts. Row numbers
    come from the block, so null or repeated ids do no harm. The written table fixes the order.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    head = T.StructType(
        [
            T.StructField("block_id", T.LongType()), T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("blob", T.BinaryType())
        ]
    )
    for c in carry:
        head.add(f"c_{c}", T.ArrayType(types[c]))
    for f in T.StructType.fromDDL(extra_schema).fields if extra_schema else []:
        head.add(f)

    def pack(batches):
        squeeze, seq = zstandard.ZstdCompressor(level=1), 0
        texts: list = []
        held: dict[str, list] = {c: [] for c in carry}
        size = 0

        def row():
            nonlocal seq, size
            got = [t or b"" for t in texts]
            out = {
                "block_id": [(TaskContext.get().partitionId() << 18) + seq],
                "sizes": [[-1 if t is None else len(t) for t in texts]], "blob": [squeeze.compress(b"".join(got))]
            }
            out |= {f"c_{c}": [v] for c, v in held.items()}
            if extra:
                out |= {k: [v] for k, v in extra(got).items()}
            b = pa.RecordBatch.from_arrays([pa.array(v, to_arrow(head[k].dataType)) for k, v in out.items()], names=list(out))
            seq, size = seq + 1, 0
            texts.clear()
            for v in held.values():
                v.clear()
            return b

        for b in batches:
            cols = [b.column(c).to_pylist() for c in carry]
            for i, t in enumerate(b.column(text).cast(pa.binary()).to_pylist()):
                texts.append(t)
                for c, v in zip(carry, cols, strict=True):
                    held[c].append(v[i])
                size += len(t or b"") + 16
                if size >= block_bytes:
                    yield row()
        if texts:
            yield row()

    return written(bounded_batches(df).select(text, *[c for c in carry if c != text]).mapInArrow(thrifty(pack), head), "blocks")


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def texts_of(blob: bytes, sizes) -> list[bytes | None]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    out, at = [], 0
    for n in sizes:
        out.append(None if n < 0 else bytes(raw[at : at + n]))
        at += max(n, 0)
    return out


def unpacked(blocks: DataFrame, schema: T.StructType, text: str) -> DataFrame:
    """The rows at `places` of each block, in the given schema."""
    arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in schema.fields])

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                texts = texts_of(row["blob"], row["sizes"])
                at = row["places"]
                cols = [
                    pa.array([texts[i] for i in at], pa.binary()).cast(pa.string()) if f.name == text else pa.array(
                        [row[f"c_{f.name}"][i] for i in at], f.type
                    ) for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return blocks.mapInArrow(thrifty(unpack), schema)


def by_range(block_id: int, hashes: np.ndarray, n_ranges: int, counts: np.ndarray | None = None) -> Iterator[tuple]:
    """(range, block_id, base, hashes, counts) for each range of hash values that has some; hashes ascend."""
    r = ((hashes >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1)))
    for a, b in zip(cut, [*cut[1:], len(r)], strict=True):
        yield int(r[a]), block_id, int(a), deltas(hashes[a:b]), None if counts is None else planes(counts[a:b])


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2**16 as a plane of low bytes and one of high bytes; larger ones count as 65535."""
    return np.minimum(values, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(2, -1).T).view("<u2").ravel()


RANGES = "range int, block_id long, base int, hashes binary, counts binary"


def range_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [("range", pa.int32()), ("block_id", pa.int64()), ("base", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def n_ranges(total_words: int, partitions: int) -> int:
    """So many that a range has about a million hashes at most, and each partition some ranges."""
    return int(max(4 * partitions, total_words // 1_000_000 + 1))


def totals(ranges: DataFrame, least: int) -> DataFrame:
    """Counts each hash over all blocks, range by range: block_id, base, n, counts (0 where below least).

    A block sends each of its hashes once with its count, so a hash that is everywhere reaches its
    range once a block, not once an occurrence."""

    def count(pdf):
        import pandas as pd

        parts = [undeltas(h) for h in pdf["hashes"]]
        own = [unplanes(c) for c in pdf["counts"]]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(own).astype(float))[at].astype(np.int64)
        total[total < least] = 0
        ends = np.cumsum([len(p) for p in parts])
        got = [total[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]
        some = [bool(g.any()) for g in got]
        return pd.DataFrame({"block_id": pdf["block_id"], "base": pdf["base"], "n": [len(g) for g in got], "counts": [planes(g) for g in got]})[some]

    return ranges.groupBy("range").applyInPandas(count, "block_id long, base int, n int, counts binary")


def with_totals(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Each block with the counts of its hashes: an array `parts` of (base, n, counts), null for none."""
    per_block = counts.groupBy("block_id").agg(F.collect_list(F.struct("base", "n", "counts")).alias("parts"))
    return blocks.join(per_block, "block_id", "left")


def counts_of(parts, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for p in parts or ():
        out[p["base"] : p["base"] + p["n"]] = unplanes(p["counts"])
    return out
