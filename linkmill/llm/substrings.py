"""Removal of repeated passages: Rabin-Karp hashes of every window, counted in Spark."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.llm import blocks as B
from linkmill.llm.common import WordHashes, carried, partitions, thrifty, window_hashes

WINDOW = 35


def _windows(texts: list, hashes: WordHashes, width: int):
    """The words of all texts, the number of words of each, the starts of windows and their hashes."""
    words = [(t or b"").split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    h = window_hashes(hashes.of(flat), width)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))  # words from here to the document's end
    starts = np.flatnonzero(left[: len(h)] >= width)
    return words, n, starts, h[starts]


def _spans(cover: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
    return edge.tolist()


def remove_repeats(docs: DataFrame, carry: list[str], text: str = "text", width: int = WINDOW) -> DataFrame:
    """Per row of docs: the columns `carry`, n_words, n_removed, spans, kept_text, kept_sha256.

    Words are `[^\\x20\\x09-\\x0D]+`. Each word is removed that lies in a window of `width` words of
    its document whose word sequence starts anywhere else too, in the same document or another.
    spans lists the maximal removed intervals as start, end, start, end, ... in words. kept_text is
    the text itself where nothing goes, else the kept words joined by one space; kept_sha256 is of the
    kept words joined by one space. Null texts stay null and count as no words. A carried column that has
    the name of a result comes back as <name>_of_row.

    Every window is hashed. A block of documents sends its distinct hashes with their counts to ranges
    of hash values; the counts over all blocks come back to the block, which then marks its repeated
    windows and merges them. A window that is everywhere is sent once a block. Windows are compared
    by 64-bit hashes: two different ones agree with a chance of 2**-64.
    """
    spark = docs.sparkSession
    results = T.StructType.fromDDL("n_words long, n_removed long, spans array<int>, kept_text string, kept_sha256 string")
    rows, named, back = carried(docs, carry, text, results.names)

    def counted(texts):
        return {"n_words": [len(t.split()) for t in texts]}

    table = B.packed(rows, "_text", named, counted, "n_words array<int>")
    total = table.agg(F.sum(F.expr("aggregate(n_words, 0L, (a, x) -> a + x)"))).first()[0] or 0
    n_ranges = B.n_ranges(total, partitions(spark))

    def hashed(batches):
        known = WordHashes()
        for b in batches:
            for block, sizes, blob in zip(*(b.column(c).to_pylist() for c in ("block_id", "sizes", "blob")), strict=True):
                h, n = np.unique(_windows(B.texts_of(blob, sizes), known, width)[3], return_counts=True)
                if len(h):
                    yield B.range_batch(list(B.by_range(block, h, n_ranges, n)))

    counts = B.totals(table.select("block_id", "sizes", "blob").mapInArrow(thrifty(hashed), B.RANGES), 2)
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in named] + results.fields)
    arrow = pa.schema([(f.name, B.to_arrow(f.dataType)) for f in schema.fields])

    def removed(batches):
        known = WordHashes()
        for b in batches:
            for row in b.to_pylist():
                texts = B.texts_of(row["blob"], row["sizes"])
                words, n, starts, h = _windows(texts, known, width)
                _, at, own = np.unique(h, return_inverse=True, return_counts=True)
                again = starts[np.maximum(B.counts_of(row["parts"], len(own)), own)[at] >= 2] if len(h) else starts
                edge = np.zeros(int(n.sum()) + 1, np.int32)
                edge[again] += 1
                edge[again + width] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                out: dict[str, list] = {"n_words": n.tolist(), "n_removed": [], "spans": [], "kept_text": [], "kept_sha256": []}
                first = 0
                for t, w in zip(texts, words, strict=True):
                    g = gone[first : first + len(w)]
                    first += len(w)
                    k = int(g.sum())
                    kept = b" ".join(compress(w, ~g) if k else w)
                    out["n_removed"].append(k)
                    out["spans"].append(_spans(g) if k else [])
                    out["kept_text"].append(kept if k else t)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"] = pa.array(out["kept_text"], pa.binary()).cast(pa.string())
                cols = [row[f"c_{c}"] for c in named] + list(out.values())
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)],
                    schema=arrow
                )

    return B.with_totals(table.drop("n_words"), counts).mapInArrow(thrifty(removed), schema).select(*back, *results.names)
