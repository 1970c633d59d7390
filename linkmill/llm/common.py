"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is missing (a local session, as in tests) a temporary folder takes
    its place; a cluster without the setting is refused, since a local folder would be lost there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-linkmill-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/linkmill/{label}-{uuid.uuid4().hex}"


_PASSING: list[list[str]] = []


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and fixes the rows.

    Within passing_tables() it lives as long as that block, unless it is to keep."""
    path = scratch(df.sparkSession, label)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that written() makes inside, at the end: nothing lazy may read them after it."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def carried(docs: DataFrame, keep: list[str], text: str, results: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """The columns `keep` and text under reserved names, so that no column of docs clashes with one of an operator.

    Gives the rows (text as _text), the reserved names of `keep`, and the columns that give `keep` its own names
    back; one that has the name of a result comes back as <name>_of_row."""
    own = ["_text" if k == text else f"_own{i}" for i, k in enumerate(keep)]
    rows = docs.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keep, own, strict=True) if o != "_text"), F.col(f"`{text}`").alias("_text"))
    return rows, own, [F.col(o).alias(f"{k}_of_row" if k in results else k) for k, o in zip(keep, own, strict=True)]


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are bounded to 8 MB and 2,000 rows, so that long texts need no more memory.

    Limits that the session has already and that are lower stay."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", 2_000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key, None)
        if now is None or not 0 < int(re.sub(r"\D", "", now) or 0) <= most:
            conf.set(key, most)
    return df


def thrifty(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system after its partition.

    Python workers live on for later tasks; without this they keep what the largest partition needed."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes by word; forgets all when it holds `most` words, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads them over the whole range."""
    h = h + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of `width` consecutive word hashes.

    The rolling sum is a difference of two prefix sums, scaled back by a power of the odd base, so
    equal windows get equal hashes wherever they start. Fewer words than `width` have no window.
    """
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.full(n, _INVERSE)
        down[0] = 1
        down = np.cumprod(down, dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * down, dtype=np.uint64, out=sums[1:])
        up = np.full(n - width + 1, BASE)
        up[0] = np.uint64(pow(int(BASE), width - 1, 1 << 64))
        up = np.cumprod(up, dtype=np.uint64)
        return mixed((sums[width:] - sums[:-width]) * up)


def deltas(sorted_hashes: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences, which compress well."""
    d = np.diff(sorted_hashes, prepend=np.uint64(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def undeltas(blob: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)
