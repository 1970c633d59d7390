"""Exact top-k search in binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmill.llm.common import bounded_batches, written

#: Rows of the index, and queries, that one task holds.
INDEX_ROWS, QUERY_ROWS = 16_384, 2_048
_FLIPS: dict[int, np.ndarray] = {}


def sign_codes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, code): a bit for each coordinate, 1 where it is positive. Rows without a vector have no code.

    A code is padded with zeros to whole 16-bit segments. Null coordinates and NaN count as not positive.
    """

    def coded(batches):
        for b in batches:
            codes = [
                None if v is None else np.packbits(
                    np.array([x is not None and x > 0 for x in v], bool), bitorder="little"
                ).tobytes() for v in b.column("v").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([c if c is None else c + b"\0" * (len(c) % 2) for c in codes], pa.binary())],
                names=["id", "code"]
            )

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return bounded_batches(rows).mapInArrow(coded, "id long, code binary")


def flips(weight: int) -> np.ndarray:
    """All 16-bit values with that many bits."""
    if weight not in _FLIPS:
        _FLIPS[weight] = np.array([sum(1 << i for i in c) for c in combinations(range(16), weight)], np.int64)
    return _FLIPS[weight]


class SegmentIndex:
    """Codes by the value of each of their 16-bit segments."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids, self.n, self.m = codes, ids, *codes.shape
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(self.m)]
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << 16))]) for s in range(self.m)]

    def search(self, query: np.ndarray, skip, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest codes, nearest first, ties by id; those with id `skip` left out.

        bound: codes farther away are not wanted, as k codes within it are known elsewhere.

        Round r looks up, in each segment, the values that differ from the query's in r bits. After
        it, each code within m * (r + 1) - 1 has been met, since one of its m segments differs in r bits at
        most. The rounds end when the k-th verified distance, or the bound, is no more than that.
        """
        seen = np.zeros(self.n, bool)
        rows, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        for r in range(17):
            new = []
            for s in range(self.m):
                v = flips(r) ^ int(query[s])
                a, b = self.first[s][v], self.first[s][v + 1]
                n = b - a
                if total := int(n.sum()):
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                    new.append(self.order[s][at])
            if new:
                got = np.concatenate(new)
                got = np.unique(got[~seen[got]])
                seen[got] = True
                got = got if skip is None else got[self.ids[got] != skip]
                d = np.bitwise_count(self.codes[got] ^ query).sum(axis=1, dtype=np.int64)
                if bound is not None:
                    got, d = got[d <= bound], d[d <= bound]
                rows, dist = np.concatenate([rows, got]), np.concatenate([dist, d])
                best = np.lexsort((self.ids[rows], dist))[:k]
                rows, dist = rows[best], dist[best]
            covered = self.m * (r + 1) - 1
            if (bound is not None and bound <= covered) or (len(rows) == k and dist[-1] <= covered):
                break
        return rows, dist


def nearest(index: DataFrame, queries: DataFrame, k: int, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each row of queries the k nearest codes of index.

    Both have (id, code). Codes meet only those of their own length, so there may be several. Rows with the query's own id are left out; ties go to
    the smaller id, null ids last. Each row of a repeated query id is answered. With fewer than k others
    there are fewer ranks.

    Index and queries are dealt into blocks of bounded size. Each query first searches one block of the index: its k-th
    distance there bounds the k-th over all, and the other blocks' rounds end at that bound. Each block's answer
    within the bound is exact, so the merged one is.
    """
    last = (1 << 63) - 1  # stands for null, so that pandas keeps ids whole
    held = lambda df: df.select(F.coalesce("id", F.lit(last)).alias("id"), "code")
    width = F.octet_length("code").alias("width")
    idx = written(held(index).select("*", width, F.monotonically_increasing_id().alias("uid")), "codes")
    qs = written(held(queries).select("*", width, F.monotonically_increasing_id().alias("uid")), "queries")
    n_i, n_q = max(1, -(-idx.count() // index_rows)), max(1, -(-qs.count() // query_rows))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    i = idx.withColumn("ib", block(n_i)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    qs = qs.withColumn("qb", block(n_q)).withColumn("home", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(n_i)).cast("int"))

    def segments(codes) -> np.ndarray:
        return np.frombuffer(b"".join(codes), "<u2").reshape(len(codes), -1)

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            ids = rows["id"].to_numpy()
            table = SegmentIndex(segments(rows["code"]), ids)
            for uid, qid, most, code in zip(asked["uid"], asked["id"], asked["most"], segments(asked["code"]), strict=True):
                got, d = table.search(code, None if qid == last else qid, k, None if most < 0 else most)
                out += [(uid, qid, ids[g], x) for g, x in zip(got, d, strict=True)]
        return pd.DataFrame(out, columns=["uid", "query_id", "neighbor_id", "distance"])

    key = ["width", "ib", "qb"]

    def met(asked: DataFrame) -> DataFrame:
        groups = i.groupBy(*key).cogroup(asked.groupBy(*key))
        return groups.applyInPandas(search, "uid long, query_id long, neighbor_id long, distance int")

    found = met(qs.withColumn("ib", F.col("home")).withColumn("most", F.lit(-1)))
    if n_i > 1:
        found = written(found, "nearest")
        enough = found.groupBy("uid").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where(F.col("n") == k)
        others = F.filter(F.sequence(F.lit(0), F.lit(n_i - 1)), lambda b: b != F.col("home"))
        rest = qs.join(enough.select("uid", "kth"), "uid", "left").withColumn("most", F.coalesce("kth", F.lit(-1)))
        found = found.unionByName(met(rest.withColumn("ib", F.explode(others))))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("distance", "neighbor_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(
        F.nullif("query_id", F.lit(last)).alias("query_id"), "rank",
        F.nullif("neighbor_id", F.lit(last)).alias("neighbor_id"), "distance"
    )
