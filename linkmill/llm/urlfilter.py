"""URL rules in sorted arrays of 64-bit digests, probed by vectorised binary search."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.common import bounded_batches, scratch, written

#: Most bytes of rules that one array may hold; more rules go to more arrays.
BLOCK_BYTES = 64 << 20
STRINGS = pa.schema([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])


def split_url(url: str):
    """(host, path) as F.expr strings for a url column; both empty for null or no `://`."""
    rest = f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return host, path


def digests_of(keys: list[bytes]) -> np.ndarray:
    """The 64-bit xxhash of each key, as Spark's xxhash64 function gives it for a string."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)).view(np.int64)


class DigestArray:
    """Rules in the ascending order of the xxhash64 of host + "\n" + path: digests and strings, both memory-mapped files."""

    def __init__(self, digests: str, strings: str):
        n = os.path.getsize(digests) // 8
        self.digests = np.memmap(digests, np.int64, "r") if n else np.empty(0, np.int64)
        self.rules = pa.ipc.open_file(pa.memory_map(strings)).read_all() if n else STRINGS.empty_table()
        self.lengths = sorted(pc.unique(pc.utf8_length(self.rules["path"])).to_pylist())

        self.rule = lru_cache(1 << 16)(self._rule)

    def _rule(self, i: int) -> tuple[str, str, str]:
        return tuple(self.rules[c][i].as_py() for c in ("host", "path", "verdict"))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, or -1: a binary search over digests, confirmed on the stored strings."""
        d = digests_of(keys)
        at = np.searchsorted(self.digests, d)
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == d) if len(self.digests) else ():
            j = at[i]
            while j < len(self.digests) and self.digests[j] == d[i]:  # a run of equal digests is searched to its end
                host, path, verdict = self.rule(j)
                if f"{host}\n{path}".encode() == keys[i] and (out[i] < 0 or verdict == "block"):
                    out[i] = j
                j += 1
        return out


def _best(array: DigestArray, hosts: list[str], paths: list[str]):
    keys, owner = [], []
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if not h:
            continue
        labels = h.split(".")
        for k in range(len(labels)):
            tail = ".".join(labels[k:])
            for n in array.lengths:
                if n <= len(p):
                    keys.append(f"{tail}\n{p[:n]}".encode())
                    owner.append(i)
    best: list = [None] * len(hosts)
    for i, j in zip(owner, array.find(keys), strict=True):
        if j >= 0:
            h, p, verdict = array.rule(j)
            rank = (len(h) + len(p), len(h), h + p, verdict)
            if best[i] is None or rank > best[i]:
                best[i] = rank
    return best


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
    block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of pages: key, host, path, rule, verdict.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains of it, if
    the url's path starts with the rule's. The longest rule (host and path together) wins; of equally
    long ones the one with the longer host, then `block`. Without a rule the verdict is `default`.
    Rules without a host fit nothing. Null urls and urls without `://` have an empty host and path.

    Spark hashes and sorts the rules and writes them to the shared folder in blocks of at most block_bytes. A block
    becomes two files there, of digests and of strings, in the order of the digests; each executor fetches them once and its
    tasks map them into memory, so none parses or sorts rules, and neither driver nor task holds more than a block.
    """
    spark = pages.sparkSession
    total = rules.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_bytes))
    cells = rules.where("host is not null and path is not null and verdict is not null and host != ''").dropDuplicates(["host", "path", "verdict"])
    digest = F.xxhash64(F.concat_ws("\n", "host", "path"))
    cells = cells.select(F.pmod(digest, F.lit(n_blocks)).alias("block"), digest.alias("digest"), "host", "path", "verdict")
    path = scratch(spark, "url-rules")
    cells.repartition("block").sortWithinPartitions("block", "digest").write.partitionBy("block").parquet(path)
    stored = spark.read.schema("digest long, host string, path string, verdict string, block long").parquet(path)
    host, tail = split_url("u")
    rows = pages.select(
        F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("u")
    ).select("key", F.expr(host).alias("host"), F.expr(tail).alias("path"))
    names = [r[0] for r in stored.select("block").distinct().collect()]  # block numbers only
    if len(names) > 1:  # several arrays: each judges all rows, the longest rule of a row wins
        rows = rows.withColumn("uid", F.monotonically_increasing_id())
        rows = written(rows, "urls")
        parts = None
        for b in names:
            part = _probed(rows, mapped_block(stored, b, path), ["uid"])
            parts = part if parts is None else parts.unionByName(part)
        top = parts.groupBy("uid").agg(F.max("rank").alias("rank"))
        rows = rows.join(top, "uid", "left")
    else:
        rows = _probed(rows, mapped_block(stored, names[0] if names else 0, path), ["key", "host", "path"])
    return rows.select(
        F.col("key").alias(key), "host", "path", F.col("rank.rule").alias("rule"),
        F.coalesce(F.col("rank.verdict"), F.lit(default)).alias("verdict")
    )


def mapped_block(stored: DataFrame, block: int, path: str) -> str:
    """Writes one block's files to the shared folder and lets executors fetch them; gives the name without ending."""
    spark = stored.sparkSession
    rows = stored.where(F.col("block") == block).sort("digest").select("digest", "host", "path", "verdict").toArrow()  # block_bytes at most
    strings = pa.BufferOutputStream()
    with pa.ipc.new_file(strings, STRINGS) as f:
        f.write_table(rows.select(STRINGS.names).cast(STRINGS))
    name = f"rules-{uuid.uuid4().hex}"
    digests = np.asarray(rows["digest"].to_numpy(), np.int64).tobytes()
    for ending, content in (("u64", digests), ("arrow", strings.getvalue().to_pybytes())):
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-files/{name}.{ending}")
        out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
        out.write(bytearray(content))
        out.close()
        spark.sparkContext.addFile(f"{path}-files/{name}.{ending}")
    return name


def _probed(rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    rank = pa.struct([("n", pa.int32()), ("host_n", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])

    def probe(batches):
        array = DigestArray(SparkFiles.get(f"{name}.u64"), SparkFiles.get(f"{name}.arrow"))
        for b in batches:
            best = _best(array, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k) for k in keep),
                    pa.array([x and dict(zip(("n", "host_n", "rule", "verdict"), x, strict=True)) for x in best], rank)
                ],
                names=[*keep, "rank"]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", rank struct<n:int,host_n:int,rule:string,verdict:string>"
    return bounded_batches(rows).mapInArrow(probe, schema)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
