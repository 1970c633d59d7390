"""Literal search through a stored index of trigrams."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.operators.grams import SIZE

#: Texts of a block, about; a trigram's keys of a block are one row.
BLOCK_TEXTS = 20_000
#: Pairs of a text and a trigram, about, from which a task makes lists at once.
TASK_GRAMS = 2_000_000
#: Blocks share at most so many folders of texts.
FOLDERS = 1024
#: Rarest trigrams of a query whose lists are intersected.
LISTS = 3


def write_index(texts: DataFrame, key: str, text: str, path: str, block_texts: int = BLOCK_TEXTS) -> None:
    """Writes two tables: `texts` (key, low, block), in folders by a hash of the key, and `postings` (gram, block, n, keys),
    sorted by gram, so that a search reads the row groups of its grams and the folders of its hits.

    low is the text in lower case; null is left out. keys are those of a block's texts with the gram, so
    a frequent gram is a row for each block and not one long list. Equal keys are texts of their own."""
    spark = texts.sparkSession
    blocks = max(1, -(-texts.count() // block_texts))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("folder", F.col("block") % FOLDERS)
    rows.repartition("folder", "block").sortWithinPartitions("folder", "block").write.partitionBy("folder").parquet(f"{path}/texts")
    kept = stored_texts(spark, path, rows.schema["key"].dataType)
    postings = lists_by_gram(kept).select("gram", "block", F.size("keys").alias("n"), "keys")
    postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")


def lists_by_gram(kept: DataFrame) -> DataFrame:
    """(gram, block, keys): the sorted different keys of a block's texts with each trigram.

    A task makes lists of some texts each, so that a gram is a row for each of these and not for each text."""

    def lists(found, block, keys):
        at = np.repeat(np.array([i for i, _ in found]), [len(g) for _, g in found])
        gram, blocks = np.concatenate([g for _, g in found]), block[at]
        order = np.lexsort((gram, blocks))
        at, gram, blocks = at[order], gram[order], blocks[order]
        first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (blocks[1:] != blocks[:-1])])
        codes = np.stack([gram[first] >> np.uint64(x) & np.uint64(0x1FFFFF) for x in (42, 21, 0)], axis=1).astype("<u4")
        text = codes.tobytes().decode("utf-32-le")
        ends = pa.array(np.r_[first, len(gram)].astype(np.int32))
        names = pa.array([text[i : i + SIZE] for i in range(0, len(text), SIZE)], pa.string())
        columns = [names, pa.array(blocks[first], pa.int32()), pa.ListArray.from_arrays(ends, keys.take(pa.array(at)))]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "block", "keys"])

    def partial(batches):
        for b in batches:
            block, keys, found, n = b.column("block").to_numpy(), b.column("key"), [], 0
            for i, x in enumerate(b.column("low")):
                code = np.frombuffer(x.as_py().encode("utf-32-le"), "<u4").astype(np.uint64)
                if len(code) >= SIZE:
                    found.append((i, np.unique(code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:])))
                    n += len(found[-1][1])
                if n > TASK_GRAMS:
                    yield lists(found, block, keys)
                    found, n = [], 0
            if found:
                yield lists(found, block, keys)

    rows = kept.where("key is not null").select("block", "key", F.make_valid_utf8("low").alias("low"))
    schema = T.StructType().add("gram", T.StringType()).add("block", T.IntegerType()).add("keys", T.ArrayType(kept.schema["key"].dataType))
    some = rows.mapInArrow(partial, schema).groupBy("gram", "block")
    return some.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))


def stored_texts(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    schema = T.StructType().add("key", key).add("low", T.StringType()).add("block", T.IntegerType()).add("folder", T.IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/texts")  # an empty table has no file to tell the schema


def search(spark: SparkSession, path: str, query: str, lists: int = LISTS) -> DataFrame:
    """(key, low): the indexed texts that hold the query literally, without regard to case.

    The keys of its rarest trigrams are intersected, and what is left is verified in the folders that hold it.
    A query of fewer characters than a trigram's scans the texts; an empty one finds them all."""
    q, postings = query.lower(), spark.read.parquet(f"{path}/postings")
    kept = stored_texts(spark, path, postings.schema["keys"].dataType.elementType)
    wanted = sorted({q[i : i + SIZE] for i in range(len(q) - SIZE + 1)})
    if not wanted:
        return kept.where(F.contains("low", F.lit(q))).select("key", "low")
    sizes = {r.gram: r.n for r in postings.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a trigram of the query
    if len(sizes) < len(wanted):
        return kept.limit(0).select("key", "low")
    rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:lists]
    lists_ = [postings.where(F.col("gram") == g).select("block", F.explode("keys").alias("key")) for g in rarest]
    hits = reduce(lambda a, b: a.join(b, ["block", "key"]), lists_)
    hits = hits.withColumn("folder", F.col("block") % FOLDERS)
    folders = [r.folder for r in hits.select("folder").distinct().collect()]  # at most FOLDERS
    return kept.where(F.col("folder").isin(folders)).join(hits, ["folder", "block", "key"], "left_semi").where(F.contains("low", F.lit(q))).select("key", "low")
