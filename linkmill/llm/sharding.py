"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmill.llm.common import written

HASH_BITS = 60
#: Buckets of fewer hash bits than this (4,095 of them) are looked up by broadcast.
BROAD = 12


def hash60(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a non-negative long. Null keys hash like no text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))), 1, 15), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: str, n_bytes: Column, limit_bytes: int, step_bits: int = 6) -> DataFrame:
    """One row per row of df: key, n_bytes, depth, shard, page.

    The directory starts as one bucket; only a bucket of more than limit_bytes splits, on the next
    bit of hash60(key), until each fits. A shard is (depth, shard, page): the number of hash bits
    used, their value, and an overflow page. The page is 0 but where all rows of an oversized bucket
    have the same 60 bits (one key that holds many rows): those go, in sequence, to pages of at most
    limit_bytes. A single row over the limit gets a shard of its own.

    Sizes are summed once over cells of a few more bits than needed; the splits are then read off
    the cells' sums. Only rows of cells that are still too large are looked at again, so no step
    holds a bucket in one task. Null sizes count as 0; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(n_bytes.cast("long"), F.lit(0)).alias("n_bytes"), hash60(F.col(key)).alias("h"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes)))) + step_bits)
    directory, base, left = None, 0, rows
    while True:
        found = _split(left, base, bits, limit_bytes)
        found = written(found, "directory")
        directory = found if directory is None else directory.unionByName(found)
        over = found.where("depth is null").select(F.col("cell").alias("o_cell"))
        if bits == HASH_BITS or over.isEmpty():
            break
        cell = F.shiftright("h", HASH_BITS - bits)
        left = left.join(over, cell == F.col("o_cell"), "left_semi")
        base, bits = bits, min(HASH_BITS, bits + step_bits)
    leaves = directory.where(F.col("depth").isNotNull() | (F.col("bits") == HASH_BITS))
    out = None
    for b in [r[0] for r in leaves.select("bits").distinct().collect()]:  # a few depths at most
        d = leaves.where(F.col("bits") == b).select(F.col("cell").alias("d_cell"), "depth")
        part = rows.join(d, F.shiftright("h", HASH_BITS - b) == F.col("d_cell")).drop("d_cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.withColumn("depth", F.lit(None).cast("int"))
    plain = out.where("depth is not null").select(
        "key", "n_bytes", "depth", F.expr(f"shiftright(h, {HASH_BITS} - depth)").alias("shard"),
        F.lit(0).cast("long").alias("page")
    )
    if bits == HASH_BITS and not directory.where((F.col("bits") == HASH_BITS) & F.col("depth").isNull()).isEmpty():
        plain = plain.unionByName(_pages(out.where("depth is null"), limit_bytes))
    return plain.withColumnRenamed("key", key)


def _split(rows: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """For each cell of `bits` hash bits: the smallest depth over `base` at which its bucket fits."""
    cells = rows.groupBy(F.shiftright("h", HASH_BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
    levels = cells.select("cell", "b", "c", F.explode(F.sequence(F.lit(base + (base > 0)), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    fits = sums.where((F.col("b") <= limit) | (F.col("c") == 1)).select("depth", "prefix")
    # A short prefix has very many cells: the few buckets of the first depths, 2**BROAD at most, go to the cells instead.
    broad = levels.where(F.col("depth") < base + BROAD).join(
        F.broadcast(fits.where(F.col("depth") < base + BROAD)), ["depth", "prefix"]
    ) if base == 0 else None
    narrow = levels.where(F.col("depth") >= base + BROAD) if base == 0 else levels
    narrow = narrow.join(fits, ["depth", "prefix"])
    first = (narrow if broad is None else broad.unionByName(narrow)).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(first, "cell", "left").withColumn("bits", F.lit(bits))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages by a running sum that is taken in each partition, then shifted by the partitions before."""
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "overflow")
    small = F.when(F.col("n_bytes") * 2 <= limit, F.col("n_bytes")).otherwise(0)
    rows = rows.withColumn("small", small).withColumn("part", F.shiftright("at", 12))  # bounded runs of rows
    runs = rows.groupBy("h", "part").agg(F.sum("small").alias("run"))
    before = F.coalesce(F.sum("run").over(Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(runs.select("h", "part", before.alias("before")), ["h", "part"])
    end = F.col("before") + F.sum("small").over(Window.partitionBy("h", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    half = max(1, limit // 2)
    page = F.when(F.col("n_bytes") * 2 <= limit, 2 * F.floor((F.greatest(end, F.lit(1)) - 1) / half)).otherwise(2 * F.col("at") + 1)
    return rows.select("key", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("shard"), page.cast("long").alias("page"))


def write_shards(df: DataFrame, key: str, n_bytes: Column, limit_bytes: int, path: str) -> None:
    """df written as Parquet with one folder per shard; rows keep all their columns. A key on several rows raises."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    shards = assign_shards(df, key, n_bytes, limit_bytes).select(F.col(key).alias("_key"), F.concat_ws("-", "depth", "shard", "page").alias("_shard"))
    out = df.join(shards, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)
