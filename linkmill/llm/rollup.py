"""Token counts by source, language and tokenizer version, kept up by signed changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.llm.common import bounded_batches
from linkmill.llm.tokens import encoder

DIMS = ["source", "lang", "tokenizer_version"]
#: Folders of records by a hash of the document's id; fixed for the life of a rollup.
BUCKETS = 64
#: Batches after which their records are summed up into one base.
COMPACT_AFTER = 16


def token_counts(docs: DataFrame, path: str, version: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of every whole text; null texts have 0."""

    def count(batches):
        encode = encoder(path)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([version] * len(n)),
                    pa.array(n, pa.int64())
                ],
                names=["doc_id", *DIMS, "n_tokens"]
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "source", "lang", F.col(text).alias("text"))
    return bounded_batches(rows).mapInArrow(count, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


class Rollup:
    """Totals in a shared folder, changed by batches that each take effect once.

    records/batch=B: signed rows by document, in folders by a hash of the id; totals/batch=B: the totals
    after B; commits: the marks that make batches count, written last. A batch that broke off leaves no
    mark; its folders are overwritten when it comes again. A batch with a mark is skipped. One writer at a
    time. A batch reads the records of the hash buckets that its documents fall into, and the last totals.
    base/upto=N: the sums of the records of the first N batches, marked in `bases`; from then on these batches'
    records are not read. It is made after every compact_after batches, so a batch reads its buckets
    of one base and of fewer batches than that, however long the history.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.buckets, self.compact_after = spark, root, buckets, compact_after

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self) -> list[int]:
        """The batches that count, in the order of their commits (as many rows as batches)."""
        if not self._exists(f"{self.root}/commits"):
            return []
        return [r.batch for r in self.spark.read.parquet(f"{self.root}/commits").select("batch", "nth").orderBy("nth").collect()]

    def _read(self, table: str, batches: list[int], schema: str) -> DataFrame:
        paths = [f"{self.root}/{table}/batch={b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = T.StructType.fromDDL(schema).names
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*names)

    RECORD = "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long, bucket int"
    TOTAL = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies changes (doc_id, source, lang, tokenizer_version, n_tokens, seq); False if batch counts already.

        A change states a document's count under a tokenizer version, and its source and language; null
        n_tokens deletes it. The last by seq (then the greatest row) of a document and version holds in
        a batch. A stated count that is new is an insert, another one a revision: minus the old row, plus
        the new. Deleting what is not there does nothing. Null ids are one document.
        """
        done = self.committed()
        if batch in done:
            return False
        key = ["doc_id", "tokenizer_version"]
        last = changes.groupBy(*key).agg(
            F.max(
                F.struct("seq", F.col("n_tokens").isNotNull().alias("stays"), "n_tokens", "source", "lang")
            ).alias("x")
        ).select(*key, "x.*")
        last = last.select(
            F.col("doc_id").alias("k"), F.col("tokenizer_version").alias("v"), "n_tokens", F.col("source").alias("s"),
            F.col("lang").alias("l")
        )
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in last.select(bucket("k")).distinct().collect()]  # numbers below `buckets`
        held = self._held(done, F.col("bucket").isin(touched) if touched else F.lit(False))
        same = F.col("doc_id").eqNullSafe(F.col("k")) & F.col("tokenizer_version").eqNullSafe(F.col("v"))
        minus = held.join(last.select("k", "v"), same, "left_semi").select(
            "doc_id", *DIMS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")
        )
        plus = last.where("n_tokens is not null").select(
            F.col("k").alias("doc_id"), F.col("s").alias("source"), F.col("l").alias("lang"),
            F.col("v").alias("tokenizer_version"), F.lit(1).cast("long").alias("docs"),
            F.col("n_tokens").cast("long").alias("tokens")
        )
        rows = minus.unionByName(plus).withColumn("bucket", bucket("doc_id"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/records/batch={batch}")
        delta = self._read("records", [batch], self.RECORD).groupBy(*DIMS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        before = self._read("totals", done[-1:], self.TOTAL)
        after = before.unionByName(delta).groupBy(*DIMS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).where("n_docs != 0")
        after.write.mode("overwrite").parquet(f"{self.root}/totals/batch={batch}")
        mark = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(len(done)).alias("nth"))
        mark.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        if len(done) + 1 - self.base() >= self.compact_after:
            self.compact()
        return True

    def base(self) -> int:
        """How many of the first batches the last base stands for."""
        if not self._exists(f"{self.root}/bases"):
            return 0
        return self.spark.read.schema("upto int").parquet(f"{self.root}/bases").agg(F.max("upto")).first()[0] or 0

    def _held(self, done: list[int], which: Column) -> DataFrame:
        """doc_id, dimensions, docs, tokens of the documents that the batches leave, in some buckets."""
        upto = self.base()
        rows = self._read("records", done[upto:], self.RECORD)
        if upto:
            schema = T.StructType.fromDDL(self.RECORD)
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/base/upto={upto}").select(*schema.names))
        sums = rows.where(which).groupBy("doc_id", *DIMS, "bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs > 0").select("doc_id", *DIMS, "docs", "tokens", "bucket")

    def compact(self) -> None:
        """Sums up the records of all committed batches as a new base; its mark is written last."""
        done = self.committed()
        rows = self._held(done, F.lit(True))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/upto={len(done)}")
        self.spark.createDataFrame([(len(done),)], "upto int").coalesce(1).write.mode("append").parquet(f"{self.root}/bases")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens after the last batch; groups without documents are left out."""
        return self._read("totals", self.committed()[-1:], self.TOTAL)
