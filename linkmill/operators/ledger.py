"""Appends by key to several tables at once: a batch counts in all of them or in none, and once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.operators.merge import last_by


class Ledger:
    """Tables under one path, each with its keys: {name: (schema, keys)}.

    A batch's rows lie in folders by batch and by a hash of their key (data/<table>/batch=/bucket=). They count once the
    batch has its mark, which is written after all of its tables; so a batch that broke off leaves no trace, and
    one that is sent again after its mark changes nothing. A batch reads the keys of the buckets that it touches only.
    After merge_after batches they are merged into one, so folders and marks to read stay few. One batch is committed
    at a time."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], buckets: int = 64, merge_after: int = 32):
        self.spark, self.path, self.buckets, self.merge_after = spark, path.rstrip("/"), buckets, merge_after
        self.tables = {n: (T.StructType.fromDDL(s), keys) for n, (s, keys) in tables.items()}

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _marks(self) -> DataFrame:
        """batch, replaces: the marks, of which a merged batch's names those that it stands for."""
        schema = "replaces array<string>, batch string"
        if not self._there(f"{self.path}/marks"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/marks")

    def batches(self) -> tuple[set[str], set[str]]:
        """The batches whose files count, and all that were ever committed."""
        marks = [(r.batch, r.replaces or []) for r in self._marks().collect()]  # merge_batches() keeps them few
        gone = {x for _, old in marks for x in old}
        return {b for b, _ in marks} - gone, {b for b, _ in marks} | gone

    def read(self, name: str, buckets: list[int] | None = None, batches: set[str] | None = None) -> DataFrame:
        """The rows of all committed batches, or of those that batches() gave before; of some buckets only, if given."""
        schema, _ = self.tables[name]
        now, at = sorted(self.batches()[0] if batches is None else batches), f"{self.path}/data/{name}"
        if not now or not self._there(at):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, *T.StructType.fromDDL("batch string, bucket int").fields])).parquet(at)
        rows = rows.where(F.col("batch").isin(now))
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*schema.names)

    def _put(self, rows: DataFrame, name: str, batch: str) -> None:
        to = f"{self.path}/data/{name}/batch={batch}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)

    def _mark(self, batch: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(replaces,)], "replaces array<string>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")

    def commit(self, batch: str, rows: dict[str, DataFrame], order: dict[str, list] | None = None, before_mark=None) -> bool:
        """Appends to each table the rows whose key it lacks; of a batch's rows with one key the first by `order`, or by
        all other columns. Null keys are equal. False if the batch had been committed before.

        before_mark is called after all tables are written, before the mark; what it raises leaves the batch out."""
        now, ever = self.batches()
        if batch in ever:
            return False
        for name, new in rows.items():
            schema, keys = self.tables[name]
            new = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
            by = (order or {}).get(name) or [c for c in schema.names if c not in keys] or keys
            bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
            new = last_by(new, keys, by).withColumn("bucket", bucket)
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most self.buckets
            have = self.read(name, touched, now).select(*(F.col(k).alias(f"_have_{k}") for k in keys))
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_have_{k}")) for k in keys))
            self._put(new.join(have, same, "left_anti"), name, batch)
        if before_mark:
            before_mark()
        self._mark(batch, [])
        if len(now) + 1 >= self.merge_after:
            self.merge_batches(f"merged-{len(ever) + 1}")
        return True

    def merge_batches(self, name: str) -> None:
        """Writes all committed batches as one, called `name`, whose mark stands for theirs: few folders to read."""
        now = sorted(self.batches()[0])
        for table, (_, keys) in self.tables.items():
            bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
            self._put(self.read(table).withColumn("bucket", bucket), table, name)
        self._mark(name, sorted({*now, *self.batches()[1]} - {name}))


#: The tables of review decisions, for Ledger: what was decided, the ids that it forces, the pairs that it rules out, and a line of evidence.
DECISIONS = {
    "decisions": ("decision string, name string, action string, id string, notes string, at timestamp", ["decision"]),
    "overrides": ("name string, id string, notes string", ["name"]),
    "rejected": ("name string, id string, notes string", ["name", "id"]),
    "evidence": ("decision string, line string", ["decision"]),
}


def record_decisions(ledger: Ledger, batch: str, log: DataFrame, before_mark=None) -> bool:
    """Adds review decisions (decision, name, action, id, notes, at) to the four tables of DECISIONS, to all or none.

    An accepted override forces its id if the name has none yet; a rejection rules out the pair. Decisions
    without an id are only kept as such. Of a batch's overrides of a name the earliest counts. The last decision of a name is
    merge.last_by(ledger.read("decisions"), ["name"], ...)."""
    with_id = log.where("id is not null and trim(id) != ''")
    accepted, rejected = with_id.where("action = 'accept_override'"), with_id.where("action = 'reject'")
    line = F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd"), "name", "action", "id")
    rows = {"decisions": log, "overrides": first_of_name(accepted), "rejected": rejected, "evidence": log.select("decision", line.alias("line"))}
    return ledger.commit(batch, rows, before_mark=before_mark)


def first_of_name(accepted: DataFrame) -> DataFrame:
    return last_by(accepted, ["name"], ["at", "decision"])
