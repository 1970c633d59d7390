"""Keyed appends of a stream: each micro-batch adds the rows whose key is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkmill.sources.tables import append_new


def json_stream(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append_stream(stream: DataFrame, table: str, checkpoint: str, keys: list[str], once: bool = True) -> StreamingQuery:
    """Writes new keys to a table; a batch that comes again after a failure appends nothing twice."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, table, keys)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
