"""Structured Streaming: micro-batches of new artifacts through the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.helpers import checkpointed


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Process what is there and stop; each batch is handed on with its number, so a sink can tell repeats.

    The offsets are kept in the session's shared checkpoint folder.
    """
    checkpointed(stream.sparkSession.range(1))  # makes sure that there is a folder
    folder = f"{stream.sparkSession.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def totals(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """(event_type, n, last) over a folder of events: each batch is summed, and sums are merged."""
    schema = spark.read.parquet(path).schema
    base, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    # a table that is one file is read through its folder
    stream = reader.option("pathGlobFilter", name).parquet(base) if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isFile() else reader.parquet(path)
    parts: dict[int, DataFrame] = {}

    def each(batch: DataFrame, number: int) -> None:
        parts[number] = checkpointed(batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")))

    run_available(stream, each)
    out = spark.createDataFrame([], "event_type string, n long, last long")
    for p in parts.values():
        out = out.unionByName(p)
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def ingest_evidence(stream: DataFrame, load: Callable[[], dict], save: Callable[[dict, int], None], to_batch: Callable[[DataFrame], dict]) -> None:
    """Merge each micro-batch into the snapshot; a batch seen before changes nothing, for all merges are insert-ignore."""
    from ..operators.claims import persist_batch

    run_available(stream, lambda batch, number: save(persist_batch(load(), to_batch(batch)), number))
