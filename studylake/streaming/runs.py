"""Reading the event table as a stream and draining a stream into files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.session import checkpoint_dir
from studylake.sources.tables import VIEWS, load

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state off the heap; needed by the arbitrary-state operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A parquet table as a file stream, with the schema of the table."""
    reader = spark.readStream.schema(load(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(sf_dir)


def view_stream(spark: SparkSession, sf_dir: str, name: str, base: str = "events") -> DataFrame:
    """A derived view over a table stream.  The stream's ``ts`` is a zoned timestamp."""
    rows = table_stream(spark, sf_dir, base)
    return spark.sql(VIEWS[name].replace(f"FROM {base}", "FROM {rows}"), rows=rows)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def ending(spark: SparkSession, label: str) -> tuple[str, DataFrame]:
    """A folder for the end of a stream's input, empty so far, and the stream of it. What is written to it later, the time (end) of
    the last event, lets the watermark pass every event."""
    path = scratch(spark, label)
    spark.createDataFrame([], "end timestamp").write.parquet(path)
    return path, spark.readStream.schema("end timestamp").parquet(path)


def drain(stream: DataFrame, label: str, mode: str, path: str | None = None, last: Callable[[], None] | None = None) -> DataFrame:
    """Process what is available and return what was emitted, with the batch it came in.

    Every micro-batch overwrites its own folder, so a batch replayed after a failure leaves the
    same files. When all is processed, ``last`` may add to the sources, and that is processed too.
    """
    spark = stream.sparkSession
    out, checkpoint = path or scratch(spark, label), scratch(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    for before in (None, last) if last else (None,):
        if before:
            before()
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out)


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
