"""A table of the latest row per key, kept up by micro-batches.

Rows lie in buckets by the hash of their key. A merge rewrites the buckets that its batch touches, under the batch's number, and then
writes a list of where every bucket now is; readers take the newest list, so they see a merge whole or not at all. A batch that
is replayed starts again from the list before it and writes the same files, so a retry changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_PLACES = "bucket int, version long, v long"


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _places(self, before: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest list, or the newest before a batch: its number and, for each bucket with rows, the version it is in."""
        folder = os.path.join(self.path, "places")
        # Made by the first merge; a schema is given, so an empty folder is an empty list.
        self.spark.createDataFrame([], "bucket int, version long").limit(0).write.mode("ignore").parquet(os.path.join(folder, "v=-1"))
        rows = self.spark.read.schema(_PLACES).parquet(folder)
        if before is not None:
            rows = rows.filter(F.col("v") < before)
        newest = rows.agg(F.max("v")).first()[0]
        if newest is None:
            return -1, {}
        return newest, {r["bucket"]: r["version"] for r in rows.filter(F.col("v") == newest).collect()}

    def _rows(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        folders = [os.path.join(self.path, f"data/version={version}/bucket={bucket}") for bucket, version in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """All rows, one per key."""
        return self._rows(self._places()[1])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Put the rows of ``batch``, one per key, in place of those with their keys."""
        _, places = self._places(batch_id)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(self.schema.names).withColumn("bucket", bucket).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            if not touched:
                return
            old = self._rows({b: v for b, v in places.items() if b in touched}).withColumn("bucket", bucket)
            same = F.lit(True)
            for k in self.keys:
                same = same & old[k].eqNullSafe(F.col(f"_{k}"))
            replaced = new.select(*(F.col(k).alias(f"_{k}") for k in self.keys))
            kept = old.join(replaced, same, "left_anti").unionByName(new)
            kept.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                os.path.join(self.path, f"data/version={batch_id}")
            )
        finally:
            new.unpersist()
        now = places | {b: batch_id for b in touched}
        listed = self.spark.createDataFrame([(b, v) for b, v in now.items()], "bucket int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, f"places/v={batch_id}"))

    def vacuum(self) -> int:
        """Delete the lists and bucket folders that the newest list does not use; not while older ones are being read."""
        newest, places = self._places()
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        used, gone = {f"data/version={v}/bucket={b}" for b, v in places.items()} | {f"places/v={newest}", "places/v=-1"}, 0
        for pattern in ("data/version=*/bucket=*", "places/v=*"):
            for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
                folder = status.getPath()
                name = "/".join(str(folder.toUri().getPath()).split("/")[-3 if pattern.startswith("data") else -2 :])
                if name not in used:
                    gone += bool(files.delete(folder, True))
        return gone


def upsert(stream: DataFrame, store: KeyedStore, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """Drain an update-mode stream, whose rows are whole, into ``store``."""
    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: store.merge(prepare(batch), batch_id)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
