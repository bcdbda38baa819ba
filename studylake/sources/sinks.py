"""Writers.  Ids are made from content, so writing the same batch again adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.operators.corpus import new_chunks


def upsert_chunks(chunks: DataFrame, path: str, by: str = "kb_name") -> None:
    """Append the chunks whose ids are not stored yet, partitioned by knowledge base."""
    spark = chunks.sparkSession
    try:
        stored = spark.read.parquet(path).select("chunk_id")
    except AnalysisException:
        stored = chunks.select("chunk_id").limit(0)
    new_chunks(chunks, stored).write.mode("append").partitionBy(by).parquet(path)


def rewrite_partitions(spark: SparkSession, path: str, by: str, keep: Callable[[DataFrame], DataFrame], staging: str, only: Column | None = None) -> None:
    """Keep of the table at ``path``, partitioned by ``by``, what ``keep`` keeps, and write nothing but partitions that lose rows.

    ``only`` is a condition on ``by`` for partitions that may lose any; others are not read. What is kept is written to
    ``staging`` first and put in place by dynamic overwrite; partitions of which nothing is kept are removed. A run that
    is stopped between can be run again.
    """
    stored = spark.read.parquet(path)
    rows = stored if only is None else stored.filter(only)
    kept = keep(rows).select(stored.columns)
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    left = kept.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("m"))
    # One row a partition of the table.
    touched = counted.join(left, F.col(by).eqNullSafe(F.col("_by")), "left").filter(F.col("m").isNull() | (F.col("m") < F.col("n"))).collect()
    if not touched:
        return
    some = [r[by] for r in touched if r["m"]]
    if some:
        kept.filter(F.col(by).isin(some) | F.lit(None in some) & F.col(by).isNull()).write.mode("overwrite").partitionBy(by).parquet(staging)
        staged = spark.read.schema(stored.schema).parquet(staging)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    jvm = spark.sparkContext._jvm
    for row in touched:
        if not row["m"]:
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, None if row[by] is None else str(row[by]))
            folder = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(path), name)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def notifications(reports: DataFrame, target: str = "parent") -> DataFrame:
    """Notification rows (learner_id, report_type, period, content) with a repeatable id."""
    key = F.concat_ws("/", F.col("learner_id").cast("string"), "report_type", F.col("period").cast("string"), F.lit(target))
    return reports.select(
        F.sha2(key, 256).alias("notification_id"), F.lit("report_push").alias("type"),
        "learner_id", "report_type", "period", "content", F.lit(target).alias("target"),
    )


NOTIFICATION = "notification_id string, type string, learner_id long, report_type string, period string, content string, target string"


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTIFICATION).json(path)


def write_notifications(rows: DataFrame, path: str) -> None:
    """JSON files by target; ids already written are left out."""
    spark = rows.sparkSession
    try:
        sent = spark.read.schema("notification_id string").json(path)
        rows = rows.join(sent, "notification_id", "left_anti")
    except AnalysisException:
        pass
    rows.write.mode("append").partitionBy("target").json(path)
