"""The annotation log as a stream: repeated sends dropped, the latest state kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.review import latest


def annotation_stream(spark: SparkSession, folder: str, late: str = "1 day", files: int = 100) -> DataFrame:
    """Annotations of a growing folder; the same content sent again within `late` under another id is dropped."""
    schema = spark.read.parquet(folder).schema
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withWatermark("created_at", late)
    return log.dropDuplicatesWithinWatermark(["example_id", "transliteration", "status"])


def window_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("created_at", width), "status").agg(F.count("*").alias("n"))


def keep_latest(stream: DataFrame, table: str, checkpoint: str):
    """Merges each batch into the table of latest annotations; a batch replayed after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{table}/v={number - 1}") if number else None
        except Exception:  # the first batch of this table
            old = None
        rows = batch if old is None else old.unionByName(batch)
        latest(rows).write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
