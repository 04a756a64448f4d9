"""Incremental indexing: streams of vectors or files appended to stored relations, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kindred.config import LshConfig
from kindred.operators.index import CloneIndex


def stream_vectors(source: DataFrame, path: str, checkpoint: str, config: LshConfig, available_now: bool = True) -> StreamingQuery:
    """Append a stream of (block_id, embedding) below ``path``; batch folders are overwritten when a batch is retried, so each counts once."""

    def ingest(batch: DataFrame, number: int) -> None:
        CloneIndex.build(batch, config).vectors.withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = source.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def load_streamed(spark: SparkSession, path: str, config: LshConfig, removed: DataFrame | None = None) -> CloneIndex:
    """The index of what was streamed: of an id that came more than once the last batch's vector counts; ids in ``removed`` are gone."""
    from kindred.operators.index import bucket_rows

    rows = spark.read.parquet(path).groupBy("block_id").agg(F.max_by(F.struct("embedding", "hashes"), "seq").alias("v")).select("block_id", "v.*")
    index = CloneIndex(config, rows, bucket_rows(rows))
    return index.remove(removed) if removed is not None else index


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, event_type, value) per window and type; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
