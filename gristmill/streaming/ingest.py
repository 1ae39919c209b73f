"""The same operators on streams: files as they arrive, and messages in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators import extract
from gristmill.sources import repository


def file_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet rows of files as they are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def extract_stream(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """What is known of each file, appended by repository; a batch that is run again replaces itself by its id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        info = extract.file_info(repository.prepared(batch))
        info.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_activity(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, start, end, messages, chars): stretches of a conversation between long pauses.

    On a stream, equal messages within the watermark count once and state older than it is dropped.
    """
    m = messages.filter("sent_at IS NOT NULL AND text IS NOT NULL")
    if m.isStreaming:
        m = m.withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["session_id", "turn", "role", "text", "sent_at"])
    else:
        m = m.dropDuplicates(["session_id", "turn", "role", "text", "sent_at"])
    g = m.groupBy("session_id", F.session_window("sent_at", gap).alias("w")).agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))
    return g.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages", "chars")
