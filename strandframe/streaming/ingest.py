"""Structured Streaming ingest of raw line files into the loaded and rejected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandframe.sources.rawlines import load_raw_lines

RAW_SCHEMA = "rec_id long, fmt string, file_name string, line_no long, line string, loaded_at timestamp"


def raw_line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of raw lines as they arrive. A file must hold whole line files, header included."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(folder)


def ingest(lines: DataFrame, loaded_path: str, rejected_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Load each micro-batch; a batch that is replayed after a failure replaces its own folder, so rows come once."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = load_raw_lines(batch).persist()
        rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{loaded_path}/batch={epoch}")
        rows.where("reason is not null").select("rec_id", "fmt", "file_name", "line_no", "reason").write.mode("overwrite").parquet(f"{rejected_path}/batch={epoch}")
        rows.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def windowed_counts(calls: DataFrame, time_column: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key over a stream, late rows being taken up to ``late``."""
    return calls.withWatermark(time_column, late).groupBy(F.window(time_column, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
