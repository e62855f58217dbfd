"""Keep the donor summary current as donor rows arrive.

Extension for the documented wish for scheduled refreshes: instead of
re-running the whole summary, a Structured Streaming query reads new donor
files as they land, adds the cell columns (a narrow projection), and keeps
the summary aggregate in state: one state row per (zip, cell, cell, cell)
group, however many donors arrive. Every micro-batch writes the complete
summary to a folder of its own under the sink; readers take the newest one
that is complete (``read_summary``), so none sees a table half written or
gone. The stream's checkpoint (offsets and state) lives in shared storage,
so a restarted driver or lost executor resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hexgiving.operators import rollups
from hexgiving.sinks import published
from hexgiving.sources.tables import with_cells


def summary_of_stream(spark: SparkSession, source_dir: str, schema: StructType,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming summary rollup over donor parquet files in ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.parquet(source_dir)
    return rollups.donor_summary(with_cells(stream))


def read_summary(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The newest complete summary under ``sink_dir``."""
    return published.latest(spark, sink_dir)


def start_summary_refresh(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                          checkpoint_dir: str, available_now: bool = False,
                          interval: str = "10 minutes", max_files_per_trigger: int | None = None,
                          state_partitions: int | None = None) -> StreamingQuery:
    """Start the refresh: each micro-batch publishes the complete, current
    summary as the next version under ``sink_dir``; the last two stay.

    ``state_partitions`` fixes the number of state-store partitions of the
    aggregation (read once, at the first start, and kept in the checkpoint);
    by default the session's ``spark.sql.shuffle.partitions``.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        published.publish(batch, sink_dir, batch_id)        # a retried batch repeats its own

    writer = (summary_of_stream(spark, source_dir, schema, max_files_per_trigger).writeStream
              .outputMode("complete").option("checkpointLocation", checkpoint_dir)
              .foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    if not state_partitions:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(int(state_partitions)))    # captured by the query at start
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)
