"""Incremental jobs: new files in, only what they change out.

* ``start_delta_refresh``: new donor files become one small delta of the
  summary per micro-batch, holding the sums of the groups that the batch
  touched. A donor id that arrives again within the watermark's delay is
  dropped; the ids seen are the only state (RocksDB, on the executors'
  disks and in the checkpoint). ``read_delta_summary`` adds the deltas up;
  ``compact`` folds them into a base now and then.
* ``load_new_orders``: new order files are joined with the customers and
  appended to the stored donor table; files already loaded are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hexgiving.functions.measures import mean_of_sums
from hexgiving.sinks import published
from hexgiving.sources.tables import MAJOR_DONOR_MIN, donor_rows, with_cells

KEYS = ("zip_code", "hex_level_7", "hex_level_8", "hex_level_9")
ANNUAL, CUMULATIVE = "annual_donation_amount", "cumulative_donation_amount"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTING, STATE_PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


def delta_of(rows: DataFrame) -> DataFrame:
    """Sums that add up: one row for each summary group of ``rows``."""
    money = lambda c: F.coalesce(F.sum(c).cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), money(ANNUAL).alias("annual"), F.count(ANNUAL).alias("annual_n"),
        money(CUMULATIVE).alias("cumulative"), F.count(CUMULATIVE).alias("cumulative_n"),
        F.count_if(F.col(ANNUAL) >= MAJOR_DONOR_MIN).alias("major"))


def _sum_up(deltas: DataFrame) -> DataFrame:
    money = lambda c: F.sum(c).cast("decimal(38,2)").alias(c)
    return deltas.groupBy(*KEYS).agg(F.sum("n").alias("n"), money("annual"), F.sum("annual_n").alias("annual_n"), money("cumulative"),
                                     F.sum("cumulative_n").alias("cumulative_n"), F.sum("major").alias("major"))


def new_donors(spark: SparkSession, source_dir: str, schema: StructType, time_col: str | None = None, delay: str = "7 days",
               key: str = "donor_id", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming donor rows, each id once.

    ``time_col``: when a row became known (a timestamp); by default its
    file's modification time. An id that comes again within ``delay`` of its
    first row is dropped; rows older than the newest time less ``delay`` are
    late and dropped too. Rows without an id are all kept.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = reader.parquet(source_dir).select(
        "*", F.col(time_col or "_metadata.file_modification_time").alias("_known"),
        F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col("_metadata.file_path"), F.lit(":"),
                                                       F.col("_metadata.row_index"))).alias("_key"))
    return rows.withWatermark("_known", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_known", "_key")


def _started(spark: SparkSession, writer, state_partitions: int | None) -> StreamingQuery:
    """Start with RocksDB state; both settings are captured by the query and kept in its checkpoint."""
    wanted = {STATE_SETTING: ROCKSDB} | ({STATE_PARTITIONS: str(int(state_partitions))} if state_partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_delta_refresh(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str,
                        available_now: bool = False, interval: str = "10 minutes", state_partitions: int | None = None,
                        **source) -> StreamingQuery:
    """Start the refresh: each micro-batch writes its delta to a folder of its own (a retried batch writes it again).

    ``source``: the options of ``new_donors``. The delta of a batch has at
    most one row for each group that its new donors are in.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        delta_of(with_cells(batch)).write.mode("overwrite").parquet(f"{sink_dir}/deltas/b{batch_id:020d}")

    stream = new_donors(spark, source_dir, schema, **source).writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(write)
    stream = stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime=interval)
    return _started(spark, stream, state_partitions)


def _parts(spark: SparkSession, sink_dir: str) -> tuple[list[str], list[str], list[str]]:
    """(folders that make up the summary, deltas the base already holds, all complete deltas)."""
    bases = published.versions(spark, f"{sink_dir}/base")
    deltas = published.versions(spark, f"{sink_dir}/deltas", "b")
    done = [d for d in deltas if bases and int(d[1:]) <= int(bases[-1][1:])]
    paths = [f"{sink_dir}/base/{bases[-1]}"] if bases else []
    return paths + [f"{sink_dir}/deltas/{d}" for d in deltas if d not in done], done, deltas


def read_deltas(spark: SparkSession, sink_dir: str) -> DataFrame:
    paths = _parts(spark, sink_dir)[0]
    if not paths:
        raise FileNotFoundError(f"no delta has been written under {sink_dir}")
    return spark.read.parquet(*paths)


def read_delta_summary(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The summary as of the last complete delta: the same rows as ``rollups.donor_summary`` of all donors so far."""
    def mean(total: str, n: str) -> Column:
        return mean_of_sums(F.col(total), F.col(n), 2)

    some = lambda total, n: F.when(F.col(n) > 0, F.col(total).cast("double"))
    return _sum_up(read_deltas(spark, sink_dir)).select(
        *KEYS, F.col("n").alias("donor_count"), some("annual", "annual_n").alias("total_annual_donations"),
        some("cumulative", "cumulative_n").alias("total_cumulative_donations"), mean("annual", "annual_n").alias("avg_annual_donation"),
        mean("cumulative", "cumulative_n").alias("avg_cumulative_donation"), F.col("major").alias("major_donors_count"))


def compact(spark: SparkSession, sink_dir: str) -> None:
    """Fold all complete deltas into the next base, then drop the deltas that the base before it held.

    A reader that listed folders before the call still finds them.
    """
    _, done, deltas = _parts(spark, sink_dir)
    if len(deltas) > len(done):
        published.publish(_sum_up(read_deltas(spark, sink_dir)), f"{sink_dir}/base", int(deltas[-1][1:]))
        published.remove(spark, f"{sink_dir}/deltas", done)


def load_new_orders(spark: SparkSession, orders_dir: str, orders_schema: StructType, customer: DataFrame, table_dir: str,
                    checkpoint_dir: str, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append the donors of order files that were not loaded before to ``table_dir``; runs until none is left.

    The order stream is joined with the customers as they are now; rows
    loaded earlier keep what they had then (a full load renews them). The
    file sink's log makes each file's rows appear once, whatever is retried;
    readers of ``table_dir`` follow it. Returns the running query.
    """
    reader = spark.readStream.schema(orders_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    donors = with_cells(donor_rows(reader.parquet(orders_dir), customer))
    return (donors.writeStream.format("parquet").option("path", table_dir).option("checkpointLocation", checkpoint_dir)
            .outputMode("append").trigger(availableNow=True).start())
