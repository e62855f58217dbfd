"""Global row numbering and repeatable sampling without a one-task window.

``row_number() OVER (ORDER BY ...)`` with no ``PARTITION BY`` moves every
row into a single task. Here the rows are range-partitioned on the sort key
(Spark samples the key to pick bounds), sorted inside each partition, and
numbered by ``position in partition + rows in earlier partitions``. The
per-partition counts are one row per partition, so that small table is
broadcast.

The partitioned and sorted rows are checkpointed into the shared folder
named by ``spark.checkpoint.dir`` before they are counted, which pins the
partition contents: a lost executor recomputes from the checkpoint and the
numbers stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexgiving.functions.draws import order_key
from hexgiving.session import checkpoint_root


def number_rows(df: DataFrame, key: str, seed: str | int = 0, out: str = "rn",
                num_partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in a repeatable random order (hash of key and seed).

    Ties on the hash are broken on ``key``; ``key`` must be unique.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    hk = "_hk"
    keyed = df.withColumn(hk, order_key(F.col(key), seed))
    ordered = ((keyed.repartitionByRange(num_partitions, F.col(hk), F.col(key)) if num_partitions
                else keyed.repartitionByRange(F.col(hk), F.col(key)))
               .sortWithinPartitions(hk, key)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_pos", F.monotonically_increasing_id()
                           - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = ordered.join(F.broadcast(offsets), "_pid")
    return numbered.withColumn(out, F.col("_off") + F.col("_pos") + F.lit(1)).drop("_pid", "_pos", "_off", hk)


def sample_n(df: DataFrame, n: int, key: str, seed: str | int = 0) -> DataFrame:
    """``n`` rows in a repeatable random order (a quota, as ``LIMIT n``).

    The order key is a uniform hash, so the ``n`` smallest lie, but for one
    chance in a billion, below a threshold a little above ``n / rows``. Rows
    under it are numbered and the first ``n`` kept; if too few lie there, all
    rows are numbered. No task holds the quota.
    """
    total = df.count()
    hk = order_key(F.col(key), seed)
    share = (n + 6 * n ** 0.5 + 20) / max(total, 1)
    few = df if share >= 1 else df.where(F.substring(hk, 1, 8) < f"{int(share * 16 ** 8):08x}")
    if share < 1 and few.count() < n:
        few = df
    return number_rows(few, key, seed, out="_rn").where(F.col("_rn") <= n).drop("_rn")


def global_rank(df: DataFrame, order_col: str, key: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``position``, ``rank`` and ``dense_rank`` by ``order_col`` descending (nulls last), over all rows.

    Rows with equal values share a rank; nulls are equal to each other.
    Position breaks ties on ``key`` (ascending, null first; unique). Rows are
    range-partitioned on value and key, so a value that a third of all rows
    share spreads over many tasks, and pinned by a checkpoint. Each partition
    is ranked by itself; one row per partition (counts, first and last value,
    start of the last run) then gives its offsets, and a run of equal
    values that crosses partition edges takes the rank at which it began.
    Other columns stay; columns named as the results are replaced.
    """
    checkpoint_root(df.sparkSession)
    order = [F.col(order_col).desc_nulls_last(), F.col(key).asc_nulls_first()]
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    pinned = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    value = Window.partitionBy("_pid").orderBy(order[0])
    local = pinned.withColumns({"_rn": F.row_number().over(Window.partitionBy("_pid").orderBy(*order)).cast("long"),
                                "_rank": F.rank().over(value).cast("long"), "_dense": F.dense_rank().over(value).cast("long")})
    at = F.struct("_rn", F.col(order_col).alias("v"))
    parts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.max("_dense").alias("d"), F.max("_rank").alias("tail"),
                                      F.min(at)["v"].alias("first"), F.max(at)["v"].alias("last"))
    # one row per partition from here to the join
    w = Window.orderBy("_pid")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "off": F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")),
        "goes_on": (F.lag("last").over(w).eqNullSafe(F.col("first")) & F.lag("n").over(w).isNotNull()).cast("long")})
    began = F.when((F.col("goes_on") == 0) | (F.col("d") > 1), F.col("off") + F.col("tail"))
    parts = parts.withColumns({
        "doff": F.coalesce(F.sum(F.col("d") - F.col("goes_on")).over(before), F.lit(0).cast("long")) - F.col("goes_on"),
        "run": F.last(began, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    parts = parts.withColumn("head", F.when(F.col("goes_on") == 1, F.lag("run").over(w)).otherwise(F.col("off") + 1))
    edges = parts.select("_pid", "off", "doff", "head").toDF("_pid", "_off", "_doff", "_head")
    out = local.join(F.broadcast(edges), "_pid")
    return out.withColumns({
        "position": F.col("_off") + F.col("_rn"),
        "rank": F.when(F.col("_dense") == 1, F.col("_head")).otherwise(F.col("_off") + F.col("_rank")),
        "dense_rank": F.col("_doff") + F.col("_dense")}).drop("_pid", "_rn", "_rank", "_dense", "_off", "_doff", "_head")
