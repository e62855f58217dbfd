"""Structure and completeness checks.

Catalog listings and column descriptions come from Spark's own catalog and
schemas; completeness is one aggregate per table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The verdicts of the setup check.
STATUS_OK = "OK: hex cell columns hold data"
STATUS_EMPTY = "EMPTY: hex cell columns exist but hold no data; re-run the load"


def completeness(df: DataFrame, columns: Sequence[str], total_name: str = "total_records") -> DataFrame:
    """Total rows against non-null counts per column, both spellings."""
    out = [F.count(F.lit(1)).alias(total_name)]
    out += [F.count(c).alias(f"{c}_count") for c in columns]
    out += [F.count(F.when(F.col(c).isNotNull(), F.lit(1))).alias(f"{c}_not_null") for c in columns]
    return df.agg(*out)


def status_line(df: DataFrame, cell_col: str = "hex_level_7") -> DataFrame:
    """One status row from whether any cell is filled."""
    filled = F.count_if(F.col(cell_col).isNotNull())
    return df.agg(F.when(filled > 0, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_EMPTY)).alias("final_status"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, duplicated keys and null keys of a declared key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("total_rows"),
        F.count(key).alias("distinct_keys"),
        F.count_if(F.col(key).isNotNull() & (F.col("_n") > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("null_keys"))


def catalog_tables(spark: SparkSession, names: Sequence[str] | None = None, database: str | None = None) -> DataFrame:
    """Tables and views of the catalog, filtered by name, sorted."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables(database)]
    if names is not None:
        wanted = {n.lower() for n in names}
        rows = [r for r in rows if r[0].lower() in wanted]
    return spark.createDataFrame(sorted(rows), "table_name string, table_type string, is_temporary boolean")


def catalog_columns(df: DataFrame, like: str | None = None) -> DataFrame:
    """Column name, type and nullability of a frame, optionally ``LIKE``-filtered."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]
    out = spark.createDataFrame(rows, "column_name string, data_type string, is_nullable string")
    if like is not None:
        out = out.where(F.col("column_name").like(like))
    return out.orderBy("column_name")
