"""Sinks: table create/overwrite, append with column defaults, CSV export and
the multi-section text report.

Everything is written by the executors as multi-file datasets into a
folder the caller names (on a cluster, shared storage; in the registered
queries, a fresh folder under ``spark.checkpoint.dir``). Nothing is
gathered on the driver: the report's sections are DataFrames of
``(section, line_key, text)`` written range-partitioned and sorted, so the
part files in name order are the report in reading order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hexgiving.functions.measures import coord_mean, mean_half_up, money_sum, rounded
from hexgiving.operators import hexmap, rollups
from hexgiving.session import checkpoint_root


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a parquet table from a query; returns its reader."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_with_defaults(df: DataFrame, location: str, created_col: str = "created_date",
                         table: str | None = None) -> DataFrame:
    """Append rows by explicit column list into a table whose load-time
    column is filled by its ``DEFAULT current_timestamp()``; returns a reader of its files.

    A named table is created (empty) on first use and stays, so later calls
    append again. Without a name the catalog entry goes after the insert and
    the files stay.
    """
    spark = df.sparkSession
    name = table or f"hexgiving_append_{uuid.uuid4().hex[:10]}"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) ({cols}, `{created_col}` TIMESTAMP DEFAULT current_timestamp()) "
              f"USING parquet LOCATION '{location.replace(chr(39), chr(92) + chr(39))}'", {"name": name})
    names = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"INSERT INTO IDENTIFIER(:name) ({names}) SELECT {names} FROM {{rows}}", {"name": name}, rows=df)
    if table:
        return spark.table(name)
    schema = spark.table(name).schema
    spark.sql("DROP TABLE IDENTIFIER(:name)", {"name": name})
    return spark.read.schema(schema).parquet(location)


# Quotes are doubled; white space, empty text and nulls survive the round trip.
CSV_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "emptyValue": '""', "nullValue": ""}


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, no index, one file per task; quotes inside a field are doubled."""
    df.write.mode("overwrite").option("header", True).options(**CSV_QUOTING).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (spark.read.option("header", True).option("multiLine", True).options(**CSV_QUOTING)
            .schema(schema).csv(path))


def csv_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as CSV and read it back with the same schema."""
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema)


# --- text report -----------------------------------------------------------------

INVERT_CENTS = "9" * 37      # any DECIMAL(38) total in cents, inverted, keeps its order as text
# Tables written once and scanned by every query are stored with zstd:
# about a quarter smaller than the default snappy, so less I/O per scan.
STORED_CODEC = "zstd"


def _line(section: int, key: str, text) -> F.Column:
    return F.struct(F.lit(section).alias("section"), F.lit(key).alias("line_key"), text.alias("text"))


def _money(c) -> F.Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


REPORT_TITLE = "ALUMNI EVENT TARGETING REPORT"


def report_lines(filtered: DataFrame, generated: str, cell_col: str = "hex_level_8",
                 record_columns: Sequence[str] | None = None, title: str = REPORT_TITLE) -> DataFrame:
    """The report as rows ``(section, line_key, text)``.

    Sections: 0 header and bounds, 1 summary statistics, 2 zips by total,
    3 segments, 4 top 10 cells, 5 every record as CSV (keyed by donor id).
    Header numbers come from one aggregate; the record section is a
    projection of the filtered rows, so it scales with them.
    """
    A, C = "annual_donation_amount", "cumulative_donation_amount"
    # Six sections read the filtered rows: pin them once in the shared
    # checkpoint folder instead of recomputing scan, join and filter six times.
    checkpoint_root(filtered.sparkSession)
    filtered = filtered.checkpoint(eager=True)
    lat, lon = F.col("latitude"), F.col("longitude")
    head = filtered.agg(
        F.count(F.lit(1)).alias("n"), money_sum(F.col(A)).alias("ta"), mean_half_up(F.col(A), 2).alias("ma"),
        money_sum(F.col(C)).alias("tc"), mean_half_up(F.col(C), 2).alias("mc"),
        rounded(coord_mean(lat), 6).alias("clat"), rounded(coord_mean(lon), 6).alias("clon"),
        F.min(lat).alias("lat0"), F.max(lat).alias("lat1"), F.min(lon).alias("lon0"), F.max(lon).alias("lon1"))
    f6 = lambda c: F.format_string("%.6f", F.col(c))
    header = head.select(F.explode(F.array(
        _line(0, "00", F.lit(title)),
        _line(0, "01", F.lit("=" * 50)),
        _line(0, "02", F.lit(f"Generated: {generated}")),
        _line(0, "03", F.concat(F.lit("Total Records Analyzed: "), F.format_number(F.col("n"), 0))),
        _line(0, "04", F.concat(F.lit("Map Center: "), f6("clat"), F.lit(", "), f6("clon"))),
        _line(0, "05", F.concat(F.lit("Geographic Bounds: "), f6("lat0"), F.lit(" to "), f6("lat1"), F.lit(" (Lat)"))),
        _line(0, "06", F.concat(F.lit(" " * 19), f6("lon0"), F.lit(" to "), f6("lon1"), F.lit(" (Lon)"))),
        _line(1, "00", F.lit("SUMMARY STATISTICS")),
        _line(1, "01", F.lit("-" * 20)),
        _line(1, "02", F.concat(F.lit("Total Donors in Analysis: "), F.format_number(F.col("n"), 0))),
        _line(1, "03", F.concat(F.lit("Total Annual Donations: "), _money(F.col("ta")))),
        _line(1, "04", F.concat(F.lit("Average Annual Donation: "), _money(F.col("ma")))),
        _line(1, "05", F.concat(F.lit("Total Cumulative Donations: "), _money(F.col("tc")))),
        _line(1, "06", F.concat(F.lit("Average Cumulative Donation: "), _money(F.col("mc")))),
    )).alias("l")).select("l.*")

    def table(section: int, title: str, df: DataFrame, key: str, digits: int = 2, by_total: bool = True,
              extra: Sequence[str] = ()) -> DataFrame:
        title_rows = df.sparkSession.range(1).select(F.explode(F.array(
            _line(section, "0", F.lit(title)),
            _line(section, "1", F.lit("-" * len(title))),
            _line(section, "2", F.lit(",".join([key, "donor_count", "total_annual", "avg_annual", *extra]))),
        )).alias("l")).select("l.*")
        # Sort key: inverted cents (fixed width) then the group key, so text
        # order is total descending, key ascending, with no global window.
        cents = F.floor(F.col("total_annual").cast("decimal(35,2)") * F.lit(100)).cast("decimal(37,0)")
        inverted = F.lpad((F.lit(INVERT_CENTS).cast("decimal(37,0)") - cents).cast("string"), 37, "0")
        order_key = F.concat(F.lit("3:"), inverted, F.lit(":"), F.col(key)) if by_total else F.concat(F.lit("3:"), F.col(key))
        body = df.select(F.lit(section).alias("section"), order_key.alias("line_key"),
                         F.concat_ws(",", quoted(F.col(key)), F.col("donor_count").cast("string"),
                                     F.format_string("%.2f", F.col("total_annual")),
                                     F.format_string(f"%.{digits}f", F.col("avg_annual")),
                                     *(F.format_string("%.4f", F.col(c)) for c in extra)).alias("text"))
        return title_rows.unionByName(body)

    zips = rollups.report_zip(filtered)
    segs = rollups.report_segment(filtered)
    cells = hexmap.report_top_hex(filtered, cell_col)
    cols = list(record_columns or filtered.columns)
    rec_title = filtered.sparkSession.range(1).select(F.explode(F.array(
        _line(5, "0", F.lit("INDIVIDUAL DONOR RECORDS")),
        _line(5, "1", F.lit("-" * 25)),
        _line(5, "2", F.lit(",".join(cols))),
    )).alias("l")).select("l.*")
    rec_body = filtered.select(
        F.lit(5).alias("section"), F.concat(F.lit("3:"), F.col("donor_id")).alias("line_key"),
        F.concat_ws(",", *[quoted(F.col(c).cast("string")) for c in cols]).alias("text"))
    return (header.unionByName(table(2, "GEOGRAPHIC DISTRIBUTION", zips, "zip_code"))
            .unionByName(table(3, "DONOR SEGMENTS", segs, "donor_segment", by_total=False))
            .unionByName(table(4, "TOP 10 HEX CELLS BY TOTAL ANNUAL DONATIONS", cells, "hex_cell", 4,
                               extra=("center_lat", "center_lon")))
            .unionByName(rec_title).unionByName(rec_body))


def quoted(text) -> F.Column:
    """One CSV field: null as empty; in quotes, with quotes doubled, if it holds a comma, a quote or a line end."""
    return F.coalesce(F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))
                      .otherwise(text), F.lit(""))


def write_report(lines: DataFrame, path: str) -> None:
    """Write the report text in reading order as a multi-part text dataset."""
    (lines.repartitionByRange("section", "line_key").sortWithinPartitions("section", "line_key")
     .select("text").write.mode("overwrite").text(path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report's lines as written (a record with a line end spans several)."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def write_donor_table(donors: DataFrame, path: str, partition_by: str = "zip_code",
                      max_records_per_file: int = 5_000_000) -> DataFrame:
    """Materialise the donor table once, partitioned by ``partition_by``.

    Readers filtering on that column then skip other partitions entirely
    (``PartitionFilters`` in the plan). ``rebalance`` gathers the rows of a
    key in few tasks and lets AQE split a key that holds a third of all rows
    into many; files are capped at ``max_records_per_file`` rows.
    """
    (donors.hint("rebalance", partition_by)
     .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
     .option("compression", STORED_CODEC)
     .partitionBy(partition_by).parquet(path))
    # read back with the declared schema (partition values stay strings)
    # and the declared column order
    return donors.sparkSession.read.schema(donors.schema).parquet(path).select(*donors.columns)


def write_clustered(df: DataFrame, path: str, cluster_by: str = "zip_code", tiebreak: str = "donor_id") -> DataFrame:
    """Write ``df`` in one pass as balanced files, each sorted by ``cluster_by``.

    Inside a file rows are sorted by the key, so each row group covers a
    narrow key range and filters on it skip row groups through parquet
    statistics. ``rebalance`` on the key sizes the files from the rows
    themselves: AQE merges small partitions and splits one whose key holds a
    third of all rows.
    """
    (df.hint("rebalance", cluster_by).sortWithinPartitions(cluster_by, tiebreak).write.mode("overwrite")
     .option("compression", STORED_CODEC).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
