"""Tables published as versions: a reader finds a whole table at any time.

``publish`` writes a new folder under the table's folder; readers take the
newest folder whose write is complete (its ``_SUCCESS`` marker). Overwriting
a table in place instead would leave it gone or half written meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEPT_VERSIONS = 2


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, table_dir: str, prefix: str = "v") -> list[str]:
    """Complete versions, oldest first."""
    fs, path = _folder(spark, table_dir)
    names = [f.getPath().getName() for f in fs.listStatus(path(table_dir))] if fs.exists(path(table_dir)) else []
    return sorted(n for n in names if n.startswith(prefix) and fs.exists(path(f"{table_dir}/{n}/_SUCCESS")))


def remove(spark: SparkSession, table_dir: str, names: list[str]) -> None:
    fs, path = _folder(spark, table_dir)
    for name in names:
        fs.delete(path(f"{table_dir}/{name}"), True)


def publish(df: DataFrame, table_dir: str, version: int | None = None, keep: int = KEPT_VERSIONS) -> str:
    """Write ``df`` as the next version (or a given one: a retry repeats it) and drop all but the last ``keep``.

    One writer at a time. Returns the version's folder.
    """
    spark = df.sparkSession
    if version is None:
        have = versions(spark, table_dir)
        version = int(have[-1][1:]) + 1 if have else 0
    path = f"{table_dir}/v{version:020d}"
    df.write.mode("overwrite").parquet(path)
    remove(spark, table_dir, versions(spark, table_dir)[:-keep])
    return path


def latest(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest complete version."""
    have = versions(spark, table_dir)
    if not have:
        raise FileNotFoundError(f"nothing has been published under {table_dir}")
    return spark.read.parquet(f"{table_dir}/{have[-1]}")
