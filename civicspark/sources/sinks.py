"""Writers: reports that never overwrite, tables, split files, cached intermediates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def free_name(spark: SparkSession, path: str) -> str:
    """The path, with ``_`` added to its stem until nothing is there."""
    while exists(spark, path):
        stem, dot, ext = path.rpartition(".")
        path = f"{stem}_.{ext}" if dot and "/" not in ext else f"{path}_"
    return path


def write_report(df: DataFrame, path: str, sep: str = ",") -> str:
    """CSV with a header per part file; an existing report is left alone and the new one gets a free name."""
    target = free_name(df.sparkSession, path)
    df.write.mode("errorifexists").option("header", True).option("sep", sep).csv(target)
    return target


ROWS_PER_BUCKET = 1 << 20


def write_table(df: DataFrame, name: str, path: str | None = None, index: Sequence[str] = (), buckets: int | None = None) -> None:
    """Materialise as a table. Index columns become buckets and sort order: later joins on them skip a shuffle.

    Unless given, the number of buckets follows the number of rows; rows are dealt to their bucket first, so that
    each bucket is one file.
    """
    if index:
        buckets = buckets or max(1, -(-df.count() // ROWS_PER_BUCKET))
        df = df.repartition(buckets, *index)
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if index:
        writer = writer.bucketBy(buckets, *index).sortBy(*index)
    writer.saveAsTable(name)


def write_split(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most ``rows`` rows, each with the header."""
    df.write.mode("errorifexists").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def public_columns(df: DataFrame) -> DataFrame:
    """Drop working columns: names that start with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Re-read a stored intermediate, or build and store it first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
