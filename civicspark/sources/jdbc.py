"""JDBC tables, read and written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_options(url: str, table: str, column: str, lower: int, upper: int, partitions: int, fetch: int = 10_000) -> dict[str, str]:
    """Options for a partitioned read: without them one task would read the whole table."""
    if partitions < 1 or upper <= lower:
        raise ValueError("a partitioned read needs lower < upper and at least one partition")
    return {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions), "fetchsize": str(fetch)}


def read_table(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Filters and column lists on the result are pushed to the database."""
    return spark.read.format("jdbc").options(**read_options(url, table, column, lower, upper, partitions), **options).load()


def write_table(df: DataFrame, url: str, table: str, batch: int = 10_000, connections: int = 16, **options: str) -> None:
    """Overwrite a table; ``truncate`` keeps its definition, ``numPartitions`` caps the connections."""
    (df.write.format("jdbc").mode("overwrite")
     .options(url=url, dbtable=table, batchsize=str(batch), numPartitions=str(connections), truncate="true", **options).save())
