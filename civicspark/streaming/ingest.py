"""Resumable file ingest: each file is taken once, however often the job restarts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from civicspark.sources.charsets import CHARSETS
from civicspark.sources.records import decoded_lines, records


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, cols: Sequence[str], sep: str = ",", quote: str | None = '"',
           files_per_trigger: int = 1000, broken: str = "_broken", charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """Append the records of all files not taken yet to the target table and return it (``cols`` and ``broken``, see ``records``).

    Progress lives in the checkpoint. A batch is written to a folder of its own number, which the same batch replaces when it is run
    again: no file counts twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        records(batch, cols, sep, quote, True, broken).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    text = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(source)
    stream = decoded_lines(text, charsets)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cols, broken]])
    return spark.read.schema(schema).parquet(target).select(*cols, broken)
