"""Restartable enrichment of the rows that still lack their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions import predicates as P
from civicspark.operators.tables import update_from

Enrich = Callable[[DataFrame], DataFrame]


def fill_backlog(table: DataFrame, key: str, outputs: Sequence[str], enrich: Enrich, where: Column | None = None) -> DataFrame:
    """Compute the outputs of the rows where any is NULL and write them back by key.

    Running it again only touches what is still missing.
    """
    todo = table.filter(P.any_null(outputs))
    if where is not None:
        todo = todo.filter(where)
    return update_from(table, enrich(todo).select(key, *outputs), key, outputs)


def resume_point(df: DataFrame, index: str, processed: Column, back: int = 2) -> DataFrame:
    """The index to restart from: the last processed one less ``back``, never below 0."""
    last = F.max(F.when(processed, F.col(index)))
    return df.agg(F.greatest(F.coalesce(last - back, F.lit(0)), F.lit(0)).cast("bigint").alias("start"))


def rows_from(df: DataFrame, index: str, start: DataFrame) -> DataFrame:
    """The tail to run (again) from the resume point."""
    return df.withColumn("_start", start.scalar()).filter(F.col(index) >= F.col("_start")).drop("_start")


def retry_errors(table: DataFrame, key: str, flag: str, outputs: Sequence[str], enrich: Enrich) -> DataFrame:
    """Run the flagged rows again and upsert their results and the new flag."""
    return update_from(table, enrich(table.filter(F.col(flag))).select(key, flag, *outputs), key, [flag, *outputs])


def map_frames(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a row-local pandas function batch by batch (Arrow); the partitions are the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def sql_on(df: DataFrame, text: str) -> DataFrame:
    """Run SQL text over a DataFrame named ``{df}``: no temporary view is left behind."""
    return df.sparkSession.sql(text, df=df)
