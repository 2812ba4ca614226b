"""Table maintenance as DataFrame algebra: union, insert, update, de-duplicate, reshape, check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.session import scratch_path


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by name; columns appear in first-seen order, missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def subset(df: DataFrame, cols: Sequence[str], rename: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    kept = [c for c in cols if c not in drop]
    return df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in kept])


def keep_known(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Drop the columns that are not in the ingest schema."""
    return df.select(*[c for c in df.columns if c in set(known)])


def add_null_columns(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Typed NULL columns for the names not there yet."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in cols.items() if c not in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. The rank limit runs before the shuffle, so a hot key sends one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def insert_absent(target: DataFrame, source: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Append the source rows whose key the target lacks; the first source row per key wins."""
    fresh = source.join(target.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return target.unionByName(first_per_key(fresh, [key], order).select(*target.columns))


def update_from(target: DataFrame, changes: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Matched rows take the new values even where they are NULL; others stay.

    Of several changes to a key the one with the smallest values counts (in column order, NULL first).
    """
    one = changes.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*cols)).alias("_new"))
    new = one.select("_k", *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in cols])
    joined = target.join(new, target[key] == new["_k"], "left")
    hit = F.col("_k").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(target[c]).alias(c) if c in cols else target[c]
                           for c in target.columns])


def dedup_cascade(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key1 (blank keys always stay), then per key2 among those left, and so on.

    A blank row is its own group, so blanks never pile up in one task.
    """
    out = df
    for key in keys:
        blank = F.col(key).isNull() | (F.col(key) == "")
        alone = [F.when(blank, F.col(o)) for o in order]
        out = first_per_key(out, [key, *alone], [F.col(o) for o in order])
    return out


def dedup_records(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct whole records."""
    return (df.select(*cols) if cols else df).dropDuplicates()


def history_maps(history: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """One row per key with ``history``: a map from every date of the table that the key has to its largest value (a fixed rule for
    double entries). Rows without a date stand under ''."""
    once = history.groupBy(key, F.coalesce(F.col(when).cast("string"), F.lit("")).alias("_at")).agg(F.max(value).alias("_value"))
    entries = F.array_sort(F.collect_list(F.struct("_at", "_value")))  # at most one entry per date
    return once.groupBy(key).agg(F.map_from_entries(entries).alias("history"))


def history_columns(maps: DataFrame, dates: Sequence[str], name) -> DataFrame:
    """A wide view of ``history_maps``: one column per given date."""
    return maps.select("*", *[F.try_element_at("history", F.lit(d)).alias(name(d)) for d in dates])


def split_parts(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a condition and those that do not (or for which it is NULL): one pass writes both to the shared folder."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "parts")
    flag = unused_name(df, "met")
    df.withColumn(flag, F.coalesce(condition, F.lit(False)).cast("int")).write.partitionBy(flag).parquet(path)
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(flag, T.IntegerType())])).parquet(path)
    return tuple(stored.filter(F.col(flag) == k).select(*df.columns) for k in (1, 0))


def unused_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stack(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that appear more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def foreign_key_violations(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose non-NULL key is not in the parent."""
    return (df.filter(F.col(key).isNotNull())
            .join(parent.select(F.col(parent_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti"))
