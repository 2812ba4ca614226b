"""Reproducible sampling by key hash. Sizes are exact and no sample is sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.hashing import hash_bucket, key_hash
from civicspark.operators.joins import join_keys

ROWS_PER_SLICE = 4096


def _sliced(df: DataFrame, key: str, salt: int) -> DataFrame:
    """``_h``, the key's hash, and ``_slice``, its equal part of the hash space; as many parts as the rows need."""
    slices = df.agg(F.ceil((F.count(F.lit(1)) + 1) / ROWS_PER_SLICE).alias("n")).scalar()
    return df.withColumn("_h", key_hash(key, salt)).withColumn("_slice", hash_bucket(F.col("_h"), slices))


def hash_rank(df: DataFrame, key: str, by: Sequence[str] = (), salt: int = 0, name: str = "rn") -> DataFrame:
    """1-based rank in hash order, per group when given; a hot group is spread over the hash slices."""
    by = list(by)
    cut = _sliced(df, key, salt)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", key))
    ranked = cut.repartition(*by, "_slice").withColumn("_inside", inside)  # never by the group alone
    joined = join_keys(ranked, offsets, [*by, "_slice"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))


def sample_exact(df: DataFrame, key: str, fraction: float, of: DataFrame | None = None, salt: int = 0) -> DataFrame:
    """Exactly floor(fraction * N) rows, N counted over ``df`` (or over ``of``: a share of a larger table).

    Hash slices below the cut are kept without moving a row; only the slice holding the cut is ranked.
    """
    cut = _sliced(df, key, salt)
    counts = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    total = (of if of is not None else df).agg(F.floor(F.count(F.lit(1)) * F.lit(float(fraction))).alias("t")).scalar()
    everything = Window.partitionBy(F.lit(0)).orderBy("_slice")  # one row per ROWS_PER_SLICE rows
    bounds = counts.select("_slice", F.coalesce(F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0)).alias("_before"), "_n").withColumn("_want", total)
    marked = cut.join(bounds.filter(F.col("_before") < F.col("_want")), "_slice")
    inside = marked.filter(F.col("_before") + F.col("_n") <= F.col("_want"))
    edge = marked.filter(F.col("_before") + F.col("_n") > F.col("_want"))
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", key))
    edge = edge.withColumn("_rn", rank).filter(F.col("_before") + F.col("_rn") <= F.col("_want")).drop("_rn")
    return inside.unionByName(edge).select(*df.columns)


def sample_backlog(df: DataFrame, todo, key: str, fraction: float) -> DataFrame:
    """floor(fraction * all rows) rows, drawn only from the rows where ``todo`` holds."""
    return sample_exact(df.filter(todo), key, fraction, of=df)


def sample_stratified(df: DataFrame, key: str, group: str, sizes: DataFrame, size: str, salt: int = 0) -> DataFrame:
    """``size`` rows per group without replacement; ``sizes`` has one row per group."""
    ranked = hash_rank(df, key, [group], salt)
    wanted = sizes.select(F.col(group), F.col(size).alias("_want"))
    return join_keys(ranked, wanted, [group]).filter(F.col("rn") <= F.col("_want")).drop("_want", "rn")


def sample_disjoint(df: DataFrame, key: str, sizes: Sequence[int], salt: int = 0) -> DataFrame:
    """Disjoint subsets of the given sizes, numbered from 0 in ``subset``."""
    ranked = hash_rank(df, key, (), salt)
    number, upper = F.lit(None).cast("int"), sum(sizes)
    for i in reversed(range(len(sizes))):
        number = F.when(F.col("rn") <= sum(sizes[: i + 1]), F.lit(i)).otherwise(number)
    return ranked.filter(F.col("rn") <= upper).withColumn("subset", number).drop("rn")


def hash_split(df: DataFrame, key: str, train: float = 0.8, salt: int = 0) -> DataFrame:
    """``is_train`` by key hash: the same split whatever the partitioning."""
    return df.withColumn("is_train", (key_hash(key, salt) < F.lit(int(train * 2147483648))).cast("int"))
