"""Counts, profiles, histograms and rates. Every aggregate combines on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, col: str, name: str = "num") -> DataFrame:
    """Value counts, most frequent first (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(col))


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: the number of rows each condition holds for."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def width_profile(df: DataFrame, cols: Sequence[str], factor: float = 1.5, floor: int = 2) -> DataFrame:
    """Longest text per column and the padded width: one pass, NULL counts as 0."""
    widest = df.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).cast("bigint").alias(c) for c in cols])
    long = widest.unpivot([], list(cols), "column_name", "max_width")
    padded = F.greatest(F.floor(F.col("max_width") * F.lit(float(factor))), F.lit(floor)).cast("bigint")
    return long.withColumn("padded_width", padded)


def moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(col).alias("total"), F.count(col).alias("n"), F.avg(col).alias("mean"),
                               F.stddev_samp(col).alias("stdev"))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right."""
    width = (high - low) / F.lit(float(bins))
    return F.least(F.floor((x - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin between the overall minimum and maximum, per group when given.

    The range is a one-row scalar subquery; counting is one pass.
    """
    edges = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).alias("e"))
    e = edges.scalar()
    with_edges = df.filter(F.col(col).isNotNull()).withColumn("_e", e)
    b = F.coalesce(equal_width_bin(F.col(col).cast("double"), F.col("_e.lo"), F.col("_e.hi"), bins), F.lit(0))
    return with_edges.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_share(df: DataFrame, col: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Share of each group per bin; windows run on the few bin rows only."""
    counts = histogram(df, col, bins, by)
    return counts.select(*by, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("share"))


def histogram_cumulative(df: DataFrame, col: str, bins: int, by: Sequence[str]) -> DataFrame:
    counts = histogram(df, col, bins, by)
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, "bin",
                         (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(*by))).alias("cumulative"))


def turnout_by(df: DataFrame, area: str, method: str) -> DataFrame:
    """Per area: how many voted in person, absentee, in all, and the rates."""
    voted, absent, total = (F.count_if(F.col(method) == "voted"), F.count_if(F.col(method) == "absentee"),
                            F.count(F.lit(1)))
    return (df.groupBy(area).agg(voted.alias("num_voted"), absent.alias("num_absentee"), total.alias("num_total"))
            .withColumn("voted_rate", F.col("num_voted") / F.col("num_total"))
            .withColumn("absentee_rate", F.col("num_absentee") / F.col("num_total"))
            .orderBy(F.desc("voted_rate"), F.asc(area)))


def weighted_mean(value: Column, weight: Column, skip_null: bool = True) -> Column:
    """sum(w v) / sum(w); with ``skip_null`` a NULL value leaves both sums, otherwise it makes the result NULL."""
    w = F.when(value.isNotNull(), weight)
    mean = F.sum(value * weight) / F.nullif(F.sum(w), F.lit(0.0))
    if skip_null:
        return mean
    return F.when(F.count_if(value.isNull()) == 0, mean)
