"""Order-dependent operators that never sort a whole table, or a whole key, in one task.

Rows are dealt to ranges of (key, order), as many as the table needs, and the ranges are written to the shared
folder: the input is computed once and a re-run task finds every row in the same range. Work inside a range is an
ordinary window; what crosses ranges is a small table of one row per (key, range).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import materialise

ROWS_PER_RANGE = 65_536


def with_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``_o`` (the order tuple) and ``_range`` (increasing in key and ``_o``); rows that tie share a range.

    The number of ranges follows the number of rows, and a hot key is cut like any other run of rows.
    """
    rows = materialise(df.withColumn("_o", order[0] if len(order) == 1 else F.struct(*order)), "ordered")
    ranges = -(-rows.count() // ROWS_PER_RANGE) or 1
    cut = rows.repartitionByRange(ranges, *keys, "_o").withColumn("_range", F.spark_partition_id().cast("bigint"))
    return materialise(cut, "ranges")


def running(df: DataFrame, keys: list[str], order: list[Column], outs: dict[str, tuple[str, Column]],
            strict: bool = False) -> DataFrame:
    """Running sums or maxima per key in ``order``; ``outs`` maps a name to (``"sum"`` | ``"max"``, column).

    ``strict`` leaves the row itself out. ``order`` must be distinct within a key.
    """
    fns = {"sum": F.sum, "max": F.max}
    source = df.select("*", *[c.alias(f"_v_{n}") for n, (_, c) in outs.items()])
    cut = with_ranges(source, keys, order)
    per_range = cut.groupBy(*keys, "_range").agg(*[fns[f](f"_v_{n}").alias(f"_p_{n}") for n, (f, _) in outs.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*keys, "_range",
                               *[fns[f](f"_p_{n}").over(before).alias(f"_b_{n}") for n, (f, _) in outs.items()])
    inside = (Window.partitionBy(*keys, "_range").orderBy("_o")
              .rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    # spelled out: a table already partitioned by the keys alone would otherwise keep a hot key in one task
    spread = cut.repartition(*keys, "_range")
    local = spread.select("*", *[fns[f](f"_v_{n}").over(inside).alias(f"_l_{n}") for n, (f, _) in outs.items()])
    offsets = offsets.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col("_range").alias("_e_range"), *[f"_b_{n}" for n in outs])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys], F.col("_range") == F.col("_e_range"))
    joined = local.join(offsets, same, "left")
    final = []
    for n, (f, _) in outs.items():
        if f == "sum":
            final.append((F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n))
        else:
            final.append(F.greatest(f"_l_{n}", f"_b_{n}").alias(n))
    return joined.select(*df.columns, *final)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """1-based row number per key; ``order`` must be unique within a key."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))})


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key; ``probs`` maps an output name to its probability.

    Equal values are merged first, then only the ranges that hold a wanted rank are looked into.
    """
    known = df.filter(F.col(value).isNotNull())
    points = known.groupBy(*keys, F.col(value).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    cut = with_ranges(points, keys, [F.col("_q")])
    part = keys or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (cut.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
              .select(*keys, "_range", "_rn",
                      F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_start"),
                      F.sum("_rn").over(Window.partitionBy(*part)).alias("_total")))
    positions = {n: (F.col("_total") - 1) * F.lit(float(p)) for n, p in probs.items()}
    wanted = [edge for pos in positions.values() for edge in (F.floor(pos), F.ceil(pos))]
    holds = reduce(lambda a, b: a | b, [(w >= F.col("_start")) & (w < F.col("_start") + F.col("_rn")) for w in wanted])
    edges = totals.filter(holds)
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in keys], F.col("_range").alias("_e_range"), "_rn", "_start", "_total")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in keys], F.col("_range") == F.col("_e_range"))
    kept = cut.join(edges, same)
    inside = Window.partitionBy(*keys, "_range").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("_end", F.col("_start") + F.sum("_n").over(inside))

    return _at_ranks(ranked, keys, probs)


def _at_ranks(ranked: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles from distinct values ``_q`` with ``_n`` rows, ``_end`` rows up to there and ``_total`` rows of the key."""
    positions = {n: (F.col("_total") - 1) * F.lit(float(p)) for n, p in probs.items()}

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_q")))

    aggs = []
    for n, pos in positions.items():
        aggs += [at(F.floor(pos)).alias(f"_lo_{n}"), at(F.ceil(pos)).alias(f"_hi_{n}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{n}")]
    got = ranked.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
                               for n in probs])


def binned_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = 1024) -> DataFrame:
    """Exact interpolated quantiles per key, for few keys of very many rows: the rows themselves hardly move.

    Three passes over ``df``, which must be cheap to compute again: the range of each key, counts per bin of the range (both combined
    before they move), and the values of the bins that hold a wanted rank. NULL values do not count.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_q"))
    part = keys or [F.lit(0)]

    def joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
        small = small.select(*[F.col(c).alias(f"_e_{c}") for c in on], *[c for c in small.columns if c not in on])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in on], F.lit(True))
        return rows.join(small, same).drop(*[f"_e_{c}" for c in on])

    span = materialise(known.groupBy(*keys).agg(F.min("_q").alias("_lo"), F.max("_q").alias("_hi"), F.count(F.lit(1)).alias("_total")), "spans")
    share = (F.col("_q") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    binned = joined(known, span, keys).withColumn("_bin", F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_rn"), F.max("_total").alias("_total"))
    before = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows per key
    counts = counts.withColumn("_start", F.coalesce(F.sum("_rn").over(before), F.lit(0)))
    ranks = [edge for p in probs.values() for edge in (F.floor((F.col("_total") - 1) * F.lit(float(p))), F.ceil((F.col("_total") - 1) * F.lit(float(p))))]
    holds = reduce(lambda a, b: a | b, [(r >= F.col("_start")) & (r < F.col("_start") + F.col("_rn")) for r in ranks])
    wanted = materialise(counts.filter(holds).select(*keys, "_bin", "_start"), "bins")
    values = joined(binned, wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", "_start", "_total", "_q").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    return _at_ranks(values.withColumn("_end", F.col("_start") + F.sum("_n").over(inside)), keys, probs)
