"""Connected components of a link table by alternating large and small stars (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the least of its neighbourhood. Only minima are aggregated."""
    if large:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the least node it is connected to) of every node of ``links`` (a, b).

    Rounds go on until a round changes no link; the count grows with the logarithm of the longest path. Every round is
    written to the shared folder. Links to oneself and repeated links do no harm; no links give no rows.
    """
    links = materialise(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        links = materialise(_star(_star(links, True), False), name)
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        # stars only: no node is both an end and a centre
        crossing = links.select("a").join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if now == state or not crossing:
            break
        state = now
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labels.unionAll(centres)
