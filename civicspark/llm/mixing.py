"""Mixing sources to target weights by Efraimidis-Spirakis keys (DataFrame functions only).

Each row of a source gets the key ``-ln(u) / quality`` with a uniform ``u`` drawn from its id: an order of sampling without
replacement in which better rows come sooner. A source's words are taken as whole epochs first; what remains of its
target is filled with the rows of smallest key, by a prefix sum of their sizes.

No source is sorted in one task: its rows are dealt to buckets of key values whose number grows with the source, only
the bucket totals meet in one window, and rows are ordered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import materialise

ROWS_PER_BUCKET = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str):
    """A number in (0, 1) from 52 bits of the id's md5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """One row per source: its words, weight and target.

    Sources in code point order (NULL last) weigh ``weights``, repeating, and share ``share`` of all words. No target is
    above ``most`` times its source's words; what such a source leaves is shared by weight among the others. That level
    is found in closed form: sources are ordered by the level at which they fill up.
    Input columns: source, size. The windows run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sources = sources.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    sources = sources.withColumn("full", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    by_full = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (sources
               .withColumn("filled", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
               .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
               .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)))
    sources = sources.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("rest_w"))
    reached = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", F.col("source").isNull(), "source", "level"))).over(everything)
    sources = sources.withColumn("at", reached)
    return sources.select("source", "source_size", "n_rows", F.when(
        F.col("at").isNull() | (F.col("full") <= F.col("at.level")), F.lit(float(most)) * F.col("source_size"))
        .otherwise(F.col("at.level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """How many words the mix takes of each row.

    Input columns: doc_id, source, size (words; NULL counts 0) and quality (NULL or not positive counts 1, larger is
    drawn sooner); other columns are ignored. Returns doc_id, source, size, source_size, target, epochs, taken, repeats.
    A row is taken ``repeats`` times, whole: ``epochs`` times and once more if the middle of its words, in key order,
    lies within what remains of the target. Ties of keys go to the smaller id, then the smaller size. Rows with a NULL
    id or source are rows like others (all NULL sources are one source). Empty input gives no rows; a source without
    words has target 0.
    """
    quality = F.col("quality").cast("double")
    rows = docs.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size"),
                       F.when(quality > 0, quality).otherwise(1.0).alias("q"))
    rows = materialise(rows.withColumn("key", -F.log(uniform("doc_id")) / F.col("q")), "mix-rows")
    targets = source_targets(rows, weights, most, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(
        F.col("source").alias("of"), "source_size", "target", F.floor(ratio).cast("long").alias("epochs"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("rest"),
        F.ceil(F.col("n_rows") / ROWS_PER_BUCKET).cast("long").alias("buckets"))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1)
    rows = rows.join(plan.select("of", "buckets"), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket).drop("of", "buckets")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    totals = (totals.join(plan, F.col("source").eqNullSafe(F.col("of")))
              .select(F.col("source").alias("of"), F.col("bucket").alias("of_bucket"), "ahead", "source_size", "target", "epochs", "rest"))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("ahead") + F.sum("size").over(inside) - F.col("size") / 2
    repeats = F.col("epochs") + F.when(middle < F.col("rest"), 1).otherwise(0)
    return (rows.withColumn("repeats", repeats.cast("int"))
            .select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("repeats") * F.col("size")).alias("taken"), "repeats"))


def document_rows(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size and quality: a document labelled good (the largest label counts) is drawn twice as soon."""
    rows = docs.select("doc_id", "source", word_count().alias("size"))
    if labels is None:
        return rows.withColumn("quality", F.lit(1.0))
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg((1.0 + F.max(F.coalesce("quality", F.lit(0)))).alias("quality"))
    return rows.join(good, F.col("doc_id") == F.col("of"), "left").drop("of")
