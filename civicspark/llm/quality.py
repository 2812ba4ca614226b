"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

* n-grams of a text: its byte trigrams, and for each pair of neighbouring words the bytes that meet and whether the word is
  repeated; hashed to ``BUCKETS`` buckets.
* The raw model counts the n-grams of all rows. The target model counts those of the rows labelled good, at most
  ``fit_rows`` of them (those of least hashed id). A row's importance weight is the ratio of the two models' probabilities
  of its n-grams, taken to the span of ``SPAN`` trigrams and ``SPAN`` pairs so that texts of any length can be compared.
* How many rows to keep, if not given, is the number of rows whose weight is above the level that best parts rows labelled
  good and bad (up to ``fit_rows`` of each). They are the rows with the largest log weight plus Gumbel noise drawn from the
  id: a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.columns import unused
from civicspark.llm.text import LOWER, slices, word_bounds, word_hashes
from civicspark.session import materialise

TRIGRAMS, PAIRS = 1 << 15, 1 << 12
BUCKETS = TRIGRAMS + PAIRS
SPAN = 100.0
FIT_ROWS = 20_000
BINS = 4096
LAST_ROWS = 10_000


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For trigrams and for word pairs: bucket of each n-gram of all rows, and the row offsets."""
    x = data.astype(np.uint32)
    if len(x) >= 3:
        grams = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
        inside = np.ones(len(grams), bool)
        for back in (1, 2):
            cut = offsets[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(grams))]] = False
        rows = np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, len(grams))]
        yield grams[inside].astype(np.int64), rows
    starts, ends, rows = word_bounds(data, offsets)
    hashes, _ = word_hashes(data, offsets)
    if len(starts) > 1:
        code = (LOWER[data[ends[:-1] - 1]].astype(np.uint32) << 9) | (LOWER[data[starts[1:]]].astype(np.uint32) << 1) | (hashes[1:] == hashes[:-1])
        buckets = TRIGRAMS + ((code * np.uint32(2246822519)) >> np.uint32(32 - 12)).astype(np.int64)
        inside = np.ones(len(code), bool)
        cut = rows[1:-1] - 1
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
        yield buckets[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(rows, len(code))]


def sum_rows(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows) - 1)
    full = np.diff(rows) > 0
    if full.any():
        out[full] = np.add.reduceat(values, rows[:-1][full], dtype=np.float64)
    return out


def labelled_sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` ids of each quality: those of least hash; an id with several labels is good only if all are good."""
    one = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
           .agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good")))
    parts = [one.filter(F.col("good") == g).orderBy(F.xxhash64("labelled"), "labelled").limit(rows) for g in (0, 1)]
    return parts[0].unionAll(parts[1])


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability of every bucket; zeros if there is nothing to learn from."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch, data, offsets in slices(batches):
            good = batch.column("good").to_numpy(zero_copy_only=False) == 1
            for buckets, rows in ngram_buckets(data, offsets):
                raw += np.bincount(buckets, minlength=BUCKETS)
                if good.any():
                    target += np.bincount(buckets[np.repeat(good, np.diff(rows))], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"), "left").select("text", "good")
    found = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for k, name in enumerate(("target", "raw")):
        counts[k][found["bucket"].to_numpy()] = found[name].to_numpy()
    if not counts[0].sum():
        return np.zeros(BUCKETS)
    counts += 0.5
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def weigh(docs: DataFrame, ratios: np.ndarray, name: str = "__weight") -> DataFrame:
    """All columns of ``docs`` and ``name``: the log importance weight of its text. A text without n-grams weighs 0."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            weight = np.zeros(batch.num_rows)
            for buckets, rows in ngram_buckets(data, offsets):
                weight += SPAN * sum_rows(sent.value[buckets], rows) / np.maximum(np.diff(rows), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel(id_col: str) -> Column:
    """Gumbel noise from 52 bits of the salted id's md5."""
    text = F.concat(F.lit("gumbel:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def level(scored: DataFrame) -> float:
    """The weight that best parts good from bad rows (``good`` 1 or 0), by the mean of both hit rates; -inf without both."""
    marked = scored.filter("good is not null").select("good", "__weight")
    ends = marked.groupBy("good").agg(F.min("__weight"), F.max("__weight")).collect()
    if len(ends) < 2:
        return float("-inf")
    low, high = min(r[1] for r in ends), max(r[2] for r in ends)
    step = (high - low) / BINS or 1.0
    bins = marked.groupBy("good", F.least(F.floor((F.col("__weight") - low) / step), F.lit(BINS - 1)).alias("bin")).count().collect()
    counts = np.zeros((2, BINS))
    for r in bins:
        counts[r.good, r.bin] += r["count"]
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(counts, 1)], 1)
    rate = below[0] / below[0][-1] + 1 - below[1] / below[1][-1]
    best = np.flatnonzero(rate >= rate.max() - 1e-12)
    return float(low + step * best[len(best) // 2])


def cut_of_top(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """(key, doc_id) of the last of the k rows of largest key (ties: smaller doc_id first, NULL before all); None for k < 1.

    ``keys``: doc_id, key. Counts per bin narrow the range that holds the cut until at most LAST_ROWS rows are left in it or
    all of them tie; no sort of all rows.
    """
    if k < 1:
        return None
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n:
        last = keys.filter(F.col("key") == low).agg(F.max("doc_id")).first()[0]
        return low, last
    ahead, inside = 0, keys
    while n > LAST_ROWS and low < high:
        step = (high - low) / BINS
        binned = inside.withColumn("bin", F.greatest(F.lit(0), F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1))))
        for r in binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect():
            if ahead + r.n >= k:
                break
            ahead += r.n
        low, high, n = r.low, r.high, r.n
        inside = keys.filter(F.col("key").between(low, high))
    if low == high:
        tied = inside.groupBy("doc_id").count().orderBy(F.col("doc_id").asc_nulls_first())
        for r in tied.toLocalIterator():
            ahead += r["count"]
            if ahead >= k:
                return low, r.doc_id
    r = inside.orderBy(F.desc("key"), F.col("doc_id").asc_nulls_first()).limit(k - ahead).collect()[-1]
    return r.key, r.doc_id


def kept_by(cut: tuple[float, int | None] | None, key: Column, doc_id: Column) -> Column:
    if cut is None:
        return F.lit(False)
    at, last = cut
    tie = doc_id.isNull() if last is None else doc_id.isNull() | (doc_id <= F.lit(last))
    return (key > F.lit(at)) | ((key == F.lit(at)) & tie)


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns, ``__weight`` and ``__key`` (lengthened if taken).

    ``docs``: doc_id, text and any other columns; ``labels``: doc_id, quality. NULL or empty texts have no n-grams and weigh 0,
    between good and bad. Rows that share an id share the noise; rows that tie at the cut in key and id are all kept.
    Without labels of both kinds all rows are kept unless ``keep`` is given. Empty input gives no rows.
    """
    sample = materialise(labelled_sample(labels, fit_rows), "quality-labels")
    ratios = fit(docs, sample)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = materialise(weigh(base, ratios).select("doc_id", "__weight"), "quality-weights")
    if keep is None:
        known = scored.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"), "left")
        keep = scored.filter(F.col("__weight") >= F.lit(level(known))).count()
    cut = cut_of_top(scored.select("doc_id", (F.col("__weight") + gumbel("doc_id")).alias("key")), keep)
    weight, key = unused(docs, "__weight"), unused(docs, "__key")
    out = weigh(docs, ratios, weight).withColumn(key, F.col(weight) + gumbel("doc_id"))
    return out.filter(kept_by(cut, F.col(key), F.col("doc_id").cast("long")))
