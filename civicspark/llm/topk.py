"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers ``floor(1024 * x)``. To turn the largest inner product into the least distance, every candidate gets one
more coordinate ``sqrt(M - |x|^2)`` (M: the largest squared norm) and every query a 0 there: then
``|q - x|^2 = |q|^2 + M - 2 q.x``.

The index: each distinct vector is keyed by its nearest pivot and the distance to it; a pivot's vectors, sorted by distance, are
cut into cells (annuli) of at most ``CELL`` vectors. Pivots are fitted on a bounded sample (``PIVOTS`` of ``SAMPLE`` rows of
least hashed id); every row is indexed. If vectors tie in distance a cell may be cut between them.

The search expands in two steps. Each query first meets the cells around its own distance in its nearest pivot, which bounds its
k-th distance r. By the triangle inequality a better vector lies, for every pivot p, in the annulus d(q, p) - r .. d(q, p) + r:
only cells that meet it are visited, and of these only scores at or above the k-th so far are handed on. Queries travel in
blocks of neighbours and meet cells through a directory of distances; scores are integer products, so the result is exact.

A pivot's cells are many where the rows are: cells and rings meet by pivot and by bucket of distance, and the number of buckets follows
the number of cells, so no key of that join grows with the rows.

Equal vectors are one class: of a class only the k + 1 smallest ids can be in any answer (one may be the query itself), so it keeps
those; equal queries are answered once. Vectors shorter than the longest are padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import materialise

PIVOTS, SAMPLE = 32, 4096
CELL, BLOCK = 512, 128
CELLS_PER_BUCKET = 64
SCALE = 1024
NO_ID = (1 << 63) - 1  # stands for a NULL id, which comes last
LARGEST = float(1 << 61)  # of a squared norm: all products then fit 64 bits


def quantised(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id (``NO_ID`` for NULL) and v: integers of whole, finite, non-empty vectors; other rows take no part, nor do vectors so long
    that products with them pass 64 bits."""
    parts = F.col(vector).cast("array<double>")
    rows = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), parts.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0))
    rows = rows.withColumn("fine", F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    norm = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.lit(float(SCALE) ** 2) * x * x)
    return rows.filter(F.col("fine") & (norm < LARGEST)).select("vec_id", F.transform("x", lambda x: F.floor(F.lit(SCALE) * x).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array<long> column as one matrix, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py():column.offsets[-1].as_py()]
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


class Space:
    """The longest dimension, the largest squared norm and the pivots, in the widened space."""

    def __init__(self, dim: int, largest: int, sample: np.ndarray):
        self.dim, self.largest = dim, largest
        # a product sums to less than 2^53 in floating point if the squared norms do (Cauchy-Schwarz, each partial sum included)
        self.exact = largest < 1 << 52
        wide = self.widen(sample)
        chosen = [0] if len(wide) else []
        gap = np.full(len(wide), np.inf)
        while chosen and len(chosen) < PIVOTS:  # farthest first
            gap = np.minimum(gap, ((wide - wide[chosen[-1]]) ** 2).sum(1))
            if gap.max() <= 0:
                break
            chosen.append(int(gap.argmax()))
        self.pivots = wide[chosen]

    def widen(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        wide = np.zeros((len(v), self.dim + 1))
        wide[:, :-1] = v
        if not query:
            wide[:, -1] = np.sqrt(np.maximum(self.largest - (wide[:, :-1] ** 2).sum(1), 0))
        return wide

    def to_pivots(self, wide: np.ndarray) -> np.ndarray:
        square = (wide ** 2).sum(1)[:, None] + (self.pivots ** 2).sum(1) - 2 * wide @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return q @ x.T

    def radius(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Distance at which a score equals ``kth``, with room for rounding."""
        square = (q.astype(np.float64) ** 2).sum(1) + self.largest - 2.0 * kth
        return np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-3


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: v and the k + 1 smallest ids that hold it, ascending, as often as rows have them."""
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
    return kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _placed(vectors: DataFrame, space, query: bool) -> DataFrame:
    """``vectors`` (v, ids) with nearest pivot and distance, dealt and sorted by them."""
    fields = [("v", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("pivot", pa.int32()), ("dist", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.value.to_pivots(space.value.widen(_matrix(batch.column("v"), space.value.dim), query))
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("v").cast(pa.list_(pa.int64())), batch.column("ids").cast(pa.list_(pa.int64())),
                                              pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], schema=pa.schema(fields))

    placed = vectors.select("v", "ids").mapInArrow(run, "v array<long>, ids array<long>, pivot int, dist double")
    return placed.repartitionByRange("pivot", "dist").sortWithinPartitions("pivot", "dist", "v")


def _cells(placed: DataFrame, dim: int, size: int) -> DataFrame:
    """Runs of at most ``size`` rows of one pivot: cell, pivot, low, high, n, vectors (n x dim integers), ids and id offsets."""
    fields = [("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("vectors", pa.binary()),
              ("ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, pivot, dist = _matrix(batch.column("v"), dim), batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            ids = batch.column("ids").to_pylist()
            i = 0
            while i < len(v):
                j = min(i + size, int(np.searchsorted(pivot, pivot[i], "right")))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids[i:j]])])
                yield pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(
                    ([pivot[i]], [dist[i]], [dist[j - 1]], [j - i], [v[i:j].astype("<i8").tobytes()], [[y for x in ids[i:j] for y in x]], [offsets]),
                    fields, strict=True)], schema=pa.schema(fields))
                i = j

    cells = placed.mapInArrow(run, "pivot int, low double, high double, n int, vectors binary, ids array<long>, offsets array<int>")
    return cells.withColumn("cell", F.xxhash64("pivot", "low", "high", "vectors"))


def _visit(pairs: DataFrame, space, k: int) -> DataFrame:
    """Best k + 1 (score, id) of each query of a block in a cell, at or above the query's bound: rows block, query, vec_id, score."""
    fields = [("block", pa.int64()), ("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                q = np.frombuffer(row["q_vectors"], "<i8").reshape(-1, space.value.dim)
                x = np.frombuffer(row["vectors"], "<i8").reshape(-1, space.value.dim)
                ids, offsets = np.array(row["ids"], np.int64), np.array(row["offsets"])
                scores = space.value.scores(q, x)
                bounds = row["bounds"] or [None] * len(q)
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for i, bound in enumerate(bounds):
                    at = np.arange(len(x))
                    if len(at) > k + 1:
                        limit = np.partition(scores[i], len(at) - k - 1)[len(at) - k - 1]
                        at = np.flatnonzero(scores[i] >= limit)
                    if bound is not None:
                        at = at[scores[i][at] >= bound]
                    if len(at):
                        mine = np.concatenate([ids[offsets[a]:offsets[a + 1]] for a in at])
                        score = np.repeat(scores[i][at], np.diff(offsets)[at])
                        order = np.lexsort((mine, -score))[:k + 1]
                        out.append((i, mine[order], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(sum(len(o[1]) for o in out), row["block"])), pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int32)),
                        pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], schema=pa.schema(fields))

    columns = pairs.select("block", "q_vectors", "bounds", "vectors", "ids", "offsets")
    return columns.mapInArrow(run, "block long, query int, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, pivots_from: int = SAMPLE) -> DataFrame:
    """The k largest integer inner products of each query among all candidates but its own id: query_id, rank, vec_id, score.

    Both tables: vec_id, embedding; other columns are ignored. Ties go to the smaller vec_id, NULL last. Vectors that are NULL, empty or hold
    NULL or non-finite components take no part, nor do those of a squared norm (in integers) of 2**61 or more, whose scores no long can hold.
    Each row is a candidate, repeated ones too; a query with a NULL id is not answered, repeated queries are answered once, without the rows
    of their own id. A query with fewer candidates gets them all; empty tables give no rows.
    """
    spark = candidates.sparkSession
    known = materialise(classes_of(quantised(candidates), k), "vectors")
    asked = quantised(queries).filter(F.col("vec_id") != NO_ID).distinct()
    size, largest = known.select(F.size("v").alias("d"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("m")).agg(F.max("d"), F.max("m")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_size, q_largest = asked.select(F.size("v").alias("d"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("m")).agg(F.max("d"), F.max("m")).first()
    dim = max(size, q_size or 0)
    sample = known.orderBy(F.xxhash64("v"), "v").limit(pivots_from).select("v").toArrow()
    fitted = Space(dim, largest, _matrix(sample["v"].combine_chunks(), dim))
    fitted.exact = fitted.exact and (q_largest or 0) < 1 << 52
    space = spark.sparkContext.broadcast(fitted)

    cells = materialise(_cells(_placed(known, space, False), dim, CELL), "cells")
    directory = cells.select("cell", "pivot", "low", "high")
    widest, of_cells = directory.agg(F.max("high"), F.count("*")).first()
    buckets = max(1, of_cells // (PIVOTS * CELLS_PER_BUCKET))
    width = max(widest, 1e-9) / buckets

    def in_buckets(rows: DataFrame, low: str, high: str) -> DataFrame:
        """A row for each bucket of distance that low .. high meets, and the first of them."""
        first, last = (F.greatest(F.lit(0.0), F.least(F.floor(F.col(c) / width), F.lit(float(buckets - 1)))).cast("int") for c in (low, high))
        return rows.withColumn(f"{low}_bucket", first).withColumn("bucket", F.explode(F.sequence(first, last)))

    def meeting(rows: DataFrame, pivot: str, low: str, high: str) -> DataFrame:
        """Rows joined with the cells of their pivot that meet low .. high; a pair is made in the first bucket that both are in."""
        rows = in_buckets(rows, low, high).withColumnRenamed("bucket", "_bucket")
        met = rows.join(in_buckets(directory, "low", "high"), (F.col(pivot) == F.col("pivot")) & (F.col("_bucket") == F.col("bucket"))
                        & (F.col("low") <= F.col(high)) & (F.col("high") >= F.col(low)))
        return met.filter(F.col("bucket") == F.greatest(f"{low}_bucket", "low_bucket"))

    distinct = asked.groupBy("v").agg(F.array(F.min("vec_id")).alias("ids"))
    blocks = _cells(_placed(distinct, space, True), dim, BLOCK)
    blocks = materialise(blocks.select(F.col("cell").alias("block"), F.col("pivot").alias("own"), F.col("low").alias("q_low"), F.col("high").alias("q_high"),
                                       F.col("vectors").alias("q_vectors")), "query-blocks")

    near = meeting(blocks, "own", "q_low", "q_high")
    near = near.select("block", "q_vectors", F.lit(None).cast("array<long>").alias("bounds"), "cell").join(cells.select("cell", "vectors", "ids", "offsets"), "cell")
    seeds = _best(_visit(near, space, k), k).groupBy("block", "query").agg(F.max("rank").alias("n"), F.min("score").alias("kth"))
    seeds = seeds.filter(F.col("n") == k + 1).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "kth"))).alias("known"))

    annuli_schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("inner", pa.float64()), ("outer", pa.float64()), ("bounds", pa.list_(pa.int64()))])

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_vectors"], "<i8").reshape(-1, space.value.dim)
                seen = dict(row["known"] or ())
                bounds = [seen.get(i) for i in range(len(q))]
                far = space.value.to_pivots(space.value.widen(q, True))
                reach = space.value.radius(q, np.array([b if b is not None else 0 for b in bounds]))
                reach[[b is None for b in bounds]] = np.inf
                inner, outer = (far - reach[:, None]).min(0), (far + reach[:, None]).max(0)
                n = len(inner)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(inner), pa.array(outer),
                                                  pa.array([bounds] * n, pa.list_(pa.int64()))], schema=annuli_schema)

    rings = blocks.select("block", "q_vectors").join(seeds, "block", "left").mapInArrow(annuli, "block long, at int, inner double, outer double, bounds array<long>")
    pairs = meeting(rings, "at", "inner", "outer").select("block", "cell", "bounds")
    pairs = pairs.join(cells.select("cell", "vectors", "ids", "offsets"), "cell").join(blocks.select("block", "q_vectors"), "block")
    answers = _best(_visit(pairs, space, k), k).groupBy("block", "query").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))

    numbered = blocks.select("block", F.col("q_vectors"))
    back = pa.schema([("block", pa.int64()), ("query", pa.int32()), ("v", pa.list_(pa.int64()))])

    def unblock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_vectors"], "<i8").reshape(-1, space.value.dim)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(q)), pa.array(np.arange(len(q), dtype=np.int32)),
                                                  pa.array(q.tolist(), pa.list_(pa.int64()))], schema=back)

    vectors = numbered.mapInArrow(unblock, "block long, query int, v array<long>")
    padded = asked.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    owners = padded.withColumnRenamed("vec_id", "query_id").join(vectors, "v").select("query_id", "block", "query")
    out = owners.join(answers, ["block", "query"])
    others = F.filter(F.array_sort(F.transform("found", lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("vec_id")))),
                      lambda x: x["vec_id"] != F.col("query_id"))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("hit.vec_id"), F.lit(NO_ID)).alias("vec_id"), (-F.col("hit.s")).alias("score"))
