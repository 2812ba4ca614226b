"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are runs of ``GRAMS`` bytes inside a folded word, its edges included, so that inflected forms of a word share terms. Of the
terms of the examples those are kept that occur ``RATIO`` times as often under one label as under the other and depend on the label
beyond chance (log-likelihood ratio past Bonferroni's bound); their document frequencies are counted over all documents. A
text is the vector of ``(1 + ln tf) * idf`` of its kept terms.

The index. Examples with equal vectors are one entry. Entries stand in order of their heaviest terms and are cut into blocks of
``BLOCK``; a term's postings are grouped by block, with the largest impact of each group. A query adds up the block maxima of its
terms, reads the most promising blocks until it holds enough examples, and then all blocks whose bound reaches the last of
them: no other block can hold a nearer example, so the result is that of comparing all.

The score. The ``NEIGHBOURS`` nearest examples, and all others as near as the last of them, vote with weights falling with the
distance, scaled to the true shares of the labels. Votes are calibrated on the examples, each voted on by the others, by isotonic
regression. Texts without a kept term share one score: the smoothed share of toxic ones among such examples.

The examples are at most ``EXAMPLES`` documents per label, those with the smallest hash of their id: the model that is broadcast is
bounded by that, whatever the corpus. Label totals and document frequencies cover all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.text import distinct, fold_latin, mix64, pack_rows, slices
from civicspark.session import materialise

GRAMS = (4, 5)
EXAMPLES = 10_000
TERMS = 1 << 14
RATIO = 2.5
NEIGHBOURS = 15
BLOCK = 64
NEAR = 0.05  # added to every distance, so that equal vectors have a finite weight
PRIOR = 2.0  # votes of a neighbour at distance one that every vote is mixed with
STEPS = 1000.0  # neighbours' similarities are told apart in these parts
EVIDENCE = 3
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term occurrence of the texts, and the row of each."""
    n = len(offsets) - 1
    stream = np.full(len(data) + n + 1, 32, np.uint8)  # a separator around each text
    stream[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[fold_latin(data)]
    blanks = np.concatenate([[0], np.cumsum(stream == 32)])
    begins = offsets[:-1] + np.arange(n)
    hashes, rows = [], []
    for size in GRAMS:
        if len(stream) < size:
            continue
        at = np.flatnonzero(blanks[size - 1:-1] == blanks[1:len(stream) - size + 2])  # no separator inside
        value = np.full(len(at), size, np.uint64)
        for k in range(size):
            value = (value << np.uint64(8)) | stream[at + k]
        hashes.append(mix64(value))
        rows.append(np.searchsorted(begins, at, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


class Vocabulary:
    """Kept terms, ascending; ``counts`` gives the distinct kept terms of each row and how often they occur."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.astype(np.uint64))
        self.present = np.zeros(1 << 20, bool)
        self.present[self.terms & np.uint64(len(self.present) - 1)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, occurrences), by row and term."""
        none = np.zeros(0, np.int64)
        if not len(self.terms):
            return none, none, none
        hashes, rows = terms_of(data, offsets)
        maybe = np.flatnonzero(self.present[hashes & np.uint64(len(self.present) - 1)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        same = self.terms[at] == hashes[maybe]
        key, tf = np.unique(rows[maybe[same]] * len(self.terms) + at[same], return_counts=True)
        return *np.divmod(key, len(self.terms)), tf


def bonferroni(terms: int) -> float:
    """The log-likelihood ratio that chance exceeds, among so many terms, in at most about one case of a hundred."""
    return 2 * math.log(max(terms, 1) / 0.01)


class Examples:
    """The block-max inverted index of labelled vectors, and the calibrated vote of their neighbours."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, weight: np.ndarray):
        """``vectors``: (term numbers, occurrences) of each example; ``weight``: how many documents an example of a label stands for."""
        self.idf, self.label_weight = idf, weight
        keys: dict[bytes, list[int]] = {}
        for i, (terms, tf) in enumerate(vectors):
            keys.setdefault(terms.astype("<i4").tobytes() + b"|" + tf.astype("<i8").tobytes(), []).append(i)
        blank = keys.pop(b"|", [])
        groups = list(keys.values())
        scaled = [self.scale(*vectors[g[0]]) for g in groups]
        heavy = [tuple(vectors[g[0]][0][np.argsort(-w, kind="stable")[:4]].tolist()) for g, w in zip(groups, scaled, strict=True)]
        order = sorted(range(len(groups)), key=lambda k: (heavy[k], min(groups[k])))
        self.groups = [groups[k] for k in order]
        self.members = np.array([[np.sum(labels[g] == 0), np.sum(labels[g] == 1)] for g in self.groups], np.float64).reshape(-1, 2)
        self.evidence = [[(ids[i], int(labels[i])) for i in sorted(g, key=lambda i: (ids[i] is None, ids[i] or 0, labels[i]))[:EVIDENCE]] for g in self.groups]
        self.blocks = -(-len(order) // BLOCK)
        self._index([vectors[groups[k][0]][0] for k in order], [scaled[k] for k in order])
        self.prior = float(np.sum(labels * weight[labels]) / max(np.sum(weight[labels]), 1e-300)) if len(labels) else 0.0
        of_blank = labels[blank]
        self.blank = float((np.sum(of_blank * weight[of_blank]) + PRIOR * self.prior) / (np.sum(weight[of_blank]) + PRIOR)) if len(labels) else 0.0
        self.vectors = [vectors[g[0]] for g in self.groups]
        self.steps = self.values = np.zeros(0)
        self.cache: dict[bytes, tuple] = {}

    def scale(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(tf)) * self.idf[terms]
        return weight / math.sqrt(float(np.sum(weight * weight)))

    def _index(self, terms: list[np.ndarray], scaled: list[np.ndarray]) -> None:
        entry = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term = np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64)
        impact = np.concatenate([*scaled, np.zeros(0)])
        order = np.lexsort((entry, term))
        self.entry, self.impact = entry[order], impact[order]
        piece = term[order] * max(self.blocks, 1) + self.entry // BLOCK  # a term's postings of one block
        self.piece_from = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else np.zeros(0, np.int64)
        self.piece_to = np.append(self.piece_from[1:], len(piece)).astype(np.int64)[:len(self.piece_from)]
        self.piece_block = piece[self.piece_from] % max(self.blocks, 1)
        self.piece_max = np.maximum.reduceat(self.impact, self.piece_from) if len(piece) else np.zeros(0)
        self.term_from = np.searchsorted(piece[self.piece_from] // max(self.blocks, 1), np.arange(len(self.idf) + 1))

    def _similar(self, weights: np.ndarray, pieces: np.ndarray, repeats: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the wanted blocks that share a term with the query, and their cosines."""
        chosen = wanted[self.piece_block[pieces]]
        pieces, weight = pieces[chosen], np.repeat(weights, repeats)[chosen]
        n = self.piece_to[pieces] - self.piece_from[pieces]
        at = np.arange(int(n.sum())) + np.repeat(self.piece_from[pieces] - (np.cumsum(n) - n), n)
        sums = np.bincount(self.entry[at], np.repeat(weight, n) * self.impact[at], len(self.groups))
        found = distinct(self.entry[at])
        return found, np.rint(np.minimum(sums[found], 1.0) * STEPS) / STEPS

    def nearest(self, terms: np.ndarray, tf: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The entries with the NEIGHBOURS nearest examples, and all as near as the last of them: (entries, cosines), nearest first.

        One example of the entry ``without`` is left out.
        """
        weights = self.scale(terms, tf)
        repeats = self.term_from[terms + 1] - self.term_from[terms]
        pieces = np.arange(int(repeats.sum())) + np.repeat(self.term_from[terms] - (np.cumsum(repeats) - repeats), repeats)
        bound = np.bincount(self.piece_block[pieces], np.repeat(weights, repeats) * self.piece_max[pieces], self.blocks)
        best_first = np.argsort(-bound, kind="stable")
        reachable = int(np.count_nonzero(bound))
        size = self.members.sum(1)
        read, step = 0, 4
        wanted = np.zeros(self.blocks, bool)
        while True:
            until = min(read + step, reachable)
            wanted[best_first[read:until]] = True
            read, step = until, step * 2
            entries, cosines = self._similar(weights, pieces, repeats, wanted)
            order = np.lexsort((entries, -cosines))
            entries, cosines = entries[order], cosines[order]
            held = np.cumsum(size[entries] - (entries == without))
            enough = int(np.searchsorted(held, NEIGHBOURS))
            if read == reachable or (enough < len(entries) and bound[best_first[read]] < cosines[enough] - 1 / STEPS):
                break
        if enough < len(entries):
            last = int(np.searchsorted(-cosines, -cosines[enough], "right"))
            entries, cosines = entries[:last], cosines[:last]
        return entries, cosines

    def vote(self, entries: np.ndarray, cosines: np.ndarray, without: int = -1, label: int = 0) -> float:
        members = self.members[entries].copy()
        members[entries == without, label] -= 1
        closeness = (1 / (1 - cosines + NEAR))[:, None] * members * self.label_weight
        return float((closeness[:, 1].sum() + PRIOR * self.prior) / (closeness.sum() + PRIOR))

    def left_out_votes(self, first: int, until: int) -> Iterator[tuple[float, float, int]]:
        """(vote of all other examples, documents it stands for, label) of the examples of some entries."""
        for e in range(first, until):
            entries, cosines = self.nearest(*self.vectors[e], e)
            for label in (0, 1):
                if self.members[e, label]:
                    yield self.vote(entries, cosines, e, label), float(self.members[e, label] * self.label_weight[label]), label

    def calibrate(self, votes: list[tuple[float, float, int]]) -> None:
        """Isotonic regression of labels on left-out votes; a run of equal value is smoothed by the prior."""
        stack: list[list[float]] = []
        for vote, mass, label in sorted(votes):
            stack.append([vote, vote, mass * label, mass])
            while len(stack) > 1 and (stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3] or stack[-2][1] == stack[-1][0]):
                a, b = stack[-2:]
                stack[-2:] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
        self.steps = np.array([x for s in stack for x in s[:2]])
        self.values = np.maximum.accumulate(np.repeat([(s[2] + PRIOR * self.prior) / (s[3] + PRIOR) for s in stack], 2)) if stack else np.zeros(0)

    def score(self, terms: np.ndarray, tf: np.ndarray) -> tuple[float, list]:
        """Calibrated score of a vector and its evidence: (id, label, cosine) of the nearest examples."""
        if not len(terms):
            return self.blank, []
        key = terms.astype("<i4").tobytes() + tf.astype("<i8").tobytes() if len(terms) > 1 else terms.tobytes()  # one term alone has one direction
        if key not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            entries, cosines = self.nearest(terms, tf)
            if not len(entries) or not len(self.steps):
                self.cache[key] = self.blank, []
            else:
                score = float(np.interp(self.vote(entries, cosines), self.steps, self.values))
                found = [(i, label, float(c)) for e, c in zip(entries[:EVIDENCE].tolist(), cosines) for i, label in self.evidence[e]]
                self.cache[key] = min(max(score, 0.0), 1.0), found[:EVIDENCE]
        return self.cache[key]


def choose_examples(docs: DataFrame, labels: DataFrame, learn: Column, most: int) -> tuple[DataFrame, list[int]]:
    """At most ``most`` document ids per label (id, label), and how many labelled documents there are of each label.

    Only labels of ids that ``docs`` has and ``learn`` (a condition on doc_id) admits count; of several labels the greatest does.
    """
    labelled = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
                .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).filter(F.coalesce(learn, F.lit(False)))
                .groupBy("doc_id").agg(F.max("label").alias("label")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    labelled = materialise(labelled, "toxic-labels")
    found = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [labelled.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return materialise(parts[0].unionAll(parts[1]).select(F.col("doc_id").alias("example_id"), "label"), "toxic-examples"), [found.get(k, 0) for k in (0, 1)]


def choose_terms(examples: DataFrame, most: int) -> np.ndarray:
    """Hashes of the at most ``most`` terms that depend on the label. ``examples``: text, label."""
    schema = pa.schema([("term", pa.int64()), ("label", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            label = batch.column("label").to_numpy(zero_copy_only=False)
            hashes, rows = terms_of(data, offsets)
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            once = np.ones(len(hashes), bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            hashes, rows = hashes[once], rows[once]
            for k in (0, 1):
                terms, n = np.unique(hashes[label[rows] == k].view(np.int64), return_counts=True)
                yield pack_rows({"term": [None, *terms.tolist()], "label": [k] * (len(terms) + 1), "n": [int(np.sum(label == k)), *n.tolist()]}, schema)

    found = examples.mapInArrow(count, "term long, label int, n long")
    with_label = [F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).cast("double") for k in (0, 1)]
    found = materialise(found.groupBy("term").agg(with_label[0].alias("b"), with_label[1].alias("a")), "toxic-terms")
    rows = found.filter("term is null").first()
    if rows is None or not rows.a or not rows.b:
        return np.zeros(0, np.uint64)
    terms = found.filter("term is not null")
    a, b, total = F.col("a"), F.col("b"), rows.a + rows.b

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    n = a + b
    ratio = 2 * (part(a, n * rows.a / total) + part(b, n * rows.b / total) + part(rows.a - a, (total - n) * rows.a / total)
                 + part(rows.b - b, (total - n) * rows.b / total))
    one_sided = (a / rows.a >= RATIO * b / rows.b) | (b / rows.b >= RATIO * a / rows.a)
    kept = terms.filter(one_sided).withColumn("ratio", ratio).filter(F.col("ratio") >= bonferroni(terms.count()))
    return np.array([r.term for r in kept.orderBy(F.desc("ratio"), "term").limit(most).select("term").collect()], np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES, terms: int = TERMS) -> tuple[Vocabulary, Examples]:
    """Learn from the labels whose doc_id meets ``learn``. ``docs``: doc_id, text; ``labels``: doc_id, toxic (0 or 1); others are ignored.

    A document without a label, and a label that is NULL or without a document, is no example; equal rows are one. Without examples
    all texts score 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen, totals = choose_examples(docs, labels, learn, examples)
    # broadcast: at most 2 * examples rows of an id and a label
    marked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("example_id"), "left").drop("example_id")
    vocabulary = Vocabulary(choose_terms(marked.filter("label is not null").select("text", "label"), terms))
    sent = spark.sparkContext.broadcast(vocabulary)
    columns = "term int, n long, doc_id long, label int, terms array<int>, occurrences array<long>"
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32())),
                        ("occurrences", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows_read = sent.value, 0
        frequency = np.zeros(len(known.terms), np.int64)
        for batch, data, offsets in slices(batches):
            rows, found, tf = known.counts(data, offsets)
            frequency += np.bincount(found, minlength=len(frequency))
            rows_read += batch.num_rows
            label = batch.column("label").to_pylist()
            mine = [i for i, x in enumerate(label) if x is not None]
            if mine:
                cut, ids = np.searchsorted(rows, np.arange(batch.num_rows + 1)), batch.column("doc_id").to_pylist()
                yield pack_rows({"term": [None] * len(mine), "n": [None] * len(mine), "doc_id": [ids[i] for i in mine], "label": [label[i] for i in mine],
                                 "terms": [found[cut[i]:cut[i + 1]] for i in mine], "occurrences": [tf[cut[i]:cut[i + 1]] for i in mine]}, schema)
        seen = np.flatnonzero(frequency)
        none = [None] * (len(seen) + 1)
        yield pack_rows({"term": [-1, *seen.tolist()], "n": [rows_read, *frequency[seen].tolist()], "doc_id": none, "label": none, "terms": none,
                         "occurrences": none}, schema)

    counted = materialise(marked.mapInArrow(count, columns), "toxic-vectors")
    frequency = {r.term: r.n for r in counted.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + frequency.get(-1, 0)) / (1 + np.array([frequency.get(k, 0) for k in range(len(vocabulary.terms))]))) + 1
    vectors = counted.filter("label is not null").select("doc_id", "label", "terms", "occurrences").distinct()
    rows = vectors.orderBy(F.xxhash64("doc_id", "terms", "occurrences"), "doc_id", "terms", "occurrences").limit(2 * examples).collect()
    known = np.array([r.label for r in rows], np.int64)
    held = np.maximum(np.bincount(known, minlength=2), 1)
    model = Examples(idf, [(np.array(r.terms, np.int64), np.array(r.occurrences, np.int64)) for r in rows], known, [r.doc_id for r in rows], np.array(totals) / held)
    if not model.groups:
        return vocabulary, model
    given = spark.sparkContext.broadcast(model)
    votes_schema = pa.schema([("vote", pa.float64()), ("mass", pa.float64()), ("label", pa.int32())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                votes = list(given.value.left_out_votes(b * BLOCK, min((b + 1) * BLOCK, len(given.value.groups))))
                yield pack_rows(dict(zip(("vote", "mass", "label"), zip(*votes), strict=True)), votes_schema)

    blocks = spark.range(0, model.blocks, 1, model.blocks).coalesce(max(1, min(model.blocks, spark.sparkContext.defaultParallelism)))
    model.calibrate([tuple(r) for r in blocks.mapInArrow(vote, "vote double, mass double, label int").collect()])
    return vocabulary, model


def predict(docs: DataFrame, fitted: tuple[Vocabulary, Examples], threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and evidence of every row of ``docs`` (doc_id, text; others are ignored); no row is moved.

    ``evidence``: id, label and similarity of the nearest examples, nearest first, at most EVIDENCE; empty for texts without a kept
    term. NULL texts are empty. Repeated rows score alike; NULL ids stay NULL. Whole texts count, however long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    example = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(example))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = sent.value
        for batch, data, offsets in slices(batches):
            rows, terms, tf = vocabulary.counts(data, offsets)
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            found = [model.score(terms[a:b], tf[a:b]) for a, b in zip(cut, cut[1:])]
            yield pack_rows({"doc_id": batch.column("doc_id"), "score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found],
                             "evidence": [[dict(zip(("doc_id", "toxic", "similarity"), e, strict=True)) for e in near] for _, near in found]}, schema)

    return docs.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, similarity: double>>")
