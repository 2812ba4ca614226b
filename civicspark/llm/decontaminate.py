"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

The index. An item is cut into units of at most ``UNIT_WORDS`` words. The impact of a term on a unit is its BM25 weight divided
by the unit's score against itself, so a passage that holds the whole unit scores 1 whatever the unit's length. Postings
are sorted by unit and cut into blocks of ``BLOCK`` postings that carry their largest impact. The index is cut into
shards of ``SHARD_WORDS`` item words on average, dealt by a hash of id and text: one shard at a time is sent to the tasks.

The queries. A passage is a window of ``2 * UNIT_WORDS`` words, moved on by ``UNIT_WORDS``: every unit that a text holds lies
whole in some window. One vectorised step passes over the windows on which no unit can reach the threshold: it sums the
impacts of the less frequent terms exactly and adds all that a unit can get from frequent ones (at most ``SHARE``). On the
others WAND moves its cursors by pivot, skipping blocks whose maxima cannot reach the threshold. All units above the threshold
are retrieved.

The check. Question and answer (the closing sentences) of a retrieved unit's item are compared with
the whole text: shares of their distinct n-grams (of up to ``NGRAM`` words) that occur in it. A row is contaminated if both shares reach
``overlap``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.text import distinct, fold_latin, ngrams, pack_rows, slices, word_hashes
from civicspark.session import materialise

UNIT_WORDS = 64
BLOCK = 16
SHARD_WORDS = 1 << 17
NGRAM = 4
ANSWER_WORDS = 8
SHARE = 0.25
K1, B = 1.2, 0.75
_TOKEN = r"[^\x20\x09-\x0D]+"


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the least number of closing sentences (or lines) with ANSWER_WORDS words, the question
    what precedes it. Where nothing would precede it, the whole text is both."""
    starts = [0, *(m.end() for m in re.finditer(r"[.!?]\s+|\n+", text))]
    for at in reversed(starts):
        if len(text[at:].split()) >= ANSWER_WORDS:
            return (text[:at], text[at:]) if text[:at].strip() else (text, text)
    return text, text


def gram_size(words: int) -> int:
    """Words per n-gram of a part: up to NGRAM, fewer in short parts, so that one changed word leaves others whole; 0 if blank."""
    return min(NGRAM, max(1, words // 3)) if words else 0


def hashes_of(texts: list[str]) -> list[np.ndarray]:
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    words, rows = word_hashes(fold_latin(np.frombuffer(b"".join(data), np.uint8)), offsets)
    return [words[a:b] for a, b in zip(rows, rows[1:])]


class Shard:
    """Postings of some units, with impacts and block maxima."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], units: int, mean_words: float):
        self.items = items
        self.unit_item: list[int] = []
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, words in enumerate(hashes_of([t for _, t in items])):
            for at in range(0, len(words), UNIT_WORDS):
                terms, tf = np.unique(words[at:at + UNIT_WORDS], return_counts=True)
                size = min(UNIT_WORDS, len(words) - at)
                idf = np.array([math.log(1 + (units - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
                weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_words))
                unit = len(self.unit_item)
                self.unit_item.append(k)
                for t, w in zip(terms.tolist(), (weight / weight.sum()).tolist(), strict=True):
                    postings.setdefault(t, []).append((unit, w))
        self.terms = np.array(sorted(postings), np.uint64)
        self.units = [[u for u, _ in postings[t]] for t in self.terms.tolist()]
        self.impacts = [[w for _, w in postings[t]] for t in self.terms.tolist()]
        self.block_max = [[max(w[i:i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.impacts]
        self.best = np.array([max(w) for w in self.impacts] or [0.0])
        self.present = np.zeros(1 << 20, bool)
        self.present[self.terms & np.uint64(len(self.present) - 1)] = True
        self._part_terms()
        self.grams = [[(n := gram_size(len(w)), distinct(ngrams(w, n))) for w in hashes_of(list(split_item(t)))] for _, t in items]

    def _part_terms(self) -> None:
        """Part the terms into frequent ones, whose impacts never sum to more than SHARE on any unit, and the others.

        ``mass`` is a unit's sum over its frequent terms; ``flat_*`` are the postings of the others, one after another.
        """
        mass = np.zeros(len(self.unit_item))
        frequent = np.zeros(len(self.terms), bool)
        for t in sorted(range(len(self.terms)), key=lambda t: -len(self.units[t])):
            more = mass.copy()
            more[self.units[t]] += self.impacts[t]
            if more.max() > SHARE:
                break
            mass, frequent[t] = more, True
        self.mass = mass
        lengths = np.array([0 if f else len(u) for f, u in zip(frequent, self.units)], np.int64)
        self.flat_from = np.cumsum(lengths) - lengths
        self.flat_length = lengths
        self.flat_units = np.array([x for f, u in zip(frequent, self.units) if not f for x in u], np.int64)
        self.flat_impacts = np.array([x for f, w in zip(frequent, self.impacts) if not f for x in w])

    def live_windows(self, window: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Windows on which some unit can reach the threshold: exact sums of its other terms, plus all its frequent ones."""
        n = self.flat_length[term]
        window, term, n = window[n > 0], term[n > 0], n[n > 0]
        if not len(term):
            return np.zeros(0, np.int64)
        at = np.arange(int(n.sum())) + np.repeat(self.flat_from[term] - (np.cumsum(n) - n), n)
        key = np.repeat(window, n) * len(self.mass) + self.flat_units[at]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(self.flat_impacts[at][order], first)
        pair = key[first]
        return np.unique(pair[sums + self.mass[pair % len(self.mass)] >= threshold - 1e-9] // len(self.mass))

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 if the index does not have it."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.present[words & np.uint64(len(self.present) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
            same = self.terms[at] == words[maybe]
            out[maybe[same]] = at[same]
        return out

    def wand(self, terms: list[int], threshold: float) -> dict[int, float]:
        """All units whose impacts on the distinct terms sum to the threshold or more."""
        found: dict[int, float] = {}
        cursors = [[self.units[t][0], 0, t] for t in terms]  # next unit, place in the postings, term
        slack = threshold - 1e-9
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.best[t]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            shallow, skip_to = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.unit_item)
            for _, at, t in cursors[:pivot + 1]:  # block maxima at the pivot unit, without moving the cursors
                at = bisect.bisect_left(self.units[t], unit, at)
                if at < len(self.units[t]):
                    block = at // BLOCK
                    shallow += self.block_max[t][block]
                    end = min((block + 1) * BLOCK, len(self.units[t]))
                    skip_to = min(skip_to, self.units[t][end - 1] + 1)
            if shallow < slack:
                target = max(unit + 1, skip_to)
            else:
                score = 0.0
                for _, at, t in cursors[:pivot + 1]:
                    at = bisect.bisect_left(self.units[t], unit, at)
                    if at < len(self.units[t]) and self.units[t][at] == unit:
                        score += self.impacts[t][at]
                if score >= slack:
                    found[unit] = score
                target = unit + 1
            moved = []
            for i, (u, at, t) in enumerate(cursors):
                if i <= pivot:
                    at = bisect.bisect_left(self.units[t], target, at)
                    if at == len(self.units[t]):
                        continue
                    u = self.units[t][at]
                moved.append([u, at, t])
            cursors = moved
        return found


def search(shard: Shard, words: np.ndarray, rows: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item number, best score, question share, answer share) of the contaminated rows of a run of texts."""
    terms = shard.lookup(words)
    hit = np.flatnonzero(terms >= 0)
    if not len(hit):
        return
    row = np.searchsorted(rows, hit, "right") - 1
    cell = (hit - rows[row]) // UNIT_WORDS
    # a cell of UNIT_WORDS words belongs to the window that starts with it and to the one that ends with it
    cells_of = np.concatenate([[0], np.cumsum(np.diff(rows) // UNIT_WORDS + 2)])
    own = cells_of[row] + cell
    window, term = np.concatenate([own, own + 1]), np.concatenate([terms[hit], terms[hit]])
    pairs = distinct(window * len(shard.terms) + term)
    window, term = np.divmod(pairs, len(shard.terms))
    live = shard.live_windows(window, term, threshold)
    begin, end = np.searchsorted(window, live), np.searchsorted(window, live, "right")
    best: dict[tuple[int, int], float] = {}
    for w, a, b in zip(live.tolist(), begin.tolist(), end.tolist(), strict=True):
        r = int(np.searchsorted(cells_of, w, "right")) - 1
        for unit, score in shard.wand(term[a:b].tolist(), threshold).items():
            key = (r, shard.unit_item[unit])
            best[key] = max(best.get(key, 0.0), score)
    texts: dict[tuple[int, int], np.ndarray] = {}
    for (r, k), score in sorted(best.items()):
        shares = []
        for n, wanted in shard.grams[k]:
            if (r, n) not in texts:
                texts[r, n] = ngrams(words[rows[r]:rows[r + 1]], n)
            shares.append(float(np.isin(wanted, texts[r, n]).mean()) if n else 1.0)
        if min(shares) >= overlap:
            yield r, k, score, shares[0], shares[1]


def shards_of(items: DataFrame) -> Iterator[Shard]:
    """The index, one bounded shard at a time. Document frequencies and lengths cover all items.

    ``items`` holds item_id and text. They are dealt to shards by a hash of both, and a shard is read alone; many equal rows meet in one
    shard, which is then larger than the average.
    """
    sized = items.withColumn("n", F.regexp_count("text", F.lit(_TOKEN))).filter("n > 0")
    total = sized.agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("n") / UNIT_WORDS)).alias("units")).first()
    if not total.n:
        return
    shards = -(-total.n // SHARD_WORDS)
    dealt = materialise(sized.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "benchmark")
    unit_terms = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("n", pa.int64())])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            words, rows = word_hashes(fold_latin(data), offsets)
            for s, a, b in zip(batch.column("shard").to_pylist(), rows, rows[1:]):
                for at in range(a, b, UNIT_WORDS):
                    found = np.unique(words[at:min(b, at + UNIT_WORDS)]).view(np.int64)
                    yield pack_rows({"shard": [s] * len(found), "term": found, "n": [1] * len(found)}, unit_terms)

    found = dealt.select("shard", "text").mapInArrow(terms, "shard long, term long, n long")
    df = materialise(found.groupBy("shard", "term").agg(F.sum("n").alias("n")), "benchmark-terms")
    everywhere = df.groupBy("term").agg(F.sum("n").alias("df"))
    for s in range(shards):
        rows = dealt.filter(F.col("shard") == s).select("item_id", "text").orderBy("item_id", "text").collect()
        counts = df.filter(F.col("shard") == s).select("term").join(everywhere, "term").collect()
        if rows:
            yield Shard([(r.item_id, r.text) for r in rows], {r.term % (1 << 64): r.df for r in counts}, total.units, total.n / total.units)


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """Pairs (doc_id, item_id) of contaminated documents, with score, question_overlap and answer_overlap.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored. NULL and blank texts match nothing; repeated
    rows and repeated items each give their own pair; NULL ids stay NULL. Without documents or items there are no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    columns = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64())])
    spark = docs.sparkSession
    out = spark.createDataFrame([], columns)
    for shard in shards_of(items):
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = sent.value
            for batch, data, offsets in slices(batches):
                words, rows = word_hashes(fold_latin(data), offsets)
                found = list(search(shard, words, rows, threshold, overlap))
                if found:
                    ids = batch.column("doc_id").to_pylist()
                    yield pack_rows({"doc_id": [ids[f[0]] for f in found], "item_id": [shard.items[f[1]][0] for f in found],
                                     "score": [f[2] for f in found], "question_overlap": [f[3] for f in found],
                                     "answer_overlap": [f[4] for f in found]}, schema)

        out = out.unionAll(docs.mapInArrow(run, columns))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns. Each shard is one pass; no row is moved."""
    spark, out = docs.sparkSession, docs
    for shard in shards_of(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches):
                words, rows = word_hashes(fold_latin(data), offsets)
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in search(sent.value, words, rows, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
