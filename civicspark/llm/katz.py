"""Katz backoff: Good-Turing discounted counts of words and word pairs with exactly normalised backoff weights.

The model. Tokens are the lower-cased words of a text and one end; the end also stands before the first word. For counts up to
``TOP`` the Good-Turing discount is Katz's, larger counts are not discounted; every distribution keeps half a count back, so
some mass is always left:

* ``P(w) = d(c) c / (N + 0.5)`` for words seen in training; all unseen words together are one event with the mass left.
* ``P(w | h) = d(c) c(h, w) / (c(h) + 0.5)`` for pairs seen, else ``a(h) P(w)`` where ``a(h)`` is the mass left by the pairs of h
  over the mass that P gives to words not seen after h. After a word not seen in training, ``P(w | h) = P(w)``.

The job. Texts are turned into slices of word numbers with a dictionary of hashes, written once.

1. Dictionaries meet by ranges of the word hash: training counts are summed, words get dense ids, frequent ones small ids
   (rank in the range times the ranges, plus the range); each slice gets ids and counts of its words back.
2. Each slice sums its base scores and deals its distinct pairs to ranges of the history; pairs of a history with more than
   1 / HOT of all training tokens are dealt by both words. A range table holds, per range, the counts of counts, the
   statistics of its histories and, per text, what does not depend on the discounts.
3. The counts of counts of all ranges give the discounts (six numbers), the ranges' shares of the at most HOT hot histories are
   added up, and one more pass over the range table resolves backoff weights and scores per text.

Only numbers per range, and the hot histories, reach the driver. The number of ranges grows with the tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.text import mix64, slices, word_hashes
from civicspark.session import materialise, scratch_path

TOP = 5
HOT = 200
SLICE_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 21
PARTS_DOCS = 1 << 22
FINE = float(1 << 30)  # sums of logarithms, none positive, are stored in these parts
END = np.uint64(0x5EED0E9D5EED0E9D)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, lowest byte first."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([used]) + len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(planes[:used].tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, used * n)), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.int64)


def _range_of(mixed: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _schema(kinds: dict[str, str]) -> tuple[str, pa.Schema]:
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return ", ".join(f"{k} {v}" for k, v in kinds.items()), pa.schema([(k, types[v]) for k, v in kinds.items()])


def _row(schema: pa.Schema, **parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([parts.get(f.name)], f.type) for f in schema], schema=schema)


SLICES, _SLICES = _schema({"slice": "long", "doc_ids": "array<long>", "held": "binary", "lengths": "binary", "tokens": "binary", "end": "long", "hashes": "binary", "counts": "binary"})
WORDS, _WORDS = _schema({"range": "long", "slice": "long", "hashes": "binary", "counts": "binary"})
IDS, _IDS = _schema({"range": "long", "slice": "long", "ids": "binary", "counts": "binary", "stats": "array<long>"})
PAIRS, _PAIRS = _schema({"range": "long", "slice": "long", "n_docs": "long", "h": "binary", "h_count": "binary", "words": "binary", "word_counts": "binary", "w": "binary",
                         "n": "binary", "n_train": "binary", "docs": "binary", "doc_ids": "array<long>", "held": "binary", "lengths": "binary",
                         "known": "binary", "base": "binary"})
TABLE, _TABLE = _schema({"range": "long", "slice": "long", "doc_ids": "array<long>", "held": "binary", "lengths": "binary", "known": "binary", "base": "binary",
                         "slices": "array<long>", "n_docs": "array<long>", "sums": "binary", "classes": "binary", "unseen_doc": "binary", "unseen_h": "binary",
                         "h": "binary", "h_count": "binary", "h_classes": "binary", "h_more": "binary", "h_lower": "binary", "stats": "array<long>"})
PARTS, _PARTS = _schema({"slice": "long", "doc_ids": "array<long>", "held": "binary", "lengths": "binary", "known": "binary", "base": "binary", "part": "binary"})


def sliced(docs: DataFrame) -> DataFrame:
    """Texts as slices of about SLICE_TOKENS tokens: numbers into the slice's distinct words. ``docs``: doc_id, text, held.

    The words of a slice are in order of ``mix64`` of their hash, so that those of a range are neighbours, whatever the ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []

        def emit() -> pa.RecordBatch:
            ids, held, lengths, words = ([x for part in kept for x in part[k]] if k == 0 else np.concatenate([part[k] for part in kept]) for k in range(4))
            hashes, tokens = np.unique(mix64(words), return_inverse=True)
            train = np.repeat(~held, lengths)
            counts = np.bincount(tokens[train], minlength=len(hashes))
            kept.clear()
            return _row(_SLICES, slice=number, doc_ids=ids, held=held.tobytes(), lengths=squeeze(lengths), tokens=squeeze(tokens), end=int(np.searchsorted(hashes, mix64(np.array([END]))[0])), hashes=hashes.astype("<u8").tobytes(),
                        counts=squeeze(counts))

        for batch, data, offsets in slices(batches):
            words, rows = word_hashes(data, offsets)
            lengths = np.diff(rows) + 1
            stream = np.full(len(words) + len(lengths), END, np.uint64)
            inside = np.ones(len(stream), bool)
            inside[np.cumsum(lengths) - 1] = False
            stream[inside] = words
            kept.append((batch.column("doc_id").to_pylist(), batch.column("held").to_numpy(zero_copy_only=False).astype(bool), lengths, stream))
            if sum(len(k[3]) for k in kept) >= SLICE_TOKENS:
                number += 1
                yield emit()
        if kept:
            number += 1
            yield emit()

    return docs.mapInArrow(run, SLICES)


def count_words(found: DataFrame, ranges: int) -> DataFrame:
    """Ids and training counts of every slice's words, per range of the hash, and a row of statistics per range."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], "<u8"), unsqueeze(row["counts"])
                cuts = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))
                for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        yield _row(_WORDS, range=r, slice=row["slice"], hashes=hashes[a:b].tobytes(), counts=squeeze(counts[a:b]))

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]["range"]
        parts = [np.frombuffer(row["hashes"], "<u8") for row in rows]
        words, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unsqueeze(row["counts"]) for row in rows]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -counts))] = np.arange(len(words))
        ids = np.where(counts > 0, rank * ranges + r + 1, 0)
        of_counts = np.bincount(counts[(counts > 0) & (counts <= TOP + 1)], minlength=TOP + 2)[1:]
        out = [_row(_IDS, range=r, stats=[int(counts.sum()), int((counts > 0).sum()), *of_counts.tolist()])]
        at = 0
        for row, part in zip(rows, parts, strict=True):
            mine = inverse[at:at + len(part)]
            at += len(part)
            out.append(_row(_IDS, range=r, slice=row["slice"], ids=squeeze(ids[mine]), counts=squeeze(counts[mine])))
        return pa.Table.from_batches(out, _IDS)

    return found.select("slice", "hashes", "counts").mapInArrow(deal, WORDS).groupBy("range").applyInArrow(count, IDS)


def discounts(of_counts: list[int]) -> np.ndarray:
    """Katz's discount of counts 1 .. TOP from the numbers of events that occur 1 .. TOP + 1 times; in (0, 1], never rising past 1.

    Where Good-Turing has no valid value (an empty class, or a value outside (0, 1)) the count keeps ``(c - 0.5) / c``.
    """
    n = [0.0, *map(float, of_counts)]
    out = np.ones(TOP + 1)
    past = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for c in range(1, TOP + 1):
        value = ((c + 1) * n[c + 1] / (c * n[c]) - past) / (1 - past) if n[c] and past < 1 else 0.0
        out[c] = value if 0 < value < 1 else (c - 0.5) / c
    return out


class Words:
    """Word probabilities from training counts."""

    def __init__(self, total: int, distinct: int, of_counts: list[int]):
        self.total, self.distinct = total, distinct
        self.discount = discounts(of_counts)
        small = sum(self.discount[c] * c * n for c, n in enumerate(of_counts[:TOP], 1))
        rest = total - sum(c * n for c, n in enumerate(of_counts[:TOP], 1))
        self.unseen = 1 - (small + rest) / (total + 0.5)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        kept = counts * np.where(counts <= TOP, self.discount[np.minimum(counts, TOP)], 1.0)
        return np.where(counts > 0, kept / (self.total + 0.5), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def deal_pairs(left: pa.Table, right: pa.Table, words: Words, ranges: int) -> pa.Table:
    """A slice's base scores, and its distinct pairs (history, word) by range with the texts that hold them."""
    row = left.to_pylist()[0]
    parts = sorted(right.to_pylist(), key=lambda r: r["range"])
    ids, counts = (np.concatenate([unsqueeze(part[c]) for part in parts]) for c in ("ids", "counts"))
    tokens, lengths = unsqueeze(row["tokens"]), unsqueeze(row["lengths"])
    held = np.frombuffer(row["held"], bool)
    n_docs = len(lengths)
    doc = np.repeat(np.arange(n_docs), lengths)
    base = np.bincount(doc, words.base(counts)[tokens], n_docs)
    known = np.bincount(doc, counts[tokens] > 0, n_docs)
    out = [_row(_PAIRS, range=-row["slice"], slice=row["slice"], n_docs=n_docs, doc_ids=row["doc_ids"], held=row["held"], lengths=row["lengths"],
                known=squeeze(known.astype(np.int64)), base=base.astype("<f8").tobytes())]
    before = np.concatenate([[row["end"]], tokens[:-1]])
    # distinct pairs of word numbers, then their range
    pair, which = np.unique(before * len(ids) + tokens, return_inverse=True)
    h, w = np.divmod(pair, len(ids))
    split = np.where(counts[h] * HOT > words.total, ids[w], 0).astype(np.uint64)
    of = _range_of(mix64(ids[h].astype(np.uint64) + mix64(split)), ranges)
    by_range = np.argsort(of, kind="stable")
    place = np.empty(len(pair), np.int64)
    place[by_range] = np.arange(len(pair))
    which = place[which]
    h, w, of = h[by_range], w[by_range], of[by_range]
    order = np.argsort(which, kind="stable")
    docs = doc[order]
    n = np.bincount(which, minlength=len(pair))
    n_train = np.bincount(which, ~held[doc], len(pair)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    cuts = np.searchsorted(of, np.arange(ranges + 1))
    for r in range(ranges):
        a, b = cuts[r], cuts[r + 1]
        if a < b:
            own, own_first, own_at = np.unique(ids[w[a:b]], return_index=True, return_inverse=True)
            out.append(_row(_PAIRS, range=r, slice=row["slice"], n_docs=n_docs, h=squeeze(ids[h[a:b]]), h_count=squeeze(counts[h[a:b]]), words=squeeze(own),
                            word_counts=squeeze(counts[w[a:b]][own_first]), w=squeeze(own_at), n=squeeze(n[a:b]), n_train=squeeze(n_train[a:b]), docs=squeeze(docs[ends[a]:ends[b]])))
    return pa.Table.from_batches(out, _PAIRS)


def count_pairs(table: pa.Table, words: Words) -> pa.Table:
    """The range table's row of a range (see the module's text); rows of texts pass."""
    rows = table.to_pylist()
    if rows[0]["range"] < 0:
        return pa.Table.from_batches([_row(_TABLE, **{k: r[k] for k in ("range", "slice", "doc_ids", "held", "lengths", "known", "base")}) for r in rows], _TABLE)

    def every(name: str) -> np.ndarray:
        return np.concatenate([unsqueeze(r[name]) for r in rows])

    h, n = every("h"), every("n")
    at = [unsqueeze(r["w"]) for r in rows]
    w, w_count = (np.concatenate([unsqueeze(r[name])[k] for r, k in zip(rows, at, strict=True)]) for name in ("words", "word_counts"))
    hs, h_first, h_at = np.unique(h, return_index=True, return_inverse=True)
    ws, w_at = np.unique(w, return_inverse=True)
    pairs, first, at = np.unique(h_at * len(ws) + w_at, return_index=True, return_inverse=True)
    c = np.bincount(at, every("n_train"), len(pairs)).astype(np.int64)
    h_count, lower = every("h_count")[h_first], words.probability(w_count[first])
    h_of = h_at[first]
    seen = (c > 0) & (hs[h_of] > 0)
    c_class = np.where(seen & (c <= TOP), c, 0)
    # statistics of the histories: numbers of words after it seen 1 .. TOP times, counts of the others, word mass of all seen
    h_classes = np.bincount(h_of * (TOP + 1) + c_class, minlength=len(hs) * (TOP + 1)).reshape(len(hs), TOP + 1)[:, 1:]
    h_more = np.bincount(h_of, np.where(seen & (c > TOP), c, 0), len(hs)).astype(np.int64)
    h_lower = np.bincount(h_of, np.where(seen, lower, 0.0), len(hs))
    value = np.where(seen, np.log10(np.maximum(c, 1)) - np.log10(h_count[h_of] + 0.5), np.log10(lower))
    starts = np.cumsum([0, *(r["n_docs"] for r in rows)])
    doc = every("docs")
    doc += np.repeat(starts[:-1], [int(unsqueeze(r["n"]).sum()) for r in rows])
    event = np.repeat(at, n)
    sums = np.bincount(doc, value[event], starts[-1])
    classes = np.bincount(doc * (TOP + 1) + c_class[event], minlength=starts[-1] * (TOP + 1)).reshape(-1, TOP + 1)[:, 1:]
    back = ~seen[event] & (hs[h_of[event]] > 0)
    hot = h_count * HOT > words.total  # their statistics are always kept: other ranges have shares of them
    used = np.union1d(h_of[event[back]], np.flatnonzero(hot & (hs > 0)))
    unseen_h = np.searchsorted(used, h_of[event[back]])
    of_counts = np.bincount(c[seen & (c <= TOP + 1)], minlength=TOP + 2)[1:]
    return pa.Table.from_batches([_row(
        _TABLE, range=rows[0]["range"], slices=[r["slice"] for r in rows], n_docs=[r["n_docs"] for r in rows], sums=squeeze(np.rint(-sums * FINE).astype(np.int64)),
        classes=squeeze(classes.reshape(-1)), unseen_doc=squeeze(doc[back]), unseen_h=squeeze(unseen_h), h=squeeze(hs[used]), h_count=squeeze(h_count[used]),
        h_classes=squeeze(h_classes[used].reshape(-1)), h_more=squeeze(h_more[used]), h_lower=h_lower[used].astype("<f8").tobytes(), stats=of_counts.tolist())], _TABLE)


def backoff(h_count: np.ndarray, classes: np.ndarray, more: np.ndarray, lower: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """log10 of the backoff weight: mass left by the pairs of a history over the word mass of what was not seen after it."""
    kept = (classes @ (discount[1:] * np.arange(1, TOP + 1)) + more) / (h_count + 0.5)
    return np.log10(1 - kept) - np.log10(1 - lower)


def _hot_histories(table: DataFrame, total: int) -> DataFrame:
    """id, count, classes and masses of a range's shares of hot histories: at most HOT rows per range, HOT in all once added up."""
    names = ", ".join(f"c{k} long" for k in range(1, TOP + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count = unsqueeze(row["h_count"])
                hot = count * HOT > total
                classes = unsqueeze(row["h_classes"]).reshape(-1, TOP)[hot]
                arrays = [unsqueeze(row["h"])[hot], count[hot], unsqueeze(row["h_more"])[hot], np.frombuffer(row["h_lower"], "<f8")[hot], *classes.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays],
                                                 names=["h", "h_count", "more", "lower", *(f"c{k}" for k in range(1, TOP + 1))])

    rows = table.filter("range >= 0").select("h", "h_count", "h_classes", "h_more", "h_lower")
    found = rows.mapInArrow(run, f"h long, h_count long, more long, lower double, {names}")
    return found.groupBy("h").agg(F.first("h_count").alias("h_count"), *(F.sum(c).alias(c) for c in ("more", "lower", *(f"c{k}" for k in range(1, TOP + 1)))))


def score(docs: DataFrame, held: Column, store: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text; others ignored).

    Rows where ``held`` (a condition on doc_id) is true are scored but not learned from. NULL and blank texts are one end. Repeated
    rows count and are scored one by one. Scores are log10 probabilities of whole texts; base_score is that of words with half
    a count added. Without training rows every token is the one unseen event, with probability 1. Empty input gives no
    rows. ``store`` is a path for the range table; by default it is written to the shared folder.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    spark = docs.sparkSession
    found = sliced(docs)
    found.write.option("compression", "uncompressed").parquet(path := scratch_path(spark, "katz-slices"))
    found = spark.read.schema(found.schema).parquet(path)
    size = found.select(F.sum(F.octet_length("hashes"))).first()[0]
    word_ranges = max(1, math.ceil((size or 0) / 8 / RANGE_TOKENS * 4))
    ids = materialise(count_words(found, word_ranges), "katz-words")
    stats = ids.filter("stats is not null").select(*(F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(TOP + 3))).first()
    total, distinct, *of_counts = (int(x or 0) for x in stats)
    words = Words(total, distinct, of_counts)
    tokens = found.select(F.sum(F.octet_length("tokens"))).first()[0] or 0
    ranges = max(1, math.ceil(tokens / RANGE_TOKENS))
    sent = spark.sparkContext.broadcast(words)
    dealt = (found.drop("hashes", "counts").groupBy("slice").cogroup(ids.filter("stats is null").groupBy("slice"))
             .applyInArrow(lambda a, b: deal_pairs(a, b, sent.value, ranges), PAIRS))
    table = dealt.groupBy("range").applyInArrow(lambda t: count_pairs(t, sent.value), TABLE)
    table.write.parquet(store := store or scratch_path(spark, "katz-ranges"))
    table = spark.read.schema(table.schema).parquet(store)
    pair_counts = table.filter("range >= 0").select(*(F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(TOP + 1))).first()
    discount = discounts([int(x or 0) for x in pair_counts])
    hot = {r.h: float(backoff(np.array([r.h_count]), np.array([[r[f"c{k}"] for k in range(1, TOP + 1)]]), np.array([r.more]), np.array([r.lower]), discount)[0])
           for r in _hot_histories(table, total).collect()}
    weights = spark.sparkContext.broadcast((discount, hot))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        discount, hot = weights.value
        sums: dict[int, np.ndarray] = {}  # of the rows of this task, given on before they grow past PARTS_DOCS texts

        def give() -> Iterator[pa.RecordBatch]:
            for k, part in sums.items():
                yield _row(_PARTS, slice=k, part=part.astype("<f8").tobytes())
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] < 0:
                    yield _row(_PARTS, **{f.name: row.get(f.name) for f in _PARTS})
                    continue
                h = unsqueeze(row["h"])
                weight = backoff(unsqueeze(row["h_count"]), unsqueeze(row["h_classes"]).reshape(-1, TOP), unsqueeze(row["h_more"]),
                                 np.minimum(np.frombuffer(row["h_lower"], "<f8"), 1 - 1e-15), discount)
                for i in np.flatnonzero(np.isin(h, list(hot))):
                    weight[i] = hot[int(h[i])]
                part = unsqueeze(row["sums"]) / -FINE + unsqueeze(row["classes"]).reshape(-1, TOP) @ np.log10(discount[1:])
                part = part + np.bincount(unsqueeze(row["unseen_doc"]), weight[unsqueeze(row["unseen_h"])], len(part))
                ends = np.cumsum([0, *row["n_docs"]])
                for k, a, b in zip(row["slices"], ends, ends[1:]):
                    sums[k] = sums[k] + part[a:b] if k in sums else part[a:b].copy()
                if sum(map(len, sums.values())) > PARTS_DOCS:
                    yield from give()
        yield from give()

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])

    def add(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        head = next(r for r in rows if r["part"] is None)
        parts = np.zeros(len(head["doc_ids"]))
        for r in sorted(r["part"] for r in rows if r["part"] is not None):  # one order of adding, so reruns agree
            parts += np.frombuffer(r, "<f8")
        return pa.table([pa.array(head["doc_ids"], pa.int64()), pa.array(np.frombuffer(head["held"], bool)), pa.array(unsqueeze(head["lengths"])),
                         pa.array(unsqueeze(head["known"])), pa.array(np.full(len(parts), total)), pa.array(np.frombuffer(head["base"], "<f8")),
                         pa.array(parts)], schema=out)

    return (table.mapInArrow(resolve, PARTS).groupBy("slice")
            .applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
