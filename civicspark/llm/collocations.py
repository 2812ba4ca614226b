"""Phrase collocations: frequent word n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass.

Words and pieces. A-Z is lower-cased; a text is split into pieces at ``BREAKS`` and those into words at blanks. Everything is per
language (NULL: ``und``). Texts are stored as bounded slices of word numbers, whose distinct n-grams and their counts are
found by sorting numbers.

1. Summaries. The n-grams of a slice (of one word to ``longest``) are dealt by a 64-bit hash of language and words to parts, as many
   as the total mass needs. A part merges the slices' counts into one Misra-Gries summary whose capacity exceeds its mass divided
   by the threshold: whenever there are more counters, the largest that has to go is subtracted from all. Each subtraction
   takes away at least capacity + 1 times its value, so no counter ever lacks as much as the threshold, and every n-gram that
   occurs that often keeps one. The slices get back one bit for each of their n-grams.
2. Counts. The slices send the words and counts of the survivors, packed, once per slice; equal words are added up
   (words, not hashes, so the counts are exact), and what stays below the threshold goes.

The table of frequent n-grams is scored by joins: a phrase with its first part and its rest at every cut, and with longer phrases.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.alignment import unsqueeze_ascending
from civicspark.llm.katz import squeeze, unsqueeze
from civicspark.llm.text import LOWER, mix64, pack_rows, release, slices, word_hashes
from civicspark.session import materialise

SLICE_BYTES = 1 << 22
PART_MASS = 1 << 23
MERGED = 1 << 20  # rows of words that are added up at a time
UNKNOWN = "und"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(BREAKS + BLANKS)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

SLICES = "slice long, langs array<string>, lang_words array<long>, words binary, lengths binary, entry_lang binary, entry_word binary, tokens binary, pieces binary"
_SLICES = pa.schema([("slice", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64())),
                     *((c, pa.binary()) for c in ("words", "lengths", "entry_lang", "entry_word", "tokens", "pieces"))])
_TEXT = zstandard.ZstdCompressor(level=3)


def _compress(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _TEXT.compress(data)


def _decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(1, int.from_bytes(data[:8], "little")))


def slice_row(number: int, langs: list[str | None], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The stored form of some texts: distinct words, distinct (language, word) entries, the entry of every word, lengths of the pieces."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAK[data])[starts] + row if len(starts) else starts  # rises with every break and every text
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]]))])
    words = array.dictionary_encode()
    names = sorted({UNKNOWN if x is None else x for x in langs})
    place = {x: k for k, x in enumerate(names)}
    of_row = np.array([place[UNKNOWN if x is None else x] for x in langs], np.int64)
    lang = of_row[row]
    entries, tokens = np.unique(lang * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    entry_lang, entry_word = np.divmod(entries, max(len(words.dictionary), 1))
    texts = words.dictionary.to_pylist()
    per_piece = np.diff(np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(piece)))
    row = {"slice": number, "langs": names, "lang_words": np.bincount(lang, minlength=len(names)).tolist(), "words": _compress(b"".join(texts)),
           "lengths": squeeze(np.array([len(t) for t in texts], np.int64)), "entry_lang": squeeze(entry_lang), "entry_word": squeeze(entry_word),
           "tokens": squeeze(tokens), "pieces": squeeze(per_piece)}
    return pack_rows({k: [v] for k, v in row.items()}, _SLICES)


class Grams:
    """The distinct n-grams of a stored slice, of one word to ``longest``, by part and hash."""

    def __init__(self, row: dict, longest: int, parts: int):
        data = np.frombuffer(_decompress(row["words"]), np.uint8)
        self.word_at = np.concatenate([[0], np.cumsum(unsqueeze(row["lengths"]))])
        self.entry_lang, self.entry_word, tokens = (unsqueeze(row[c]) for c in ("entry_lang", "entry_word", "tokens"))
        self.data, self.langs = data, row["langs"]
        hashes = word_hashes(data, self.word_at)[0]
        of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        hashes = mix64(hashes[self.entry_word] + of_lang[self.entry_lang]) if len(tokens) else np.zeros(0, np.uint64)
        pieces = unsqueeze(row["pieces"])
        left = np.repeat(np.cumsum(pieces), pieces) - np.arange(len(tokens))  # words from here to the end of the piece
        entries = max(len(self.entry_word), 1)
        #: per length: the n-gram of one word less that opens it, its last word, its hash, its count
        self.levels = []
        number, of_gram = tokens, hashes
        for n in range(1, longest + 1):
            at = np.flatnonzero(left >= n)
            if n == 1:
                opening, closing, which = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), tokens
            else:
                keys, which = np.unique(number[at] * entries + tokens[at + n - 1], return_inverse=True)
                opening, closing = np.divmod(keys, entries)
                of_gram = mix64(of_gram[opening] * _STEP + hashes[closing] + np.uint64(n))
                number = np.full(len(tokens), -1, np.int64)
                number[at] = which
            self.levels.append((opening, closing, of_gram, np.bincount(which, minlength=len(of_gram))))
        every = np.concatenate([level[2] for level in self.levels])
        part = ((every >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascends with the hash
        self.order = np.argsort(every, kind="stable")
        self.hashes, self.counts = every[self.order], np.concatenate([level[3] for level in self.levels])[self.order]
        self.cuts = np.searchsorted(part[self.order], np.arange(parts + 1))

    def phrases(self, kept: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray, np.ndarray]:
        """Language numbers, words, counts and parts of the n-grams at some ascending places, by part; those with one opening stand together."""
        firsts = np.cumsum([0, *(len(level[2]) for level in self.levels)])
        gram, part = self.order[kept], np.searchsorted(self.cuts, kept, "right") - 1
        by = np.lexsort((gram, part))
        kept, gram, part = kept[by], gram[by], part[by]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.word_at) - 1, [None, pa.py_buffer(self.word_at), pa.py_buffer(self.data)])
        langs = np.zeros(len(gram), np.int64)
        texts, places = [], []
        for n, (a, b) in enumerate(zip(firsts, firsts[1:])):
            mine = np.flatnonzero((gram >= a) & (gram < b))
            at = gram[mine] - a
            entries = []
            for k in range(n, -1, -1):
                opening, closing = self.levels[k][:2]
                entries.insert(0, closing[at])
                at = opening[at]
            langs[mine] = self.entry_lang[entries[0]]
            of = [words.take(pa.array(self.entry_word[e])) for e in entries]
            texts.append(pc.binary_join_element_wise(*of, pa.scalar(b" ", pa.large_binary())) if n else of[0])
            places.append(mine)
        back = np.argsort(np.concatenate(places), kind="stable")
        return langs, pa.concat_arrays(texts).take(pa.array(back)), self.counts[kept], part


def _packed(texts: pa.LargeBinaryArray) -> tuple[bytes, bytes]:
    """The bytes of some texts one after another, and their lengths."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return _compress(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""), squeeze(np.diff(ends))


def _unpacked(data: bytes, lengths: bytes) -> pa.LargeBinaryArray:
    ends = np.concatenate([[0], np.cumsum(unsqueeze(lengths))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(_decompress(data))])


class Summary:
    """A mergeable Misra-Gries summary of 64-bit keys. No counter falls short by more than ``error``, nor by ``mass / (capacity + 1)``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([self.counts, counts]))
        self.error += error
        if len(keys) > self.capacity:
            cut = int(np.partition(sums, len(sums) - self.capacity - 1)[len(sums) - self.capacity - 1])
            stays = sums > cut
            keys, sums = keys[stays], sums[stays] - cut
            self.error += cut
        self.keys, self.counts = keys, sums

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may occur ``threshold`` times, ascending; all that do are among them if the capacity exceeds mass / threshold."""
        return self.keys[self.counts + self.error >= threshold]


def summarise(table: pa.Table, threshold: int) -> tuple[list[dict], Summary]:
    """Rows of one part (hashes, counts, mass of a slice) merged into its summary."""
    rows = table.to_pylist()
    summary = Summary(sum(r["mass"] for r in rows) // threshold + 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, r in enumerate(rows):
        held.append((unsqueeze_ascending(r["hashes"]), unsqueeze(r["counts"])))
        if i == len(rows) - 1 or sum(len(k) for k, _ in held) >= summary.capacity:
            summary.merge(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
    return rows, summary


def frequent_phrases(docs: DataFrame, longest: int = 3, threshold: int = 10) -> tuple[DataFrame, DataFrame]:
    """All n-grams of one word to ``longest`` that occur ``threshold`` times in a language (lang, phrase, words, f), and the number of
    words of each language (lang, n). ``docs``: text, lang; other columns are ignored."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch, data, offsets in slices(batches, size=SLICE_BYTES):
            yield slice_row(number, batch.column("lang").to_pylist(), data, offsets)
            number += 1
        release()

    stored = materialise(docs.mapInArrow(run, SLICES), "phrase-slices")
    totals = stored.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    words = stored.select(F.sum(F.expr("aggregate(lang_words, 0L, (s, x) -> s + x)"))).first()[0] or 0
    parts = max(1, math.ceil(words * longest / PART_MASS))
    dealt_schema = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("mass", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, longest, parts)
                for p, (a, b) in enumerate(zip(grams.cuts, grams.cuts[1:])):
                    if a < b:
                        yield pack_rows({"part": [p], "slice": [row["slice"]], "mass": [int(grams.counts[a:b].sum())],
                                         "hashes": [squeeze(np.diff(grams.hashes[a:b], prepend=np.uint64(0)))], "counts": [squeeze(grams.counts[a:b])]}, dealt_schema)
        release()

    survived_schema = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())])

    def survive(table: pa.Table) -> pa.Table:
        rows, summary = summarise(table, threshold)
        kept = summary.survivors(threshold)
        bits = [np.packbits(np.isin(unsqueeze_ascending(r["hashes"]), kept)).tobytes() for r in rows]
        return pa.Table.from_batches([pack_rows({"slice": [r["slice"] for r in rows], "part": [r["part"] for r in rows], "bits": bits}, survived_schema)])

    dealt = stored.mapInArrow(deal, "part long, slice long, mass long, hashes binary, counts binary")
    survived = dealt.groupBy("part").applyInArrow(survive, "slice long, part long, bits binary")
    sent_schema = pa.schema([("part", pa.int64()), ("langs", pa.list_(pa.string())), ("of_lang", pa.binary()), ("phrases", pa.binary()), ("lengths", pa.binary()),
                             ("counts", pa.binary())])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            grams = Grams(row, longest, parts)
            places = []
            for r in sorted(right.to_pylist(), key=lambda r: r["part"]):
                a, b = grams.cuts[r["part"]], grams.cuts[r["part"] + 1]
                places.append(a + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(b - a))))
            lang, phrase, counts, part = grams.phrases(np.concatenate([np.zeros(0, np.int64), *places]))
            found = np.unique(part)
            for p, x, y in zip(found.tolist(), np.searchsorted(part, found).tolist(), np.searchsorted(part, found, "right").tolist()):
                texts, lengths = _packed(phrase.slice(x, y - x))
                out.append(pack_rows({"part": [p], "langs": [row["langs"]], "of_lang": [squeeze(lang[x:y])], "phrases": [texts], "lengths": [lengths],
                                      "counts": [squeeze(counts[x:y])]}, sent_schema))
        return pa.Table.from_batches(out, sent_schema)

    counted_schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        """Exact sums, words by words; no more than the distinct ones and MERGED rows are held in expanded form."""
        def added(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])

        held: list[pa.Table] = []
        for batch in table.to_batches(max_chunksize=64):
            for row in batch.to_pylist():
                lang = pa.array(row["langs"], pa.large_string()).take(pa.array(unsqueeze(row["of_lang"])))
                held.append(pa.table({"lang": lang, "phrase": _unpacked(row["phrases"], row["lengths"]), "f": unsqueeze(row["counts"])}))
                if sum(map(len, held)) > MERGED + 2 * len(held[0]):
                    held = [added(held)]
        sums = added(held)
        sums = sums.filter(pc.greater_equal(sums["f"], threshold))
        return pa.table([sums["lang"].cast(pa.string()), sums["phrase"].cast(pa.string()), sums["f"]], schema=counted_schema)

    sent = stored.groupBy("slice").cogroup(survived.groupBy("slice")).applyInArrow(send, "part long, langs array<string>, of_lang binary, phrases binary, lengths binary, counts binary")
    counted = sent.groupBy("part").applyInArrow(count, "lang string, phrase string, f long")
    return materialise(counted.withColumn("words", F.size(F.split("phrase", " "))), "phrase-counts"), totals


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, by score descending, count descending, words ascending.

    Phrases have two to ``longest`` words and occur ``threshold`` times (a). Of all cuts into two parts (occurring l and r times) the
    one with the lowest floor(10**6 a a / (l r)) counts, ties to the shortest first part. A phrase that lies inside a longer one with at
    least ``inside`` percent of its count is left out. ``docs``: text, lang; others are ignored. NULL texts are empty; a language
    without frequent phrases, or no rows at all, gives no rows. Repeated rows count one by one. Counts are below 10**16.
    """
    frequent, totals = frequent_phrases(docs, longest, threshold)
    w = F.split("phrase", " ")

    def part(start, length):
        return F.array_join(F.slice(w, start, length), " ")

    phrases = frequent.filter("words >= 2").withColumnRenamed("f", "a")
    cut = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    scored = (cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
              .withColumn("over", exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", exact["l"] * exact["r"])
              .withColumn("score", F.expr("over div under")))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    within = (phrases.filter("words >= 3").withColumn("n", F.explode(F.expr("sequence(2, words - 1)")))
              .withColumn("at", F.explode(F.expr("sequence(1, words - n + 1)"))).groupBy("lang", part(F.col("at"), F.col("n")).alias("phrase")).agg(F.max("a").alias("longer")))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
