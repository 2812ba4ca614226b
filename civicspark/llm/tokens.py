"""Token-ID output: whole texts encoded and written as fixed-width bit-packed blocks, and read back.

File format: a Parquet table with one row per block, in document order inside each shard.

* ``shard``, ``block``: place of the block; shards and blocks ascend with doc_id (NULL ids first, ties by text).
* ``first`` / ``n_ids``: ids of the shard before the block, ids in the block.
* ``doc_ids``, ``offsets``: the documents of the block and where each begins in it (one more offset than documents).
* ``bits``, ``payload``: width of an id and the packed ids (see ``bitpack``).

A block holds whole documents and closes at ``BLOCK_IDS`` ids. Since ids have one width, ids ``a .. b`` of a block are at
a known place: a document is read alone through the offsets, without unpacking what precedes it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.llm.bitpack import pack, unpack, width
from civicspark.llm.text import pack_rows, release
from civicspark.session import scratch_path

BLOCK_IDS = 1 << 16
RUN_BYTES = 1 << 23
PIECES = 4096
REMEMBERED = 600_000  # about 120 MB of a worker for each half that is full
CLOSING = "!\"#$%&)*+,-./:;=>?@\\]^_`|}~"
ODD = r"^ | $| \s|\s |[\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLOCKS = "shard int, block int, first long, n_ids long, doc_ids array<long>, offsets array<long>, bits int, payload binary"

_loaded: dict[tuple[int, bool], PieceIds] = {}


def piece_ids(definition: str, special_as_text: bool = True) -> PieceIds:
    """The encoder of a tokenizer's definition, loaded once per worker.

    Strings of special tokens in a text are ordinary text, or, without ``special_as_text``, what the library makes of them: their ids.
    """
    from tokenizers import Tokenizer

    key = zlib.crc32(definition.encode()), special_as_text
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = special_as_text
        _loaded[key] = PieceIds(tokenizer)
    return _loaded[key]


class PieceIds:
    """Ids of pieces of text, as little-endian unsigned 32-bit bytes; remembers the pieces met of late.

    At most twice ``remembered`` pieces are held, but for those of one run: when the newer half is full it becomes the older half.
    Pieces without a tab are joined by tabs and encoded together: a lone tab before other text is cut off by the
    pre-tokenizer and is one id, which no other text yields. The others are encoded one by one.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.remembered = REMEMBERED
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tab = self._encode("\t")[0]
        #: Texts that hold one of these are encoded whole.
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (t.special and tokenizer.encode_special_tokens)]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        joined = [p for p in pieces if p and "\t" not in p and not p[-1].isspace()]
        for at in range(0, len(joined), PIECES):
            part = joined[at:at + PIECES]
            ids = self._encode("\t".join(part))
            stops = np.append(np.flatnonzero(ids == self.tab), len(ids))
            if len(stops) != len(part):
                raise ValueError("this tokenizer does not cut at tabs")
            data, ends = ids.tobytes(), (stops * 4).tolist()
            self.newer.update(zip(part, map(data.__getitem__, map(slice, [0, *(e + 4 for e in ends[:-1])], ends)), strict=True))
        for p in set(pieces).difference(joined):
            self.newer[p] = self._encode(p).tobytes()

    def whole(self, text: str) -> bytes:
        return self._encode(text).tobytes()

    def __call__(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of the given distinct pieces.

        The pre-tokenizer always cuts between a letter or digit and closing punctuation: so a new piece that ends in
        punctuation is its stem and its ending, each encoded once.
        """
        if len(self.newer) > self.remembered:
            self.older, self.newer = self.newer, {}
        newer, older = self.newer, self.older
        for at in range(0, len(pieces), self.remembered):
            new: dict[str, None] = {}
            composed = []
            for p in pieces[at:at + self.remembered]:
                if p in newer:
                    continue
                if p in older:
                    newer[p] = older[p]
                    continue
                stem = p.rstrip(CLOSING)
                if len(stem) < len(p) and stem[-1:].isalnum():
                    composed.append((p, stem, p[len(stem):]))
                    for part in composed[-1][1:]:
                        if part in older:
                            newer[part] = older[part]
                        elif part not in newer:
                            new[part] = None
                else:
                    new[p] = None
            self._learn(list(new))
            for p, stem, ending in composed:
                newer[p] = newer[stem] + newer[ending]
        return [newer[p] for p in pieces]


def encode_texts(encode: PieceIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text.

    A byte-level pre-tokenizer always cuts before a space, and before a line break, that stands between two characters which
    are not white space. Texts are cut there, each distinct piece is encoded once, and the pieces' ids are strung
    together. A text in which a space touches other white space, or that holds an added token, is encoded as one piece, so the
    ids are always those of the whole text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    for content in encode.added:
        odd = odd | pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
    lines = pc.replace_substring_regex(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), r"([^\s\x0B])\n([^\s\x0B])", "\\1 \n\\2")
    lists = pc.split_pattern(lines, " ")
    pieces = lists.flatten().dictionary_encode()
    which = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(per_text)[:-1]]) if n else np.zeros(0, np.int64)
    is_first = np.zeros(len(which), bool)
    is_first[firsts] = True
    words = pieces.dictionary.to_pylist()
    heads, head_of = np.unique(which[is_first], return_inverse=True)
    # piece numbers: words with their space, then openings of texts, then odd texts as a whole
    which = which.copy()
    which[is_first] = len(words) + head_of
    odd_at = np.flatnonzero(odd)
    which[firsts[odd_at]] = len(words) + len(heads) + np.arange(len(odd_at))
    source = [w if w[:1] == "\n" else " " + w for w in words] + [words[h] for h in heads] + texts.take(pa.array(odd_at)).to_pylist()
    used = np.flatnonzero(np.bincount(which, minlength=len(source)))
    short = used[used < len(source) - len(odd_at)]
    ids = encode([source[k] for k in short.tolist()]) + [encode.whole(source[k]) for k in used[len(short):].tolist()]
    lengths = np.zeros(len(source), np.int64)
    lengths[used] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    begins = np.cumsum(lengths) - lengths
    take = lengths[which]
    ends = np.cumsum(take)
    n = int(ends[-1]) if len(ends) else 0
    narrow = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    at = np.arange(n, dtype=narrow)
    at += np.repeat((begins[which] - (ends - take)).astype(narrow), take)
    ids = flat[at]
    sums = np.concatenate([[0], ends])
    return ids, sums[np.cumsum(per_text)] - sums[firsts]


def _runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``run_bytes`` of text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, done = 0, 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(sizes, done + run_bytes, "right")))
            yield batch.slice(i, j - i)
            i, done = j, int(sizes[j - 1])


def _encode_blocks(tokenizer_json, bits: int, end_id: int, remembered: int, run_bytes: int, special_as_text: bool) -> Callable:
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("bits", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        encode = piece_ids(tokenizer_json.value, special_as_text)
        encode.remembered = remembered
        release()
        for batch in _runs(batches, run_bytes):
            ids, counts = encode_texts(encode, batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts + 1)])
            with_end = np.full(int(offsets[-1]), end_id, np.uint32)
            keep = np.ones(len(with_end), bool)
            keep[offsets[1:] - 1] = False
            with_end[keep] = ids
            doc_ids = batch.column("doc_id").to_pylist()
            i = 0
            while i < len(doc_ids):
                j = min(len(doc_ids), max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_IDS, "left"))))
                a, b = int(offsets[i]), int(offsets[j])
                yield pack_rows({"shard": [shard], "block": [block], "first": [first], "n_ids": [b - a], "doc_ids": [doc_ids[i:j]],
                                 "offsets": [(offsets[i:j + 1] - a).tolist()], "bits": [bits], "payload": [pack(with_end[a:b], bits)]}, schema)
                block, first, i = block + 1, first + b - a, j
        release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, remembered: int = REMEMBERED, run_bytes: int = RUN_BYTES,
                 special_as_text: bool = True) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write the token table to ``path``.

    NULL texts are empty: such a document is its end id alone. Repeated ids are documents of their own. The tokenizer's
    definition is read on the driver and sent to the tasks; only texts are shuffled, by ranges of doc_id. ``remembered`` bounds the
    pieces a worker remembers, ``run_bytes`` the text it encodes at once: less takes less memory and more time, the ids are the same. ``special_as_text``: see ``piece_ids``.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    bits = width(max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    run = _encode_blocks(spark.sparkContext.broadcast(definition), bits, end_id, remembered, run_bytes, special_as_text)
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The token table with ``start``: ids of all documents before the block. One row per shard meets in the window."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy(F.col("shard").alias("of")).agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return blocks.join(F.broadcast(shards), F.col("shard") == F.col("of")).withColumn("start", F.col("shard_start") + F.col("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token table: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                at = row["offsets"]
                yield pack_rows({"doc_id": row["doc_ids"], "start": [row["start"] + a for a in at[:-1]],
                                 "n_tokens": [b - a for a, b in zip(at, at[1:])],
                                 "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]}, out)

    blocks = read_blocks(spark, path).select("start", "n_ids", "doc_ids", "offsets", "bits", "payload")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of one document (one list for each row with that id)."""
    found = spark.read.schema(BLOCKS).parquet(path).filter(F.array_contains("doc_ids", doc_id)).toLocalIterator()
    return [unpack(r.payload, r.bits, a, b).tolist() for r in found for d, a, b in zip(r.doc_ids, r.offsets, r.offsets[1:]) if d == doc_id]


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None, remembered: int = REMEMBERED,
             run_bytes: int = RUN_BYTES, special_as_text: bool = True) -> DataFrame:
    """Write the token table (to a fresh shared folder unless ``path`` is given) and return what it holds per document."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, end_id, remembered, run_bytes, special_as_text)
    return read_documents(docs.sparkSession, path)
