"""Token counts under a unigram piece model, by dynamic programming shared along a trie of pre-tokens.

The pieces are those of a public vocabulary file. A piece's score follows from its rank by a rule: ``-ln(rank + SHIFT)``, less a
constant for every piece used, so that fewer and earlier pieces win (Zipf's law with offset; no model is trained).

A pre-token is a word after ``PREFIX``. The best score of a prefix of a pre-token depends on that prefix alone; so the distinct
pre-tokens of a slice of texts are put in a trie and the forward scores are computed once per trie node, that is once per
distinct prefix. The node where a pre-token ends stores its token count. A trie holds the pre-tokens of one bounded slice and
is dropped after it, so memory does not grow with the corpus and no distinct words are shuffled. Beyond ``DEPTH`` characters a
pre-token has no nodes: its scores go on from the last ``longest`` ones, which are all that they depend on, so an unbroken text of
many megabytes takes no more memory than itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.text import slices, word_bounds

PREFIX = "▁"
SHIFT = 2.7
PER_PIECE = 4.0
CHARS = 0x110000
TRIE_BYTES = 1 << 24
DEPTH = 1024


class Pieces:
    """Scores of the pieces; bytes of characters outside the vocabulary fall back to byte pieces."""

    def __init__(self, pieces: list[str]):
        self.score = {p: -math.log(rank + SHIFT) - PER_PIECE for rank, p in reversed(list(enumerate(pieces)))}
        self.byte_score = -math.log(len(pieces) + SHIFT) - PER_PIECE
        self.longest = max(map(len, pieces), default=1)


class Trie:
    """Nodes are numbered; ``best`` and ``count`` hold each prefix's best score and its number of tokens."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.child: dict[int, int] = {}  # node * CHARS + character -> node
        self.best = [0.0]
        self.count = [0]

    def _forward(self, word: str, end: int, tops: list[float], tokens: list[int], base: int) -> tuple[float, int]:
        """Best score and its number of tokens of the first ``end`` characters; ``tops`` and ``tokens`` hold those of prefixes from ``base`` on."""
        score, c = self.pieces.score, word[end - 1]
        size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        # the fallback: each byte of the character is a token
        top, n = tops[end - 1 - base] + size * self.pieces.byte_score, tokens[end - 1 - base] + size
        for begin in range(max(0, end - self.pieces.longest), end):
            s = score.get(word[begin:end])
            if s is not None:
                s += tops[begin - base]
                if s > top or (s == top and tokens[begin - base] + 1 < n):
                    top, n = s, tokens[begin - base] + 1
        return top, n

    def insert(self, word: str) -> int:
        """The number of tokens of ``word``; new nodes are scored, known prefixes are not scored again."""
        child, best, count = self.child, self.best, self.count
        node, tops, tokens, base = 0, [0.0], [0], 0
        for end, c in enumerate(word, 1):
            if end <= DEPTH:
                edge = node * CHARS + ord(c)
                node = child.get(edge, -1)
                if node < 0:
                    top, n = self._forward(word, end, tops, tokens, base)
                    node = child[edge] = len(best)
                    best.append(top)
                    count.append(n)
                top, n = best[node], count[node]
            else:
                top, n = self._forward(word, end, tops, tokens, base)
                if len(tops) > DEPTH + self.pieces.longest:
                    base += len(tops) - self.pieces.longest
                    del tops[:-self.pieces.longest], tokens[:-self.pieces.longest]
            tops.append(top)
            tokens.append(n)
        return tokens[-1]


def load_pieces(model_file: str) -> list[str]:
    """Pieces of a sentencepiece model in rank order, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in ids]


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and n_bytes of every row of ``docs`` (doc_id, text; other columns are ignored).

    NULL and blank texts have no tokens. Repeated rows are counted one by one. The vocabulary (a bounded file) is sent to the tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(sent.value)
        for batch, data, offsets in slices(batches, size=TRIE_BYTES):
            starts, ends, rows = word_bounds(data, offsets)
            cuts = np.empty(2 * len(starts), np.int64)  # words and the gaps between them, as one string column on the same bytes
            cuts[0::2], cuts[1::2] = starts, ends
            pieces_and_gaps = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            words = pieces_and_gaps.take(pa.array(np.arange(0, len(pieces_and_gaps), 2))).dictionary_encode() if len(cuts) else None
            counts = np.zeros(0, np.int64)
            if words is not None:
                trie = Trie(model)
                distinct = [PREFIX + w.decode("utf-8", "replace") for w in words.dictionary.to_pylist()]
                tokens = np.fromiter(map(trie.insert, distinct), np.int64, len(distinct))
                counts = tokens[words.indices.to_numpy(zero_copy_only=False)]
            sums = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(rows)), pa.array(np.diff(sums[rows])),
                                              pa.array(np.diff(offsets))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_bytes long")
