"""Cross-tokenizer alignment: where two tokenizers cut a text at the same bytes, and which of their tokens overlap.

One text. Tokens of A (byte-level BPE) and B (sentencepiece with byte fallback) are reduced to the byte offsets at which they end.
Divide and conquer: a common end near the middle of an interval is located by bisection, both halves are treated alike, and an
interval without a common end inside is a leaf group. Every pair of tokens whose bytes overlap is a link. Many texts are
halved together, one depth after another.

A corpus. A byte-level pre-tokenizer cuts before a space, and before a line break, between two characters that are not white
space; if no entry of B's vocabulary reaches over such a place either, both tokenizers end there, so texts fall into pieces
that are encoded and aligned once and remembered. A text with other white space is one piece. Bounded slices of texts are
stored as piece numbers with the links of their distinct pieces:

1. The distinct pairs of a slice, with the number of its documents that hold them, meet by hash; the sums go back to the slices.
2. The highest count of each A id is one number per entry of A's vocabulary, and is broadcast.
3. Each slice adds the counts of its documents' links up.

No pair is sent more than once per slice, so neither a frequent pair nor a frequent id makes a hot group.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.katz import squeeze, unsqueeze
from civicspark.llm.text import distinct, mix64, pack_rows, release, slices
from civicspark.llm.tokens import PieceIds
from civicspark.session import materialise

SLICE_BYTES = 1 << 21
PART_PAIRS = 1 << 21
REMEMBERED = 250_000  # pieces; little more than twice as many are held
ODD = r"^\s|\s$| \s|\s |[\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_loaded: dict[tuple[int, int, int], PairEncoder] = {}


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Numbers of A tokens up to the end of each group, ascending.

    ``ends_a`` and ``ends_b`` are the ends of the tokens of pieces that stand one after another, ``firsts`` the first A token of each
    piece. All intervals of a depth are halved together; one is searched outwards from its middle, a step in each round.
    """
    lo, hi = firsts, np.append(firsts[1:], len(ends_a))
    step = np.zeros(len(lo), np.int64)
    leaves = []
    while len(lo):
        at = (lo + hi - 1) // 2 + (step + 1) // 2 * np.where(step % 2, 1, -1)
        inside = np.flatnonzero((at >= lo) & (at < hi - 1))
        end = ends_a[at[inside]]
        cut = np.zeros(len(lo), bool)
        cut[inside[ends_b[np.searchsorted(ends_b, end)] == end]] = True
        done = ~cut & (step >= 2 * (hi - lo - 1))
        leaves.append(hi[done])
        rest = ~cut & ~done
        half = at[cut] + 1
        lo, hi, step = (np.concatenate(x) for x in ((lo[rest], lo[cut], half), (hi[rest], half, hi[cut]), (step[rest] + 1, np.zeros(2 * len(half), np.int64))))
    return np.sort(np.concatenate([*leaves, np.zeros(0, np.int64)])).astype(np.int64)


#: A piece's groups as text, its links as bytes (A id << 32 | B id each), and the numbers of A tokens, B tokens and groups.
Aligned = tuple[str, bytes, int, int, int]


def align_pieces(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray, written: list[str]) -> list[Aligned]:
    """Alignments of pieces: ids of their tokens one after another, tokens per piece, bytes per id; ``written`` has id and mark as text."""
    ends_a, ends_b = np.cumsum(a_bytes[a]), np.cumsum(b_bytes[b])
    up_to_a = np.cumsum(n_a)
    cuts = shared_cuts(ends_a, ends_b, up_to_a - n_a)
    ends = ends_a[cuts - 1]
    cuts_b = np.searchsorted(ends_b, ends) + 1
    pieces = ends_a[up_to_a - 1]
    # A tokens of a group, then its B tokens, each with the mark that follows it
    group_a, group_b = (np.repeat(np.arange(len(cuts)), np.diff(c, prepend=0)) for c in (cuts, cuts_b))
    marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    marks_a[cuts - 1] = 1
    marks_b[cuts_b - 1] = 2 + (pieces[np.minimum(np.searchsorted(pieces, ends), len(pieces) - 1)] == ends)
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + np.concatenate([[0], cuts_b])[group_a]] = a * 4 + marks_a
    line[np.arange(len(b)) + cuts[group_b]] = b * 4 + marks_b
    groups = "".join(map(written.__getitem__, line.tolist())).split("\n")
    # tokens overlap in each stretch between two ends of either side
    stretch = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    stretch = stretch[np.diff(stretch, prepend=-1) > 0]
    links = (a[np.searchsorted(ends_a, stretch)] << 32 | b[np.searchsorted(ends_b, stretch)]).astype("<u8").tobytes()
    upto = (np.searchsorted(stretch, pieces, "right") * 8).tolist()
    n_groups = np.diff(np.searchsorted(ends, pieces, "right"), prepend=0).tolist()
    return list(zip(groups, (links[x:y] for x, y in zip([0, *upto], upto)), n_a.tolist(), n_b.tolist(), n_groups))


class PairEncoder:
    """Both tokenizers; aligns pieces and remembers those met of late."""

    def __init__(self, a_definition: str, b_model: bytes, remembered: int):
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(a_definition)
        tokenizer.encode_special_tokens = True
        self.a, self.b = PieceIds(tokenizer), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.remembered = 1 << 14
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands_for = {chr(c): c for c in printable} | {chr(256 + n): c for n, c in enumerate(sorted(set(range(256)).difference(printable)))}
        entries = {i: bytes(stands_for[c] for c in entry) for entry, i in tokenizer.get_vocab().items() if all(c in stands_for for c in entry)}
        self.a_bytes = [entries.get(i, b"") for i in range(tokenizer.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, side))) for side in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{mark}" for i in range(max(len(self.a_size), len(self.b_size))) for mark in ",|;\n"]
        self.b_space = self.b.piece_to_id("▁")
        # whether no entry reaches over a space, or a line break, from what precedes it
        self.cut_spaces = not any("▁" in p.lstrip("▁") for p in pieces)
        self.cut_lines = not any("\n" in p[1:] or p[:1] == "\n" and len(p) > 1 for p in pieces) and self.b.encode("\nx")[:1] == [self.b_space]
        self.newer: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}
        self.remembered = remembered

    def _align(self, pieces: list[str], a: list[bytes], b: list[list[int]]) -> list[Aligned | None]:
        """None where the tokens do not spell the piece."""
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        n_a //= 4
        ids_a, ids_b = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        data = [p.encode() for p in pieces]
        spelt = np.ones(len(pieces), bool)
        for ids, n, known, size in ((ids_a, n_a, self.a_bytes, self.a_size), (ids_b, n_b, self.b_bytes, self.b_size)):
            spells = list(map(known.__getitem__, ids.tolist()))
            if b"".join(spells) != b"".join(data) or (np.add.reduceat(np.append(size[ids], 0), np.cumsum(n) - n) * (n > 0) != list(map(len, data))).any():
                ends = np.cumsum(n).tolist()
                spelt &= [b"".join(spells[x:y]) == d for x, y, d in zip([0, *ends], ends, data)]
        if not spelt.all():
            ids_a, ids_b = ids_a[np.repeat(spelt, n_a)], ids_b[np.repeat(spelt, n_b)]
            n_a, n_b = n_a[spelt], n_b[spelt]
        found = align_pieces(ids_a, ids_b, n_a, n_b, self.a_size, self.b_size, self.written) if len(n_a) else []
        if len(found) == len(pieces):
            return found
        good = iter(found)
        return [next(good) if ok else None for ok in spelt.tolist()]

    def whole(self, text: str) -> Aligned | None:
        """A text that is not cut. A space precedes it: A's is written, B adds its own."""
        return self._align([" " + text], [self.a.whole(" " + text)], [self.b.encode(text, num_threads=1)])[0] if text else None

    def __call__(self, pieces: list[str]) -> list[Aligned | None]:
        """The alignment of each of the given distinct pieces: a space or line break and what follows it."""
        out: list[Aligned | None] = []
        for at in range(0, len(pieces), 1 << 14):
            if len(self.newer) > self.remembered:
                self.older, self.newer = self.newer, {}
            newer, older, part = self.newer, self.older, pieces[at:at + (1 << 14)]
            new = []
            for p in part:
                if p not in newer:
                    if p in older:
                        newer[p] = older[p]
                    else:
                        new.append(p)
            if new:
                spaced = [p[0] == " " for p in new]
                b = self.b.encode([p[1:] if s else p for p, s in zip(new, spaced)], num_threads=1)
                newer.update(zip(new, self._align(new, self.a(new), [x if s else x[1:] for x, s in zip(b, spaced)]), strict=True))
            out += map(newer.__getitem__, part)
        return out


def cut_texts(encode: PairEncoder, texts: pa.Array) -> tuple[list[Aligned | None], np.ndarray, np.ndarray]:
    """Alignments of the distinct pieces, the piece numbers of all texts one after another, and the number of pieces of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    if not encode.cut_spaces:
        odd = np.ones(n, bool)
    lines = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
    if encode.cut_lines:
        lines = pc.replace_substring_regex(lines, r"([^\s\x0B])\n([^\s\x0B])", "\\1 \n\\2")
    lists = pc.split_pattern(lines, " ")
    words = lists.flatten().dictionary_encode()
    which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    names = words.dictionary.to_pylist()
    odd_at = np.flatnonzero(odd)
    which[(np.cumsum(per_text) - per_text)[odd_at]] = len(names) + np.arange(len(odd_at))
    used = np.bincount(which, minlength=len(names))[:len(names)] > 0
    short = [w for w, u in zip(names, used.tolist()) if u and w]
    found = dict(zip(short, encode([w if w[0] == "\n" else " " + w for w in short]), strict=True))
    return [found.get(w) for w in names] + [encode.whole(t) for t in texts.take(pa.array(odd_at)).to_pylist()], which, per_text


SLICES = ("slice long, doc_ids array<long>, lengths binary, n_a binary, n_b binary, n_groups binary, digests binary, pieces binary, n_links binary, links binary, "
          "pairs binary, counts binary, n_pairs long")
_SLICES = pa.schema([("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in (
    "lengths", "n_a", "n_b", "n_groups", "digests", "pieces", "n_links", "links", "pairs", "counts")), ("n_pairs", pa.int64())])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs of the given lengths that begin at ``starts``, one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def slice_row(number: int, doc_ids: list, pieces: list[Aligned | None], which: np.ndarray, per_text: np.ndarray) -> pa.RecordBatch:
    """The stored form of some aligned texts (see ``SLICES``). Texts with a piece that the tokens do not spell have no pieces."""
    unspelt = np.array([p is None for p in pieces], bool)
    doc = np.repeat(np.arange(len(per_text)), per_text)
    wrong = np.zeros(len(per_text), bool)
    wrong[doc[unspelt[which]]] = True
    which, lengths = which[~wrong[doc]], np.where(wrong, 0, per_text)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    numbers = np.flatnonzero(np.bincount(which, minlength=len(pieces)))
    kept = [pieces[k] for k in numbers.tolist()]
    which = np.searchsorted(numbers, which)
    sizes = np.array([(n_a, n_b, n_groups, len(links) // 8) for _, links, n_a, n_b, n_groups in kept], np.int64).reshape(-1, 4)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    sums = [np.diff(np.concatenate([[0], np.cumsum(sizes[which, k])])[ends]) for k in range(3)]
    groups = [p[0] for p in kept]
    listed = which.tolist()
    digests = [hashlib.sha256(";".join([groups[k] for k in listed[a:b]]).encode()).digest() if b > a else bytes(32) for a, b in zip(ends.tolist(), ends[1:].tolist())]
    every = np.frombuffer(b"".join([p[1] for p in kept]), "<u8")
    pairs, links = np.unique(every, return_inverse=True)
    n_links = sizes[:, 3]
    # pieces of a document once, then their pairs once
    once = distinct(doc * max(len(kept), 1) + which)
    of, piece = np.divmod(once, max(len(kept), 1))
    spread = _spread((np.cumsum(n_links) - n_links)[piece], n_links[piece])
    held = distinct(np.repeat(of, n_links[piece]) * max(len(pairs), 1) + links[spread])
    counts = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
    row = {"slice": number, "doc_ids": doc_ids, "lengths": squeeze(lengths), "n_a": squeeze(sums[0]), "n_b": squeeze(sums[1]), "n_groups": squeeze(sums[2]),
           "digests": b"".join(digests), "pieces": squeeze(which), "n_links": squeeze(n_links), "links": squeeze(links),
           "pairs": squeeze(np.diff(pairs, prepend=np.uint64(0))), "counts": squeeze(counts), "n_pairs": len(pairs)}
    return pack_rows({k: [v] for k, v in row.items()}, _SLICES)


def unsqueeze_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data).view(np.uint64), dtype=np.uint64)


def _parts(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by part and value, and the first place of each part in it."""
    part = ((mix64(pairs) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_file``: a byte-level BPE of the tokenizers library, ``b_file``: a sentencepiece model; both are read on the driver. NULL and
    empty texts, and texts that the tokens do not spell, have zeros and ''. Repeated rows are documents of their own; NULL ids stay NULL.
    Very long texts are sliced alone and whole. Without rows there is no result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with open(a_file, encoding="utf-8") as f:
        a_definition = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    sent = spark.sparkContext.broadcast((a_definition, b_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(sent.value[0].encode()), zlib.crc32(sent.value[1]), REMEMBERED
        if key not in _loaded:
            _loaded[key] = PairEncoder(*sent.value, REMEMBERED)
        number = TaskContext.get().partitionId() << 32
        for batch, _, _ in slices(batches, size=SLICE_BYTES):
            yield slice_row(number, batch.column("doc_id").to_pylist(), *cut_texts(_loaded[key], batch.column("text")))
            number += 1
        release()

    stored = materialise(docs.mapInArrow(run, SLICES), "alignment-slices")
    parts = max(1, math.ceil((stored.agg(F.sum("n_pairs")).first()[0] or 0) / PART_PAIRS))
    dealt_schema = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, counts = unsqueeze_ascending(row["pairs"]), unsqueeze(row["counts"])
                order, cuts = _parts(pairs, parts)
                pairs, counts = pairs[order], counts[order]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if x < y:
                        yield pack_rows({"part": [p], "slice": [row["slice"]], "pairs": [squeeze(np.diff(pairs[x:y], prepend=np.uint64(0)))],
                                         "counts": [squeeze(counts[x:y])]}, dealt_schema)

    summed_schema = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("ids", pa.list_(pa.int32())), ("best", pa.list_(pa.int64()))])

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [unsqueeze_ascending(r["pairs"]) for r in rows]
        pairs, at = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.concatenate([unsqueeze(r["counts"]) for r in rows]))
        ids, first = np.unique(pairs >> np.uint64(32), return_index=True)
        ends = np.cumsum([0, *map(len, each)])
        part = rows[0]["part"]
        return pa.Table.from_batches([pack_rows({
            "slice": [None, *(r["slice"] for r in rows)], "part": [part] * (len(rows) + 1), "counts": [None, *(squeeze(counts[at[x:y]]) for x, y in zip(ends, ends[1:]))],
            "ids": [ids.astype(np.int32)] + [None] * len(rows), "best": [np.maximum.reduceat(counts, first)] + [None] * len(rows)}, summed_schema)])

    dealt = stored.select("slice", "pairs", "counts").mapInArrow(deal, "part long, slice long, pairs binary, counts binary")
    summed = materialise(dealt.groupBy("part").applyInArrow(add, "slice long, part long, counts binary, ids array<int>, best array<long>"), "alignment-counts")
    highest = (summed.filter("slice is null").select(F.explode(F.arrays_zip("ids", "best")).alias("x")).groupBy(F.col("x.ids").alias("id"))
               .agg(F.max("x.best").alias("best")).collect())  # at most one row per entry of A's vocabulary
    best_of = np.zeros(max([r.id for r in highest], default=0) + 1, np.int64)
    best_of[[r.id for r in highest]] = [r.best for r in highest]
    given = spark.sparkContext.broadcast(best_of)
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        pairs = unsqueeze_ascending(row["pairs"])
        counts = np.zeros(len(pairs), np.int64)
        back = sorted(right.to_pylist(), key=lambda r: r["part"])
        counts[_parts(pairs, parts)[0]] = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(r["counts"]) for r in back)])
        best = counts == given.value[(pairs >> np.uint64(32)).astype(np.int64)] if len(pairs) else counts > 0
        links, n_links = unsqueeze(row["links"]), unsqueeze(row["n_links"])
        piece_ends = np.concatenate([[0], np.cumsum(n_links)])
        ends = np.concatenate([[0], np.cumsum(unsqueeze(row["lengths"]))])
        pieces = unsqueeze(row["pieces"])
        of_docs = []
        for value in (counts, best.astype(np.int64)):
            of_piece = np.diff(np.concatenate([[0], np.cumsum(value[links])])[piece_ends])
            of_docs.append(np.diff(np.concatenate([[0], np.cumsum(of_piece[pieces])])[ends]))
        count_sum, n_best = of_docs
        n_a, n_b, n_groups = (unsqueeze(row[c]) for c in ("n_a", "n_b", "n_groups"))
        hexed = row["digests"].hex()
        digests = [hexed[64 * i:64 * i + 64] if n_a[i] else "" for i in range(len(n_a))]
        # every group of x and y tokens has x + y - 1 overlapping pairs
        return pa.Table.from_batches([pack_rows({"doc_id": row["doc_ids"], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
                                                 "n_best": n_best, "count_sum": count_sum, "groups_sha256": digests}, out)])

    kept = stored.drop("counts", "n_pairs").groupBy("slice").cogroup(summed.filter("slice is not null").select("slice", "part", "counts").groupBy("slice"))
    return kept.applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
