"""N-gram Jaccard join: links between texts whose shingle sets are similar, by prefixes under several global token orders.

If two sets reach the threshold, they share a token among the first ``n - ceil(t n) + 1`` of each under any global order of the
tokens. All orders here put tokens of few documents first and differ in how they break ties, so a candidate must
share a prefix token under each of them.

1. One pass gives every text's set size and fingerprint; equal sets are one class from here on. Tokens held by more than
   about a hundredth of the texts (a list whose length is bounded by a hundred mean set sizes) come last in every order.
2. A second pass deals all other tokens to ranges of their hash, packed per slice of texts; the number of ranges grows with the
   tokens. A range counts the documents of its tokens and answers each slice with those that occur twice or more. Tokens of
   one text alone cannot be shared: a text with more of them than its prefix is long has no partner and is done.
3. The prefixes of the remaining sets meet token by token. A token's holders are first compared with its most central holder
   (fewest tokens before it) only; verified links form components; then only holders outside the central one's component
   meet the others of the token. So a group of near copies costs one comparison per copy, and no link between components is lost.
4. A candidate passes the bound by sizes and places of its first shared token, and the other orders' prefixes, before the sets are intersected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.columns import unused
from civicspark.llm.components import components
from civicspark.llm.text import mix64, release, shingle_sets, slices, word_hashes
from civicspark.session import materialise

RANGE_TOKENS = 1 << 21
FREQUENT = 100  # a token in more than 1 / FREQUENT of the texts is frequent
LAST = 0xFFFF  # the count of frequent tokens in the orders; others stay below
LOW = np.uint64((1 << 48) - 1)


def fingerprint(tokens: np.ndarray) -> int:
    return int(mix64(np.array([mix64(tokens).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, fp of each row, and rows (NULL, count, token) with ``frequent`` for tokens frequent in a slice.

    A column ``mark`` (long) of ``docs`` is passed on.
    """
    marked = "mark" in docs.columns
    also = [("mark", pa.int64())] if marked else []
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("frequent", pa.bool_()), *also])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            sets = shingle_sets(*word_hashes(data, offsets), n)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(np.zeros(rows, bool)),
                                              *([batch.column("mark")] if marked else [])], schema=schema)
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(3, rows / FREQUENT)
            if often.any():
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(counts[often]), pa.array(tokens[often].view(np.int64)),
                                                  pa.array(np.ones(k, bool)), *([pa.nulls(k, pa.int64())] if marked else [])], schema=schema)

    return docs.mapInArrow(run, "doc_id long, size long, fp long, frequent boolean" + (", mark long" if marked else ""))


PACKED = "key long, slice long, tokens binary, counts binary, dfs binary, fps binary, sizes binary, places binary"
_PACKED = pa.schema([("key", pa.int64()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("tokens", "counts", "dfs", "fps", "sizes", "places"))])


def _row(key: int, piece: int, **parts: np.ndarray) -> pa.RecordBatch:
    values = [key, piece, *(parts[f.name].tobytes() if f.name in parts else None for f in list(_PACKED)[2:])]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PACKED, strict=True)], schema=_PACKED)


def _all(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    out = pa.Table.from_batches(batches, schema)
    release()
    return out


def _split48(tokens: np.ndarray) -> np.ndarray:
    """The low 48 bits of tokens as 6 bytes each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _join48(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def deal_tokens(docs: DataFrame, n: int, ranges: int, frequent) -> DataFrame:
    """Packed rows: one per slice and range of tokens (key 0 .. ranges - 1) and one per slice with its texts (key below 0).

    A row lists its tokens text by text, with the number of tokens of each text. Equal sets of a slice are dealt once. A
    text's row holds fingerprints, sizes and its frequent tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for _, data, offsets in slices(batches):
            sets = {}
            for s in shingle_sets(*word_hashes(data, offsets), n):
                if len(s):
                    sets.setdefault(fingerprint(s), s)
            if not sets:
                continue
            piece += 1
            sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
            tokens = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets)), sizes)
            often = np.isin(tokens, frequent.value)
            key = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            key[often] = ranges
            order = np.argsort(key, kind="stable")  # keeps texts in order inside a range
            tokens, owner = tokens[order], owner[order]
            cuts = np.searchsorted(key[order], np.arange(ranges + 2))
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if a < b:
                    yield _row(r, piece, tokens=_split48(tokens[a:b]), counts=np.bincount(owner[a:b], minlength=len(sets)).astype("<u4"))
            a, b = cuts[ranges], cuts[ranges + 1]
            yield _row(-piece, piece, tokens=tokens[a:b].astype("<u8"), counts=np.bincount(owner[a:b], minlength=len(sets)).astype("<u4"),
                       fps=np.fromiter(sets, np.int64, len(sets)).astype("<i8"), sizes=sizes.astype("<u4"))

    return docs.mapInArrow(run, PACKED)


def count_range(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each row of a range, its tokens that occur in two texts or more, with their counts. Rows of texts pass."""
    rows = table.to_pylist()
    if rows[0]["key"] < 0:
        yield from table.to_batches()
        return
    parts = [_join48(r["tokens"]) for r in rows]
    tokens = np.concatenate(parts)
    order = np.argsort(tokens)
    ranked = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    runs = np.diff(np.append(starts, len(ranked)))
    df = np.empty(len(tokens), np.int64)
    df[order] = np.repeat(runs, runs)
    at = 0
    for row, part in zip(rows, parts, strict=True):
        mine = df[at:at + len(part)]
        at += len(part)
        shared = mine > 1
        if shared.any():
            counts = np.frombuffer(row["counts"], "<u4")
            owner = np.repeat(np.arange(len(counts)), counts)[shared]
            yield _row(row["key"], row["slice"], tokens=_split48(part[shared]), dfs=np.minimum(mine[shared], LAST - 1).astype("<u2"),
                       places=np.cumsum(np.bincount(owner, minlength=len(counts))).astype("<u4"))


SETS = "fp long, size int, own int, tokens array<long>, first array<long>, second array<long>, third array<long>"
_SETS = pa.schema([("fp", pa.int64()), ("size", pa.int32()), ("own", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("tokens", "first", "second", "third"))])


def gather_sets(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """The texts of a slice that may have a partner: size, tokens held alone (``own``), shared tokens, and the prefixes."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["key"] < 0)
    fps, sizes = np.frombuffer(head["fps"], "<i8"), np.frombuffer(head["sizes"], "<u4").astype(np.int64)
    counts = np.frombuffer(head["counts"], "<u4")
    tokens, dfs = [np.frombuffer(head["tokens"], "<u8")], [np.full(int(counts.sum()), LAST, np.int64)]
    owners = [np.repeat(np.arange(len(fps)), counts)]
    for r in rows:
        if r["key"] >= 0:
            places = np.frombuffer(r["places"], "<u4").astype(np.int64)
            tokens.append(_join48(r["tokens"]) | (np.uint64(r["key"]) << np.uint64(48)))
            dfs.append(np.frombuffer(r["dfs"], "<u2").astype(np.int64))
            owners.append(np.repeat(np.arange(len(fps)), np.diff(places, prepend=0)))
    tokens, dfs, owner = np.concatenate(tokens), np.concatenate(dfs), np.concatenate(owners)
    shared = np.bincount(owner, minlength=len(fps))
    own = sizes - shared
    prefix = sizes - (sizes * percent + 99) // 100 + 1
    live = own < prefix
    keep = live[owner]
    tokens, dfs, owner = tokens[keep], dfs[keep], owner[keep]
    wide = np.frexp(dfs.astype(float))[1]  # counts to the power of two
    orders = [np.lexsort((tokens, dfs, owner)), np.lexsort((mix64(tokens + np.uint64(1)), wide, owner)), np.lexsort((mix64(tokens + np.uint64(2)), wide, owner))]
    texts = np.flatnonzero(live)
    if not len(texts):
        return
    begin = np.searchsorted(owner[orders[0]], texts)
    lists = []
    for k, order in enumerate([orders[0], *orders]):
        length = shared[texts] if k == 0 else prefix[texts] - own[texts]
        offsets = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens[order][at].view(np.int64))))
    yield pa.RecordBatch.from_arrays([pa.array(fps[texts]), pa.array(sizes[texts].astype(np.int32)), pa.array(own[texts].astype(np.int32)), *lists], schema=_SETS)


def _may_link(x: tuple[Column, Column], y: tuple[Column, Column], percent: int) -> Column:
    """Whether sets of these (size, place) can reach the threshold if the token at those places is the first they share.

    None of the ``place`` tokens before it is shared. A pair need only pass at its first shared token: it meets there.
    """
    most = F.least(x[0] - x[1], y[0] - y[1])
    return 100 * most >= percent * (x[0] + y[0] - most)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under the other orders and whose sets reach the threshold."""
    sides = [sets.select(F.col("fp").alias(k), F.col("size").alias(f"{k}_size"), *(F.col(c).alias(f"{k}_{c}") for c in ("tokens", "second", "third"))) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    both = both.filter(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.filter(100 * shared >= percent * (F.col("a_size") + F.col("b_size") - shared)).select("a", "b")


def similar_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Labels (node, label) of the components of linked sets. ``sets`` has one row per class (see SETS)."""
    held = sets.select("fp", "size", "own", F.posexplode("first").alias("at", "token"))
    held = held.select("token", "fp", "size", (F.col("own") + F.col("at")).alias("place"))
    centre = held.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct((F.col("place") / F.col("size")).alias("share"), F.col("fp").alias("b"),
                                                                               F.col("size").alias("b_size"), F.col("place").alias("b_place"))).alias("centre"))
    centre = centre.filter("n > 1").select("token", "centre.b", "centre.b_size", "centre.b_place")
    held = materialise(held.join(centre, "token"), "held")
    fits = _may_link((F.col("size"), F.col("place")), (F.col("b_size"), F.col("b_place")), percent)
    stars = held.filter((F.col("fp") != F.col("b")) & fits).select(F.col("fp").alias("a"), "b").distinct()
    links = materialise(verify(stars, sets, percent), "links")
    labels = components(links)
    known = labels.withColumnRenamed("node", "of")
    named = held.join(known, F.col("fp") == F.col("of"), "left").select("token", "fp", "size", "place", "b", F.coalesce("label", "fp").alias("label"))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    named = named.join(hubs, F.col("b") == F.col("hub"), "left").withColumn("hub_label", F.coalesce("hub_label", "b"))
    named = materialise(named.select("token", "fp", "size", "place", "label", (F.col("label") != F.col("hub_label")).alias("outside")), "named")
    x = named.filter("outside").select("token", F.col("fp").alias("a"), F.col("size").alias("a_size"), F.col("place").alias("a_place"), F.col("label").alias("a_label"))
    y = named.select("token", F.col("fp").alias("b"), F.col("size").alias("b_size"), F.col("place").alias("b_place"), F.col("label").alias("b_label"), F.col("outside").alias("b_outside"))
    fits = _may_link((F.col("a_size"), F.col("a_place")), (F.col("b_size"), F.col("b_place")), percent)
    once = ~F.col("b_outside") | (F.col("a") < F.col("b"))
    rest = x.join(y, "token").filter((F.col("a_label") != F.col("b_label")) & once & fits)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = verify(rest, sets, percent)
    return components(links.unionAll(more))


def similar_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: rows are linked if 100 * intersection >= percent * union of their sets.

    ``docs``: doc_id, text; other columns are ignored. A set holds the distinct shingles of n words (of lower-cased A-Z); a text of
    fewer words is one shingle; NULL and blank texts have none and are linked with nothing. component_id is the least doc_id
    reachable by links, the row's own included (NULL ids count only where nothing else is there). Repeated rows are equal
    sets, hence one component. Empty input gives no rows.
    """
    rows, classes = linked_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, percent, F.min("doc_id"))
    if classes is None:
        return rows.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = classes.join(least, "label").select(F.col("fp").alias("of"), "component_id")
    out = rows.join(found, (F.col("fp") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_rows(docs: DataFrame, n: int, percent: int, least: Column) -> tuple[DataFrame, DataFrame | None]:
    """The rows (doc_id, n_shingles, fp, and ``mark`` if given) and the classes of equal sets: fp, ``least`` of its rows, label of its component.

    There are no classes if no row has a shingle.
    """
    spark = docs.sparkSession
    signed = materialise(signatures(docs, n), "signatures")
    rows = signed.filter("not frequent").select("doc_id", F.col("size").alias("n_shingles"), "fp", *(["mark"] if "mark" in docs.columns else []))
    docs = docs.select("doc_id", "text")
    total, texts = rows.agg(F.sum("n_shingles"), F.count("*")).first()
    if not total:
        return rows, None
    often = signed.filter("frequent").groupBy("fp").agg(F.sum("size").alias("n")).filter(F.col("n") >= texts / FREQUENT).select("fp")
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.fp for r in often.collect()], np.int64).view(np.uint64)))
    ranges = max(1, math.ceil(total / RANGE_TOKENS))
    dealt = deal_tokens(docs, n, ranges, frequent)
    counted = dealt.groupBy("key").applyInArrow(lambda t: _all(count_range(t), _PACKED), PACKED)
    sets = counted.groupBy("slice").applyInArrow(lambda t: _all(gather_sets(t, percent), _SETS), SETS)
    rest = [F.first(c).alias(c) for c in ("size", "own", "tokens", "first", "second", "third")]
    sets = materialise(sets.groupBy("fp").agg(*rest), "sets")
    labels = similar_sets(sets, percent)
    classes = rows.filter("n_shingles > 0").groupBy("fp").agg(least.alias("least"))
    classes = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    return rows, materialise(classes, "classes")


def one_per_group(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, with all columns, and every row without a shingle (NULL and blank texts).

    It is the row of the least doc_id (a NULL id only if the component has no other), then of the least hash of the text; rows equal in
    both are of one component, and any one of them stays. Ids need not be unique.
    """
    text = F.col("text").cast("string")
    mark, of = unused(docs, "mark_of_text"), [unused(docs, c) for c in ("kept_id", "kept_mark")]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("mark"))
    _, classes = linked_rows(given, n, percent, F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "mark")))
    if classes is None:
        return docs
    keep = classes.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(of[0]), F.col("least.mark").alias(of[1]))
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.filter(~blank).withColumn(mark, F.xxhash64(text))
    kept = marked.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(of[0])) & (F.col(mark) == F.col(of[1])), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns).unionAll(docs.filter(blank))
