"""Delimited records that may run over several lines, from files that are read in splits.

A quoted field may hold line breaks, so whether a split begins inside a field depends on all that precedes it in the file. Two
passes over the lines, no shuffle:

1. Each split is read from both states (outside, inside a quoted field) at once, which gives the state it ends in from either. The
   first split of a file also gives its header. One small row per split comes out; composing them along each file, an ordered fold
   over a file's splits, gives the state every split begins in.
2. Each split gives the records that lie whole in it, by the csv reader. A record that is cut by the end of a split comes out as a
   fragment of either side; fragments of one record meet by (file, split) and are read again.

A quoted field that is not closed within the next whole split, or by the end of the file, is taken for a stray quote: its
lines are records of their own, so a fragment never outgrows two splits. Values are mapped by the header of their own file.
A record whose number of fields is not its header's is kept, with its text in the ``broken`` column. No row is lost.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.session import materialise
from civicspark.sources.charsets import CHARSETS, decoded

TOLD = 1 << 18  # entries (splits that begin inside a field, files of another header) that are sent to the tasks at once


class Automaton:
    """Which state a line ends in: inside a quoted field (True) or not, from either state. Quotes count at the beginning of a field only."""

    def __init__(self, sep: str, quote: str):
        s, q = re.escape(sep), re.escape(quote)
        field = f"(?:{q}(?:[^{q}]++|{q}{q})*+{q}[^{s}]*+|[^{q}{s}][^{s}]*+|)"
        self.quote = quote
        self.outside = re.compile(f"{field}(?:{s}{field})*+", re.DOTALL)
        self.inside = re.compile(f"(?:[^{q}]++|{q}{q})*+{q}[^{s}]*+(?:{s}{field})*+", re.DOTALL)
        self.held = re.compile(f"(?:[^{q}]++|{q}{q})*+", re.DOTALL)

    def end(self, line: str, state: bool) -> bool:
        if self.quote not in line:
            return state
        return not (self.inside if state else self.outside).fullmatch(line)

    def closes(self, line: str) -> bool:
        """Whether the line, begun inside a field, comes out of it at some place."""
        return self.quote in line and not self.held.fullmatch(line)


def _dialect(sep: str, quote: str | None) -> dict:
    return {"delimiter": sep, "quoting": csv.QUOTE_NONE} if quote is None else {"delimiter": sep, "quotechar": quote, "doublequote": True}


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, start, lines) of each split of a task, in order; the lines must be used up before the next split."""
    current: list = []

    def rows() -> Iterator[tuple[str, int, str]]:
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist())

    source = rows()

    def lines(key: tuple[str, int], first: str) -> Iterator[str]:
        yield first
        for f, s, v in source:
            if (f, s) != key:
                current.append((f, s, v))
                return
            yield v

    for f, s, v in source:
        current.append((f, s, v))
        while current:
            f, s, v = current.pop()
            split = lines((f, s), v)
            yield f, s, split
            for _ in split:
                pass


def _records(lines: Iterator[str], dialect: dict) -> Iterator[tuple[list[str], str]]:
    """(fields, text) of the records of some lines; blank lines are skipped."""
    taken: list[str] = []

    def remember() -> Iterator[str]:
        for line in lines:
            taken.append(line)
            yield line + "\n"

    for fields in csv.reader(remember(), **dialect):
        text = "\n".join(taken)
        taken.clear()
        if fields:
            yield fields, text


def lines_of(spark: SparkSession, path: str | list[str], charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """Lines of files, decoded one by one: file, start (of the split that a line belongs to), value. A line ends at a line feed."""
    return decoded_lines(spark.read.option("lineSep", "\n").text(path), charsets)


def decoded_lines(text: DataFrame, charsets: Sequence[str]) -> DataFrame:
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       decoded(F.col("value").cast("binary"), charsets).alias("value"))


SPLIT = "file string, start long, end_outside boolean, end_inside boolean, closes boolean, header array<string>"


def survey_splits(lines: DataFrame, sep: str = ",", quote: str | None = '"', header: bool = True) -> DataFrame:
    """One row per split: end states from either state, whether a field open at its beginning is closed in it, and the file's header."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end_outside", pa.bool_()), ("end_inside", pa.bool_()), ("closes", pa.bool_()),
                        ("header", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        automaton = Automaton(sep, quote) if quote is not None else None
        for file, start, split in _splits(batches):
            outside, inside, closes, head = False, True, False, None
            opening: list[str] = []
            for line in split:
                if header and start == 0 and head is None:  # the header ends with the first record
                    if line.strip() or opening:
                        opening.append(line)
                        if automaton is None or not automaton.end("\n".join(opening), False):
                            head = next(csv.reader([x + "\n" for x in opening], **_dialect(sep, quote)))
                if automaton is not None and automaton.quote in line:
                    closes = closes or automaton.closes(line)
                    outside, inside = automaton.end(line, outside), automaton.end(line, inside)
            if head is not None:
                head = [c.lstrip("﻿").strip() for c in head]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, start, outside, inside, closes, head), schema, strict=True)], schema=schema)

    return lines.mapInArrow(run, SPLIT)


def split_states(surveyed: DataFrame) -> DataFrame:
    """file, start, and the state the split begins in (``inside``), by a fold over the splits of each file in order."""
    steps = F.array_sort(F.collect_list(F.struct("start", "end_outside", F.when(F.col("closes"), F.col("end_inside")).otherwise(F.col("end_outside")).alias("end_inside"),
                                                 "closes")))
    folded = F.aggregate("steps", F.expr("named_struct('state', false, 'out', cast(array() as array<struct<start: bigint, inside: boolean>>))"),
                         lambda acc, s: F.struct(F.when(acc["state"], s["end_inside"]).otherwise(s["end_outside"]).alias("state"),
                                                 F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), (acc["state"] & s["closes"]).alias("inside")))).alias("out")))
    files = surveyed.groupBy("file").agg(steps.alias("steps"))
    return files.select("file", F.explode(folded["out"]).alias("x")).select("file", "x.start", "x.inside")


class Layout:
    """What the tasks must know of some files: splits that begin inside a field, headers, and the files that have not the usual header."""

    def __init__(self, headers: list[list[str]], inside: set[tuple[str, int]], unusual: dict[str, int]):
        self.headers, self.inside, self.unusual = headers, inside, unusual


def parse(lines: DataFrame, layout: Layout, cols: Sequence[str], sep: str, quote: str | None, header: bool, broken: str) -> DataFrame:
    """Rows (file, *cols, broken) of whole records, and fragments: rows with a ``fragment`` text at ``start``, ``opens`` or not."""
    sent = lines.sparkSession.sparkContext.broadcast(layout)
    names = [*cols, broken]
    schema = pa.schema([("file", pa.string()), *((c, pa.string()) for c in names), ("start", pa.int64()), ("opens", pa.bool_()), ("fragment", pa.string())])
    ddl = ", ".join(["file string", *(f"`{c}` string" for c in names), "start long, opens boolean, fragment string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        known, automaton = sent.value, Automaton(sep, quote) if quote is not None else None
        out: list[tuple] = []
        number = {c.lower(): k for k, c in enumerate(cols)}

        def row(file: str, places: list[int], fields: list[str], text: str) -> tuple:
            values: list[str | None] = [None] * len(cols)
            for k, v in zip(places, fields):
                if k >= 0:
                    values[k] = v or None
            return (file, *values, text if len(fields) != len(places) else None, None, None, None)

        def give() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for file, start, split in _splits(batches):
            head = known.headers[known.unusual.get(file, 0)]
            places = [number.get(c.lower(), -1) for c in head]
            if automaton is not None and (file, start) in known.inside:  # the rest of a record of the split before
                rest = []
                for line in split:
                    rest.append(line)
                    if not automaton.end(line, True):
                        break
                out.append((file, *[None] * len(names), start, False, "\n".join(rest)))
            skip = header and start == 0
            open_record: list[str] = []

            def whole(split=split, open_record=open_record) -> Iterator[str]:
                """Lines of whole records; what is open at the end stays in ``open_record``."""
                state = False
                for line in split:
                    if automaton is None:
                        yield line
                        continue
                    state = automaton.end(line, state)
                    open_record.append(line)
                    if not state:
                        yield from open_record
                        open_record.clear()

            for fields, text in _records(whole(), _dialect(sep, quote)):
                if skip:
                    skip = False
                    continue
                out.append(row(file, places, fields, text))
                if len(out) >= 4096:
                    yield give()
            if open_record:
                out.append((file, *[None] * len(names), start, True, "\n".join(open_record)))
            if out:
                yield give()

    return lines.mapInArrow(run, ddl)


def _joined_fragments(parsed: DataFrame, layout: Layout, cols: Sequence[str], sep: str, quote: str, broken: str) -> DataFrame:
    """Records put together from an opening fragment and the closing one of the next split; lines of one that is never closed."""
    sent = parsed.sparkSession.sparkContext.broadcast(layout)
    pieces = parsed.filter("fragment is not null").select("file", "start", "opens", "fragment")
    # the number of openings up to here names the record; a file has at most two fragments per split
    ordered = F.array_sort(F.collect_list(F.struct("start", "opens", "fragment")))
    files = pieces.groupBy("file").agg(ordered.alias("pieces"))
    schema = pa.schema([("file", pa.string()), *((c, pa.string()) for c in [*cols, broken])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        known, number, automaton = sent.value, {c.lower(): k for k, c in enumerate(cols)}, Automaton(sep, quote)
        for batch in batches:
            for r in batch.to_pylist():
                places = [number.get(c.lower(), -1) for c in known.headers[known.unusual.get(r["file"], 0)]]
                texts: list[list[str]] = []
                for p in r["pieces"]:
                    if p["opens"] or not texts:
                        texts.append([])
                    texts[-1].append(p["fragment"])
                out = []
                for text in map("\n".join, texts):
                    stray = automaton.end(text, False)
                    for part in text.split("\n") if stray else [text]:
                        fields = next(csv.reader((x + "\n" for x in part.split("\n")), **_dialect(sep, quote)), [])
                        if fields:
                            values: list[str | None] = [None] * len(cols)
                            for k, v in zip(places, fields):
                                if k >= 0:
                                    values[k] = v or None
                            out.append((r["file"], *values, part if len(fields) != len(places) or stray and automaton.end(part, False) else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)

    return files.mapInArrow(run, ", ".join(["file string", *(f"`{c}` string" for c in [*cols, broken])]))


def records(lines: DataFrame, cols: Sequence[str] | None = None, sep: str = ",", quote: str | None = '"', header: bool = True,
            broken: str = "_broken", filename: str | None = None, told: int = TOLD) -> DataFrame:
    """Records of ``lines`` (see ``lines_of``) as text columns, and ``broken``: the text of records with too few or too many fields.

    Columns are mapped by name, in any case, from each file's header: missing ones are NULL, and without ``cols`` all headers' columns come out, those of the
    first files first. ``header=False`` needs ``cols``, in the files' order. ``quote=None`` takes quotes as data: every line is a record.
    Empty fields are NULL, blank lines are skipped. ``filename`` names a column for the file.
    """
    spark = lines.sparkSession
    surveyed = materialise(survey_splits(lines, sep, quote, header), "splits") if header or quote is not None else None
    headers: list[list[str]] = [list(cols or [])]
    kinds = []
    if header:
        kinds = (surveyed.filter("header is not null").groupBy("header").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first"))
                 .orderBy(F.desc("files"), "first").collect())  # one row per distinct header
        headers = [list(k.header) for k in kinds] or headers
        if cols is None:
            seen: dict[str, str] = {}
            for kind in sorted(kinds, key=lambda k: k.first):
                for c in kind.header:
                    seen.setdefault(c.lower(), c)
            cols = list(seen.values())
    if cols is None:
        raise ValueError("no header and no column names")
    entries = []
    if surveyed is not None:
        if quote is not None:
            entries.append(split_states(surveyed).filter("inside").select("file", "start", F.lit(-1).alias("header")))
        for k, kind in enumerate(kinds[1:], 1):
            entries.append(surveyed.filter(F.col("header") == F.array(*[F.lit(c) for c in kind.header])).select("file", F.lit(-1).cast("long").alias("start"), F.lit(k).alias("header")))
    told_of = None
    for e in entries:
        told_of = e if told_of is None else told_of.unionAll(e)
    told_of = materialise(told_of, "told") if told_of is not None else None
    count = told_of.count() if told_of is not None else 0
    groups = max(1, -(-count // told))  # more files than one task should know of are read group by group
    out = None
    for g in range(groups):
        mine = lines if groups == 1 else lines.filter(F.pmod(F.xxhash64("file"), F.lit(groups)) == g)
        rows = []
        if told_of is not None:
            rows = (told_of if groups == 1 else told_of.filter(F.pmod(F.xxhash64("file"), F.lit(groups)) == g)).collect()
        layout = Layout(headers, {(r.file, r.start) for r in rows if r.header < 0}, {r.file: r.header for r in rows if r.header > 0})
        parsed = parse(mine, layout, cols, sep, quote, header, broken)
        if quote is not None:
            fragments = _joined_fragments(parsed, layout, cols, sep, quote, broken)
            part = parsed.filter("fragment is null").select("file", *cols, broken).unionAll(fragments)
        else:
            part = parsed.select("file", *cols, broken)
        out = part if out is None else out.unionAll(part)
    return out.select(*cols, broken, *([F.col("file").alias(filename)] if filename else []))


def read_records(spark: SparkSession, path: str | list[str], cols: Sequence[str] | None = None, sep: str = ",", quote: str | None = '"', header: bool = True,
                 broken: str = "_broken", filename: str | None = None, charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """Delimited files of any layout, charset (line by line) and size: see ``records``. One file is read by as many tasks as it has splits."""
    return records(lines_of(spark, path, charsets), cols, sep, quote, header, broken, filename)
