"""The record reader against Python's csv reader on whole files, with files cut into many splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from civicspark.sources import charsets, files, records
from civicspark.streaming.ingest import ingest


@pytest.fixture
def tiny_splits(spark):
    """Splits of some 200 bytes, so that records and fields run over them."""
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole(text, header=True, **dialect):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), **dialect) if r]
    head, body = (rows[0], rows[1:]) if header else (None, rows)
    return head, body


def padded(head, body):
    return [tuple((r[i] or None) if i < len(r) else None for i in range(len(head))) for r in body]


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple(x or "" for x in r))


def test_automaton_agrees_with_the_csv_reader():
    automaton, rng = records.Automaton(",", '"'), random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice(['"', ",", "a", '""', "\n", 'b"', '","']) for _ in range(rng.randint(0, 12)))
        state = False
        for line in s.split("\n"):
            state = automaton.end(line, state)
        assert state == (list(csv.reader(io.StringIO(s + "\nMARK\n", newline="")))[-1] != ["MARK"])


@pytest.mark.parametrize("seed", [1, 2])
def test_records_over_lines_and_splits(spark, tiny_splits, tmp_path, seed):
    rng = random.Random(seed)

    def field():
        raw = "".join(rng.choice(["x", "yy", " ", "é", "1"]) for _ in range(rng.randint(0, 12)))
        kind = rng.random()
        if kind < 0.25:
            return '"' + raw + rng.choice(["\n", "\n\n", ",", '""', "\n,\n"]) + raw + '"'
        return raw.strip() + (' 5" ' if kind > 0.95 else "")

    for name in "ab":
        lines = [",".join(field() for _ in range(rng.choice([3, 3, 3, 3, 2, 5]))) for _ in range(30)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["id,name,note", *lines]) + "\n", newline="")
    got = records.read_records(spark, str(tmp_path), filename="file").collect()
    assert records.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    for name in "ab":
        text = (tmp_path / f"{name}.csv").read_text()
        head, body = whole(text)
        mine = [r for r in got if r.file.endswith(f"{name}.csv")]
        assert sorted((tuple(r[c] for c in head) for r in mine), key=repr) == sorted(padded(head, body), key=repr)
        assert sorted(len(r) for r in body if len(r) != 3) == sorted(whole(r._broken, False)[1][0].__len__() for r in mine if r._broken is not None)


def test_stray_quotes_lose_no_row(spark, tiny_splits, tmp_path):
    lines = [f"{i},name {i},plain" for i in range(60)]
    lines[50] = '50,"never closed,plain'
    (tmp_path / "a.csv").write_text("id,name,note\n" + "\n".join(lines) + "\n")
    got = {r.id: r for r in records.read_records(spark, str(tmp_path)).collect()}
    assert sorted(map(int, got)) == list(range(60))
    assert got["50"]._broken == lines[50] and [i for i, r in got.items() if r._broken] == ["50"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    again = {r.id: r for r in records.read_records(spark, str(tmp_path)).collect()}
    assert again == got


def test_headers_by_name_order_and_group(spark, tmp_path):
    for i, (head, row) in enumerate([("a,b", "1,2"), ("b,a", "2,1"), ("﻿a,c", "1,3"), ('"a", b', '1,2'), ("a,b", "")]):
        (tmp_path / f"{i}.csv").write_text(f"{head}\n{row}\n")
    want = [("1", "2", None), ("1", "2", None), ("1", "2", None), ("1", None, "3")]
    for told in (1 << 18, 1):
        got = records.records(records.lines_of(spark, str(tmp_path)), told=told)
        assert got.columns == ["a", "b", "c", "_broken"]
        assert sorted(rows_of(got, ["a", "b", "c"]), key=repr) == sorted(want, key=repr)
    assert sorted(rows_of(records.read_records(spark, str(tmp_path), ["b"]), ["b"]), key=repr) == sorted([("2",), ("2",), ("2",), (None,)], key=repr)


def test_plain_quotes_blank_lines_and_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1|"x\n\n2|y"\n', newline="")
    got = records.read_records(spark, str(tmp_path / "a.csv"), ["id", "name"], "|", None, header=False)
    assert rows_of(got, ["id", "name", "_broken"]) == [("1", '"x', None), ("2", 'y"', None)]
    (tmp_path / "b.csv").write_bytes(b'id,name\r\n1,"two\r\nlines"\r\n\r\n2,last')
    assert rows_of(records.read_records(spark, str(tmp_path / "b.csv")), ["id", "name", "_broken"]) == [("1", "two\r\nlines", None), ("2", "last", None)]
    (tmp_path / "c.csv").write_text("")
    assert records.read_records(spark, str(tmp_path / "c.csv"), ["id"]).collect() == []


def test_charsets_of_lines(spark, tmp_path):
    lines = {"windows-1252": ["Zoë Ångström", "Müller straße", "São João, Curaçao", "“curly” café", "El Niño está aquí"],
             "windows-1250": ["Łukasz Żółć", "Příliš žluťoučký kůň", "Gdańsk i Łódź", "Škoda žije v městě"],
             "ISO-8859-5": ["Привет из Москвы", "Улица 5, дом 7"], "utf-8": ["日本 Zoë", "plain"]}
    (tmp_path / "a.csv").write_bytes(b"id,name\n" + b"".join(f'{c} {i},"{t}"\n'.encode(c) for c, ts in lines.items() for i, t in enumerate(ts)))
    got = {r.id: r.name for r in files.read_mixed_encoding(spark, str(tmp_path)).collect()}
    assert got == {f"{c} {i}": t for c, ts in lines.items() for i, t in enumerate(ts)}
    odd = spark.createDataFrame([(bytes(range(0x80, 0x100)),), (None,), (b"",)], "v binary")
    assert odd.filter(charsets.decoded(F.col("v")).isNull()).count() == 1
    for c in charsets.CHARSETS:
        back = odd.select(charsets.encode_single_byte(charsets.decode_single_byte(F.col("v"), c), c).alias("b")).first().b
        assert bytes(back) == bytes(range(0x80, 0x100))


def test_ingest_takes_each_file_once(spark, tiny_splits, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text('id,name\n1,"two\nlines"\n2,short,long\n')
    args = (spark, str(source), str(tmp_path / "out"), str(tmp_path / "marks"), ["id", "name"])
    assert rows_of(ingest(*args), ["id", "name", "_broken"]) == [("1", "two\nlines", None), ("2", "short", "2,short,long")]
    (source / "b.csv").write_text("name,id\nlater,3\n")
    assert rows_of(ingest(*args), ["id", "name"]) == [("1", "two\nlines"), ("2", "short"), ("3", "later")]
    assert ingest(*args).count() == 3


def test_newest_stamp_reads_no_content(spark, tmp_path):
    for day in ("2021-01-01", "2021-03-01", "2021-02-01"):
        (tmp_path / f"vf_{day}.csv").write_text(f"id\n{day}\n")
    read = lambda: files.read_delimited(spark, str(tmp_path), ["id"])
    assert [r.id for r in files.latest_snapshot(spark, str(tmp_path), read, r"vf_([0-9-]+)").collect()] == ["2021-03-01"]
    assert files.latest_snapshot(spark, str(tmp_path), read, r"other_([0-9]+)").collect() == []
