"""Collocations against plain counting, the summaries against their bound."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicspark.llm import collocations
from civicspark.llm.queries import ORACLES
from civicspark.plans.compare import compare, duck

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, threshold=10, inside=50, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    kept = {g: c for g, c in f.items() if len(g[1]) >= 2 and c >= threshold}
    out = []
    for (lang, w), a in kept.items():
        if any(p == lang and len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x))) and 100 * c >= inside * a for (p, x), c in kept.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rows, ranks = [], collections.Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "New", "York", "of", "and", "city", "deep", "Été", "日本", "x|y", "a\xa0b", "to"]
    out = []
    for _ in range(250):
        w = rng.choices(vocabulary, k=rng.randint(1, 30))
        out.append(("".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\x0b", " ; "]) for x in w), rng.choice(["en", "en", "fr", None, "und", ""])))
    return out + [(None, "en"), ("", None), (" \n", "en"), (None, None), ("deep sea " * 4000, "fr"), ("z" * 3000, "en")] + [("one two three four", "es")] * 10 + [("one two. three four", "es")] * 9


@pytest.mark.parametrize(("slice_bytes", "part_mass"), [(1 << 22, 1 << 23), (700, 500)])
@pytest.mark.parametrize("longest", [3, 4])
def test_collocations_against_plain_counting(spark, rows, monkeypatch, slice_bytes, part_mass, longest):
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(collocations, "PART_MASS", part_mass)
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "text string, lang string, phrase string, slice string, n string").repartition(3)
    assert found(collocations.collocations(docs, longest)) == brute(rows, longest)
    if longest == 3:
        assert found(collocations.collocations(docs, top=3)) == brute(rows, top=3)


def test_nothing_to_count(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(collocations.collocations(docs.filter(F.lit(False)))) == []
    assert found(collocations.collocations(docs.filter("length(text) < 3"))) == []


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(2)
    for trial in range(30):
        stream = rng.zipf(1.3, 5000).astype(np.uint64) % np.uint64(900)
        threshold = int(rng.integers(2, 60))
        whole = collocations.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, int(rng.integers(1, 9))):
            small = collocations.Summary(whole.capacity)
            for piece in np.array_split(part, 3):
                small.merge(*np.unique(piece, return_counts=True))
            assert len(small.keys) <= small.capacity
            whole.merge(small.keys, small.counts, small.error)
        keys, counts = np.unique(stream, return_counts=True)
        true = dict(zip(keys.tolist(), counts.tolist()))
        assert set(keys[counts >= threshold].tolist()) <= set(whole.survivors(threshold).tolist())
        assert whole.error < threshold and all(true[k] - whole.error <= c <= true[k] for k, c in zip(whole.keys.tolist(), whole.counts.tolist()))


def test_exact_scores_of_large_counts(spark):
    a, l, r = 999_999_999_999_999, 10**15, 10**15 + 7
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(*(F.col(c).cast("decimal(18,0)") for c in "alr"))
    row = df.withColumn("over", F.col("a") * F.col("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", F.col("l") * F.col("r")).select(F.expr("over div under").alias("s")).first()
    assert row.s == 10**6 * a * a // (l * r)


def test_sql_twin_on_odd_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, "text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    message = compare(collocations.collocations(spark.read.parquet(str(tmp_path / "documents.parquet"))), con, ORACLES["op12_collocations"])
    assert message.startswith("ok"), message
