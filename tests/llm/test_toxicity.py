"""Toxicity: the index against all cosines, the query against a plain version, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicspark.llm import toxicity
from civicspark.llm.langid import fold_of
from civicspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def random_model(rng, n=400, terms=30):
    idf = rng.uniform(1, 6, terms)
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False))
        vectors.append((t.astype(np.int64), rng.integers(1, 4, len(t)).astype(np.int64)))
    labels = rng.integers(0, 2, n)
    return idf, vectors, labels, toxicity.Examples(idf, vectors, labels, list(range(n)), np.array([3.0, 1.0]))


def dense(idf, terms, tf):
    v = np.zeros(len(idf))
    v[terms] = (1 + np.log(tf)) * idf[terms]
    return v / max(math.sqrt((v * v).sum()), 1e-300)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_nearest_equals_comparing_all(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(block)
    idf, vectors, labels, model = random_model(rng)
    full = np.array([dense(idf, *v) for v in vectors])
    for terms, tf in vectors[:120]:
        if not len(terms):
            continue
        cosines = np.rint(np.minimum(full @ dense(idf, terms, tf), 1) * toxicity.STEPS) / toxicity.STEPS
        shared = np.array([bool(set(terms.tolist()) & set(t.tolist())) for t, _ in vectors])
        ranked = np.sort(cosines[shared])[::-1]
        last = ranked[min(toxicity.NEIGHBOURS, len(ranked)) - 1] if len(ranked) >= toxicity.NEIGHBOURS else -1
        want = {(i, float(cosines[i])) for i in np.flatnonzero(shared & (cosines >= last))}
        entries, found = model.nearest(terms, tf)
        assert {(i, float(c)) for e, c in zip(entries.tolist(), found.tolist()) for i in model.groups[e]} == want


def test_votes_are_weighted_and_calibrated_upwards():
    rng = np.random.default_rng(3)
    idf, vectors, labels, model = random_model(rng)
    entries, cosines = model.nearest(*next(v for v in vectors if len(v[0]) > 2))
    weight = sum(w * m * s for c, e in zip(cosines, entries) for w, m, s in [(1 / (1 - c + toxicity.NEAR), model.members[e], model.label_weight)])
    want = (weight[1] + toxicity.PRIOR * model.prior) / (weight.sum() + toxicity.PRIOR)
    assert model.vote(entries, cosines) == pytest.approx(want)
    model.calibrate(list(model.left_out_votes(0, len(model.groups))))
    assert (np.diff(model.steps) >= 0).all() and (np.diff(model.values) >= 0).all() and model.values.min() >= 0 and model.values.max() <= 1
    masses = {(v, label): m for v, m, label in model.left_out_votes(0, len(model.groups))}
    assert sum(m for (_, label), m in masses.items()) > 0


def test_terms_stay_inside_words():
    texts = [b"Idiot! an", b"", b"x", "ÉTÉ été".encode(), b"ab cd"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes, rows = toxicity.terms_of(np.frombuffer(b"".join(texts), np.uint8), offsets)

    def plain(t):
        words = "".join(c if c.isalpha() else " " for c in t.decode().lower()).split()
        edged = [(" " + w + " ").encode() for w in words]
        return sorted(e[i:i + n] for n in toxicity.GRAMS for e in edged for i in range(len(e) - n + 1))

    by = {}
    for i, t in enumerate(texts):
        assert len(hashes[rows == i]) == len(plain(t))
        for h in set(hashes[rows == i].tolist()):
            by.setdefault(h, set()).add(i)
    assert sorted(len(set(plain(t))) for t in texts) == sorted(len(set(hashes[rows == i].tolist())) for i, t in enumerate(texts))


@pytest.fixture(scope="module")
def small(spark):
    """300 documents, every fifth with one of two marked words in some form; odd rows; clashing columns."""
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        mark = ["grobling", "groblings", "schnodder", "schnodderig"][i // 5 % 4] if toxic else "pleasant"
        rows.append((i, f"the day {i} was long and {mark} for all of the people w{i % 17}", "x", "x", "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x", "x", "x"), (1001, "", "x", "x", "x"), (1002, " \n ", "x", "x", "x"), (None, "a groblinghaft day", "x", "x", "x"),
             (1003, "long words " * 20_000 + "schnodderei", "x", "x", "x"), (1004, "same", "x", "x", "x"), (1004, "same", "x", "x", "x")]
    labels += [(None, 1), (5000, 1), (7, None), (5, 0), (5, 1), (1004, 0), (1000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, example_id string, toxic string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("label", F.lit("x"))


def test_marked_documents_are_found_and_odd_rows_kept(small):
    docs, labels = small
    held = fold_of("doc_id", 4) == 2
    out = toxicity.predict(docs, toxicity.fit(docs, labels, ~held)).collect()
    assert len(out) == docs.count() and sum(r.doc_id == 1004 for r in out) == 2
    by = {r.doc_id: r for r in out}
    assert [i for i in range(300) if by[i].predicted] == list(range(0, 300, 5))
    assert by[None].predicted == 1 and by[1003].predicted == 1 and by[None].evidence[0].toxic == 1
    assert {by[i].predicted for i in (1000, 1001, 1002, 1004)} == {0} and by[1000].score == by[1001].score and by[1000].evidence == []
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_labels_of_held_out_rows_do_not_matter(small, spark):
    docs, labels = small
    held = fold_of("doc_id", 4) == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted((str(r.doc_id), r.score) for r in toxicity.predict(docs, toxicity.fit(docs, x, ~held)).collect()) for x in (labels, flipped))
    assert first == second


def test_fewer_examples_than_labels(small):
    docs, labels = small
    vocabulary, model = toxicity.fit(docs, labels, F.lit(True), examples=40)
    assert sum(map(len, model.groups)) <= 80 and model.prior == pytest.approx(0.2, abs=0.03)


def test_nothing_to_learn_or_to_score(small):
    docs, labels = small
    none = toxicity.predict(docs, toxicity.fit(docs, labels.filter(F.lit(False)), F.lit(True))).collect()
    assert {r.score for r in none} == {0.0}
    one_label = toxicity.predict(docs, toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True))).collect()
    assert {r.predicted for r in one_label} == {0}
    nothing = docs.filter(F.lit(False))
    assert toxicity.predict(nothing, toxicity.fit(nothing, labels, F.lit(True))).collect() == []


def test_query_columns(spark):
    out = QUERIES["op11_toxicity"](spark, FOLDER)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
