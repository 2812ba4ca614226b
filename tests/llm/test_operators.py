"""Each operator against a brute-force version on small tables with odd rows."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from civicspark.llm import bitpack, decontaminate, jaccard, katz, langid, licenses, mixing, quality, text, tokens, topk, trie_counts
from civicspark.llm.components import components
from civicspark.plans.compare import duck
from civicspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words_of(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Real texts, and NULL, empty, blank, one-word, very long, repeated and near-equal ones; a clashing extra column for each operator."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    base = " ".join(f"w{i}" for i in range(120))
    more = [None, "", " \t\n ", "word", "a b c", "a b c", base, base + " tail", base.upper(), ("lorem ipsum dolor " * 9000) + "end", "12345 !!! ???",
            "日本語 の テキスト です", "x y  z\x0b q", "été　ça <|endoftext|> end", "tab\there\n\n\nnew"]
    rows += [(5000 + i, t, None, None) for i, t in enumerate(more)]
    rows += [(7000, "same row twice", "en", "s"), (7000, "same row twice", "en", "s"), (None, "no id here", "de", "s"), (None, None, None, "s")]
    clash = "size string, target string, score string, kept string, good string, labelled string, __weight string, of_words string, fp string, token string"
    names = [c.split()[0] for c in clash.split(", ")]
    df = spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], f"doc_id long, text string, lang string, source string, {clash}")
    return df, rows


@pytest.fixture(scope="module")
def empty(odd):
    return odd[0].filter(F.lit(False))


def test_word_hashes_follow_the_word_rule():
    import pyarrow as pa

    texts = ["Ab  cd\x0bEF", None, "", "  ", "AB cd ef", "é x y"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    (_, data, offsets), = text.slices(iter([batch]))
    hashes, rows = text.word_hashes(data, offsets)
    assert np.diff(rows).tolist() == [len(words_of(t)) for t in texts]
    by = collections.defaultdict(set)
    for w, h in zip([w for t in texts for w in words_of(t)], hashes.tolist()):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_slices_keep_every_row_and_long_texts():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 50, "", "c" * 5]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(text.slices(iter([batch.slice(0, 3), batch.slice(3)]), size=12))
    assert [t for b, _, _ in parts for t in b.column("text").to_pylist()] == texts
    assert all(len(d) == o[-1] for _, d, o in parts)


# 1


def leaks(rows, items, overlap=0.6):
    """Brute force: every item against every whole text, by shares of distinct 4-word runs of question and answer."""
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for d, t, *_ in rows:
        w = words_of(t)
        for i, item in items:
            shares = []
            for part in decontaminate.split_item(item):
                p = words_of(part)
                n = decontaminate.gram_size(len(p))
                shares.append(len(grams(p, n) & grams(w, n)) / len(grams(p, n)))
            if min(shares) >= overlap:
                out.add((d, i))
    return out


def test_decontamination_finds_what_brute_force_finds(spark, odd):
    _, rows = odd
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    long_item = " ".join(f"q{i}" for i in range(300)) + ". The answer is here now."
    items += [(900, long_item), (901, "Who was it? It was them all."), (902, items[0][1]), (903, None), (904, "  ")]
    extra = [(8000, "before " * 90 + items[3][1] + " after" * 90), (8001, items[5][1].upper()), (8002, "x " + long_item), (8003, items[3][1][:40])]
    rows = [*rows, *extra]
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}
    want = leaks(rows, [i for i in items if i[1] and i[1].strip()])
    assert got == want and {(8000, items[3][0]), (8001, items[5][0]), (8002, 900)} <= got and 8003 not in {d for d, _ in got}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] not in {d for d, _ in got})


def test_decontamination_in_several_shards_agrees(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    one = sorted(decontaminate.find_contamination(docs, bench).select("doc_id", "item_id").collect())
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 400)
    assert sorted(decontaminate.find_contamination(docs, bench).select("doc_id", "item_id").collect()) == one


def test_wand_retrieves_exactly_the_units_above_the_threshold():
    rng = np.random.default_rng(1)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 80)))) for i in range(150)]
    grouped = [decontaminate.hashes_of([t])[0] for _, t in items]
    units = [w[a:a + 64] for w in grouped for a in range(0, len(w), 64)]
    df = collections.Counter(int(t) for u in units for t in set(u.tolist()))
    shard = decontaminate.Shard(items, df, len(units), sum(map(len, units)) / len(units))
    weights = collections.defaultdict(float)
    for t, us, ws in zip(range(len(shard.terms)), shard.units, shard.impacts):
        for u, w in zip(us, ws):
            weights[u, t] = w
    for _ in range(60):
        query = np.unique(rng.integers(0, len(shard.terms), rng.integers(1, 25))).tolist()
        for threshold in (0.2, 0.5, 0.9):
            want = {u: s for u in range(len(shard.unit_item)) if (s := sum(weights.get((u, t), 0.0) for t in query)) >= threshold - 1e-9}
            got = shard.wand(query, threshold)
            assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in got)


def test_decontamination_of_nothing(spark, odd, empty):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(odd[0], bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(odd[0], bench.limit(0)).count() == odd[0].count()


# 2


def groups(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i), r[0])) for i, r in enumerate(rows)), key=str)


def near_copies():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in (6, 7, 8, 30, 60, 200):
        base = [f"b{size}x{i}" for i in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, size)] = f"e{rng.integers(0, 40)}"
            rows.append((n, " ".join(w + base[:3] * int(rng.integers(0, 2)))))
            n += 1
    common = [f"c{i}" for i in range(40)]
    for i in range(40):
        rows.append((n, " ".join(common + [f"u{i}k{j}" for j in range(i % 14)])))
        n += 1
    return rows


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join_against_all_pairs(spark, odd, n, percent):
    rows = [(r[0], r[1]) for r in odd[1]] + [(20000 + d, t) for d, t in near_copies()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in jaccard.similar_documents(df, n, percent).collect()), key=str)
    assert got == groups(rows, n, percent)


def test_jaccard_join_with_many_ranges_agrees(spark, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "RANGE_TOKENS", 500)
    assert sorted((tuple(r) for r in jaccard.similar_documents(df).collect()), key=str) == groups(rows, 4, 85)


def test_one_of_each_group_stays(spark, odd, empty):
    df, rows = odd
    kept = jaccard.one_per_group(df, 4, 85)
    found = groups(rows, 4, 85)
    assert kept.columns == df.columns
    assert sorted({str(r.doc_id) for r in kept.collect()}) == sorted({str(d) for d, _, c in found if d == c})
    assert kept.filter("doc_id = 7000").count() == 1
    assert jaccard.one_per_group(empty).count() == 0 and jaccard.similar_documents(empty).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "first text without any id"), (None, "second text that has no id"), (None, "second text that has no id"), (1, base), (None, base), (None, base + " tail"),
            (2, "shared id but a text of its own"), (2, base), (3, "one id and one text"), (3, "one id and another text"), (3, "one id and one text"),
            (None, None), (None, ""), (None, None), (4, " "), (4, " ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string")
    kept = jaccard.one_per_group(df, 4, 85)
    want = [rows[0], rows[1], rows[3], rows[6], rows[8], rows[9], *rows[11:]]
    assert kept.columns == df.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert jaccard.one_per_group(df.filter("doc_id = 4")).count() == 2


def test_components_of_long_paths(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100) for i in range(30)] + [(5, 5), (1, 2)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31])
def test_bit_packing_round_trip_and_ranges(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint64)
        data = bitpack.pack(ids, bits)
        assert len(data) == -(-n // 64) * bits * 8
        assert bitpack.unpack(data, bits, 0, n).tolist() == ids.tolist()
        if n > 2:
            a, b = sorted(rng.integers(0, n, 2).tolist())
            assert bitpack.unpack(data, bits, a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << bits], np.uint64), bits)
    assert bitpack.width(50257) == 16 and bitpack.width(65537) == 17 and bitpack.width(1) == 1


def test_token_files_hold_whole_encodings(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    df, rows = odd
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    path = str(tmp_path / "tokens")
    got = [tuple(r) for r in tokens.tokenise(df, TOKENIZER, 2, path).collect()]
    start, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokens.document_ids(spark, path, 5003) == [[*plain.encode("word").ids, 2]]
    assert len(tokens.document_ids(spark, path, 7000)) == 2


def test_queries_write_the_plain_encoding_of_special_tokens(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "plain words here", "two <|endoftext|> of <|endoftext|>", "<|endoftext|>", "x\n<|endoftext|> y", "almost <|endoftext| >"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    for d, text_ in enumerate(texts):
        ids = np.array([*plain.encode(text_, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for out in (QUERIES["op3_token_output"](spark, str(tmp_path)), corpus_pipeline.token_output(spark, docs, str(tmp_path))):
        assert sorted(tuple(r) for r in out.collect()) == want


def test_token_files_of_nothing(empty):
    assert tokens.tokenise(empty, TOKENIZER).count() == 0


# 4


def test_licences_are_found_and_inherited(spark):
    files = [
        ("/a/LICENSE", "Released under the MIT License."), ("/a/b/c/x.py", "code"), ("/a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("/a/b/c/y.py", "// Licensed under CC BY-NC 4.0.\ncode"), ("/a/z.py", None), ("/ab/q.py", "no licence word but licence here"), ("/q.py", ""),
        (None, "text"), ("/a/b/c/x.py", "code"), ("/a/d/COPYING", "word " * 30000), ("/a/d/e.py", "This work is licensed under the GNU General Public License, version 3."),
        ("/a/d/f.py", "x"), ("/r/LICENSE", "Licensed under CC BY 4.0."), ("/r/LICENSE", "Released under the MIT License."), ("/r/s/t", "t")]
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "file_id long, path string, text string, score string")
    got = {r.file_id: (r.licence, r.origin, r.from_dir) for r in licenses.scan(df).collect()}
    assert got[0] == ("MIT", "own", None) and got[1] == ("Apache-2.0", "inherited", "/a/b") == got[8]
    assert got[3] == ("CC-BY-NC-4.0", "own", None) and got[4] == ("MIT", "inherited", "/a")
    assert got[5] == got[6] == got[7] == (None, "none", None)
    assert got[9] == ("MIT", "inherited", "/a") == got[11] and got[10][:2] == ("GPL-3.0", "own")
    assert got[14] == ("CC-BY-4.0", "inherited", "/r") and len(got) == len(files)
    assert licenses.scan(df.limit(0)).count() == 0


def test_lines_that_name_no_licence_are_compared_too(spark):
    files = [("/a/LICENSE", "Released under the MIT License."), ("/a/x.py", "code\nAll rights reserved.\ncode"), ("/a/y.py", "code"),
             ("/b/z.py", "Redistribution and use in source and binary forms are permitted.\ncode"), ("/b/w.py", "use of this, in a form of the work")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "file_id long, path string, text string")
    got = {r.file_id: (r.licence, r.origin) for r in licenses.scan(df).collect()}
    assert got[1] == ("Proprietary", "own") and got[2] == ("MIT", "inherited") and got[3] == ("BSD-3-Clause", "own")


def test_notices_inside_sentences_over_lines_and_whole_texts(spark):
    filler = "plain words that say something else about other matters"
    files = [(f"{filler} {filler}. Released under the MIT License. {filler} {filler} {filler}", "MIT"), (f"Licensed under CC BY 4.0. {filler} {filler}", "CC-BY-4.0"),
             ("code here\n# This work is licensed under the GNU General\n# Public License, version 3.\nmore code", "GPL-3.0"),
             ("This work is licensed under the GNU General Public License.", "GPL"), (f"{filler}\nMit\nAll\n{filler}", None),
             ("This project is licensed under the MIT License - see the file in the root of the project for details of what it says", "MIT")]
    df = spark.createDataFrame([(i, f"/d{i}/x.py", t) for i, (t, _) in enumerate(files)], "file_id long, path string, text string")
    whole = [(name, body.replace("<year>", "2020")) for name, body in licenses.whole_texts()]
    df = df.unionAll(spark.createDataFrame([(100 + i, f"/w{i}/LICENSE", f"Copyright (c) 2020 A. Author\n\n{t}") for i, (_, t) in enumerate(whole)], df.schema))
    got = {r.file_id: r.licence for r in licenses.scan(df).collect()}
    assert got == {**{i: n for i, (_, n) in enumerate(files)}, **{100 + i: n for i, (n, _) in enumerate(whole)}}


def test_every_line_that_reaches_the_threshold_is_likely(spark):
    rng = np.random.default_rng(4)
    lines = {t for _, t in licenses.TEMPLATES}
    for _, t in licenses.TEMPLATES:
        words = re.findall(licenses.TERM, t.lower())
        lines |= {" ".join([*rng.permutation(words)[:rng.integers(1, len(words) + 1)], *["word"] * int(rng.integers(0, 3))]) for _ in range(40)}
        lines.add(" ".join(sorted({w for w in words if w in licenses.STOP})))
    df = spark.createDataFrame([(t,) for t in sorted(lines)], "segment string").select(F.col("segment").alias("key"), "segment")
    named = re.compile(licenses.telling(licenses.TEMPLATES))
    found = {r.key for r in licenses.own_licences(df).collect() if named.search(r.key.lower())}
    kept = {r.key for r in df.filter(licenses.likely(licenses.TEMPLATES, 0.5)(F.col("segment"))).collect()}
    assert found and found <= kept and "word" not in kept


# 5


def test_language_held_out_accuracy_and_odd_texts(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(langid.fold_of("doc_id") != 0))
    found = langid.predict(docs.withColumn("score", F.lit("x")), model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.fold_of("doc_id") == 0)
    total, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert total > 150 and right / total > 0.98
    rows = {r.doc_id: r for r in langid.predict(odd[0], model).collect()}
    assert [rows[i].lang_pred for i in (5000, 5001, 5002, 5010)] == ["und"] * 4 and rows[5011].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in rows.values()) and langid.predict(odd[0], model).count() == odd[0].count()
    nothing = langid.train(empty)
    assert nothing is None and {r.lang_pred for r in langid.predict(odd[0], nothing).collect()} == {"und"}
    one = langid.train(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(odd[0], one).collect()} == {"en", "und"}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    if n > 2:
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= (2 if n < 4 else 4)


def test_trigrams_stay_inside_their_text():
    data = np.frombuffer("abÉx..yz".encode() + b"q", np.uint8)
    offsets = np.array([0, 9, 9, 10])
    grams, rows = langid.trigrams(data, offsets)
    alone, _ = langid.trigrams(data[9:], np.array([0, 1]))
    assert np.diff(rows).tolist() == [len(" abéx yz ".encode()) - 2, 0, 1] and grams[-1:].tolist() == alone.tolist()


# 6


def test_quality_keeps_good_and_drops_bad(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.resample(docs.withColumn("__weight", F.lit("x")), labels)
    assert kept.columns[:len(docs.columns)] == docs.columns and "__weight_" in kept.columns
    rates = {r.quality: (r.n, r.k) for r in labels.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").groupBy("quality").agg(
        F.count("*").alias("n"), F.count("kept").alias("k")).collect()}
    assert rates[1][1] >= 0.99 * rates[1][0] and rates[0][1] <= 0.05 * rates[0][0]
    assert quality.resample(odd[0], labels.limit(0)).count() == odd[0].count()
    assert quality.resample(odd[0], labels, keep=10).count() == 10
    assert quality.resample(empty, labels).count() == 0 and quality.resample(odd[0], labels, keep=0).count() == 0


def test_weights_against_plain_counting(spark):
    docs = spark.createDataFrame([(0, "ab ab ab"), (1, "abc xyz"), (2, None), (3, "q")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (0, 0)], "labelled long, good int")
    ratios = quality.fit(docs, sample)
    got = {r.doc_id: r["__weight"] for r in quality.weigh(docs, ratios).collect()}
    for d, t in ((0, b"ab ab ab"), (1, b"abc xyz"), (2, b""), (3, b"q")):
        want = 0.0
        for buckets, _ in quality.ngram_buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)])):
            want += quality.SPAN * ratios[buckets].mean() if len(buckets) else 0.0
        assert abs(got[d] - want) < 1e-3
    assert got[1] > got[0] and got[2] == got[3] == 0


def test_top_k_cut_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "LAST_ROWS", 5)
    rng = np.random.default_rng(5)
    rows = [(i, float(k)) for i, k in enumerate(np.round(rng.normal(size=400), 1).tolist())]
    rows += [(None, 0.3), (7, 0.3)]
    keys = spark.createDataFrame(rows, "doc_id long, key double")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    for k in (1, 2, 57, 200, 401, 402, 1000):
        cut = quality.cut_of_top(keys, k)
        got = keys.filter(quality.kept_by(cut, F.col("key"), F.col("doc_id"))).count()
        last = order[min(k, len(order)) - 1]
        assert (cut[0], cut[1]) == (last[1], last[0]) and got == sum(r[1] > last[1] or (r[1] == last[1] and (r[0] is None or last[0] is not None and r[0] <= last[0])) for r in rows)
    same = spark.createDataFrame([(i, 1.0) for i in range(50)], "doc_id long, key double")
    assert quality.cut_of_top(same, 20) == (1.0, 19) and quality.cut_of_top(same.limit(0), 0) is None


# 7


@pytest.mark.parametrize("per_bucket", [64, 1])
def test_top_k_against_all_products(spark, monkeypatch, per_bucket):
    rng = np.random.default_rng(7)
    vectors = [(i, (rng.normal(size=8) * (1 + i % 3)).round(2).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(60)] + [(2000, None), (2100, []), (2200, [1.0, None] * 4), (2300, [float("nan")] * 8), (2450, [1e30] + [0.0] * 7),
                                                                 (2400, [float("inf")] * 8), (2500, [0.0] * 8), (2600, [1.0, 2.0]), (2500, [0.0] * 8), (None, [5.0] * 8), (None, [5.0] * 8),
                                                                 (2701, [4.0] * 8), (2701, [4.0] * 8), (2700, [1e30] * 8)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string")
    monkeypatch.setattr(topk, "CELL", 16)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "PIVOTS", 4)
    monkeypatch.setattr(topk, "CELLS_PER_BUCKET", per_bucket)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), 10).collect()), key=repr)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))) for i, v in vectors
             if v and all(x is not None and math.isfinite(x) and abs(x) < 1e29 for x in v)]
    want = []
    for q, own in {i: v for i, v in whole if i is not None and i % 100 == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(own, v)), i is None, i or 0) for i, v in whole if i != q))[:10]
        want += [(q, r, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(best, 1)]
    assert got == sorted(want, key=repr) and any(r[2] is None for r in got) and any(r[2] == 2701 and x[2] == 2701 for r, x in zip(got, got[1:]))
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, few, 10).count() == 6 and topk.top_k(df.limit(0), df, 10).count() == 0 and topk.top_k(df, df.limit(0), 10).count() == 0


# 8


def brute_katz(rows, held):
    c1, c2, streams = collections.Counter(), collections.Counter(), []
    for d, t, *_ in rows:
        w = [*words_of(t), None]
        streams.append((d, w))
        if not held(d):
            c1.update(w)
            c2.update(zip([None, *w[:-1]], w))
    total, distinct = sum(c1.values()), len(c1)
    d1, d2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in (c1, c2))
    kept = lambda d, c: c * (d[c] if c <= 5 else 1)
    p1 = {w: kept(d1, c) / (total + 0.5) for w, c in c1.items()}
    unseen = 1 - sum(p1.values())
    after = collections.defaultdict(list)
    for (h, w), c in c2.items():
        after[h].append((w, c))
    back = {h: (1 - sum(kept(d2, c) for _, c in f) / (c1[h] + 0.5)) / (1 - sum(p1[w] for w, _ in f)) for h, f in after.items()}

    def p(h, w):
        return kept(d2, c2[h, w]) / (c1[h] + 0.5) if (h, w) in c2 else back.get(h, 1.0) * p1.get(w, unseen)

    for h in [None, *list(back)[:5], "never seen"]:
        assert abs(sum(p(h, w) for w in c1) + p(h, "never seen") - 1) < 1e-9
    return [(d, held(d), len(w), sum(c1[x] > 0 for x in w), total, sum(math.log10((c1[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w),
             sum(math.log10(p(h, x)) for h, x in zip([None, *w[:-1]], w))) for d, w in streams]


@pytest.mark.parametrize("range_tokens", [katz.RANGE_TOKENS, 30000])
def test_katz_scores_against_plain_counting(spark, odd, monkeypatch, range_tokens):
    df, rows = odd
    monkeypatch.setattr(katz, "RANGE_TOKENS", range_tokens)
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    got = sorted((tuple(r) for r in katz.score(df, langid.fold_of("doc_id") == 1).collect()), key=str)
    want = sorted(brute_katz(rows, held), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-7)


def test_katz_without_training_rows(spark, odd, empty):
    assert katz.score(empty, F.lit(False)).count() == 0
    assert {(r.n_known, r.base_score, r.score) for r in katz.score(odd[0], F.lit(True)).collect()} == {(0, 0.0, 0.0)}


def test_discounts_are_valid():
    for counts in ([0] * 6, [100, 40, 20, 10, 5, 3], [5, 0, 3, 0, 1, 9], [1, 50, 2, 2, 2, 2]):
        assert all(0 < d <= 1 for d in katz.discounts(counts))


# 9


def test_trie_counts_against_plain_segmentation(spark, odd, empty):
    pieces = trie_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = trie_counts.Pieces(pieces)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(best[end - 1][0] + size * model.byte_score, best[end - 1][1] + size)]
            options += [(best[b][0] + model.score[word[b:end]], best[b][1] + 1) for b in range(end) if word[b:end] in model.score]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    df, rows = odd
    got = sorted((tuple(r) for r in trie_counts.count_tokens(df.withColumn("n_tokens", F.lit("x")), pieces).collect()), key=str)
    memo = {}
    want = []
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        for x in w:
            if x not in memo:
                memo[x] = plain(trie_counts.PREFIX + x)
        want.append((d, len(w), sum(memo[x] for x in w), len((t or "").encode())))
    assert got == sorted(want, key=str)
    assert trie_counts.count_tokens(empty, pieces).count() == 0


# 10


def test_long_runs_have_no_nodes(monkeypatch):
    """Beyond DEPTH characters the counts are the same, and nothing is kept."""
    rng = np.random.default_rng(1)
    pieces = trie_counts.Pieces(trie_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    words = ["▁" + "".join(rng.choice(list("abcdething é日"), rng.integers(1, 300))) for _ in range(150)]
    whole = trie_counts.Trie(pieces)
    want = [whole.insert(w) for w in words]
    monkeypatch.setattr(trie_counts, "DEPTH", 7)
    short = trie_counts.Trie(pieces)
    assert [short.insert(w) for w in words] == want and len(short.best) < len(whole.best) / 10
    import tracemalloc

    tracemalloc.start()
    short.insert("▁" + "a1b2" * 50_000)
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_mix_targets_by_water_level(spark):
    sizes = {"a": 100, "b": 10, "c": 0, "d": 5000, None: 40}
    rows = [(i, s, n // 10 + (j < n % 10), None) for i, (s, n, j) in enumerate((s, n, j) for s, n in sizes.items() for j in range(10))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality int")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = dict(zip([*sorted(s for s in sizes if s), None], itertools.cycle((1, 2, 3))))
    want, open_, rest = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while True:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            want.update({s: level * weights[s] for s in open_})
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            rest -= want[s]
        open_ -= full
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_takes_epochs_then_a_fraction(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)
    df, _ = odd
    rows = [r.asDict() for r in mixing.mix(mixing.document_rows(df.drop("size"))).collect()]
    again = [r.asDict() for r in mixing.mix(mixing.document_rows(df.drop("size"))).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == df.count()
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert all(r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"] and r["epochs"] <= r["repeats"] <= r["epochs"] + 1 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert mixing.mix(mixing.document_rows(empty)).count() == 0


# queries against SQL on tables with odd rows


@pytest.mark.parametrize("name", ["op10_mixing", "op2_jaccard_join"])
def test_sql_twins_on_odd_rows(spark, odd, tmp_path, name):
    from civicspark.plans.compare import compare

    odd[0].filter("doc_id is not null and doc_id <> 7000").select("doc_id", "text", "lang", "source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duck(FOLDER)
    for t in ("documents", "labels"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    message = compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
    assert message.startswith("ok"), message
