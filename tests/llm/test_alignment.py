"""Alignment of two tokenizers against the plain definition on whole texts."""

import bisect
import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import public_tokenizers
from civicspark.llm import alignment
from civicspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts, both libraries as they are."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.decoders import ByteLevel

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        del ByteLevel
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [c for c in range(256) if c not in chars]
        self.decode = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.decode[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def document(self, text):
        a, b = self.tokens(text)
        spans = [[(i, e - len(x), e) for (i, x), e in zip(t, itertools.accumulate(len(x) for _, x in t))] for t in (a, b)]
        ends = [[s[2] for s in t] for t in spans]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in common:
            k, m = bisect.bisect(ends[0], c), bisect.bisect(ends[1], c)
            groups.append(",".join(str(x) for x, _ in a[i:k]) + "|" + ",".join(str(x) for x, _ in b[j:m]))
            i, j = k, m
        links, j = [], 0
        for x, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(b) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    links.append((x, spans[1][j][0]))
                j += 1
        return len(a), len(b), groups, links


def brute(rows):
    plain = Plain()
    docs = [plain.document(t) for _, t in rows]
    counts = collections.Counter(p for *_, links in docs for p in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted((str(i), na, nb, len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (i, _), (na, nb, g, links) in zip(rows, docs, strict=True))


def found(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_cuts_are_the_common_ends():
    rng = random.Random(1)
    for _ in range(600):
        pieces, a, b, firsts, want, at = [], [], [], [], [], 0
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(1, 40)
            x, y = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2))
            firsts.append(len(a))
            want += [len(a) + x.index(c) + 1 for c in sorted(set(x) & set(y))]
            a, b, at = a + [at + e for e in x], b + [at + e for e in y], at + n
            pieces.append((x, y))
        assert alignment.shared_cuts(np.array(a), np.array(b), np.array(firsts)).tolist() == want
    n = 20_000
    for a, b in ((range(1, n + 1), range(1, n + 1)), (range(2, 2 * n + 1, 2), [*range(1, 2 * n, 2), 2 * n]), (range(2, 2 * n + 1, 2), [*range(1, n, 2), *range(n, 2 * n + 1, 2)])):
        assert alignment.shared_cuts(np.array(a), np.array(b), np.array([0])).tolist() == [i + 1 for i, e in enumerate(a) if e in set(b)]
    assert alignment.shared_cuts(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.fixture(scope="module")
def rows():
    real = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    odd = [None, "", " ", "\n", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\na", "a\n", "tab\tx \ty", "été　ça", "日本語 の", "<|endoftext|> <s> </s>", "▁a b", "a▁ b", "a ▁b",
           "<0x41> x", "x\u0085y z", "null\x00 byte", "é ﬁ ½", "a\r\nb c\r", "word", "don't  we'll", "x" * 5000, "lorem ipsum " * 3000 + "end", "🙂 emoji🙂🙂 x", ";\r y", "a\x0bb c"]
    rng = random.Random(7)
    alphabet = ["a", "the", " ", " ", "  ", "\n", "\t", ".", ",", "é", "日", "'s", "12", "\r", "\xa0", "Ω", "▁", "-", "!!", " ", "wor", "ing"]
    nasty = ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(600)]
    return real + [(10_000 + i, t) for i, t in enumerate(odd + nasty)] + [(None, "no id"), (None, None), (20_000, "same row"), (20_000, "same row")]


def test_pieces_spell_what_whole_texts_spell(rows):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        encode = alignment.PairEncoder(f.read(), g.read(), 50)
    plain = Plain()
    texts = [t for _, t in rows]
    pieces, which, per_text = alignment.cut_texts(encode, pa.array(texts, pa.string()))
    ends = [0, *itertools.accumulate(per_text.tolist())]
    for t, x, y in zip(texts, ends, ends[1:]):
        mine = [pieces[k] for k in which[x:y]]
        n_a, n_b, groups, links = plain.document(t)
        if None in mine:
            assert (n_a, n_b) == (0, 0), t
        else:
            assert ";".join(m[0] for m in mine) == ";".join(groups) and [sum(m[k] for m in mine) for k in (2, 3, 4)] == [n_a, n_b, len(groups)], t
            assert [int.from_bytes(m[1][k:k + 8], "little") for m in mine for k in range(0, len(m[1]), 8)] == [p << 32 | q for p, q in links], t


@pytest.mark.parametrize(("slice_bytes", "part_pairs"), [(1 << 22, 1 << 21), (2000, 700)])
def test_alignment_against_whole_texts(spark, rows, monkeypatch, slice_bytes, part_pairs):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(alignment, "PART_PAIRS", part_pairs)
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, slice string, part string, counts string").repartition(3)
    assert found(alignment.align(docs, A, B)) == brute(rows)


def test_nothing_to_align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(alignment.align(docs.filter(F.lit(False)), A, B)) == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(alignment.align(blank, A, B)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in "12"]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    assert found(QUERIES["op13_alignment"](spark, FOLDER)) == brute(rows)
