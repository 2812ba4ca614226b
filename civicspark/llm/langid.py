"""Language identification by error-correcting output codes.

Every language has a codeword; each bit of it is predicted by a binary classifier on hashed byte trigrams (naive Bayes: the
log ratio of a trigram's probability in the languages whose bit is 1 and in those whose bit is 0). A text is decoded to
the language whose codeword has the least logistic loss against the predicted margins, each bit weighted by how well it
separates the training counts. A small lead over the second codeword flags the text as ambiguous.

The classifiers learn from trigram counts of all training rows, summed per language by Spark; only the table of
``BUCKETS`` sums per language reaches the driver. Texts are folded first: A-Z and Latin-1 capitals to lower case, all other
ASCII to one separator, repeated separators to one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.text import fold_latin, pack_rows, slices

BUCKETS = 1 << 14
AMBIGUOUS = 0.6
UNDETERMINED = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the folded texts, and the trigram offsets of the rows. A text stands between separators."""
    n = len(offsets) - 1
    folded = _FOLD[fold_latin(data)]
    # room for a separator around each text
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    out[np.arange(len(data)) + 2 * row + 1] = folded
    begin = offsets[:-1] + 2 * np.arange(n)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[begin] = True
    out = out[keep]
    rows = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([begin, [len(keep)]])]
    if len(out) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    x = out.astype(np.uint32)
    grams = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    last = np.minimum(rows[1:], len(out)) - 2
    inside = np.ones(len(grams), bool)
    for cut in (last, last + 1):
        inside[cut[(cut >= 0) & (cut < len(grams))]] = False
    return grams[inside].astype(np.int64), np.concatenate([[0], np.cumsum(inside)])[np.minimum(rows, len(grams))]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])[offsets]
    found = np.diff(seen) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace"))
    return found


def codewords(n: int, bits: int = 31, tries: int = 200) -> np.ndarray:
    """n codewords of +1/-1, one row each.

    Up to five languages use every split into two sides (the exhaustive code, 15 bits for five). More use the code of largest
    least distance among ``tries`` random ones (fixed seed), of at least ``bits`` bits and six for each doubling of n.
    """
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits or [(1,) * n], np.int8).T.reshape(n, -1)
    bits = max(bits, 6 * int(n - 1).bit_length())
    best, most = None, -1
    for seed in range(tries):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + bits * np.eye(n, dtype=np.int32)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


class Model:
    """Languages in code point order, their codewords, trigram weights and bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)  # every language speaks with one voice, however many rows it has
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            one, zero = self.code[:, b] > 0, self.code[:, b] < 0
            if zero.any():
                self.weights[:, b] = np.log(share[one].mean(0)) - np.log(share[zero].mean(0))
        # mean margin of each language on each bit; a bit counts as far as its own margins agree with the codewords
        margins = share @ self.weights
        self.trust = np.maximum((margins * self.code).min(0), 1e-3)

    def decode(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in 0..1 and ambiguity of each row of summed trigram weights."""
        margin = sums / np.maximum(n, 1)[:, None] / self.trust
        loss = np.stack([np.logaddexp(0, -2 * margin * c) @ self.trust for c in self.code], 1) / self.trust.sum()
        choice = loss.argmin(1)
        if len(self.languages) == 1:
            return choice, np.ones(len(choice)), np.zeros(len(choice), bool)
        two = np.partition(loss, 1, 1)[:, :2]
        score = 1 / (1 + np.exp(-4 * (two[:, 1] - two[:, 0])))
        return choice, score, score < AMBIGUOUS


def train(docs: DataFrame) -> Model | None:
    """Learn from all rows (text, lang) with a non-NULL lang; None if there are none. NULL texts count as empty."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, data, offsets in slices(batches):
            grams, rows = trigrams(data, offsets)
            spoken = batch.column("lang").dictionary_encode()
            names, number = spoken.dictionary.to_pylist(), spoken.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(names):
                mine = np.repeat(number == k, np.diff(rows))
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += np.bincount(grams[mine], minlength=BUCKETS)
        for name, total in sums.items():
            at = np.union1d(np.flatnonzero(total), [0])
            yield pack_rows({"lang": [name] * len(at), "bucket": at, "n": total[at]}, schema)

    rows = docs.filter(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    languages = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    number = {name: k for k, name in enumerate(languages)}
    counts[[number[x] for x in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of ``docs`` (doc_id, text; other columns are ignored).

    NULL texts, texts without a letter, and all texts if nothing was learned are ``und`` with score 0, not ambiguous.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, data, offsets in slices(batches):
            n = batch.num_rows
            known = has_letter(data, offsets) if model else np.zeros(n, bool)
            if model:
                grams, rows = trigrams(data, offsets)
                sums = np.zeros((n, model.code.shape[1]))
                full = np.diff(rows) > 0
                if full.any():
                    for b in range(sums.shape[1]):
                        sums[full, b] = np.add.reduceat(model.weights[:, b][grams], rows[:-1][full], dtype=np.float64)
                choice, score, ambiguous = model.decode(sums, np.diff(rows))
                names = np.array([*model.languages, UNDETERMINED], object)[np.where(known, choice, len(model.languages))]
            else:
                names, score, ambiguous = np.full(n, UNDETERMINED, object), np.zeros(n), known
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)),
                                              pa.array(ambiguous & known)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold_of(id_col: str, folds: int = 5) -> Column:
    """The fold of a row: crc32 of its id as text, modulo the folds. A NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
