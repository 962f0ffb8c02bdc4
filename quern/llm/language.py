"""Language ID by a string kernel: blended-spectrum presence kernels, Nyström landmarks, ridge regression.

The kernel of two texts is the number of n-grams (1 to ``spectrum`` UTF-8 bytes of lower-cased
letters, all else one space) that occur in both, over the root of what each has: k(s,t) / sqrt(k(s,s)
k(t,t)). A bounded sample of each language (``quota`` texts, by a 64-bit hash of doc_id and text, and
``MOST_ROWS`` of all together, with about ``MOST_CODES`` n-grams) trains the model, some of them as landmarks: ``ALL_LANDMARKS``
at most, dealt alike to the languages. With very many languages the model keeps the n-grams that most landmarks have, so that
n-grams times languages stay below ``MODEL_CELLS``. With K the landmarks' kernel matrix, texts map to rows of K^-1/2, in which
one-versus-rest kernel ridge regression is a linear solve. Scores of a batch are the product of
its presence matrix (sparse) with the landmarks' matrix and the regression's, multiplied beforehand.

Defined results: a null text, and one without any letter, is ``und`` with score 0; rows that repeat
are predicted each; texts are read whole, however long; of languages that score alike the first by name
is given; without training rows all texts are ``und``; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytetext import slices
from quern.llm.common import cut, lookup, python_workers, unit

QUOTA = 500
LANDMARKS = 60
SPECTRUM = 3
MOST_ROWS = 20_000
MOST_CODES = 8_000_000  # n-gram codes of the sample
ALL_LANDMARKS = 600
MODEL_CELLS = 24_000_000  # n-grams times languages of the model
LANDMARK_BLOCK = 64
RIDGE = 1e-3

_U = np.uint64
_SPACE = 32
_LETTER = np.full(256, _SPACE, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def presence(texts: pa.Array, spectrum: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: (first row, end row, text, n-gram code) of every n-gram that occurs in a text, once each."""
    for low, high, raw, offsets in slices(pc.utf8_lower(texts.cast(pa.large_string()))):
        n = high - low
        doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
        byte = _LETTER[raw]
        again = (byte[1:] == _SPACE) & (byte[:-1] == _SPACE) & (doc[1:] == doc[:-1])
        stay = np.concatenate(([True], ~again)) if len(byte) else np.zeros(0, bool)
        doc, byte = doc[stay], byte[stay].astype(np.uint64)
        keys, code = [], np.zeros(len(byte), np.uint64)
        for k in range(1, spectrum + 1):
            if len(byte) < k:
                break
            code = (code[: len(byte) - k + 1] << _U(8)) | byte[k - 1 :]
            whole = doc[: len(code)] == doc[k - 1 :]
            keys.append((doc[: len(code)] << _U(36) | _U(k) << _U(32) | code)[whole])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        yield low, high, (key >> _U(36)).astype(np.int64), key & _U((1 << 36) - 1)


def _gather(matrix: np.ndarray, text: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """The product of a presence matrix, given as (text, column) in order of text, with ``matrix``."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    step = 2_000_000 // max(1, matrix.shape[1]) + 1
    for low in range(0, len(text), step):
        of = text[low : low + step]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[of[first]] += np.add.reduceat(matrix[column[low : low + step]], first, axis=0)
    return out


def fit(grams_of: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, sorted n-gram codes, n-grams by languages matrix) from the n-gram codes of each text, or None without rows."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    text, code = np.repeat(np.arange(len(y)), [len(g) for g in grams_of]), np.concatenate(grams_of).astype(np.uint64)
    own = np.maximum(np.bincount(text, minlength=len(y)), 1)
    per = max(1, min(landmarks, ALL_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(y == c)[:per] for c in range(len(names))])[:ALL_LANDMARKS]
    place = np.full(len(y), -1)
    place[chosen] = np.arange(len(chosen))
    mine = place[text] >= 0
    grams, often = np.unique(code[mine], return_counts=True)
    most = max(1, MODEL_CELLS // len(names))
    if len(grams) > most:
        grams = np.sort(grams[np.lexsort((grams, -often))[:most]])
    at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
    known = grams[at] == code
    mark, gram = place[text[known & mine]], at[known & mine]  # which landmark has which n-gram
    kernel = np.empty((len(y), len(chosen)))
    for low in range(0, len(chosen), LANDMARK_BLOCK):
        high = min(low + LANDMARK_BLOCK, len(chosen))
        here = (mark >= low) & (mark < high)
        has = np.zeros((len(grams), high - low))
        has[gram[here], mark[here] - low] = 1
        has /= np.sqrt(own[chosen[low:high]])
        kernel[:, low:high] = _gather(has, text[known], at[known], len(y)) / np.sqrt(own)[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    share = len(y) / (len(names) * np.bincount(y, minlength=len(names)))[y]  # languages count alike
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weighted = phi * share[:, None]
    solved = np.linalg.solve(phi.T @ weighted + ridge * len(y) * np.eye(phi.shape[1]), weighted.T @ target)
    order = np.argsort(gram, kind="stable")
    return names, grams, _gather((root @ solved) / np.sqrt(own[chosen])[:, None], gram[order], mark[order], len(grams))


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, matrix = model or ([], np.zeros(0, np.uint64), np.zeros((0, 1)))
        for batch in batches:
            texts = batch.column("text")
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for low, high, text, code in presence(texts, SPECTRUM):
                n = high - low
                byte = code & _U(0xFF)
                single = (code >> _U(32)) == 1
                letters = np.bincount(text[single & (byte >= 97) & (byte <= 122)], minlength=n) > 0
                for i in np.flatnonzero((np.bincount(text[single & (byte >= 128)], minlength=n) > 0) & ~letters):
                    letters[i] = any(c.isalpha() for c in texts[low + int(i)].as_py())
                if not len(grams):
                    continue
                own = np.maximum(np.bincount(text, minlength=n), 1)
                at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                known = grams[at] == code
                got = _gather(matrix, text[known], at[known], n) / np.sqrt(own)[:, None]
                best = got.argmax(axis=1)
                lang[low:high] = np.where(letters, np.array(names, object)[best], "und")
                score[low:high] = np.where(letters, np.clip((got[np.arange(n), best] + 1) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their n-gram codes."""
    for batch in batches:
        for low, high, text, code in presence(batch.column("text"), SPECTRUM):
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=high - low))))
            grams = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code.astype(np.int64)))
            n = high - low
            yield pa.RecordBatch.from_arrays([batch.column("u").slice(low, n), batch.column("lang").slice(low, n), grams], names=["u", "lang", "grams"])


def train(docs: DataFrame, quota: int = QUOTA, landmarks: int = LANDMARKS, most: int = MOST_ROWS):
    """The model of the rows that aren't held out; languages are counted over all rows, then sampled.

    A language has ``quota`` rows in expectation, and all together at most ``most``, with about ``MOST_CODES`` n-grams. Texts come to the driver as sets of n-gram codes.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    each = min(quota, most / max(1, counts.count()))
    share = counts.select("lang", (F.lit(float(each)) / F.col("_n")).alias("share"))
    place = unit(F.xxhash64(F.lit(3), "doc_id", "text"))
    picked = lookup(rows.select("lang", "text", place.alias("u")), share, ["lang"], "inner").where(F.col("u") < F.col("share"))
    coded = cut(picked.select("u", "lang", "text").mapInArrow(_coded, "u double, lang string, grams array<bigint>"))
    codes = coded.agg(F.sum(F.size("grams"))).first()[0] or 0
    if codes > MOST_CODES:
        coded = coded.where(unit(F.xxhash64(F.lit(4), "u", "lang")) < MOST_CODES / codes)
    got = coded.orderBy("u", "lang").limit(most).toPandas()
    return fit([np.asarray(g, np.int64) for g in got["grams"]], got["lang"].tolist(), landmarks)


def predict(docs: DataFrame, quota: int = QUOTA, landmarks: int = LANDMARKS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Only the text decides."""
    python_workers(docs.sparkSession)
    model = train(docs, quota, landmarks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predicted(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
