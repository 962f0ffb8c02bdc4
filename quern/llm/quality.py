"""Document quality by hierarchical empirical Bayes.

1. A logistic classifier over surface figures of whole texts (case, symbols, word lengths, repeated
   words and word runs) gives each document's own evidence. It is fitted on labelled rows, of
   which a bounded sample (``sample_rows`` labelled doc_ids, by a 64-bit hash, and twice as many rows
   at most) is taken.
2. Grouped aggregates over all documents sum that evidence by path (source and language) and by
   host (source). Host rates shrink towards the global rate, path rates towards their host's;
   how strongly follows from the spread between hosts and between paths (method of moments), so
   sparse sites say little.
3. A document's odds are its classifier odds times the path's prior odds over the global prior odds. Its own
   evidence is left out of the path's sums that it meets, so that it counts once.

Defined results: a null text is an empty text; texts are read whole, however long; a score of just the
threshold is kept; null sources and languages are groups of their own;
rows that repeat are scored each; a doc_id that labels repeat has the mean of its labels; where
labels hold no two classes, nothing is known against any document and all are kept; an empty
table gives an empty table; further columns are carried by ``keep_good`` and ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytetext import shingles, slices, words
from quern.llm.common import cut, lookup, python_workers, unit

SAMPLE_ROWS = 20_000

_KIND = np.full(256, 6)  # symbols
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
N_KINDS = 7
N_FIGURES = 16


def figures(texts: pa.Array) -> np.ndarray:
    """One row of surface figures per text."""
    out = np.zeros((len(texts), N_FIGURES))
    for low, high, raw, offsets in slices(texts):
        n = high - low
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        kinds = np.bincount(doc * N_KINDS + _KIND[raw], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
        lines = np.bincount(doc[raw == 10], minlength=n)
        hashes, starts, ends, first = words(raw, offsets)
        n_words = np.diff(first)
        of = np.repeat(np.arange(n), n_words)
        length = (ends - starts).astype(float)
        some = np.maximum(n_words, 1)
        mean = np.bincount(of, length, n) / some

        def distinct(text: np.ndarray, h: np.ndarray, n: int = n) -> tuple[np.ndarray, np.ndarray]:
            """Different elements of each text, and how often its most frequent one occurs."""
            key = (text.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
            key.sort()
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(key)))
            doc = (key[at] >> np.uint64(48)).astype(np.int64)
            most = np.zeros(n, np.int64)
            np.maximum.at(most, doc, count)
            return np.bincount(doc, minlength=n), most

        kinds_of_word, top_word = distinct(of, hashes)
        text, grams = shingles(hashes, first, 5)
        kinds_of_gram, top_gram = distinct(text, grams)
        n_grams = np.maximum(np.bincount(text, minlength=n), 1)
        letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 3], 1)
        total = np.maximum(size, 1)
        out[low:high] = np.stack(
            [
                np.log1p(n_words),
                mean,
                np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0)),
                kinds[:, 0] / letters,
                kinds[:, 2] / total,
                kinds[:, 5] / some,
                np.minimum(kinds[:, 6] / some, 3.0),
                kinds[:, 4] / some,
                np.log1p(lines) - np.log1p(n_words),
                kinds_of_word / some,
                np.log1p(kinds_of_word) / np.log1p(some),
                top_word / some,
                kinds_of_gram / n_grams,
                top_gram / n_grams,
                (n_words == 0).astype(float),
                (n_words < 20).astype(float),
            ],
            axis=1,
        )
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; (weights, intercept) for unscaled columns."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / sd, -8, 8)])
    keep = np.full(z.shape[1], ridge)
    keep[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[1:] / sd, float(w[0] - (w[1:] * mean / sd).sum())


def classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """A function from a text column to the log-odds of good quality; None if labels hold no two classes.

    A bounded sample of labelled documents is sent as rows of figures, never as texts.
    """
    python_workers(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    total = known.count()
    if not total:
        return None
    if total > sample_rows:
        known = known.where(unit(F.xxhash64(F.lit(5), "doc_id")) < sample_rows / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = figures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["u", "y", "x"])

    rows = lookup(docs.select("doc_id", "text"), cut(known), ["doc_id"], "inner").select(F.xxhash64("doc_id", "text").alias("u"), "y", "text")
    # A doc_id may stand in many rows, so what comes to the driver is bounded by rows too.
    got = rows.mapInArrow(run, "u bigint, y double, x array<double>").orderBy("u", "y").limit(2 * sample_rows).toPandas()
    if got.empty or got["y"].round().nunique() < 2:
        return None
    w, b = _fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy())
    mean, sd = (f(np.stack(got["x"].to_numpy()), axis=0) for f in (np.mean, np.std))
    reach = 8 * np.maximum(sd, 1e-6)

    @F.pandas_udf("double")
    def log_odds(text: pd.Series) -> pd.Series:
        x = figures(pa.array(text, pa.large_string()))
        return pd.Series(np.clip(x, mean - reach, mean + reach) @ w + b)

    return log_odds


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    inside = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(inside / (1 - inside))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior observations worth of a group's parent, by moments of the group rates around ``mean``."""
    rate = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("within"),
    ).first()
    if not row["n"]:
        return 1.0
    between = max((row["spread"] - row["chance"]) / row["n"], 1e-6)
    return float(min(max(row["within"] / row["n"] / between - 1, 1.0), 1e6))


def site_rates(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(rows of source and lang with host and path posteriors, the global rate) from rows with p.

    ``evidence`` has source, lang and p. Sums are combined before the shuffle, so a hot host costs
    no task more than its partial sums.
    """
    paths = cut(evidence.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = total["s"] / total["n"] if total["n"] else 0.5
    k_host = _strength(hosts, F.lit(rate))
    hosts = cut(hosts.select(F.col("source").alias("_host"), ((k_host * rate + F.col("s")) / (k_host + F.col("n"))).alias("host_rate")))
    paths = cut(lookup(paths, hosts, F.col("source").eqNullSafe(F.col("_host")), "inner").drop("_host"))
    k_path = _strength(paths, F.col("host_rate"))
    rates = paths.select(
        F.col("source").alias("_source"),
        F.col("lang").alias("_lang"),
        "host_rate",
        F.col("n").alias("_n"),
        F.col("s").alias("_s"),
        F.lit(k_path).alias("_k"),
        ((k_path * F.col("host_rate") + F.col("s")) / (k_path + F.col("n"))).alias("path_rate"),
    )
    return cut(rates), rate


def _combined(rows: DataFrame, rates: DataFrame, rate: float) -> DataFrame:
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang"))
    others = (F.col("_k") * F.col("host_rate") + F.col("_s") - _logistic(F.col("_odds"))) / (F.col("_k") + F.col("_n") - 1)
    odds = F.col("_odds") + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    joined = lookup(rows, rates, same, "inner").withColumn("path_rate", others)
    return joined.withColumn("score", _logistic(odds)).drop("_source", "_lang", "_n", "_s", "_k")


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Per row: doc_id, classifier probability, host and path posterior rates, combined score, keep."""
    log_odds = classifier(docs, labels, **options)
    odds = F.lit(10.0) if log_odds is None else log_odds("text")
    rows = cut(docs.select("doc_id", "source", "lang", odds.alias("_odds")))
    rates, rate = site_rates(rows.withColumn("p", _logistic(F.col("_odds"))))
    p = _logistic(F.col("_odds")).alias("classifier")
    return _combined(rows, rates, rate).select("doc_id", p, "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns; texts stay in their partitions.

    The classifier runs once to gather the sites' rates and once more where rows are decided,
    which is cheaper than moving texts to their scores.
    """
    log_odds = classifier(docs, labels, **options)
    if log_odds is None:
        return docs
    rates, rate = site_rates(docs.select("source", "lang", _logistic(log_odds("text")).alias("p")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, "source", "lang", log_odds("text").alias("_odds"))
    return _combined(rows, rates, rate).where(F.col("score") >= threshold).select("_row.*")
