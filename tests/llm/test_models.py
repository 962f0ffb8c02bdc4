"""Fitted operators against plain reckonings: the field by enumeration, the kernel by its matrix, own evidence left out."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import language, neardup, personal, quality


def test_field_equals_enumerated_segmentations():
    rng = random.Random(3)
    for text in ("70.23.22.57", "+1 (743) 555-3824", "12 345 678 90", "ab@cd.ef", "4465758382889437"):
        zone = personal.Zone(text, 0, len(text))
        weights = {(k, f): rng.uniform(-1, 1) for _, _, fs in zone.segments for f in fs for k in range(4)}
        scored = zone.scored(weights)
        totals = {}
        for size in range(4):
            for chosen in itertools.combinations(range(len(scored)), size):
                spans = sorted((scored[c][0], scored[c][1]) for c in chosen)
                if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
                    totals[chosen] = sum(scored[c][3] for c in chosen)
        z = math.log(sum(math.exp(v) for v in totals.values()))
        posterior, log_z = zone.marginals(scored)
        assert log_z == pytest.approx(z)
        for c in range(len(scored)):
            assert posterior[c] == pytest.approx(sum(math.exp(v - z) for chosen, v in totals.items() if c in chosen))
        assert tuple(sorted(zone.best(scored))) == max(totals, key=totals.get)


def test_scores_equal_a_plain_kernel_ridge():
    rng = random.Random(1)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "stuvwx"}
    rows = [(lang, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(6))) for lang, a in alphabets.items() for _ in range(8)]
    sets = [c for _, t in rows for _, _, _, c in language.presence(pa.array([t], pa.large_string()), 3)]
    names, grams, matrix = language.fit(sets, [lang for lang, _ in rows], landmarks=8, ridge=1e-3)

    def plain(text):  # the n-grams of the text with other characters as one space
        return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    bags = [plain(t) for _, t in rows]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in bags] for a in bags])
    # With every training text a landmark, Nyström is exact: ridge in the kernel's own feature space.
    values, vectors = np.linalg.eigh(kernel)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = kernel @ root
    y = np.where(np.array([[lang == n for n in names] for lang, _ in rows]), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + 1e-3 * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    for text in ("abc def", "ghi xyz stu", "dd ee"):
        code = next(language.presence(pa.array([text], pa.large_string()), 3))[3]
        known = np.isin(code, grams)
        got = matrix[np.searchsorted(grams, code[known])].sum(axis=0) / math.sqrt(len(code))
        k = np.array([len(plain(text) & b) / math.sqrt(len(plain(text)) * len(b)) for b in bags])
        assert got == pytest.approx(k @ root @ w, abs=1e-6)


def test_repeated_rows_do_not_fill_the_driver(spark, docs_of):
    docs = docs_of([(1, f"some text {i}") for i in range(300)] + [(2, "other words")])
    model = language.train(docs, quota=500, most=50)
    assert model is not None and model[0] == ["en"]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels, sample_rows=10).columns == docs.columns


def test_own_evidence_counts_once(spark):
    rows = spark.createDataFrame([("a", "en", x) for x in (0.0, 1.0, 2.0)], "source string, lang string, _odds double")
    p = [1 / (1 + math.exp(-x)) for x in (0.0, 1.0, 2.0)]
    rates, rate = quality.site_rates(rows.withColumn("p", quality._logistic(F.col("_odds"))))
    k, host = rates.first()["_k"], rates.first()["host_rate"]
    got = {r["_odds"]: r["path_rate"] for r in quality._combined(rows, rates, rate).collect()}
    for i, x in enumerate((0.0, 1.0, 2.0)):
        assert got[x] == pytest.approx((k * host + sum(p) - p[i]) / (k + 2))


def test_a_hot_text_is_dealt_in_copies(spark):
    texts = spark.createDataFrame([(bytes([i]), f"a b c d e f g h {'x' * (i // 20)}") for i in range(60)], "h binary, text string")
    pairs = spark.createDataFrame([(bytes([i]), bytes([0])) for i in range(1, 60)], "a binary, b binary")
    one, many = ({(bytes(r["a"]), round(r["similarity"], 6)) for r in neardup.verified(pairs, texts, 5, 0.5, hot).collect()} for hot in (1000, 7))
    assert one == many and len(one) > 10
