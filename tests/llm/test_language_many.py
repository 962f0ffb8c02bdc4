"""Language ID with very many languages: the fit stays bounded and still tells them apart."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np

from quern.llm import language


def sample(languages, each, seed=1):
    """Texts of artificial languages, each with n-grams of its own among common ones."""
    rng = np.random.default_rng(seed)
    grams, langs = [], []
    for c in range(languages):
        own = rng.choice(400_000, 500, replace=False)
        for _ in range(each):
            codes = np.concatenate((rng.choice(own, 200, replace=False), rng.choice(3_000, 200, replace=False)))
            grams.append(np.unique(codes).astype(np.int64))
            langs.append(f"l{c:03d}")
    return grams, langs


def right(model, grams, langs):
    names, known, matrix = model
    score = []
    for g in grams:
        at = np.searchsorted(known, g.astype(np.uint64))
        at = np.minimum(at, len(known) - 1)
        score.append(matrix[at[known[at] == g.astype(np.uint64)]].sum(0).argmax())
    return np.mean([names[i] == x for i, x in zip(score, langs, strict=True)])


def test_three_hundred_languages_fit_within_bounds():
    grams, langs = sample(300, 20)
    tracemalloc.start()
    began = time.process_time()
    model = language.fit(grams, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900e6 and time.process_time() - began < 120
    assert model[2].size <= language.MODEL_CELLS
    assert right(model, grams[::7], langs[::7]) > 0.97


def test_few_languages_have_all_their_landmarks_and_n_grams():
    grams, langs = sample(4, 80)
    names, known, matrix = language.fit(grams, langs)
    first = [g for c in range(4) for g in grams[c * 80 : c * 80 + language.LANDMARKS]]
    assert len(known) == len(np.unique(np.concatenate(first))) and matrix.shape[1] == 4
    assert right((names, known, matrix), grams, langs) == 1
