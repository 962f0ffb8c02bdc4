"""Labels and scores of the license scan against plain votes by diagonal."""

from __future__ import annotations

import random
import re

import pytest

from quern.llm import licenses
from tests.llm.test_corpus import lower

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text: str, shift: int = 3, coverage: float = 0.6) -> tuple[str, float]:
    """Labels and score: every pair of words votes for a diagonal; near diagonals are one run."""
    w = WORD.findall(lower(text))
    labels, score = set(), 0.0
    for tid, (name, phrase) in enumerate(licenses.ALL):
        t = phrase.split()
        votes: dict[int, set[int]] = {}
        for i in range(len(w) - 1):
            for j in range(len(t) - 1):
                if (w[i], w[i + 1]) == (t[j], t[j + 1]):
                    votes.setdefault(i - j, set()).add(j)
        runs: list[list[int]] = []
        for d in sorted(votes):
            if runs and d - runs[-1][-1] <= shift:
                runs[-1].append(d)
            else:
                runs.append([d])
        base = tid < len(licenses.PHRASES)
        for run in runs:
            pairs = set().union(*[votes[d] for d in run])
            first, last = min(d + min(votes[d]) for d in run), max(d + max(votes[d]) + 1 for d in run)
            cover = len(pairs) / (len(t) - 1)
            held = cover >= coverage and last - first + 1 <= 1.5 * len(t)
            whole = base and any(len(votes[d]) == len(t) - 1 for d in run)
            if whole or (held and not base):
                labels.add(name)
            if whole or held:
                score = max(score, 1.0 if whole else cover)
    return ",".join(sorted(labels)), score


def test_labels_equal_plain_votes(docs_of):
    rng = random.Random(6)
    texts = []
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(licenses.ALL)[1].split()
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randrange(0, 2)] = [rng.choice(["the", "zz", "software", "license"])] * rng.randrange(0, 3)
            words += [rng.choice(["x", "this", "of", "license"]) for _ in range(rng.randrange(0, 6))] + t
        texts.append(" ".join(x.upper() if rng.random() < 0.2 else x for x in words))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.digest(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        labels, score = plain(text)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), text
