"""Secret spans and links by fuzz against plain loops, and texts with very many matches."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

from quern.llm import secrets
from tests.llm.test_corpus import secret_base

REACH = 200


def linked(text: str) -> list[tuple[int, int, str, int]]:
    """Base spans, and weak ones that some scope completes, by looking at every scope of a text."""
    base = secret_base(text)
    weak = []
    for ord_, (kind, pattern) in enumerate((("ident", secrets.IDENT), ("endpoint", secrets.ENDPOINT), ("blob", secrets.BLOB)), 3):
        weak += [(m.start(), ord_, kind, m.end()) for m in re.finditer(pattern, text)]
    weak = [w for w in weak if not any(s < w[3] and w[0] < e for s, _, _, e in base)]
    more = set()
    for scope in range(-1, len(text) // REACH + 1):
        inside = [x for x in base + weak if scope * REACH <= x[0] < (scope + 2) * REACH]
        roles = {secrets.ROLE[x[2]] for x in inside}
        for x in inside:
            need = {"blob": {"id"}, "ident": {"secret"}, "endpoint": {"id", "secret"}}.get(x[2])
            if need and need <= roles:
                more.add(x)
    return sorted(base + sorted(more))


def test_spans_and_links_by_fuzz(docs_of):
    rng = random.Random(9)
    bits = ["password", "Token", "api_key", "user_id", "client-id", "https://", "s3://b.c", "AKIA", "QWERTY12345", "deadbeef", "=", ":", " ", "'", "é日", "x", "0"]
    texts = ["".join(rng.choice("abcdef0123456789=:AKI ") for _ in range(rng.randrange(0, 90))) for _ in range(400)]
    texts += ["".join(rng.choice("af=:AKI ") * rng.randrange(1, 30) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 160))) for _ in range(400)]
    text_of = dict(enumerate(texts))
    for r in secrets.digest(docs_of(list(text_of.items()))).collect():
        text = text_of[r["doc_id"]]
        want = ",".join(f"{k}:{s}:{e}" for s, _, k, e in linked(text))
        assert r["spans"] == want, text
        n = Counter(k for _, _, k, _ in secret_base(text))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])


def test_work_is_in_proportion_to_matches(docs_of):
    def seconds(n: int) -> float:
        began = time.monotonic()
        row = secrets.digest(docs_of([(1, "token=abcdef1 " * n)])).first()
        assert row["n_assign"] == n and row["spans"].endswith(f"assign:{14 * (n - 1)}:{14 * n - 1}")
        return time.monotonic() - began

    seconds(10)
    few, many = seconds(6_000), seconds(48_000)
    assert many < 8 * max(few, 1.0)
