"""Shards against a plain reckoning of every column, on odd rows, clashing names and from a foreign folder."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

from quern.llm import sharding

ROOT = Path(__file__).resolve().parents[2]


def plain(rows, bits=6):
    """Rows (doc_id, size, crc, curve) in order; bins by value, for dimensions with few values or numbers by their own edges."""
    out = []
    names = [sorted({r[i] for r in rows if r[i] is not None}, key=lambda v: v.encode()) for i in (3, 2)]
    assert all(len(n) <= 64 for n in names)
    chars = sorted(len(r[1] or "") for r in rows)
    edges = sorted({float(chars[max(0, -(-len(chars) * i // 64) - 1)]) for i in range(1, 64)})
    for r in rows:
        bins = [[0 if r[i] is None else n.index(r[i]) for i, n in zip((3, 2), names, strict=True)] + [sum(e < len(r[1] or "") for e in edges)]]
        text = r[1]
        out.append((r[0], len((text or "").encode()) + 8, None if text is None else zlib.crc32(text.encode()), int(sharding.hilbert_index(np.array(bins), bits)[0]), text))
    lead = {}
    for r in out:
        lead[r[4]] = min(lead.get(r[4], r[3]), r[3])
    return [(a, b, c, lead[t], t) for a, b, c, _, t in out]


def test_every_column_equals_a_plain_reckoning(docs_of):
    rng = random.Random(4)
    rows = [(i, "w" * rng.randrange(0, 400), rng.choice(["en", "fr", None]), f"https://site{rng.randrange(20):02d}.example") for i in range(500)]
    rows += [(1000 + i, "same text", rng.choice(["en", "fr"]), f"https://site{i % 20:02d}.example") for i in range(60)]
    rows += [(2000, None, None, None), (2000, None, "en", "https://site01.example"), (None, "w", "en", "https://site01.example")]
    got = [r.asDict() for r in sharding.digest(docs_of(rows)).collect()]
    want = plain(rows)
    n = len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["curve"]) for r in got) == Counter(w[:4] for w in want)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    low = lambda x: (x is not None, x or 0)
    placed = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [(p["curve"], low(p["text_crc32"])) for p in placed] == sorted((p["curve"], low(p["text_crc32"])) for p in placed)
    for s in range(24):
        first, end = -(-s * n // 24), -(-(s + 1) * n // 24)
        assert [(p["shard"], p["slot"]) for p in placed[first:end]] == [(s, k) for k in range(end - first)]
    shards = defaultdict(set)
    for p in placed:
        if 1000 <= (p["doc_id"] or 0) < 1060:
            shards["same"].add(p["shard"])
    assert max(shards["same"]) - min(shards["same"]) <= 60 // (n // 24) + 1  # a group is one run of the order


def test_strings_with_a_common_head_have_bins_of_their_own(spark):
    rows = spark.createDataFrame([(f"https://site{i % 20:02d}.example",) for i in range(400)], "d0 string")
    assert rows.select(*[b.alias("b") for b in sharding._bins(rows, ["d0"], 64)]).distinct().count() == 20
    rows = spark.createDataFrame([(f"https://site{i:04d}.example",) for i in range(1000)] * 2 + [("https://hot",)] * 1000, "d0 string")
    by_bin = Counter(r[0] for r in rows.select(*[b.alias("b") for b in sharding._bins(rows, ["d0"], 16)]).collect())
    assert len(by_bin) >= 11 and sorted(by_bin.values())[-2] <= 2 * 3000 / 16


def test_clashing_names_and_empty_tables(docs_of):
    docs = docs_of([(1, "a"), (2, None)]).selectExpr("*", "1 as curve", "2 as Shard", "3 as text_hash")
    out = sharding.sharded(docs)
    assert out.columns == [*docs.columns, "curve_", "shard_"] and out.count() == 2
    assert sharding.sharded(docs.limit(0)).count() == 0 and sharding.digest(docs).count() == 2


def test_it_runs_from_a_foreign_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from quern.session import local_session\n"
        "from quern.llm import sharding\n"
        "s = local_session(2, 2)\n"
        "d = s.createDataFrame([(1, 'a', 'en', 's', 1)], 'doc_id long, text string, lang string, source string, n_chars long')\n"
        "assert len(sharding.digest(d).collect()) == 1\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
