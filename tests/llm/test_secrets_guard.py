"""Secret scans of texts that have no digit, ``=`` or ``:``."""

from __future__ import annotations

from quern.llm import secrets


def test_letters_only_hex_runs_are_found(docs_of):
    runs = ["deadbeef" * 3, "so " + "f" * 30 + " it goes", "x " + "a" * 23, "AKIA" + "Q" * 16 + " and " + "abcdef" * 4]
    got = {r["doc_id"]: (r["n_access"], r["n_hex"], r["spans"]) for r in secrets.digest(docs_of(list(enumerate(runs)))).collect()}
    assert got == {0: (0, 1, "hex:0:24"), 1: (0, 1, "hex:3:33"), 2: (0, 0, ""), 3: (1, 1, "access:0:20,hex:25:49")}
