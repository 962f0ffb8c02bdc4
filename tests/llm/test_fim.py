"""Fill-in-middle against a plain cut into lines, bit selection by itself, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from quern.llm import fim, queries

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, fim_percent=100, spm_percent=50):
    text = text or ""
    told = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = LINES.findall(text)
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(2)
    out = [(i, "".join(rng.choice(["a", "\n", "\r", "é", "日本", "😀", "<", "S>", " ", " b"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    out += [(1000, None), (1001, ""), (1002, "\n"), (1003, "\n" * 50), (1004, "no feed"), (1005, "a<P>b\nc"), (1006, "x<S\ny>S>"), (1007, "<M>"), (None, "a\nb\nc\n"), (1, "twice\n"), (1, "twice\n")]
    return out + [(2000, "line é\n" * 60_000), (2001, "x" * 400_000), (2002, "\n" * 300_000 + "end")]


@pytest.mark.parametrize("percents", [(100, 50), (60, 0), (0, 100)])
def test_outputs_equal_plain_cuts(spark, docs_of, percents):
    docs = docs_of(rows()).withColumnRenamed("label", "output").withColumnRenamed("size", "n")
    made = fim.transformed(docs, 7, *percents).withColumn("back", fim.restored(fim.F.col("form"), fim.F.col("output"))).collect()
    key = lambda r: (str(r[0]), str(r[1:]))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made), key=key)
    want = sorted(((i, *plain(i, t, *percents), t or "") for i, t in rows()), key=key)
    assert got == want


def test_bits_are_selected_by_rank():
    rng = random.Random(5)
    for size in (1, 2, 3, 63, 64, 65, 1000):
        places = sorted(rng.sample(range(size), rng.randrange(1, size + 1)))
        bits = sum(1 << p for p in places)
        assert [fim.select(bits, k, size) for k in range(len(places))] == places


def test_empty_table_and_columns(docs_of):
    got = fim.digest(docs_of([]))
    assert got.collect() == [] and got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_query_equals_duckdb(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    rel = con.sql(queries.ORACLES["op13_fill_in_middle"])
    got = queries.op13_fill_in_middle(spark, tables)
    assert set(rel.columns) == set(got.columns)
    assert sorted(map(str, map(tuple, got.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))
