"""Fill-in-middle transformation by bit parallelism over big integers.

A text's UTF-8 bytes are translated, by ``bytes.translate``, into class masks: one big integer for line
feeds, one for the bytes that begin a code point. Shifted boolean operations mark where units (lines with their
line feed) end, ``bit_count`` gives their number, and the end of the unit of a given rank is
selected by recursive halving: the lower half's count says in which half the bit is. Each step halves
the integer, so a selection costs as much as one pass over the mask. Two cuts part the text into prefix, middle and suffix;
code points before a cut are the bits of the second mask below it.

Cuts, form and order follow from a hash of the seed and doc_id alone, so reruns agree. Everything happens
within a row: nothing is shuffled. ``restored`` puts the text together again from output and form, in columns.

Defined results: a null text is an empty one; empty texts and texts that hold a sentinel stay plain, so that
outputs can be taken apart without doubt; a null doc_id counts as an empty string in the hash; texts are cut whole, however long; rows
that repeat are each transformed, alike; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import python_workers

SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _class_table(chosen: set[int]) -> bytes:
    return bytes(ord("1") if b in chosen else ord("0") for b in range(256))


FEEDS = _class_table({10})
HEADS = _class_table({b for b in range(256) if b & 0xC0 != 0x80})


def mask(raw: bytes, table: bytes) -> int:
    """The bytes of a class as bits of one integer; byte i is bit i."""
    return int(raw[::-1].translate(table), 2) if raw else 0


def unit_ends(feeds: int, size: int) -> int:
    """Bits of the last bytes of units: line feeds, and the last byte of the text."""
    starts = (feeds << 1 | 1) & ((1 << size) - 1)  # the first byte, and what follows a line feed
    return starts >> 1 | (1 << size >> 1)


def select(bits: int, rank: int, size: int) -> int:
    """The place of the bit of a 0-based rank among those set, by recursive halving."""
    at = 0
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, size = low, half
        else:
            bits, rank, at, size = bits >> half, rank - n, at + half, size - half
    return at


def parts(raw: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """(number of units, byte where the prefix ends, byte where the middle ends)."""
    ends = unit_ends(mask(raw, FEEDS), len(raw))
    n = ends.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = lambda k: select(ends, k - 1, len(raw)) + 1 if k else 0
    return n, cut(a), cut(b)


def code_points(heads: int, end: int) -> int:
    return (heads & ((1 << end) - 1)).bit_count()


def _draws(seed: int) -> list[Column]:
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per row: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    python_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        raw = text.encode()
        n, a, b = parts(raw, h1, h2)
        if not raw or h3 % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
        heads = mask(raw, HEADS)
        before = code_points(heads, a)
        spm = h4 % 100 < spm_percent
        output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        return n, "spm" if spm else "psm", before, code_points(heads, b) - before, output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [one(*r) for r in zip(*[batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4")], strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_draws(seed))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made of."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """Per row: n, form, sizes of prefix and middle, and the digests of output and restored text."""
    sha = lambda c: F.sha2(c, 256)
    rows = transformed(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256")
    )
