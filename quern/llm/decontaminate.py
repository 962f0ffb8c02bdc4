"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of words; a symbol is a pair of neighbouring words. The CGK embedding
reads a window by a walk that puts out the symbol it stands on and goes on by 0 or 1 as a random
function of step and symbol says, so that a small edit distance becomes a small Hamming distance.

1. Every item has a window length (about three quarters of its size, so its windows are item-sized)
   and gives windows at all of its offsets. Several times, a walk of its own and a few
   sampled steps give each window a key. A step that is always sampled is the first: so a
   document's window is looked at only where it begins on a symbol that some item has. How many steps
   are sampled, how far ahead, and how often, follows from the item's size: ``HORIZON`` is set so that
   items with as many edits as are allowed are found with a probability of 0.98 at least.
2. A document's windows walk the same way and leave as soon as what they have sampled so far
   begins no item's key. Those that meet a key are candidates.
3. A candidate is verified by the exact edit distance, in words, of the whole item to the best
   stretch of the document around the place: at most ``share`` of the item's words. Stretches that hold
   fewer of the item's symbols than so many edits can leave are passed over, as they can't match.

Items so short that no edit is allowed are looked up by the hash of all their words. Items are taken in blocks
of bounded size, so what is sent to tasks doesn't grow with the benchmark; documents are read once a
block of ``BLOCK_WORDS`` words and never shuffled. Verification holds ``CELLS`` cells at a time.

Defined results: null texts match nothing, nor do items without words; texts and items are taken whole, however
long; of equally near passages of a text the first counts; items that repeat are reported each; rows that
repeat are scanned each; empty tables match nothing; further columns are carried by ``keep_clean`` and
ignored by ``matches``. Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.bytetext import mix, slices, words
from quern.llm.common import python_workers

SHARE = 0.2
#: (items up to so many words, steps ahead, sampled steps, repeats)
HORIZON = ((8, 2, 1, 4), (1 << 62, 8, 2, 8))
BLOCK_WORDS = 1_000_000
FIRST_BITS = 20
PREFIX_BITS = 16
SLICE_BYTES = 1 << 21
CELLS = 1 << 20

_U = np.uint64


def symbols(hashes: np.ndarray) -> np.ndarray:
    """A symbol for every word but the last: its pair with the next one."""
    return mix(hashes[:-1] * _U(0x9FB21C651E98DF25) + hashes[1:])


def window_length(n_words: int) -> int:
    """Window length, in symbols, of items of a size: one of a few lengths, for all items to share walks."""
    most = max(3, (n_words - 1) * 3 // 4)
    lengths = [3]
    while lengths[-1] <= most:
        lengths.append(lengths[-1] * 4 // 3 + 1)
    return max(x for x in lengths if x <= most)


def _plan(length: int, repeat: int, ahead: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """(multiplier of each step, the sampled steps) of a repeat's walk for windows of a length."""
    steps = min(2 * length - 2, ahead)
    rng = np.random.default_rng([length, repeat])
    multipliers = rng.integers(0, 2**63, steps + 1, dtype=np.uint64) * _U(2) + _U(1)
    return multipliers, np.sort(rng.choice(np.arange(1, steps + 1), min(sampled, steps), replace=False))


def _walked(syms: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, repeat: int, shape: tuple[int, int], tables: list[np.ndarray] | None):
    """(key, window) of the windows that begin at ``starts``; of a text, symbols end at ``ends``.

    ``tables`` are bitmaps of the keys' beginnings; a window leaves where its own isn't among them.
    """
    multipliers, sampled = _plan(length, repeat, *shape)
    key = mix(syms[starts] ^ _U(repeat * 1_000_003 + length))
    alive = np.arange(len(starts))
    at, end = starts.copy(), np.minimum(starts + length, ends)
    pad = _U(0x2545F4914F6CDD1D)
    last = len(syms) - 1
    prefixes = [key]
    done = 0
    for k, step in enumerate(sampled):
        for j in range(done, step):
            here = syms[np.minimum(at, last)]
            at += ((here * multipliers[j]) >> _U(63)).astype(np.int64)
        done = step
        key = mix(key * _U(0xD6E8FEB86659FD93) + np.where(at < end, syms[np.minimum(at, last)], pad))
        if tables is None:
            prefixes.append(key)
        else:
            stay = tables[k][(key >> _U(64 - PREFIX_BITS)).astype(np.int64)]
            alive, key, at, end = alive[stay], key[stay], at[stay], end[stay]
    return (key, alive) if tables is not None else prefixes


class Index:
    """Keys of a block of items: what a task needs to find and verify them."""

    def __init__(self, item_ids: list, texts: list[str], share: float = SHARE) -> None:
        self.ids, self.items, self.share = [], [], share
        for low, _, raw, offsets in slices(pa.array(texts, pa.large_string())):
            hashes, _, _, first = words(raw, offsets)
            for i in range(len(first) - 1):
                if first[i + 1] > first[i]:
                    self.ids.append(item_ids[low + i])
                    self.items.append(hashes[first[i] : first[i + 1]])
        self.first = np.zeros(1 << FIRST_BITS, bool)
        by_plan: dict[tuple, list[int]] = {}
        whole: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            if int(len(item) * share) == 0 or len(item) < 2:
                whole.setdefault(len(item), []).append(i)
                continue
            self.first[(symbols(item) >> _U(64 - FIRST_BITS)).astype(np.int64)] = True
            shape = next(h[1:] for h in HORIZON if len(item) <= h[0])
            by_plan.setdefault((window_length(len(item)), *shape), []).append(i)
        self.whole = []
        for n, members in sorted(whole.items()):
            key = np.array([_whole_key(self.items[i], n)[0] for i in members])
            order = np.argsort(key, kind="stable")
            self.whole.append((n, key[order], np.array(members, np.int32)[order]))
        self.plans = []
        for (length, ahead, sampled, repeats), members in sorted(by_plan.items()):
            syms = [symbols(self.items[i]) for i in members]
            all_syms, base = np.concatenate(syms), np.cumsum([0] + [len(s) for s in syms])
            item = np.repeat(np.array(members, np.int32), [len(s) for s in syms])
            offset = np.concatenate([np.arange(len(s), dtype=np.int32) for s in syms])
            begin, end = np.arange(len(all_syms)), np.repeat(base[1:], [len(s) for s in syms])
            for repeat in range(repeats):
                prefixes = _walked(all_syms, begin, end, length, repeat, (ahead, sampled), None)
                tables = []
                for p in prefixes[1:]:
                    tables.append(np.zeros(1 << PREFIX_BITS, bool))
                    tables[-1][(p >> _U(64 - PREFIX_BITS)).astype(np.int64)] = True
                order = np.argsort(prefixes[-1], kind="stable").astype(np.int32)
                self.plans.append((length, repeat, (ahead, sampled), tables, prefixes[-1][order], order, item, offset))

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (text, item, word at which the item would begin) that some repeat proposes."""
        if len(hashes) < 2 or not self.plans:
            return np.zeros((0, 3), np.int64)
        syms = symbols(hashes)
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))[:-1]
        begins = np.flatnonzero(self.first[(syms >> _U(64 - FIRST_BITS)).astype(np.int64)])
        begins = begins[begins + 1 < first[text_of[begins] + 1]]  # a pair of words of one text
        ends = first[text_of[begins] + 1] - 1
        found = []
        for length, repeat, shape, tables, keys, order, item, offset in self.plans:
            key, window = _walked(syms, begins, ends, length, repeat, shape, tables)
            which, at = _equal(keys, key)
            if len(which):
                begin, at = begins[window[which]], order[at]
                found.append(np.stack([text_of[begin], item[at], begin - offset[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _short(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """The first place of every item that must stand word for word: (text, item) to (0, last word)."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, keys, item in self.whole:
            key = _whole_key(hashes, n)
            which, at = _equal(keys, key)
            inside = which + n <= first[text_of[which] + 1]
            which, at = which[inside], at[inside]
            pair = np.stack([text_of[which], item[at]], axis=1)
            pair, place = np.unique(pair, axis=0, return_index=True)
            ends = which[place] + n - 1 - first[text_of[which[place]]]
            best.update(((t, i), (0, e)) for (t, i), e in zip(pair.tolist(), ends.tolist(), strict=True))
        return best

    def verified(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Per text and item the best (text, item, distance, last word), where the distance is within ``share``."""
        rows = self.candidates(hashes, first)
        best = self._short(hashes, first)
        for i in np.unique(rows[:, 1]):
            item = self.items[i]
            n = len(item)
            most = int(n * self.share)
            near = rows[rows[:, 1] == i]
            spot = (near[:, 2] - first[near[:, 0]]) // (most + 1) * (most + 1)  # neighbouring places share a stretch
            near = np.unique(np.stack([near[:, 0], spot], axis=1), axis=0)
            width = n + 3 * most + 2
            own = np.unique(symbols(item))
            step = max(1, CELLS // width)
            for low in range(0, len(near), step):
                text, spot = near[low : low + step].T
                begin = first[text] + spot - most
                at = begin[:, None] + np.arange(width)
                inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
                there = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], _U(0))
                left = np.isin(symbols(there.reshape(-1)), own)
                held = np.append(left, False).reshape(there.shape)[:, :-1].sum(axis=1)
                may = held >= len(item) - 1 - 2 * most  # an edit changes two pairs of words at most
                text, begin, there = text[may], begin[may], there[may]
                if not len(text):
                    continue
                distance, last = edit_distance(item, there)
                for t, d, e in zip(text.tolist(), distance.tolist(), (begin + last - first[text]).tolist(), strict=True):
                    if d <= most and (d, e) < best.get((t, int(i)), (n + 1, 0)):
                        best[t, int(i)] = (d, e)
        return [(t, i, d, e) for (t, i), (d, e) in sorted(best.items())]


def _whole_key(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words."""
    key = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        key = mix(key * _U(0x9FB21C651E98DF25) + hashes[j : j + len(key)])
    return key


def _equal(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``key``, place in the sorted ``keys``) of all equal pairs."""
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    count = high - low
    which = np.repeat(np.arange(len(key)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]


def edit_distance(item: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of ``item`` to any part of each row of ``stretches``, and where the part ends."""
    columns = np.arange(stretches.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(stretches), len(columns)), np.int32)
    for i, word in enumerate(item):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, :-1] + (stretches != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - columns, axis=1) + columns
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end - 1


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list, list[str]]]:
    """Items with their texts, a bounded block at a time."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // (block_words * 6)) + 1
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        if got:
            yield [r["item_id"] for r in got], [r["text"] for r in got]


def _scan(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, int, int, int]]:
    for low, _, raw, offsets in slices(batch.column("text"), SLICE_BYTES):
        hashes, _, _, first = words(raw, offsets)
        for t, i, d, e in index.verified(hashes, first):
            yield low + t, i, d, e


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item found in it: edit distance, words of the item, last word of the passage."""
    spark = docs.sparkSession
    python_workers(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_words int, last_word bigint"
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(Index(ids, texts, share))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                found = list(_scan(batch, own))
                rows = [t for t, *_ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array([own.ids[i] for _, i, _, _ in found], id_type),
                        pa.array([d for _, _, d, _ in found], pa.int32()),
                        pa.array([len(own.items[i]) for _, i, _, _ in found], pa.int32()),
                        pa.array([e for *_, e in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "distance", "item_words", "last_word"],
                )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item; texts stay in their partitions."""
    spark = docs.sparkSession
    python_workers(spark)
    for ids, texts in _blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(Index(ids, texts, share))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for t, *_ in _scan(batch, index.value):
                    keep[t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
