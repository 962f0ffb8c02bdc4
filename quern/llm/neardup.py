"""Near-duplicate classes by BagMinHash, banding and verified multiset overlap.

1. Equal texts are one: a text goes on as its digest, its smallest doc_id and a signature.
2. The signature is of the multiset of word 5-grams, weights being counts. Weights are discretised
   to dyadic levels [0,1), [1,2), [2,4), ...; a Poisson process of its own runs over each level
   of an element. Points of a level that an element fills only in part are split by halves, by
   the binary digits of their place, and kept where they lie below the weight. A component of
   the signature is the earliest of its points, so two components agree with a probability equal
   to the weighted Jaccard similarity. Points after an adaptive stop time can't count and are
   never made; a text whose components aren't all met by then goes on with twice the time.
3. Bands of the signature are buckets. Texts of a bucket are compared with its smallest text.
   Where buckets still span several components, all their texts are searched for further links by
   prefixes: shingles in one order, those of a single component first, then from rare to frequent.
   Two texts that reach the threshold share one of their first shingles, with enough left after it,
   so only texts met there are compared. A shingle that starts very many texts makes them a group,
   whose texts are compared in blocks of bounded size, those of sizes that fit with each other, by
   products of their incidence matrices. No link between components is lost.
4. A pair counts if the exact multiset overlap of its whole texts reaches the threshold. Components
   follow by contraction of verified links.

Defined results: equal texts share a class; texts without words (null ones count as one text) are
in a class by equality alone; texts are read whole, in slices, however long; a class is named by its
smallest doc_id, and a null one is never smallest; rows that repeat are rows of their own with the
same class; an empty table gives an empty table; further columns of the input are carried by ``keep_one`` and
ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.bytetext import mix, overlap, unit, weighted
from quern.llm.common import cut, lookup, python_workers, shelf
from quern.operators.identity import components as linked

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
BLOCK = 128
HOT = 256
LIST = 128
EARLIER = 32

Keep = Callable[[DataFrame], DataFrame]

_U = np.uint64


def bag_minhash(text: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n by m) of n weighted sets, given as rows (text, element, count) in order of text."""
    weight = np.bincount(text, count, n)
    stop = (np.log(m) + 3.0) / np.maximum(weight, 1.0)
    doc, seed, width, low, top = [text], [mix(element)], [np.ones(len(text))], [np.zeros(len(text))], [count]
    level = 1
    while (more := count > 1 << (level - 1)).any():
        doc.append(text[more])
        seed.append(mix(element[more] ^ _U(level << 50)))
        width.append(np.full(int(more.sum()), float(1 << (level - 1))))
        low.append(width[-1])
        top.append(count[more])
        level += 1
    doc, state, width, low, top = (np.concatenate(x) for x in (doc, seed, width, low, top))
    due = -np.log(unit(state)) / (m * width)
    best_at = np.full(n * m, np.inf)
    best = np.zeros(n * m, np.uint64)
    open_ = np.flatnonzero(due <= stop[doc])
    while True:
        cells, times, values = [], [], []
        live = open_
        while len(live):
            point = mix(state[live] ^ _U(0xA5A5A5A5A5A5A5A5))
            part = width[live] > 1
            place = low[live] + np.where(part, np.floor(unit(mix(point)) * width[live] * (1 - 2.0**-52)), 0.0)
            met = place < top[live]
            cells.append(doc[live][met] * m + ((point >> _U(32)) % _U(m)).astype(np.int64)[met])
            times.append(due[live][met])
            values.append(point[met])
            state[live] = mix(state[live] + _U(0x632BE59BD9B4E019))
            due[live] += -np.log(unit(state[live])) / (m * width[live])
            live = live[due[live] <= stop[doc[live]]]
        if cells:
            cell, at, value = np.concatenate(cells), np.concatenate(times), np.concatenate(values)
            order = np.lexsort((value, at, cell))
            cell, at, value = cell[order], at[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
            cell, at, value = cell[first], at[first], value[first]
            sooner = at < best_at[cell]
            best_at[cell[sooner]], best[cell[sooner]] = at[sooner], value[sooner]
        short = np.isinf(best_at).reshape(n, m).any(axis=1) & (weight > 0)
        if not short.any():
            return best.reshape(n, m)
        stop[short] *= 2
        open_ = np.flatnonzero(short[doc] & (due <= stop[doc]))


def _signed(k: int, bands: int, rows: int):
    m = bands * rows
    salts = mix(np.arange(bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = batch.column("doc_id"), batch.column("h")
            for low, high, text, element, count in weighted(batch.column("text"), k):
                n = high - low
                sig = bag_minhash(text, element, count, n, m)
                keys = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * _U(0x9FB21C651E98DF25) + sig.reshape(n, bands, rows)[:, :, r] + salts)
                low_bits = (sig & _U(0xFF)).astype(np.uint8).view(np.int8)
                lists = lambda x, size, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, n),
                        h.slice(low, n),
                        pa.array(np.bincount(text, count, n).astype(np.int64)),
                        lists(low_bits, m),
                        lists(keys.view(np.int64), bands),
                    ],
                    names=["doc_id", "h", "weight", "sig", "bands"],
                )

    return run


def digest_of(text: Column) -> Column:
    """Identity of a text: 16 bytes; a null text is an empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signed_texts(docs: DataFrame, k: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per different text: h, smallest doc_id, weight, signature bytes and band keys."""
    python_workers(docs.sparkSession)
    rows_in = docs.select("doc_id", digest_of(F.col("text")).alias("h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h binary, weight bigint, sig array<tinyint>, bands array<bigint>"
    signed = rows_in.mapInArrow(_signed(k, bands, rows), schema)
    firsts = lambda c: F.first(c).alias(c)  # noqa: E731  the same for all rows of a text
    return signed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), firsts("weight"), firsts("sig"), firsts("bands"))


def _near(threshold: float, m: int) -> Column:
    """Like weights, and a signature within five deviations of the threshold: what is worth comparing first.

    Pairs passed over here stay in their buckets, and where those are torn they are compared exactly.
    """
    weights = F.col("weight_a"), F.col("weight_b")
    least = m * threshold - 5 * np.sqrt(m * threshold * (1 - threshold))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return (F.least(*weights) >= threshold * F.greatest(*weights)) & (agree >= int(least))


def _with_ends(pairs: DataFrame, of: DataFrame, hot: int = HOT, keep: Keep = cut) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``of`` (by h) for either end, as x_a and x_b.

    A text that is ``b`` in more than ``hot`` pairs is dealt in as many copies as spread them over tasks.
    """
    names = [c for c in of.columns if c != "h"]
    heavy = keep(pairs.groupBy("b").agg(F.ceil(F.count("*") / hot).cast("int").alias("_n")).where(F.col("_n") > 1))
    n = F.coalesce(F.col("_n"), F.lit(1))
    pairs = lookup(pairs, heavy, ["b"]).withColumn("_salt", F.pmod(F.xxhash64("a"), n).cast("int")).drop("_n")
    a = of.select(F.col("h").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    b = of.select(F.col("h").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    b = lookup(b, heavy, ["b"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    return pairs.join(a, "a").join(b, ["b", "_salt"]).drop("_salt")


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float, hot: int = HOT, keep: Keep = cut) -> DataFrame:
    """The pairs (a, b) of digests whose texts overlap by ``threshold``; ``texts`` has h and text."""

    @F.pandas_udf("double")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(overlap(pa.array(x, pa.large_string()), pa.array(y, pa.large_string()), k))

    both = _with_ends(pairs, texts, hot, keep).withColumn("similarity", same("text_a", "text_b"))
    return both.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")


def components(edges: DataFrame, keep: Keep = cut) -> DataFrame:
    """(h, comp) of every end of an edge (a, b): comp is the smallest h that it can reach."""
    return linked(edges, keep=keep).select(F.col("node").alias("h"), F.col("component").alias("comp"))


def _elements(k: int):
    """Texts to sets of 64-bit elements; the n-th time that a shingle occurs is an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, text, element, count in weighted(batch.column("text"), k):
                of = np.repeat(np.arange(len(text)), count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                value = mix(element[of] ^ (nth.astype(np.uint64) << _U(48)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(text[of], minlength=high - low))))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(low, high - low), lists], names=["h", "elements"])

    return run


def _shared(x: list[np.ndarray], y: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all sets of ``y``."""
    ex, ey = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(ex, ey)
    rx, ry = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.repeat(np.arange(len(y)), [len(v) for v in y])
    out = np.zeros((len(x), len(y)), np.float32)

    def places(elements: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, elements), len(both) - 1)
        known = both[at] == elements
        return at[known], rows[known]

    if len(both):
        (cx, rx), (cy, ry) = places(ex, rx), places(ey, ry)
        for low in range(0, len(both), columns):
            mx, my = np.zeros((len(x), columns), np.float32), np.zeros((len(y), columns), np.float32)
            for m, c, r in ((mx, cx, rx), (my, cy, ry)):
                here = (c >= low) & (c < low + columns)
                m[r[here], c[here] - low] = 1
            out += mx @ my.T
    return out


def _entries(sets: DataFrame, threshold: float) -> DataFrame:
    """Where the texts of ``sets`` (t, c, n, elements) may meet texts of other components: e, t, c, n, place, low, before.

    Elements have one order for all texts: those of a single component, then the others from rare to frequent.
    Two texts that reach the threshold hold their first common element within the first n - ceil(threshold * n) + 1
    of the longer one, and within a shorter stretch (``low``) of the other: overlap must still be possible after it.
    Elements of a single component are never common to a pair that counts, so they are places only.
    ``before`` has the text's last EARLIER elements before this one.
    """
    met = sets.select("t", "c", F.explode("elements").alias("e"))
    common = met.groupBy("e").agg(F.count("*").alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") != F.col("c1"))
    ranked = lookup(met.select("t", "e"), cut(common.select("e", "f")), ["e"], "inner").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("ranked"))
    n, alone = F.col("n"), F.col("n") - F.size("ranked")
    first = lambda share: (n - F.ceil(n * share - 1e-9) + 1).cast("int")
    rows = sets.select("t", "c", "n").join(ranked, "t").withColumn("alone", alone)
    rows = rows.withColumn("ranked", F.slice("ranked.e", F.lit(1), F.greatest(first(threshold) - F.col("alone"), F.lit(0))))
    near = lambda e, i: F.struct(e.alias("e"), F.slice("ranked", F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER))).alias("before"))
    rows = rows.select("t", "c", "n", "alone", F.posexplode(F.transform("ranked", near)))
    place = F.col("alone") + F.col("pos")
    return rows.select("col.e", "t", "c", "n", place.alias("place"), (place < first(2 * threshold / (1 + threshold))).alias("low"), "col.before")


def _met(listed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of text numbers that meet in a list, are of different components and can reach the threshold.

    Texts that share one of their last elements before this one have met there, where as much or more was left, or in
    the group of that element if its list is too long. So near copies meet once, not at each of their first elements.
    """
    long, short = (listed.select("e", *[F.col(c).alias(f"{c}_{s}") for c in ("t", "c", "n", "place", "low", "before")]) for s in "xy")
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    fits = (F.col("n_y") >= F.col("n_x") * threshold - 1e-9) & (left >= (F.col("n_x") + F.col("n_y")) * (threshold / (1 + threshold)) - 1e-6)
    shorter = F.struct("n_y", "t_y") < F.struct(F.col("n_x").alias("n_y"), F.col("t_x").alias("t_y"))
    new = ~F.arrays_overlap("before_x", "before_y")
    pairs = long.join(short.where("low_y"), "e").where((F.col("c_x") != F.col("c_y")) & shorter & fits & new)
    return pairs.select(F.col("t_x").alias("x"), F.col("t_y").alias("y")).distinct()


def _blockwise(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) of components among ``members`` (g, t, c, n, elements), each with each other of its group.

    Texts of a group are dealt to classes of size, of which only neighbours can reach the threshold, and classes to blocks.
    """
    kind = F.floor(F.log(F.col("n").cast("double")) / -np.log(threshold) + 1e-9).cast("int")
    members = members.withColumn("s", kind)
    sizes = members.groupBy("g", "s").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    blocks = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("g", "s", "i")
    other = blocks.select("g", F.col("s").alias("s2"), F.col("i").alias("i2"))
    pairs = blocks.withColumn("s2", F.explode(F.array(F.col("s"), F.col("s") + 1))).join(other, ["g", "s2"])
    pairs = cut(pairs.where((F.col("s") != F.col("s2")) | (F.col("i") <= F.col("i2"))).withColumn("pair", F.monotonically_increasing_id()))
    dealt = members.join(sizes, ["g", "s"]).withColumn("i", F.pmod(F.xxhash64("t"), F.col("n_blocks")).cast("int")).select("g", "s", "i", "c", "elements")
    sides = [pairs.select("pair", "g", "s", "i", F.lit(0).alias("side")), pairs.select("pair", "g", F.col("s2").alias("s"), F.col("i2").alias("i"), F.lit(1).alias("side"))]
    rows = dealt.join(sides[0].union(sides[1]), ["g", "s", "i"]).select("pair", "side", "c", "elements")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["side"] == 0], frame[frame["side"] == 1]
        found = []
        if len(x) and len(y):
            sx, sy = ([np.asarray(v, np.int64) for v in f["elements"]] for f in (x, y))
            shared = _shared(sx, sy)
            nx, ny = np.array([len(v) for v in sx]), np.array([len(v) for v in sy])
            alike = shared >= threshold * (nx[:, None] + ny[None, :] - shared) - 1e-6
            cx, cy = x["c"].to_numpy(), y["c"].to_numpy()
            at = {c: c for c in (*cx, *cy)}

            def top(c: int) -> int:
                while at[c] != c:
                    c = at[c]
                return c

            for p, q in zip(*np.nonzero(alike), strict=True):
                a, b = top(cx[p]), top(cy[q])
                if a != b:
                    at[max(a, b)] = min(a, b)
                    found.append((cx[p], cy[q]))
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("pair").applyInPandas(compare, "a bigint, b bigint")


def _joining(rest: DataFrame, own, k: int, threshold: float, most: int = LIST, block: int = BLOCK, keep: Keep = cut) -> DataFrame:
    """Links (a, b) between components among all texts of torn buckets (rows h, comp): none that counts is lost.

    Lists of more than ``most`` texts of their shorter kind connect texts to groups, which are compared blockwise.
    """
    comps = cut(rest.select("comp").distinct().withColumn("c", F.monotonically_increasing_id()))
    nodes = cut(rest.select("h", "comp").distinct().join(comps, "comp").select("h", "c").withColumn("t", F.monotonically_increasing_id()))
    sets = own(nodes.select("h")).mapInArrow(_elements(k), "h binary, elements array<bigint>")
    sets = cut(nodes.join(sets, "h").select("t", "c", F.size("elements").alias("n"), "elements"))
    entries = cut(_entries(sets, threshold))
    lists = entries.groupBy("e").agg(F.count_if("low").alias("lows"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    lists = keep(lists.where((F.col("lows") > 0) & (F.col("c0") != F.col("c1"))).select("e", "lows"))
    pairs = _met(lookup(entries, lists.where(F.col("lows") <= most).select("e"), ["e"], "inner"), threshold)
    x, y = (nodes.select(F.col("t").alias(t), F.col("h").alias(h)) for t, h in (("x", "a"), ("y", "b")))
    named = cut(pairs.join(x, "x").join(y, "y").select("a", "b"))
    sure = verified(named, own(named.select(F.explode(F.array("a", "b")).alias("h"))), k, threshold, keep=keep)
    ends = [nodes.select(F.col("h").alias(e), F.col("c").alias(f"c{e}")) for e in "ab"]
    links = sure.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    hot = lists.where(F.col("lows") > most).select("e")
    if hot.limit(1).count():
        hot = keep(lookup(entries, hot, ["e"], "inner").select("e", "t"))
        edges = hot.join(hot.groupBy("e").agg(F.min("t").alias("b")), "e").select(F.col("t").alias("a"), "b").distinct()
        group = components(edges, keep).select(F.col("h").alias("t"), F.col("comp").alias("g"))
        links = links.union(_blockwise(sets.join(group, "t"), threshold, block))
    names = [comps.select(F.col("c").alias(e), F.col("comp").alias(f"c{e}")) for e in "ab"]
    return cut(links.distinct().join(names[0], "a").join(names[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def text_classes(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per different text: h, its smallest doc_id and ``comp``, the digest that names its class."""
    signed = cut(signed_texts(docs, k, bands, rows))
    with shelf() as keep:  # for small frames alone: what held frames were made from stays on disk with them
        return _classed(docs, signed, keep, k, threshold, bands * rows)


def _classed(docs: DataFrame, signed: DataFrame, keep: Keep, k: int, threshold: float, m: int) -> DataFrame:
    full = signed.where(F.col("weight") > 0)
    texts = docs.select(F.col("doc_id").alias("_id"), digest_of(F.col("text")).alias("_h"), F.coalesce("text", F.lit("")).alias("text"))

    def own(hs: DataFrame) -> DataFrame:
        """The texts of digests ``h``, each from the document of its smallest doc_id."""
        ends = keep(hs.distinct().join(signed.select("h", "doc_id"), "h"))
        at = (F.col("_h") == F.col("h")) & F.col("_id").eqNullSafe(F.col("doc_id"))
        return lookup(texts, ends, at, "inner").select("h", "text").dropDuplicates(["h"])

    in_band = full.select("h", F.explode("bands").alias("band"))
    first = in_band.groupBy("band").agg(F.min("h").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    member = cut(in_band.join(first, "band"))  # only buckets of several texts
    pairs = keep(member.where(F.col("h") != F.col("b")).select(F.col("h").alias("a"), "b").distinct())
    used = cut(_with_ends(pairs, full.select("h", "weight", "sig"), keep=keep).where(_near(threshold, m)).select("a", "b"))
    links = cut(verified(used, own(used.select(F.explode(F.array("a", "b")).alias("h"))), k, threshold, keep=keep).select("a", "b"))
    comp = keep(components(links, keep))
    placed = member.join(comp, "h", "left").select("band", "h", F.coalesce("comp", "h").alias("comp"))
    torn = placed.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where(F.col("least") != F.col("most")).select("band")
    rest = cut(placed.join(torn, "band", "left_semi"))
    if rest.limit(1).count():
        more = _joining(rest, own, k, threshold, keep=keep)
        if more.limit(1).count():
            # Links between components: their own components rename those found so far.
            renamed = components(more, keep).select(F.col("h").alias("comp"), F.col("comp").alias("_to"))
            alone = more.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(comp, "h", "left_anti").select("h", F.col("h").alias("comp"))
            comp = comp.unionByName(alone).join(renamed, "comp", "left").select("h", F.coalesce("_to", "comp").alias("comp"))
    return cut(signed.select("h", "doc_id").join(comp, "h", "left").select("h", "doc_id", F.coalesce("comp", "h").alias("comp")))


def _leaders(classes: DataFrame) -> DataFrame:
    """(comp, class_id): the smallest doc_id of each class."""
    return classes.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_texts"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), different texts in the class."""
    of = text_classes(docs, **options)
    of = cut(of.join(_leaders(of), "comp").select("h", "class_id", "class_texts", F.col("doc_id").alias("text_id")))
    return docs.select("doc_id", digest_of(F.col("text")).alias("h")).join(of, "h").select("doc_id", "class_id", "text_id", "class_texts")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (a null one if there is no other).

    Rows are told apart by doc_id and text; of rows that repeat both, the first by all columns
    stays, found within the one doc_id. Texts move only for doc_ids that several rows carry.
    """
    names = docs.columns
    of = text_classes(docs, **options)
    best = of.groupBy("comp").agg(F.min_by("h", F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("h")).select("h")
    best = cut(best.join(of.select("h", F.col("doc_id").alias("_first")), "h").select(F.col("h").alias("_h"), "_first"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", digest_of(F.col("text")).alias("_at"))
    at = (F.col("_at") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    kept = lookup(rows, best, at, "inner").drop("doc_id")
    again = rows.groupBy("doc_id", "_at").count().where(F.col("count") > 1).select(F.col("_at").alias("_h")).distinct()
    again = cut(again)
    if not again.limit(1).count():
        return kept.select("_row.*")
    one = Window.partitionBy("_h").orderBy(F.xxhash64(F.to_json("_row")))
    several = lookup(kept, again, ["_h"], "left_semi").withColumn("_n", F.row_number().over(one)).where(F.col("_n") == 1)
    return lookup(kept, again, ["_h"], "left_anti").select("_row.*").union(several.select("_row.*"))
