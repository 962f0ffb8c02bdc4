"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Word counts give each source's size; weights and a cap at twice the size give its target: sources
   over their cap stop there and the rest is shared again, until none is over.
2. Within a source, rows stand in a random order (a hash of the row, and of its number among rows that
   are equal) and are cut into blocks by that order. A target becomes whole passes over the
   source plus a remainder, which is filled by a run of whole blocks, by the next block's first rows, and
   by those later rows of that block that still fit, one after another. What is left is less
   than the smallest row that was passed over.
3. The blocks taken are the source's quota. A binary tree over the output shards splits the
   quotas of all sources exactly: at each node, one multivariate-hypergeometric draw says how
   many of each source's blocks go left. Leaves then get disjoint runs of each source's
   permuted blocks.
4. ``materialise`` writes out rows by shard: a row's copies go to the shards of its block's copies, in
   pieces of bounded size, and are shuffled locally by a hash. Texts move once.

Tables by source (sizes, weights, quotas) are metadata: one row a source. There are at most
``MOST_BLOCKS`` blocks besides one a source, so blocks grow with the input and their tables don't.

Defined results: a null text has no words; texts are measured whole; a null source is a source of its own and
comes last; rows that repeat have places of their own, so some may be taken more often than others;
rows of different content that tie in all 53 bits of their place are taken together; an empty table gives
an empty table; extra columns are carried by ``materialise`` and ``mixed``, whatever their names
(``materialise`` puts underscores behind the name of a column it adds where the input has that name),
and ignored by ``digest``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, fresh, global_rank, lookup, unit

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 200_000
MOST_BLOCKS = 20_000
PIECE_WORDS = 4_000_000
LEVELS = 4
CHUNK = 256


def _uniform(seed: int, *cols: Column) -> Column:
    return unit(F.xxhash64(F.lit(seed), *cols))


# -- rows, their numbers among equals, and their places ----------------------------------------------------------------


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.xxhash64("text").alias("_h"), size.alias("size"), *more)


def _same(a: str, b: str) -> Column:
    names = ("_id", "_of", "_h")
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _repeats(rows: DataFrame) -> DataFrame:
    """The keys that several rows share."""
    return cut(rows.groupBy("_id", "_of", "_h").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``nth``: the number of a row among equal ones.

    A group of equal rows is counted by input partition first, so no task gets all of it.
    """
    rows = cut(rows.withColumn("_p", F.spark_partition_id()))
    here = Window.partitionBy("_id", "_of", "_h", "_p").orderBy("_p")
    parts = rows.groupBy("_id", "_of", "_h", "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_id", "_of", "_h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row an input partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    r, p = rows.withColumn("_k", F.row_number().over(here) - 1).alias("r"), parts.alias("p")
    both = r.join(p, _same("r", "p") & (F.col("r._p") == F.col("p._p")))
    return both.select(*[F.col(f"r.`{c}`") for c in rows.columns if c != "_p"], (F.col("_before") + F.col("_k")).cast("bigint").alias("nth"))


def _placed(rows: DataFrame, again: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their places ``u`` in [0, 1); only rows that repeat are numbered."""
    first = F.lit(0).cast("bigint").alias("nth")
    if again.isEmpty():
        out = rows.select("*", first)
    else:
        r, a = rows.alias("r"), again.alias("a")
        out = lookup(r, a, _same("r", "a"), "left_anti").select("*", first).unionByName(_numbered(lookup(r, a, _same("r", "a"), "left_semi")))
    return out.withColumn("u", _uniform(seed, F.col("_id"), F.col("_of"), F.col("_h"), F.col("nth"))).drop("nth")


# -- targets -----------------------------------------------------------------------------------------------------------


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: sid (rank by code point, null last), source, source_size, weight, target, from rows (source, size).

    Targets are shares of ``share`` times all words by weight; none exceeds ``most`` times its source, and
    the excess is shared again by weight until none is above. Each round is one sum over the sources.
    """
    of = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    of = global_rank(of, [F.asc_nulls_last("source")], "sid").withColumn("sid", F.col("sid").cast("int"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    of = cut(of.withColumn("weight", F.get(weights, F.col("sid") % len(WEIGHTS))).withColumn("cap", most * F.col("source_size")))
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        row = of.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(over, F.col("cap"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (share * (row["words"] or 0) - (row["full"] or 0.0)) / row["weight"]
    target = F.least(F.col("cap"), F.col("weight") * level)
    return of.select("sid", "source", "source_size", "weight", target.alias("target"))


# -- quotas ------------------------------------------------------------------------------------------------------------


def hypergeometric(population: Column, successes: Column, draws: Column, u: Column) -> Column:
    """The number of successes among ``draws`` of ``population`` without replacement, by inversion at ``u``.

    Probabilities follow one from another by their ratio. They are summed within 12 standard deviations of
    the mean; what lies beyond is under 1e-30.
    """

    def inverted(g: Column) -> Column:
        n, k, d, low = g["n"], g["k"], g["d"], g["low"]
        counts = F.sequence(low.cast("bigint"), g["high"].cast("bigint"))
        state = lambda p, total, got: F.struct(p.alias("p"), total.alias("sum"), got.alias("got"))
        following = lambda p, x: p * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
        zero = state(F.lit(1.0), F.lit(0.0), low.cast("bigint"))
        total = F.aggregate(counts, zero, lambda a, x: state(following(a["p"], x), a["sum"] + a["p"], a["got"]), lambda a: a["sum"])

        def walk(bound: Column) -> Column:
            step = lambda a, x: state(following(a["p"], x), a["sum"] + a["p"], a["got"] + (a["sum"] + a["p"] < bound).cast("bigint"))
            return F.aggregate(counts, zero, step, lambda a: F.least(a["got"], g["high"].cast("bigint")))

        return _let(g["u"] * total, walk)

    def bounded(g: Column) -> Column:
        reach = 12 * F.sqrt(F.greatest(g["mean"] * (1 - g["k"] / F.greatest(g["n"], F.lit(1.0))), F.lit(0.0))) + 10
        low = F.greatest(F.lit(0.0), g["d"] - (g["n"] - g["k"]), F.floor(g["mean"] - reach).cast("double"))
        high = F.least(g["k"], g["d"], F.ceil(g["mean"] + reach).cast("double"))
        return _let(F.struct(*[g[c].alias(c) for c in ("n", "k", "d", "u")], low.alias("low"), high.alias("high")), inverted)

    n, k, d = (c.cast("double") for c in (population, successes, draws))
    mean = d * k / F.greatest(n, F.lit(1.0))
    return _let(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), u.alias("u"), mean.alias("mean")), bounded)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _drawn(parts: Column, total: Column, draws: Column, *seeds: Column) -> Column:
    """Draws from the parts (id, quota) one after another, each from what is left: structs (id, quota, left)."""
    kept = "array<struct<id:int,quota:bigint,left:bigint>>"
    zero = F.struct(total.alias("rest"), draws.alias("draws"), F.array().cast(kept).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        got = hypergeometric(acc["rest"], x["quota"], acc["draws"], unit(F.xxhash64(*seeds, x["id"])))
        out = F.array_append(acc["out"], F.struct(x["id"].alias("id"), x["quota"].alias("quota"), got.alias("left")))
        return F.struct((acc["rest"] - x["quota"]).alias("rest"), (acc["draws"] - got).alias("draws"), out.alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def _added(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x["quota"])


def split_quotas(quotas: DataFrame, levels: int, seed: int = 11) -> DataFrame:
    """Split the sources' block quotas (sid, quota) among 2**levels shards: rows (sid, shard, quota).

    Every node deals half of its blocks to either child; of which sources they are is a
    multivariate-hypergeometric draw. Sources are in chunks of ``CHUNK``: a node's draw is made
    between the chunks' sums first, then within each chunk, so no row holds all sources.
    """
    entry = F.struct(F.col("sid").alias("id"), F.col("quota").cast("bigint").alias("quota"))
    chunk = F.floor(F.col("sid") / CHUNK).cast("int").alias("chunk")
    nodes = quotas.groupBy(chunk).agg(F.array_sort(F.collect_list(entry)).alias("q")).select(F.lit(0).alias("shard"), "chunk", "q")
    chunks = F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("id"), F.col("own").alias("quota"))).over(Window.partitionBy("shard")))
    for level in range(levels):
        nodes = nodes.withColumn("own", _added(F.col("q"))).withColumn("chunks", chunks).withColumn("total", _added(F.col("chunks")))
        half = F.floor((F.col("total") + 1) / 2).cast("bigint")
        nodes = nodes.withColumn("between", _drawn(F.col("chunks"), F.col("total"), half, F.lit(seed), F.lit(level), F.col("shard")))
        mine = F.filter("between", lambda x: x["id"] == F.col("chunk"))[0]["left"]
        nodes = nodes.select("shard", "chunk", "q", "own", mine.alias("mine"))
        nodes = nodes.withColumn("out", _drawn(F.col("q"), F.col("own"), F.col("mine"), F.lit(seed), F.lit(level), F.col("shard"), F.lit("within")))
        child = lambda count: F.transform("out", lambda x: F.struct(x["id"].alias("id"), count(x).alias("quota")))
        left, right = child(lambda x: x["left"]), child(lambda x: x["quota"] - x["left"])
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), left.alias("q")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("q")))
        nodes = nodes.select("chunk", F.inline(halves)).select("shard", "chunk", "q")
    return nodes.select("shard", F.inline("q")).select(F.col("id").alias("sid"), "shard", "quota")


# -- the plan ----------------------------------------------------------------------------------------------------------


@dataclass
class Mix:
    """What is taken: ``figures`` has a row a source, ``dealt`` a row a block with the shards of its copies."""

    figures: DataFrame
    dealt: DataFrame
    again: DataFrame
    sizes: DataFrame
    sources: int
    seed: int

    def taken(self, rows: DataFrame) -> DataFrame:
        """Rows of ``_keyed`` with source_size, target and ``shards``: one shard for each time that the row is taken."""
        names = ["sid", F.col("source").alias("_source"), "source_size", "target", "passes", "n_blocks", "edge", "upto", "picks"]
        rows = lookup(_placed(rows, self.again, self.seed), self.figures.select(*names), F.col("_of").eqNullSafe(F.col("_source")), "inner", most=self.sources)
        at = F.col("edge") == F.col("block")
        inside = (F.col("block") < F.col("edge")) | (at & ((F.col("u") <= F.col("upto")) | F.array_contains("picks", F.col("u"))))
        rows = rows.withColumn("block", _block()).withColumn("copies", F.col("passes") + inside.cast("int"))
        rows = lookup(rows, self.dealt, ["sid", "block"], most=MOST_BLOCKS + self.sources)
        shards = F.slice(F.coalesce("dealt", F.array().cast("array<int>")), F.lit(1), F.col("copies"))
        return rows.withColumn("shards", shards).drop("sid", "_source", "passes", "n_blocks", "edge", "upto", "picks", "block", "dealt", "u")


def _block() -> Column:
    return F.least(F.floor(F.col("u") * F.col("n_blocks")), F.col("n_blocks") - 1).cast("bigint")


def _edges(rows: DataFrame, blocks: DataFrame, of: DataFrame, sources: int) -> DataFrame:
    """Per source the block in which its room ends, and there the place up to which rows are taken, and those picked later.

    Running sums are over a source's blocks (there are at most ``MOST_BLOCKS``) and over the rows of one block.
    """
    in_order = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    upto = lookup(blocks, of.select("sid", "room"), ["sid"], "inner", most=sources).withColumn("sum", F.sum("words").over(in_order))
    ends = upto.where((F.col("sum") > F.col("room")) & (F.col("sum") - F.col("words") <= F.col("room")))
    ends = cut(ends.groupBy("sid", "room").agg(F.min_by(F.struct("block", (F.col("sum") - F.col("words")).alias("before")), "block").alias("e")).select("sid", "room", "e.*"))
    by_place = Window.partitionBy("sid").orderBy("u")
    last = lookup(rows.select("sid", "block", "u", "size"), ends, ["sid", "block"], "inner", most=sources).withColumn("sum", F.col("before") + F.sum("size").over(by_place))
    fits = F.col("sum") <= F.col("room")
    later = F.array_sort(F.collect_list(F.when(~fits, F.struct("u", "size"))))
    last = last.groupBy("sid", "block", "room", "before").agg(
        F.coalesce(F.max(F.when(fits, F.col("u"))), F.lit(-1.0)).alias("upto"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.col("before")).alias("sum"), later.alias("later")
    )
    zero = F.struct(F.floor(F.col("room") - F.col("sum")).cast("bigint").alias("left"), F.array().cast("array<double>").alias("picks"))

    def pick(acc: Column, x: Column) -> Column:
        ok = (x["size"] <= acc["left"]) & (x["size"] > 0)
        picked = F.struct((acc["left"] - x["size"]).alias("left"), F.array_append(acc["picks"], x["u"]).alias("picks"))
        return F.when(ok, picked).otherwise(acc)

    return last.select("sid", F.col("block").alias("edge"), "upto", F.aggregate("later", zero, pick, lambda acc: acc["picks"]).alias("picks"))


def plan(docs: DataFrame, *, block_words: int = BLOCK_WORDS, levels: int = LEVELS, seed: int = 11, share: float = 1.5, most: float = 2.0) -> Mix:
    """Which rows the mix takes, how often, and to which of ``2**levels`` shards each copy goes."""
    sizes = cut(_keyed(docs))
    again = _repeats(sizes)
    of = targets(sizes.select(F.col("_of").alias("source"), "size"), share, most)
    words, sources = of.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    step = float(max(block_words, words / MOST_BLOCKS))
    blocks = F.greatest(F.lit(1.0), F.ceil(F.col("source_size") / step).cast("double"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("int")
    of = of.withColumn("n_blocks", blocks).withColumn("passes", passes)
    of = of.withColumn("room", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    placed = _placed(sizes, again, seed)
    rows = lookup(placed, of.select("sid", F.col("source").alias("_source"), "n_blocks"), F.col("_of").eqNullSafe(F.col("_source")), "inner", most=sources)
    rows = rows.select("sid", _block().alias("block"), "u", "size")
    summed = cut(rows.groupBy("sid", "block").agg(F.sum("size").alias("words")))
    edges = _edges(rows, summed, of, sources)
    figures = cut(lookup(of, edges, ["sid"], most=sources).withColumn("edge", F.coalesce("edge", F.lit(-1))))
    copies = F.col("passes") + (F.col("block") <= F.col("edge")).cast("int")
    slots = lookup(summed.select("sid", "block"), figures.select("sid", "passes", "edge"), ["sid"], "inner", most=sources)
    slots = slots.select("sid", "block", copies.alias("n")).where("n > 0").select("sid", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "copy", "block"), "copy", "block")
    slots = cut(slots.withColumn("slot", F.row_number().over(order) - 1))
    leaves = split_quotas(slots.groupBy("sid").agg(F.count("*").alias("quota")), levels, seed)
    in_order = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    upto = leaves.withColumn("upto", F.sum("quota").over(in_order)).groupBy("sid").agg(F.array_sort(F.collect_list("upto")).alias("upto"))
    dealt = lookup(slots, upto, ["sid"], "inner", most=sources).withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("slot"))))
    dealt = dealt.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("d"))
    dealt = cut(dealt.select("sid", "block", F.transform("d", lambda x: x["shard"]).alias("dealt")))
    return Mix(figures, dealt, again, sizes, sources, seed)


def digest(docs: DataFrame, **options) -> DataFrame:
    mix = plan(docs, **options)
    return mix.taken(mix.sizes).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"),
    )


def materialise(docs: DataFrame, *, levels: int = LEVELS, seed: int = 11, **options) -> DataFrame:
    """The rows that the mix takes, once for each time, with ``shard`` and ``piece``, dealt by both and in random order within.

    A shard has as many pieces as keep each at about ``PIECE_WORDS`` words.
    """
    mix = plan(docs, levels=levels, seed=seed, **options)
    words = mix.figures.agg(F.sum("target")).first()[0] or 0.0
    pieces = int(words / (1 << levels) / PIECE_WORDS) + 1
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = mix.taken(_keyed(docs, whole)).where(F.size("shards") > 0)
    rows = rows.select("_row", "_id", "_h", F.posexplode("shards").alias("_copy", "_shard"))
    rows = rows.withColumn("_at", F.xxhash64(F.lit(seed + 2), "_id", "_h", "_copy")).withColumn("_piece", F.pmod("_at", F.lit(pieces)).cast("int"))
    rows = rows.repartition("_shard", "_piece").sortWithinPartitions("_shard", "_piece", F.xxhash64(F.lit(seed + 3), "_at"))
    names = [fresh("shard", docs.columns), fresh("piece", docs.columns)]
    return rows.select("_row.*", F.col("_shard").alias(names[0]), F.col("_piece").alias(names[1]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """What ``materialise`` gives, with the columns of ``docs`` alone."""
    out = materialise(docs, **options)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
