"""Identity: components of identifier links, alias chains, resolution that never guesses, scores, replays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import deterministic_id, ladder
from quern.session import ship, stored, unsized


#: Links, both ways, up to which what is left of a graph is settled in one task.
FEW_LINKS = 100_000


def components(edges: DataFrame, few: int = FEW_LINKS, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node that a node is linked with.

    Contraction: each round every node is merged into the first node of its closed neighbourhood, until at most
    ``few`` links are left, which one task settles; then merges are followed back. "First" is by the nodes' own
    order and by a fresh random one in turn. The first of these ends stars at once; the second takes a quarter
    of the nodes or more in expectation, whatever the graph, so rounds are logarithmic, and labels are final.
    ``keep`` is where links wait between rounds (see ``shelf``); the result's labels are stored.
    """
    ship(edges.sparkSession)
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = unsized(keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    merges: list[DataFrame] = []
    while both.count() > few:
        if len(merges) % 2:
            at = lambda c, salt=len(merges): F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("n"))
            first = F.least(F.min(at("b")), at("a"))["n"]
        else:
            first = F.least(F.min("b"), F.col("a"))
        into = unsized(keep(both.groupBy("a").agg(first.alias("c")).select(F.col("a").alias("node"), "c")))
        merges.append(into)
        left, right = into.select(F.col("node").alias("a"), F.col("c").alias("ca")), into.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        open_ = both.join(left, "a").join(right, "b").where(F.col("ca") != F.col("cb"))
        both = unsized(keep(open_.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()))
    kind = both.schema["a"].dataType.simpleString()
    labels = both.coalesce(1).mapInPandas(_settled, f"node {kind}, c {kind}")
    while merges:
        further = unsized(stored(labels)).select(F.col("node").alias("c"), F.col("c").alias("end"))
        labels = merges.pop().join(further, "c", "left").select("node", F.coalesce("end", "c").alias("c"))
    labels = unsized(stored(labels))
    least = labels.groupBy("c").agg(F.min("node").alias("component"))
    return labels.join(least, "c").select("node", "component")


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node of all links with the root of its tree, by union-find."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "c": pd.Series([top(x) for x in nodes], dtype=object)})


def canonical(aliases: DataFrame) -> DataFrame:
    """Follow (node, target) links to their end: (node, canonical).

    Pointers double each round, so a chain of any length ends after its logarithm of rounds. Once a pointer
    has gone further than there are links, its chain has no end: such nodes are on a cycle, or lead to one,
    and get the smallest node they meet.
    """
    now = unsized(stored(aliases.select("node", F.col("target").alias("at"), F.least("node", "target").alias("least"))))
    links, done = now.count(), 0
    while True:
        nxt = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("further"))
        step = now.join(nxt, "at", "left").select(
            "node", "at", F.coalesce("next", "at").alias("new"), F.least("least", F.coalesce("further", "least")).alias("least"), F.col("next").isNotNull().alias("open")
        )
        step = unsized(stored(step))
        moving = step.where(F.col("open")).limit(1).count()
        now = step.select("node", F.col("new").alias("at"), "least")
        done += 1
        if not moving or 1 << done > links:
            break
    ends = now.select(F.col("node").alias("at")).distinct().withColumn("_in", F.lit(True))
    return now.join(ends, "at", "left").select("node", F.when(F.col("_in"), F.col("least")).otherwise(F.col("at")).alias("canonical"))


def resolve_unique(lanes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """The one profile that all of a row's identifiers agree on, or null: never a guess.

    ``lanes`` has keys, identifier_type, identifier_hash; ``links`` maps those to profile_id.
    """
    met = lanes.join(links, ["identifier_type", "identifier_hash"], "left")
    found = met.groupBy(*keys).agg(F.collect_set("profile_id").alias("_b"), F.array_sort(F.collect_set(F.when(F.col("profile_id").isNotNull(), F.col("identifier_type")))).alias("matched_via"))
    n = F.size("_b")
    return found.select(*keys, F.when(n == 1, F.col("_b")[0]).alias("profile_id"), n.alias("candidates"), "matched_via")


def guarded_links(links: DataFrame, most: int = 10) -> DataFrame:
    """Links of identifiers that at most ``most`` profiles share; shared ones (family phones) are suppressed."""
    shared = links.groupBy("identifier_type", "identifier_hash").agg(F.count_distinct("profile_id").alias("_n"))
    return links.join(shared.where(F.col("_n") <= most).drop("_n"), ["identifier_type", "identifier_hash"], "left_semi")


# Points of weak signals that agree, of their co-occurrence, the cap and the bands.
SIGNAL_POINTS = {"device_fingerprint": 45, "cookie_id": 35, "session_id": 30, "ip": 15}
TOGETHER, CAP = 15, 95
BANDS = ((80, "high"), (45, "medium"), (1, "low"))


def weak_score(agree: dict[str, Column]) -> Column:
    """Sum of the points of the signals that agree, more if several do, capped below certainty."""
    hits = [F.coalesce(c, F.lit(False)).cast("int") for c in agree.values()]
    points = sum((h * SIGNAL_POINTS[s] for h, s in zip(hits, agree, strict=True)), F.lit(0))
    return F.least(F.lit(CAP), points + F.when(sum(hits, F.lit(0)) >= 2, TOGETHER).otherwise(0))


def band(score: Column) -> Column:
    return ladder([(score >= 100, "exact"), *[(score >= least, b) for least, b in BANDS]], "none")


def match_probability(levels: dict[str, tuple[Column, float, float]], prior: float) -> Column:
    """Fellegi-Sunter: log2 odds of each agreement from its m and u, and the probability they make with the prior."""
    total = F.lit(math.log2(prior / (1 - prior)))
    for agrees, m, u in levels.values():
        total = total + F.when(agrees, F.lit(math.log2(m / u))).when(~agrees, F.lit(math.log2((1 - m) / (1 - u)))).otherwise(F.lit(0.0))
    odds = F.pow(F.lit(2.0), total)
    return odds / (1 + odds)


def reversion(events: DataFrame, merges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A versioned ledger after profiles were merged: current rows of absorbed profiles are flipped off and
    appended anew under the surviving profile with a higher version, numbered in order again.

    ``events`` has profile_id, data_version, is_current; ``merges`` maps node to canonical.
    """
    m = merges.where(F.col("node") != F.col("canonical")).select(F.col("node").alias("profile_id"), "canonical")
    hit = events.join(m, "profile_id", "left")
    moved = F.col("is_current") & F.col("canonical").isNotNull()
    old = hit.withColumn("is_current", F.col("is_current") & F.col("canonical").isNull())
    new = hit.where(moved).withColumn("profile_id", F.col("canonical")).withColumn("data_version", F.col("data_version") + 1)
    out = old.unionByName(new).drop("canonical")
    w = Window.partitionBy("profile_id", "is_current").orderBy(*order)
    return out.withColumn("sequence", F.when(F.col("is_current"), F.row_number().over(w)))


def normal_email(text: Column) -> Column:
    out = F.lower(F.trim(text))
    return F.when(out.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), out)


def normal_phone(text: Column, country: str = "91") -> Column:
    """E.164 digits: a ten-digit number gets the country's code, an international one keeps its own."""
    raw = F.regexp_replace(F.trim(text), r"[\s().-]", "")
    digits = F.regexp_replace(raw, r"^(\+|00)", "")
    good = digits.rlike(r"^[0-9]{8,15}$")
    out = F.when(raw.rlike(r"^(\+|00)"), F.concat(F.lit("+"), digits)).when(F.length(digits) == 10, F.concat(F.lit("+" + country), digits)).otherwise(F.concat(F.lit("+"), digits))
    return F.when(good, out)


def identifier_hash(salt: str, kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), deterministic_id(F.lit(salt), F.lit(kind), value))
