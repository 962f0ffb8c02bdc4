"""Identity resolution that decides: mint, link, merge, review or suppress; a log of reversible commands; replays in other orders.

``decide`` settles every event of a batch against the links that were there before it, by two groupings: links
by identifier, so that an identifier goes along with the first and last of the profiles that hold it, however many
they are, and identifiers by event. ``commands`` writes what was decided as rows of a log, each with the
state of one subject (a profile, a link, a merge, a review, a suppression), and ``compensate`` appends the inverse of chosen
rows; ``folded`` is the state that the log tells, the last word on each subject. Nothing is
deleted, so an unmerge undoes what its merge wrote and nothing else. ``absorb`` is the rule for whole batches: it closes over all links of
a batch, so its partition doesn't depend on the order of arrival, which ``replay`` checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import deterministic_id, ladder
from quern.operators.identity import components
from quern.session import stored, unsized

STRONG = ("strong", "strong_on_link")
MEDIUM = "medium"
GUARDED = ("phone",)
KEY = ["brand_id", "identifier_type", "identifier_hash"]
EVENT = ["brand_id", "event_id"]

# Commands, the kind of subject that each is about, and the command that takes it back.
SUBJECTS = {"mint": "profile", "link": "link", "merge": "merge", "route_to_review": "review", "suppress": "suppression"}
INVERSES = {"mint": "tombstone", "link": "unlink", "merge": "unmerge", "route_to_review": "withdraw_review", "suppress": "lift_suppression", "unmerge": "remerge"}


def is_strong(tier: Column) -> Column:
    return tier.isin(*STRONG)


def holders(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per identifier: first and last of its profiles, each with whether it was merged away, their number, and the same of those without a strong identifier.

    ``links`` has brand_id, identifier_type, identifier_hash, profile_id, tier, all active; ``aliases`` brand_id, profile_id.
    """
    owner = ["brand_id", "profile_id"]
    told = links.groupBy(*owner).agg(F.bool_or(is_strong(F.col("tier"))).alias("_owned")).join(aliases.select(*owner).distinct().withColumn("_gone", F.lit(True)), owner, "left")
    profile = F.struct("profile_id", F.coalesce("_gone", F.lit(False)).alias("gone"))
    free = F.when(~F.col("_owned"), profile)
    return links.join(told, owner).groupBy(*KEY).agg(
        F.min(profile).alias("first"), F.max(profile).alias("last"), F.count_distinct("profile_id").alias("n"), F.min(free).alias("first_free"), F.max(free).alias("last_free")
    )


def decide(identifiers: DataFrame, links: DataFrame, aliases: DataFrame, suppressed: DataFrame, threshold: int = 10, guard_devices: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, new links, new suppressions) of events (brand_id, event_id, identifier_type, identifier_hash, tier).

    A phone that is suppressed already, or that would be one profile's too many, is no key. Strong identifiers of no profile mint one,
    of one link to it, of several merge the last of them into the first, unless either was merged away before: that goes to review.
    Medium ones (devices) only continue a profile, where all agree, and never merge; with ``guard_devices`` they
    don't pull a new strong identifier into a profile that has one, and stay with their owner when another is minted.
    """
    met = identifiers.distinct().join(holders(links, aliases), KEY, "left").join(suppressed.select(*KEY).distinct().withColumn("_off", F.lit(True)), KEY, "left")
    many = F.coalesce("n", F.lit(0)) + 1 > threshold
    met = met.withColumn("suppress", F.col("identifier_type").isin(*GUARDED) & (F.coalesce("_off", F.lit(False)) | many)).drop("_off")
    strong, medium = is_strong(F.col("tier")) & ~F.col("suppress"), F.col("tier") == MEDIUM
    low, high = (lambda c, when: F.min(F.when(when, F.col(c)))), (lambda c, when: F.max(F.when(when, F.col(c))))
    per = met.groupBy(*EVENT).agg(
        low("first", strong).alias("lo"), high("last", strong).alias("hi"), F.bool_or(strong & F.col("n").isNull()).alias("fresh"),
        low("first", medium).alias("m_lo"), high("last", medium).alias("m_hi"), low("first_free", medium).alias("f_lo"), high("last_free", medium).alias("f_hi"),
        F.count_if("suppress").alias("suppressed"), F.min(F.concat_ws(":", "identifier_type", "identifier_hash")).alias("_key"),
    )
    guarded = F.col("fresh") & F.lit(guard_devices)
    lo, hi = F.col("lo.profile_id"), F.col("hi.profile_id")
    device = lambda a, b: F.when(guarded, F.col(a)["profile_id"]).otherwise(F.col(b)["profile_id"])
    merging = F.coalesce(lo != hi, F.lit(False))
    least, most = F.least(lo, device("f_lo", "m_lo")), F.greatest(hi, device("f_hi", "m_hi"))
    known = F.coalesce(F.when(~merging & (least == most), least), lo)
    collision = merging & (F.col("lo.gone") | F.col("hi.gone"))
    action = ladder([(collision, "skipped"), (merging, "merged"), (known.isNull(), "minted")], "linked")
    decisions = per.select(*EVENT, action.alias("action"), F.coalesce(known, deterministic_id(F.col("brand_id"), F.col("_key"))).alias("profile_id"), F.when(merging, hi).alias("other_id"), "suppressed")
    grown = met.join(decisions.where(F.col("action").isin("minted", "linked")), EVENT)
    stays = (F.col("action") == "minted") & (F.col("tier") == MEDIUM) & F.col("n").isNotNull() & F.lit(guard_devices)
    new = grown.where(~stays).select(*KEY, "profile_id", "tier", "event_id").join(links.select(*KEY, "profile_id"), [*KEY, "profile_id"], "left_anti")
    off = met.where("suppress").groupBy(*KEY).agg((F.max(F.coalesce("n", F.lit(0))) + 1).alias("profile_count"))
    return decisions, new, off


def _rows(df: DataFrame, command: str, a: Column, b: Column, at: Column) -> DataFrame:
    """Log rows of a command; its id follows from its subject, so a replay has the same."""
    kind = SUBJECTS[command]
    told = df.select("brand_id", F.lit(command).alias("command"), F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"), F.lit(True).alias("is_on"), at.alias("decided_at")).distinct()
    return told.withColumn("decision_id", deterministic_id(F.col("brand_id"), F.col("command"), F.col("a"), F.coalesce("b", F.lit(""))))


def commands(decisions: DataFrame, new_links: DataFrame, suppressions: DataFrame, decided_at: Column) -> DataFrame:
    """What was decided as log rows: brand_id, command, kind, a, b, is_on, decided_at, decision_id."""
    key, nothing = F.concat_ws(":", "identifier_type", "identifier_hash"), F.lit(None)
    did = lambda *actions: decisions.where(F.col("action").isin(*actions))
    parts = [
        _rows(did("minted"), "mint", F.col("profile_id"), nothing, decided_at),
        _rows(new_links, "link", F.col("profile_id"), key, decided_at),
        _rows(did("merged"), "merge", F.col("profile_id"), F.col("other_id"), decided_at),
        _rows(did("skipped"), "route_to_review", F.col("profile_id"), F.col("other_id"), decided_at),
        _rows(suppressions, "suppress", key, nothing, decided_at),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with those of the rows that it doesn't hold: a second delivery adds nothing."""
    return log.unionByName(rows.join(log.select("decision_id"), "decision_id", "left_anti").select(*log.columns))


def compensate(log: DataFrame, chosen: Column, at: Column) -> DataFrame:
    """The log with the inverse of those subjects' last words that are chosen: an unmerge for a merge, a remerge for an unmerge."""
    last = F.max_by(F.struct("command", "is_on", "decision_id"), F.struct("decided_at", "decision_id")).alias("_l")
    now = log.groupBy("brand_id", "kind", "a", "b").agg(last).select("brand_id", "kind", "a", "b", "_l.*").where(chosen)
    inverse = F.create_map(*[F.lit(x) for pair in (INVERSES | {"remerge": "unmerge"}).items() for x in pair])[F.col("command")]
    rows = now.where(inverse.isNotNull()).select(
        "brand_id", inverse.alias("command"), "kind", "a", "b", (~F.col("is_on")).alias("is_on"), at.alias("decided_at"), deterministic_id(F.lit("undo"), F.col("decision_id"), at).alias("decision_id")
    )
    return append(log, rows)


def folded(log: DataFrame) -> DataFrame:
    """The last word on each subject: brand_id, kind, a, b, is_on, and how many commands were about it."""
    return log.groupBy("brand_id", "kind", "a", "b").agg(F.max_by("is_on", F.struct("decided_at", "decision_id")).alias("is_on"), F.count("*").alias("commands"))


def identity_map(state: DataFrame) -> DataFrame:
    """(brand_id, identifier, profile_id): links that are on, to the first profile of those that merges join."""
    on = state.where("is_on")
    node = lambda c: F.concat_ws("\u0000", "brand_id", c)
    joined = components(on.where("kind = 'merge'").select(node("a").alias("a"), node("b").alias("b")))
    links = on.where("kind = 'link'").select("brand_id", F.col("b").alias("identifier"), F.col("a").alias("profile_id"), node("a").alias("node"))
    root = F.coalesce(F.element_at(F.split("component", "\u0000"), -1), F.col("profile_id"))
    return links.join(joined, "node", "left").select("brand_id", "identifier", root.alias("profile_id")).distinct()


# -- replay ------------------------------------------------------------------------------------------------------------

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def star(batch: DataFrame) -> DataFrame:
    """Edges that join the identifiers of an event: each with the event's first."""
    first = batch.groupBy("event_id").agg(F.min("key").alias("a"))
    return batch.join(first, "event_id").select("a", F.col("key").alias("b")).distinct()


def absorb(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(key, profile) after a batch (event_id, key) met those known: all that the batch joins is one profile.

    Keys begin with i, profiles with p. The first profile of a component stays and takes in the others; a component without
    one mints it from its first key.
    """
    held = known.join(batch.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.col("profile").alias("b"))
    labels = components(star(batch).unionByName(held))
    is_profile = F.col("node").startswith("p")
    stays = labels.groupBy("component").agg(F.min(F.when(is_profile, F.col("node"))).alias("_p"))
    named = labels.join(stays, "component").select("node", F.coalesce("_p", F.concat(F.lit("p"), "component")).alias("into"))
    moved = known.join(named.withColumnRenamed("node", "profile"), "profile", "left").select("key", F.coalesce("into", "profile").alias("profile"))
    new = named.where(~is_profile).select(F.col("node").alias("key"), F.col("into").alias("profile")).join(known, "key", "left_anti")
    return moved.unionByName(new)


def replay(events: DataFrame, seeds: list[int], batches: int = 3, rule: Rule = absorb) -> DataFrame:
    """Partitions of identifiers (event_id, key) after arrival in other orders: seed, key, label (the first key of its profile).

    Every seed deals the events into batches by its own hash; all seeds are replayed together, as their keys stay apart.
    """
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    dealt = events.distinct().select("event_id", "key", seed)
    tag = F.concat(F.lit("i"), F.col("seed").cast("string"), F.lit("\u0000"), F.col("key"))
    dealt = stored(dealt.select(F.struct("seed", "event_id").alias("event_id"), tag.alias("key"), F.pmod(F.xxhash64("seed", "event_id"), F.lit(batches)).alias("batch")))
    known = events.sparkSession.createDataFrame([], "key string, profile string")
    for n in range(batches):
        known = unsized(stored(rule(dealt.where(F.col("batch") == n).select("event_id", "key"), known)))
    part = F.split(F.substr("key", F.lit(2)), "\u0000")
    first = known.groupBy("profile").agg(F.min("key").alias("_first"))
    bare = F.element_at(F.split("_first", "\u0000"), -1)
    return known.join(first, "profile").select(part[0].cast("int").alias("seed"), part[1].alias("key"), bare.alias("label"))


def order_report(events: DataFrame, replayed: DataFrame) -> DataFrame:
    """Per component of all events: its identifiers, how many different partitions the replays gave it, and labels that differ from it."""
    truth = components(star(events.distinct())).withColumnRenamed("node", "key")
    met = replayed.join(truth, "key")
    one = met.groupBy("component", "seed").agg(F.sum(F.xxhash64("key", "label").cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"), F.count_if(F.col("label") != F.col("component")).alias("off"))
    return one.groupBy("component").agg(F.max("n").alias("identifiers"), F.count_distinct("digest").alias("partitions"), F.sum("off").alias("differences"))
